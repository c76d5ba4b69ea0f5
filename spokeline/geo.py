"""Geometry texts (WKT, EWKT, hex WKB and EWKB) read without native libraries."""

from __future__ import annotations

import math
import re
import struct

EARTH_RADIUS_M = 6_371_008.8

_HEX = re.compile(r"^(?:[0-9A-Fa-f]{2})+$")
_WKT = re.compile(r"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*([A-Z]+)\s*(?:ZM|Z|M)?\s*(EMPTY|\(.*\))\s*$", re.I | re.S)
_POINT = re.compile(r"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$", re.I)
_TOKEN = re.compile(r"[(),]|[^\s(),]+")
_KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


class Unreadable(ValueError):
    pass


def _nested(tokens: list[str], at: int) -> tuple[list, int]:
    """The nested lists of a bracketed text; a coordinate is a tuple of numbers."""
    items, numbers = [], []
    at += 1
    while at < len(tokens):
        t = tokens[at]
        if t == "(":
            inner, at = _nested(tokens, at)
            items.append(inner)
            continue
        if t in ",)":
            if numbers:
                items.append(tuple(numbers))
                numbers = []
            if t == ")":
                return items, at + 1
        else:
            numbers.append(float(t))
        at += 1
    raise Unreadable("brackets")


def _rings(rings: list) -> list:
    for ring in rings:
        if len(ring) < 4 or ring[0][:2] != ring[-1][:2]:
            raise Unreadable("ring")
    return rings


def _from_wkt(text: str) -> tuple[str, list]:
    m = _WKT.match(text)
    if not m:
        raise Unreadable("text")
    kind = m[1].upper()
    if m[2].upper() == "EMPTY":
        return kind, []
    tokens = _TOKEN.findall(m[2])
    body, end = _nested(tokens, 0)
    if end != len(tokens):
        raise Unreadable("rest")
    if kind == "MULTIPOINT":
        body = [p[0] if isinstance(p, list) else p for p in body]
    return kind, body


def _from_wkb(data: bytes) -> tuple[str, list]:
    def geometry(at: int) -> tuple[str, list, int]:
        order = "<" if data[at] == 1 else ">" if data[at] == 0 else None
        if order is None:
            raise Unreadable("byte order")
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        iso = (code & 0x0FFFFFFF) // 1000
        width = 2 + (bool(code & 0x80000000) or iso in (1, 3)) + (bool(code & 0x40000000) or iso in (2, 3))
        kind = _KINDS.get((code & 0x0FFFFFFF) % 1000)
        if kind is None:
            raise Unreadable("kind")

        def count() -> int:
            nonlocal at
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            if n > len(data):
                raise Unreadable("count")
            return n

        def point() -> tuple:
            nonlocal at
            p = struct.unpack_from(f"{order}{width}d", data, at)
            at += 8 * width
            return p

        if kind == "POINT":
            p = point()
            return kind, [] if all(map(math.isnan, p)) else [p], at
        if kind == "LINESTRING":
            return kind, [point() for _ in range(count())], at
        if kind == "POLYGON":
            return kind, [[point() for _ in range(count())] for _ in range(count())], at
        parts = []
        for _ in range(count()):
            k, part, at = geometry(at)
            parts.append(part[0] if k == "POINT" and part else part)
        return kind, parts, at

    try:
        kind, body, end = geometry(0)
    except (struct.error, IndexError) as e:
        raise Unreadable("bytes") from e
    if end != len(data):
        raise Unreadable("rest")
    return kind, body


def read_geometry(text: str | None) -> tuple[str, list] | None:
    """(kind, nested coordinates), or None for a null, empty or broken geometry."""
    if not text:
        return None
    try:
        kind, body = _from_wkb(bytes.fromhex(text)) if _HEX.match(text) else _from_wkt(text)
        if kind == "POLYGON":
            _rings(body)
        elif kind == "MULTIPOLYGON":
            for part in body:
                _rings(part)
    except (ValueError, TypeError, IndexError, RecursionError):
        return None
    return (kind, body) if body else None


def _points(body: list):
    for x in body:
        if isinstance(x, tuple):
            yield x
        else:
            yield from _points(x)


def usable(lon: float, lat: float) -> bool:
    """A location: finite, in range and not 0,0 (which marks a missing one)."""
    return abs(lat) <= 90 and abs(lon) <= 180 and not (lat == 0 and lon == 0)


def place_of(text: str | None) -> tuple[float, float] | None:
    """(lon, lat) of a geometry: the point, or the centre of the bounding box."""
    if text and (m := _POINT.match(text)):
        try:
            lon, lat = float(m[1]), float(m[2])
        except ValueError:
            return None
        return (lon, lat) if usable(lon, lat) else None
    shape = read_geometry(text)
    if shape is None:
        return None
    pts = list(_points(shape[1]))
    if not pts or any(len(p) < 2 or not (math.isfinite(p[0]) and math.isfinite(p[1])) for p in pts):
        return None
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    lon, lat = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2
    return (lon, lat) if usable(lon, lat) else None


def edges_of(text: str | None) -> list[float] | None:
    """x1, y1, x2, y2 of every edge of a polygon's or multipolygon's rings, one after another."""
    shape = read_geometry(text)
    if shape is None or shape[0] not in ("POLYGON", "MULTIPOLYGON"):
        return None
    out: list[float] = []
    for rings in [shape[1]] if shape[0] == "POLYGON" else shape[1]:
        for ring in rings:
            for p, q in zip(ring, ring[1:]):
                out += (p[0], p[1], q[0], q[1])
    return out if out and all(map(math.isfinite, out)) else None
