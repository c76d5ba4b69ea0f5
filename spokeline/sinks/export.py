"""Export targets: a name, the tables it needs, how it is built, how it is written; and bundles of targets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "geojson")


def bool_letters(df: DataFrame) -> DataFrame:
    """Booleans as t and f, as CSV readers of other systems expect them."""
    return df.withColumns({f.name: F.when(F.col(f"`{f.name}`"), "t").when(~F.col(f"`{f.name}`"), "f") for f in df.schema if isinstance(f.dataType, T.BooleanType)})


def geojson_features(df: DataFrame, geometry: Column, id_column: str | None = None) -> DataFrame:
    """One GeoJSON feature per row in a column ``value``: newline-delimited, so that it is written in parallel.

    ``geometry`` is a struct of type and coordinates; every other column becomes a property.
    """
    properties = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    parts = [F.lit("Feature").alias("type"), *([F.col(id_column).alias("id")] if id_column else []), geometry.alias("geometry"), properties.alias("properties")]
    return df.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value"))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a table; CSV gets a header, letters for booleans and neither arrays nor maps (as JSON text)."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}; there are {', '.join(FORMATS)}")
    if kind == "csv":
        nested = {f.name: F.to_json(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
        df = bool_letters(df.withColumns(nested) if nested else df)
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if kind == "geojson":
        df.write.mode("overwrite").text(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        getattr(writer, kind)(path)


@dataclass(frozen=True)
class Target:
    name: str
    needs: tuple[str, ...]
    build: Callable[[Mapping[str, DataFrame]], DataFrame]
    formats: tuple[str, ...] = ("parquet", "csv")
    partition_by: tuple[str, ...] = ()
    optional: bool = False


TARGETS: dict[str, Target] = {}
BUNDLES: dict[str, dict[str, str]] = {}


def register_target(target: Target) -> Target:
    if target.name in TARGETS:
        raise ValueError(f"target {target.name} is registered already")
    if bad := set(target.formats) - set(FORMATS):
        raise ValueError(f"target {target.name} has unknown formats {sorted(bad)}")
    TARGETS[target.name] = target
    return target


def register_bundle(name: str, files: Mapping[str, str]) -> None:
    """files: target name -> file name with {kind}."""
    if missing := [t for t in files if t not in TARGETS]:
        raise ValueError(f"bundle {name} has unknown targets {missing}")
    BUNDLES[name] = dict(files)


def list_targets() -> list[str]:
    return sorted(TARGETS)


def build_target(name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    target = TARGETS[name]
    if missing := [t for t in target.needs if t not in tables]:
        raise KeyError(f"target {name} needs {missing}")
    return target.build(tables)


def export_target(name: str, tables: Mapping[str, DataFrame], path: str, kind: str = "parquet") -> str:
    if kind not in TARGETS[name].formats:
        raise ValueError(f"{name} can't be written as {kind}; it can as {TARGETS[name].formats}")
    write_table(build_target(name, tables), path, kind, TARGETS[name].partition_by)
    return path


def export_bundle(name: str, tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, str]:
    """Write all targets of a bundle; optional ones whose tables are missing are left out."""
    written = {}
    for target, pattern in BUNDLES[name].items():
        if TARGETS[target].optional and any(t not in tables for t in TARGETS[target].needs):
            continue
        file_kind = kind if kind in TARGETS[target].formats else TARGETS[target].formats[0]
        written[target] = export_target(target, tables, f"{folder.rstrip('/')}/{pattern.format(kind=file_kind)}", file_kind)
    return written


def _blocks(tables: Mapping[str, DataFrame]) -> DataFrame:
    return tables["blocks"].join(tables["scores"].withColumnRenamed("block", "geoid20"), "geoid20", "left")


def intersections(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are ends of segments, with their number of legs."""
    from spokeline.operators.network import leg_counts

    return nodes.join(leg_counts(segments), "node_id")


register_target(Target("connectivity", ("connectivity",), lambda t: t["connectivity"], ("csv", "parquet")))
register_target(Target("census_blocks", ("blocks", "scores"), _blocks, ("parquet", "csv", "json")))
register_target(Target("destinations", ("destinations",), lambda t: t["destinations"], ("parquet", "csv", "json"), partition_by=("dest_type",)))
register_target(Target("intersections", ("segments", "nodes"), lambda t: intersections(t["segments"], t["nodes"])))
register_target(Target("intersections_geojson", ("segments", "nodes"), lambda t: geojson_features(intersections(t["segments"], t["nodes"]), point_geometry(F.col("lon"), F.col("lat")), "node_id"), ("geojson",)))
register_target(Target("ways", ("stress",), lambda t: t["stress"]))
register_target(Target("score_inputs", ("score_inputs",), lambda t: t["score_inputs"], ("csv", "json", "parquet")))
register_target(Target("mileage", ("mileage",), lambda t: t["mileage"], ("csv", "parquet"), optional=True))
register_bundle("all", {t: t + ".{kind}" for t in ("connectivity", "census_blocks", "destinations", "intersections", "ways", "score_inputs", "mileage")})
