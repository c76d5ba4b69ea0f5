"""Readers of outside files: GeoJSON, CSV with typed keys, FIPS speeds, files found by role."""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeline.sources.tables import pad_code


def read_geojson(spark: SparkSession, path: str, properties: str, whole_file: bool = False) -> DataFrame:
    """Features with lower-case property columns (a DDL schema) and ``geometry`` as WKT polygons or points.

    Newline-delimited features are read in parallel; a FeatureCollection in one document needs ``whole_file``.
    """
    schema = f"type string, geometry struct<type: string, coordinates: string>, properties struct<{properties}>"
    if whole_file:
        rows = spark.read.schema(f"features array<struct<{schema.replace(' string', ': string', 1).replace('geometry struct', 'geometry: struct').replace('properties struct', 'properties: struct')}>>").json(path, multiLine=True)
        rows = rows.select(F.explode("features").alias("f")).select("f.*")
    else:
        rows = spark.read.schema(schema).json(path)
    names = rows.schema["properties"].dataType.fieldNames()
    flat = F.regexp_replace("geometry.coordinates", r"\s", "")
    pairs = F.regexp_replace(flat, r"\[(-?[0-9.eE+-]+),(-?[0-9.eE+-]+)(?:,[^\]]*)?\]", "$1 $2")
    rounds = F.translate(pairs, "[]", "()")
    kind = F.upper("geometry.type")
    wkt = F.when(kind == "POINT", F.concat(F.lit("POINT ("), rounds, F.lit(")"))).otherwise(F.concat(kind, F.lit(" "), rounds))
    return rows.select(*[F.col(f"properties.`{n}`").alias(n.lower()) for n in names], F.when(F.col("geometry.coordinates").isNotNull(), wkt).alias("geometry"))


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed CSV with a header (no inference: codes keep their zeros), cut to ``columns`` in the scan."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def default_speeds(towns: DataFrame, city: DataFrame, state: DataFrame) -> DataFrame:
    """(fips, city_speed, state_speed, speed) of towns (fips): the town's own, else its state's; codes are padded.

    city: fips_code_city, speed; state: fips_code_state, speed.
    """
    table = lambda df, code, width, name: df.where(F.col(code).isNotNull()).groupBy(pad_code(F.col(code), width).alias(f"k_{name}")).agg(F.min("speed").alias(name))
    code = pad_code(F.col("fips"), 7)
    found = towns.withColumn("fips", code).join(table(city, "fips_code_city", 7, "city_speed"), F.col("fips") == F.col("k_city_speed"), "left")
    found = found.join(table(state, "fips_code_state", 2, "state_speed"), F.substring("fips", 1, 2) == F.col("k_state_speed"), "left")
    return found.select("fips", "city_speed", "state_speed", F.coalesce("city_speed", "state_speed").alias("speed"))


def union_regions(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows of all regions, one for each key; columns that a region lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(list(keys))


#: File patterns of every input role; the first file by name counts.
ROLES: dict[str, tuple[str, ...]] = {
    "ways": ("ways-*.parquet",), "nodes": ("nodes-*.parquet", "nodes.parquet"), "pois": ("poi*.parquet",), "census": ("census-*.parquet", "census_blocks.parquet"),
    "boundary": ("boundary-*.geojson",), "analysis_boundary": ("analysis_boundary-*.geojson", "boundary-*.geojson"), "jobs": ("jobs*.csv", "lodes*.csv"), "segments": ("segments*.parquet",),
}


def find_inputs(folder: str, roles: Mapping[str, Sequence[str]] = ROLES) -> dict[str, str]:
    """role -> file; roles without a file are left out."""
    found = {}
    for role, patterns in roles.items():
        for pattern in patterns:
            if hits := sorted(Path(folder).glob(pattern)):
                found[role] = str(hits[0])
                break
    return found


def store_file(source: str, folder: str, role: str) -> str:
    """Copy a file to a name made of its role and content, ``{role}-{first 12 hex digits of SHA-256}{suffix}``."""
    digest = hashlib.sha256()
    with open(source, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    target = Path(folder) / f"{role}-{digest.hexdigest()[:12]}{Path(source).suffix}"
    target.parent.mkdir(parents=True, exist_ok=True)
    if not target.exists():
        shutil.copyfile(source, target)
    return str(target)
