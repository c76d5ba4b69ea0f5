"""Session helpers: the shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}
_FOLDERS: set[tuple[SparkSession, str]] = set()


def build_session(app: str = "spokeline", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned with; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return SparkSession.builder.appName(app).master(master).config(map=settings).getOrCreate()


def scratch_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own; on a cluster the
    setting is required, since a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = "file://" + tempfile.mkdtemp(prefix="spokeline-")
    return _LOCAL_BASE[app]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, folder in list(_FOLDERS):
        try:
            _remove(spark, folder)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


class Scratch:
    """Tables written once to the shared folder and read back, so that lost executors cost a re-read only."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_base(spark)}/spokeline-{spark.sparkContext.applicationId}"
        _FOLDERS.add((spark, self.folder))

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._spokeline_path = path
        return kept

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that ``keep`` wrote and nothing reads any more."""
        path = getattr(df, "_spokeline_path", None)
        if path:
            _remove(self.spark, path)


def keep(df: DataFrame) -> DataFrame:
    return Scratch(df.sparkSession).keep(df)
