"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# timestamps are naive, so the session zone is pinned; everything else is left to the cluster
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "profilekit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_settings(spark: SparkSession) -> SparkSession:
    """Sets what results depend on in a session somebody else built: naive times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", REQUIRED_CONF["spark.sql.session.timeZone"])
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing the session has to be a local one; a fresh local folder is then
    used. On a cluster a machine-local folder would be invisible to the executors, so that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = getattr(spark, "_profilekit_scratch", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="profilekit-")
        spark._profilekit_scratch = root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else writes to."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    Inside ``temporary`` the table goes at the end of the block, unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    open_ = getattr(spark, "_profilekit_open", None)
    if open_ and not keep:
        open_[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._profilekit_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and nobody reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._profilekit_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that were materialised inside it, but those written with ``keep``."""
    open_ = getattr(spark, "_profilekit_open", None)
    if open_ is None:
        open_ = spark._profilekit_open = []
    open_.append([])
    try:
        yield
    finally:
        for path in open_.pop():
            _delete(spark, path)
