"""Session helpers: a local session, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made here for applications whose session names none.
_OWN: dict[str, str] = {}
#: Tables written by this process and not removed yet.
_WRITTEN: list[str] = []


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g", settings: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.config(map=settings or {}).master(f"local[{cores}]")
        .appName("dialoom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own, removed at exit."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            place = tempfile.mkdtemp(prefix="dialoom-")
            atexit.register(shutil.rmtree, place, True)
            _OWN[app] = f"file://{place}"
        found = _OWN[app]
    return found


def new_place(spark: SparkSession) -> str:
    """The path of a table to be written in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def durable(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it from there.

    It cuts the lineage: what follows never recomputes ``df``, and no executor
    holds the only copy of a part. :func:`scratch` removes what was written in it.
    """
    path = new_place(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_durable(spark: SparkSession) -> None:
    """Removes all tables that this process wrote with :func:`durable`; frames that read them can be read no more."""
    _remove(spark, _WRITTEN)
    _WRITTEN.clear()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes on leaving what :func:`durable` wrote inside: for a query whose result is written or counted within."""
    kept = len(_WRITTEN)
    try:
        yield
    finally:
        _remove(spark, _WRITTEN[kept:])
        del _WRITTEN[kept:]


def rows_within(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it needs to tell."""
    return df.limit(limit + 1).count() <= limit


def broadcast_within(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if rows_within(df, limit) else df
