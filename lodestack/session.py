"""Session, table and scratch-storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: list[str] = []
_WRITTEN: list[str] = []


def local_session(cpus: int | str = 8, app: str = "lodestack", **conf: str) -> SparkSession:
    """A local session with the settings used in tests and in the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


class Shared:
    """A broadcast with a key by which workers remember what they make of it."""

    def __init__(self, spark: SparkSession, value):
        self.key, self._box = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._box.value

    def drop(self) -> None:
        """Remove it from memory and disk; nothing can use it afterwards."""
        self._box.destroy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset a local session gets a temporary folder; on a cluster, whose
    executors could not see it, that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="lodestack-"))
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], True)
    return f"file://{_LOCAL_SCRATCH[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back, which cuts its lineage.

    The table survives the loss of executors, is computed once however often it is
    read, and gives the optimizer real sizes. Written tables are removed by release(), at
    the latest when the program ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, removed like the tables of cut()."""
    path = f"{shared_dir(spark)}/lodestack/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_at_exit, spark)
    _WRITTEN.append(path)
    return path


def cut_all(*dfs: DataFrame) -> list[DataFrame]:
    """cut() of several results that don't depend on each other, at the same time."""
    with ThreadPoolExecutor(max_workers=min(8, len(dfs))) as pool:
        return list(pool.map(cut, dfs))


def release(spark: SparkSession) -> None:
    """Remove every table written by cut(); results that read them become unusable."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session has ended: only what is on this machine can still be removed
        for path in _WRITTEN:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://"), True)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give a scan enough partitions for Python work.

    A scan of a large table has many splits and stays as it is, so nothing is shuffled
    there; only a scan with fewer than two splits a core is dealt out anew.
    """
    reachable(df.sparkSession)
    n = cores(df.sparkSession)
    if df.rdd.getNumPartitions() >= 2 * n:
        return df
    return df.repartition(per_core * n)


def env_int(raw: str | None, default: int, minimum: int = 1) -> int:
    """An integer setting; the default if it is absent, no number or below the minimum."""
    try:
        value = int(raw) if raw is not None else default
    except ValueError:
        return default
    return value if value >= minimum else default


def bench_cpus() -> int:
    return env_int(os.environ.get("BENCH_CPUS"), 8)
