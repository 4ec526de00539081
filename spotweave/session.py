"""Session defaults and the shared folder used for checkpoints and stage files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """Local session for tests and benches; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spotweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; a
    cluster without it is an error, as a machine-local path would be lost
    with its executor.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        # the setting cannot be changed in a running session; Spark keeps the folder in use
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        return sc.getCheckpointDir().removeprefix("file:").rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spotweave-{spark.sparkContext.applicationId}"


#: By application: the folder in use for a group of steps, and the last one of each group.
_active: dict[str, str] = {}
_last: dict[tuple[str, str], str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of this application, never reused."""
    group = _active.get(spark.sparkContext.applicationId)
    return f"{group or scratch_root(spark)}/{uuid.uuid4().hex}/{label}"


@contextmanager
def scratch_group(spark: SparkSession, name: str) -> Iterator[None]:
    """What is stored inside goes to a folder of its own, which is deleted when the group begins again.

    For steps of which each is written before the next begins.
    """
    app = spark.sparkContext.applicationId
    if (app, name) in _last:
        _delete(spark, _last.pop((app, name)))
    before = _active.pop(app, None)
    _last[app, name] = _active[app] = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        _active.pop(app)
        if before is not None:
            _active[app] = before


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application stored, once no result of it is in use."""
    _delete(spark, scratch_root(spark))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a result that later steps read more than once, and read it back.

    A written table survives lost executors, is computed once, and starts a
    short new plan. Its file size is known, so Spark can judge joins with it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*results: DataFrame) -> None:
    """Delete stored results that nothing reads any more."""
    for df in results:
        _delete(df.sparkSession, df._stored_at)


#: Rows that one task sorts or groups at once, about.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` to a task for each ``task_rows`` of ``rows``; left to Spark where the session has as many tasks.

    So the memory of a task doesn't grow with the input. Both sides of a join get the same ``rows``.
    """
    n = -(-rows // task_rows)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)


class Bucketed:
    """A stored result dealt to files by the hash of ``keys``.

    A join or grouping on these keys reads the files as they are, without a
    shuffle. There are as many files as shuffle partitions.
    """

    def __init__(self, df: DataFrame, label: str, keys: list[str]):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path, self.name = scratch_path(self.spark, label), f"spotweave_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # dealt out before the write, so that each task writes one file; no shuffle where they are already
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def plain(self) -> DataFrame:
        """The rows as an ordinary stored result; the catalog forgets the table."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)

    def delete(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


@contextmanager
def dealt_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Joins run inside leave rows where they are if both sides are dealt by some of the join keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
