"""Tables in the folder that all executors share: what cuts a lineage, and basins laid out by blocks of cells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of one pass at least, and passes at most: what is on its way between tasks is that of one pass only.
PASS = 8
PASSES = 16
#: While a table is written: shuffle files go with the write that made them, and rows that lie by a cell's id are joined there by cell and month.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Where there is none, a local master gets one of its own, as in tests; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rainfold-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str = "rainfold") -> str:
    """A path in the shared folder that the file system deletes when the application ends, if nothing has deleted it before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of ``WRITING`` for what is written inside; the session has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written and read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    with writing(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.rainfold_path = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int | None = None, sort: tuple[str, ...] = (), placed: bool = False, path: str | None = None) -> DataFrame:
    """The rows as a table in buckets of ``key``: joins and groups by it read the table without a shuffle.

    Where buckets are many, the rows are first written by groups of ``PASS`` buckets or more, then shuffled group by group, so that no shuffle holds the whole table.
    ``placed``: the rows of a task are in few buckets already, so they aren't shuffled before. With ``path`` the table stays; ``opened`` reads it in another session.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, at = f"rainfold_{uuid.uuid4().hex}", path or new_path(spark)
    passes = 1 if placed else max(1, min(PASSES, n // PASS))

    def put(rows: DataFrame) -> None:
        writer = rows.write.format("parquet").bucketBy(n, key)
        if placed:  # results on their way: measured numbers don't repeat, so neither dictionaries nor compression pay
            writer = writer.option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
        (writer.sortBy(*sort) if sort else writer).option("path", at).saveAsTable(name)

    with writing(spark):
        if placed:
            put(df)
            return _table(spark, name, at)
        put(df.limit(0))  # rows are inserted afterwards: shuffle files of an insertion go with it, those of saveAsTable stay
        if passes == 1:
            df.repartition(n, key).write.insertInto(name)
        else:
            stage = new_path(spark)
            numbered = df.withColumn("_pass", F.pmod(F.pmod(F.hash(key), F.lit(n)), F.lit(passes)))  # a bucket is in one pass
            numbered.sortWithinPartitions("_pass", *sort).write.partitionBy("_pass").parquet(stage)
            for k in range(passes):
                rows = spark.read.schema(numbered.schema).parquet(stage).where(F.col("_pass") == k).drop("_pass")
                rows.repartition(n, key).write.insertInto(name)
                _deleted(spark, f"{stage}/_pass={k}")
            _deleted(spark, stage)
    return _table(spark, name, at)


def _table(spark: SparkSession, name: str, path: str) -> DataFrame:
    out = spark.table(name)
    out.rainfold_path, out.rainfold_table = path, name
    return out


def opened(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that another session wrote with ``bucketed`` to ``path``."""
    name = f"rainfold_{uuid.uuid4().hex}"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({kinds}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def there(frame: DataFrame) -> bool:
    """Whether a stored table's files are still there."""
    spark = frame.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(frame.rainfold_path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that nothing needs any more."""
    for frame in frames:
        spark = frame.sparkSession
        if hasattr(frame, "rainfold_table"):
            spark.sql(f"DROP TABLE IF EXISTS {frame.rainfold_table}")
        _deleted(spark, frame.rainfold_path)
