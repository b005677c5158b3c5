"""Helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+; bytes.split() cuts at exactly these.
BLANKS = " \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(c: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; null for null."""
    return F.crc32(c.cast("string").cast("binary")) % folds


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a number that tells equal rows apart.

    It holds within one job only: splits follow the cores that are alive, so a later scan of the same
    files may number them otherwise. So the job that numbers rows writes them, too, with ``stored``.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a slice stay within ``max_bytes``; a longer text goes alone. At the end Arrow's unused memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values) if not pa.types.is_list(values.type) else pc.multiply(pc.list_value_length(values), 4), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def named(df: DataFrame, *without: str) -> list[Column]:
    """The columns of a frame, whatever characters their names have."""
    return [F.col(quoted(c)) for c in df.columns if c not in without]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def word_places(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All words of some texts, A-Z in lower case: their places among the distinct words, these, and how many words there are up to each text's end."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    known = words.flatten().dictionary_encode()
    names, place = known.dictionary.cast(pa.binary()), known.indices.to_numpy()
    real = pc.not_equal(names, b"").to_numpy(zero_copy_only=False)[place]  # blanks at the ends of a text leave empty words
    before = np.concatenate([[0], np.cumsum(real)])
    return place[real], names, before[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """word_places with the distinct words as a list."""
    place, names, upto = word_places(texts)
    return place, names.to_pylist(), upto


def mapped(df: DataFrame, source: str, made: dict[str, str], make) -> DataFrame:
    """The columns of ``df`` that don't have one of the new names (``made``: name and type) in either case, then the new ones.

    ``make``: from an Arrow array of ``source`` to the new arrays, called in the tasks. Column names are free: maps see places instead.
    """
    lowered = {c.lower() for c in made}
    keep = [c for c in df.columns if c.lower() not in lowered]
    inner = df.select(*[F.col(quoted(c)).alias(f"_{k}") for k, c in enumerate(keep)], F.col(quoted(source)).alias("_source"))
    names = [f"_{k}" for k in range(len(keep))]
    new = [f"_new{k}" for k in range(len(made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_source"):
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *make(batch.column("_source"))], names=[*names, *new])

    schema = inner.drop("_source").select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(new, made.values(), strict=True)]).schema
    return inner.mapInArrow(run, schema).toDF(*keep, *made)


#: Rows of ids or verdicts that may be broadcast, counted before: a few MB.
FEW = 200_000


def text_hash(c: Column) -> Column:
    """What tells a text again in another scan (128 bits); null for null."""
    return F.unhex(F.md5(c.cast("string")))


def known_again(df: DataFrame, judged: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``df`` that ``judged`` (doc, h, kept, linked: one row for each row) keeps, with their own columns.

    Rows are known by key and text, which hold in every scan, however it is split. Of rows that are equal in both and ``linked`` one stays.
    """
    by = judged.groupBy("doc", "h").agg(F.max("kept").alias("kept"), F.max("linked").alias("linked"), F.count("*").alias("rows"))
    lost = held(by.where(~F.col("kept") | (F.col("rows") > 1) & F.col("linked")).select(F.col("doc").alias("_rf_d"), F.col("h").alias("_rf_h"), F.col("kept").alias("_rf_again")))
    same = F.col(quoted(key)).cast("long").eqNullSafe(F.col("_rf_d")) & text_hash(F.col(quoted(text))).eqNullSafe(F.col("_rf_h"))
    kept = df.join(F.broadcast(lost) if lost.count() <= FEW else lost, same, "left_anti")
    again = lost.where("_rf_again")
    if not again.isEmpty():
        kept = kept.unionByName(df.join(F.broadcast(again) if again.count() <= FEW else again, same, "left_semi").dropDuplicates([key, text]))
    return kept.select(*named(df))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session has none, a local master gets one of its own, as in tests; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rainfold-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: this cuts the lineage and survives lost executors. ``files``: at most so many.

    The file system deletes the table when the application ends, if ``dropped`` hasn't deleted it before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rainfold-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.rainfold_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing needs any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.rainfold_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame) -> DataFrame:
    """A stored table for results: they no longer need the tables that they come from, and go when the application ends."""
    return stored(df)


def looked_up(rows: DataFrame, table: DataFrame, on: str, weight: str) -> DataFrame:
    """Left join of ``rows`` with a stored table by ``on``; ``weight`` of the table says how many rows ask for an entry.

    Entries that a ten-thousandth of all rows ask for (at most 10 000 then) are broadcast, so no key's rows meet in one task; the
    others are joined by shuffle. A null finds nothing.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) >= max(1000, total // 10_000)
    heavy = table.where(hot).drop(weight)
    light = table.where(~hot).drop(weight)
    if heavy.isEmpty():
        return rows.join(light, on, "left")
    cold = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on, "left")
    return rows.join(F.broadcast(heavy), on).unionByName(cold)
