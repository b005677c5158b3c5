"""Exact duplicates by Grace hashing on complete contents.

Copies are first combined where they are read, so a group of copies of any size
sends at most a few rows per task. What is left is dealt out by a hash of the content; a
task splits its share into spill files by further hash bits, again and again,
until a bucket fits an open-addressing table that compares complete contents.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, dropped, held, known_again, named, numbered, quoted, slices, stored, text_hash

NONE = -(1 << 63)


class Table:
    """Open addressing with linear probing over content hashes; a slot matches only if the whole content is equal."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[int] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, h: int, content: bytes, best: int, count: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        at = (h >> 20) & mask
        while (k := int(slots[at])) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                self.counts[k] += count
                if best > self.best[k]:
                    self.best[k] = best
                return
            at = (at + 1) & mask
        slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(best)
        self.counts.append(count)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(slots):
            self._grow()

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        slots = np.full(size, -1, np.int64)
        for k, h in enumerate(self.hashes):
            at = (h >> 20) & (size - 1)
            while slots[at] >= 0:
                at = (at + 1) & (size - 1)
            slots[at] = k
        self.slots = slots

    def rows(self) -> Iterator[tuple[int, bytes, int, int]]:
        return zip(self.hashes, self.contents, self.best, self.counts, strict=True)


def content_hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


HEAD = struct.Struct("<QqqI")


def grace(rows: Iterator[tuple[int, bytes, int, int]], fit: int, fan: int = 16, level: int = 0) -> Iterator[Table]:
    """Tables that together hold the rows, equal contents in one of them; beyond ``fit`` bytes the rows go to spill files."""
    table, spill, files = Table(), None, []
    try:
        for h, content, best, count in rows:
            if spill is None:
                table.add(h, content, best, count)
                if table.bytes > fit and level < 8:
                    spill = tempfile.TemporaryDirectory(prefix="grace-")
                    files = [open(os.path.join(spill.name, str(k)), "w+b") for k in range(fan)]  # noqa: SIM115
                    for row in table.rows():
                        _put(files, level, *row)
                    table = Table()
            else:
                _put(files, level, h, content, best, count)
        if spill is None:
            yield table
        for f in files:
            f.seek(0)
            yield from grace(_taken(f), fit, fan, level + 1)
            f.close()
    finally:
        for f in files:
            f.close()
        if spill is not None:
            spill.cleanup()


def _put(files: list, level: int, h: int, content: bytes, best: int, count: int) -> None:
    f = files[(h >> (56 - 4 * level)) % len(files)]
    f.write(HEAD.pack(h, best, count, len(content)))
    f.write(content)


def _taken(f) -> Iterator[tuple[int, bytes, int, int]]:
    while head := f.read(HEAD.size):
        h, best, count, size = HEAD.unpack(head)
        yield h, f.read(size), best, count


PARTS = pa.schema([("bucket", pa.int64()), ("content", pa.binary()), ("best", pa.int64()), ("n", pa.int64())])
GROUPS = pa.schema([("text_sha256", pa.string()), ("best", pa.int64()), ("n", pa.int64())])


def _groups(rows: DataFrame, fit: int) -> DataFrame:
    """(text_sha256, best, n) for the contents of ``rows`` (_key, _text) that occur more than once."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()

        def flush() -> pa.RecordBatch:
            found = list(table.rows())
            return pa.record_batch([pa.array([h - (1 << 63) for h, *_ in found], pa.int64()), *(pa.array([r[k] for r in found], t) for k, t in ((1, pa.binary()), (2, pa.int64()), (3, pa.int64())))], schema=PARTS)

        for batch in slices(batches, "_text"):
            for k, x in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                content = (x or "").encode().lower()
                table.add(content_hash(content), content, NONE if k is None else k, 1)
            if table.bytes > fit // 4:
                yield flush()
                table = Table()
        yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken():
            for batch in slices(batches, "content"):
                for h, c, b, n in zip(*(batch.column(x).to_pylist() for x in PARTS.names), strict=True):
                    yield h + (1 << 63), c, b, n

        for table in grace(taken(), fit):
            found = [(hashlib.sha256(c).hexdigest(), b, n) for _, c, b, n in table.rows() if n > 1]
            for k in range(0, len(found), 10_000):
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*found[k : k + 10_000], strict=True), GROUPS.types, strict=True)], schema=GROUPS)

    parts = rows.mapInArrow(combine, "bucket long, content binary, best long, n long")
    return parts.repartition("bucket").mapInArrow(meet, "text_sha256 string, best long, n long")


def _judged(df: DataFrame, text: str, key: str, fit: int) -> DataFrame:
    """One row for each row: _key, h (hash of the text as it is), text_sha256, best, n, kept."""
    rows = df.select(F.col(quoted(key)).cast("long").alias("_key"), F.col(quoted(text)).alias("_text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            got = [hashlib.sha256((x or "").encode().lower()).hexdigest() for x in batch.column("_text").to_pylist()]
            yield pa.record_batch([*map(batch.column, ("row", "_key", "h")), pa.array(got, pa.string())], names=["row", "_key", "h", "text_sha256"])

    light = stored(numbered(rows.withColumn("h", text_hash(F.col("_text"))), "row").mapInArrow(digest, "row long, _key long, h binary, text_sha256 string"))
    groups = stored(_groups(rows, fit))
    few = F.broadcast(groups) if groups.count() <= FEW else groups
    best = F.nullif("best", F.lit(NONE))
    winners = light.join(few, "text_sha256").where(F.col("_key").eqNullSafe(best)).groupBy("text_sha256").agg(F.max("row").alias("winner"))
    winners = stored(groups.join(winners, "text_sha256"))
    few = F.broadcast(winners) if winners.count() <= FEW else winners
    alone = F.col("n").isNull()
    out = held(light.join(few, "text_sha256", "left").select("_key", "h", "text_sha256", F.when(alone, F.col("_key")).otherwise(best).alias("best"), F.coalesce("n", F.lit(1).cast("long")).alias("n"), (alone | (F.col("winner") == F.col("row"))).alias("kept")))
    dropped(light, groups, winners)
    return out


def exact_groups(df: DataFrame, text: str = "text", key: str = "doc_id", fit: int = 64_000_000) -> DataFrame:
    """One row for each input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
    equal texts the row with the largest integer key stays; among equal keys the one
    that is read last, so exactly one row of a group stays; a null key is the
    smallest, and keep_id is then null. Other columns are not read. ``fit`` bounds the
    bytes of contents that a task holds at once; a group's size doesn't matter, since
    equal contents are one table row. A single text larger than that is held whole. The result
    is a stored table; texts are written nowhere but in the shuffle.
    """
    return _judged(df, text, key, fit).select(F.col("_key").alias(key), F.col("best").alias("keep_id"), F.col("n").alias("group_size"), "kept", "text_sha256")


def drop_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that ``exact_groups`` keeps, with their own columns, whatever their names; of rows that are equal in key and text one."""
    return known_again(df, _judged(df, text, key, 64_000_000).select(F.col("_key").alias("doc"), "h", "kept", F.lit(True).alias("linked")), text, key)
