"""The prefix trie of conversations, with totals of subtrees by bands of depth.

A node is a sequence of first turns. Its name is a chained hash of 128 bits, so each conversation names its own nodes in one
task and nothing but names and counts is shuffled. Depths fall into bands of fixed height. A node adds its
numbers only to its ancestors in its own band; then, from the deepest band up, the completed total of each node at a band's top goes to the
ancestors in the band above. So a node makes at most as many rows as a band is high, and
rounds are as many as bands: conversations of a thousand turns cost neither a thousand rounds nor a million rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, WORD, dropped, held, looked_up, quoted, stored

#: The name of the textless root.
ROOT = bytes(16)
TURNS = "array<struct<digest:binary,words:bigint>>"
#: Ids of a chunk of one node's ends.
CHUNK = 512


def packed_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): a conversation a row, its turns in order as a digest of role and text and the number of words.

    A null turn comes first; turns that tie go by role, then by digest. Null role or text is empty. Rows without a conversation's id belong to none. Other columns are not read.
    A conversation is one row of 24 bytes a turn; texts are not shuffled.
    """
    said, who = F.coalesce(F.col(quoted(text)), F.lit("")), F.coalesce(F.col(quoted(role)), F.lit(""))
    one = F.struct(
        F.col(quoted(turn)).isNotNull().alias("known"), F.col(quoted(turn)).alias("turn"), who.alias("role"),
        F.unhex(F.md5(F.concat(F.md5(who.cast("binary")), said).cast("binary"))).alias("digest"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = df.where(F.col(quoted(conv)).isNotNull()).select(F.col(quoted(conv)).cast("long").alias("conv_id"), one.alias("one"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    return sorted_.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).cast(TURNS).alias("turns"))


def _names(digests: list[bytes]) -> list[bytes]:
    """The names of a conversation's nodes, the root first."""
    out = [ROOT]
    for d in digests:
        out.append(hashlib.blake2b(out[-1] + d, digest_size=16).digest())
    return out


def _paths(packed: DataFrame, height: int) -> DataFrame:
    """(node, depth, words, conv_id, ended, above) for each conversation and depth.

    ``above``: the ancestors in the node's own band, highest first; of a node at the top of a band all ancestors in the band above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for conv, turns in zip(part.column("conv_id").to_pylist(), part.column("turns").to_pylist(), strict=True):
                    names, words = _names([t["digest"] for t in turns]), [0, *(t["words"] for t in turns)]
                    for d, name in enumerate(names):
                        top = max(0, (d - 1) // height * height)
                        for k, v in enumerate((name, d, words[d], conv, d == len(turns), names[top:d])):
                            out[k].append(v)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["node", "depth", "words", "conv_id", "ended", "above"])

    return packed.mapInArrow(run, "node binary, depth long, words long, conv_id long, ended boolean, above array<binary>")


def _ends(packed: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: the hash of their ids in ascending order.

    Ids are first joined to texts by node and range of ids, at most 512 in one; a node's texts then stream
    through the hash in order, so a node at which very many conversations end needs no memory either.
    """

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_names(d)[-1] for d in batch.column("digests").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column("conv_id")], names=["node", "conv_id"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({"node": pa.array([now], pa.binary()), "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            done: list[list] = [[], []]
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        done[0].append(now)
                        done[1].append(state.hexdigest())
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield row()

    ends = packed.select("conv_id", F.transform("turns", lambda x: x["digest"]).alias("digests")).mapInArrow(last, "node binary, conv_id long")
    chunks = ends.groupBy("node", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def _completed(nodes: DataFrame, height: int) -> DataFrame | None:
    """(above, saved, leaves) of the nodes at the tops of bands below the first one, with the totals of their whole subtrees; a stored table, or None where there is no such band."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    bands = deepest // height
    if not bands:
        return None
    at_top = F.col("depth") % height == 0
    deep = nodes.where(F.col("depth") >= height)
    inner = deep.groupBy(F.when(at_top, F.col("node")).otherwise(F.col("above")[0]).alias("node")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    tops = stored(deep.where(at_top).select("node", (F.col("depth") / height).cast("int").alias("band"), "above").join(inner, "node"))
    few = tops.count() <= FEW  # then one partition, so that rounds need no shuffle
    done = []
    for band in range(bands, 0, -1):
        now = tops.where(F.col("band") == band)
        if few:
            now = now.coalesce(1)
        if done:
            below = (done[-1].coalesce(1) if few else done[-1]).groupBy(F.col("above")[0].alias("node")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
            now = now.join(below, "node", "left").select("node", "band", "above", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"))
        done.append(stored(now, 1 if few else None))
    all_ = stored(reduce(DataFrame.unionByName, done), 1 if few else None)
    dropped(tops, *done)
    return all_


def prefix_trie(packed: DataFrame, height: int = 32) -> DataFrame:
    """One row for each node of the trie of ``packed`` conversations (conv_id, turns, as of ``packed_turns``; each id once): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node's members are the conversations that begin with it, turnless ones being members of the root alone; conv_id is
    the smallest of them. saved_tokens: over the subtree, the words of each node's last turn times the members beyond the first.
    ends_sha256: hash of the ids of the members that end there. A node is a leaf if all of its members
    end there. No conversations give no nodes. ``height``: of a band. The result is a stored table.
    """
    packed = stored(packed)
    paths = _paths(packed, height)
    counted = paths.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ended").alias("ended"),
        F.first("depth").alias("depth"), F.first("words").alias("words"), F.first("above").alias("above"),
    )
    saved, leaf = ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("ended") == F.col("n_convs")).cast("long").alias("leaf")
    nodes = stored(counted.select("node", "conv_id", "n_convs", "depth", "above", saved, leaf))
    spread = lambda saved, leaves: F.transform("above", lambda a, i: F.struct(a.alias("node"), F.col(saved).alias("saved"), F.col(leaves).alias("leaves"), (i == F.size("above") - 1).cast("long").alias("children")))
    at_top = F.col("depth") % height == 0
    itself = F.array(F.struct("node", "saved", F.col("leaf").alias("leaves"), F.lit(0).cast("long").alias("children")))
    told = ("conv_id", "depth", "n_convs")
    shares = nodes.select(F.inline(itself), F.try_element_at("above", F.lit(-1)).alias("parent"), *told)
    shares = shares.withColumn("ends_sha256", F.lit(None).cast("string"))
    more = [nodes.where(~at_top).select(F.inline(spread("saved", "leaf")))]
    tops = _completed(nodes, height)
    if tops is not None:
        more.append(tops.select(F.inline(spread("saved", "leaves"))))
    for m in more:
        shares = shares.unionByName(m, allowMissingColumns=True)
    shares = shares.unionByName(_ends(packed), allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    total = stored(shares.groupBy("node").agg(*[F.max(c).alias(c) for c in told], F.max("parent").alias("parent"), zero("saved"), zero("leaves"), zero("children"), F.max("ends_sha256").alias("ends_sha256")))
    parents = total.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("children").alias("weight")).where("weight > 0")
    out = looked_up(total, parents, "parent", "weight").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    out = held(out)
    dropped(packed, nodes, total, *([tops] if tops is not None else []))
    return out
