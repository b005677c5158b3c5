"""N-gram Jaccard join by adaptive multi-match prefixes (Wang et al. 2012).

Shingles are ordered by their hash, and a document's prefix is the first part of its set. If a
pair is similar, then prefixes that are l longer than needed share at least l
shingles, so a longer prefix allows more matches to be asked for. Here the
matches that a pair must have follow from both sizes and both prefixes.

First every document has the shortest prefix. Posting counts tell exactly what a
document's candidates would cost; where that is too much, its prefix is lengthened,
and it may then leave out as many of its most frequent prefix shingles as the longer prefix
pays for. The longest prefix is the whole set, rarest shingles first: there a
place tells how many shingles can still be shared from it on, so pairs that can't
be similar don't even meet. Documents that stay costly (large groups of near copies, or of texts that
share most of what they have) are compared with one pivot for each shingle at a
time, and pairs that are already connected are left out; rounds go on as long as they
halve what is open, and all that is left is compared then. So a group of copies costs a few
comparisons a member, and no link between different components is ever skipped.

A document's identity between two scans is its key and a hash of its text, never a row number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FEW, dropped, held, known_again, numbered, quoted, slices, stored, text_hash, word_codes
from .components import connected_components

SIZE = 5


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    if len(h) < k:
        return np.zeros(0, np.int64)
    out = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes (int64) of its 5-word shingles, A-Z in lower case; of fewer words the whole sequence."""
    place, names, upto = word_codes(texts)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[place]
    ends = np.concatenate([[0], upto])
    runs = _mixed(h, SIZE)
    return [np.unique(runs[a : b - SIZE + 1] if b - a >= SIZE else _mixed(h[a:b], b - a)) if b > a else np.zeros(0, np.int64) for a, b in zip(ends, ends[1:], strict=False)]


def shingles(text: str | None) -> np.ndarray:
    """The set of one text."""
    return shingle_sets(pa.array([text], pa.string()))[0]


def _least(n):
    """Shingles that a set of n must share with any similar one: four fifths, rounded up."""
    return -(-4 * n // 5)


def _shingled(df: DataFrame, whole: bool) -> DataFrame:
    """The other columns, n, set (a 128-bit hash of the set) and tokens: the whole set, or its shortest prefix."""
    rest = [c for c in df.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = shingle_sets(batch.column("_text"))
            sizes = [len(s) for s in sets]
            parts = sets if whole else [s[: len(s) - _least(len(s)) + 1] for s in sets]
            flat = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(sizes, pa.int32()), keys, tokens], names=[*rest, "n", "set", "tokens"])

    kinds = ", ".join(f"{c} {t}" for c, t in df.drop("_text").dtypes)
    return df.mapInArrow(run, f"{kinds}, n int, set binary, tokens array<long>")


def _need(a: str, b: str) -> Column:
    """Shingles that sets of these sizes must share."""
    return F.ceil((F.col(a) + F.col(b)) * 4 / 9)


def _sizes_fit(a: str, b: str) -> Column:
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these nodes. A short list of nodes goes to the rows, which then aren't shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids, "node", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), stored, whose whole sets have a Jaccard similarity of 0.8 or more. Only the sets of these pairs are shuffled."""
    pairs = stored(pairs.select("a", "b"))
    n = pairs.count()
    if not n:
        return pairs
    few = n <= FEW
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")).join(F.broadcast(pairs) if few else pairs, "a")
    right = _only(sets, stored_ends := stored(pairs.select(F.col("b").alias("node")).distinct()))
    both = left.join(right.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    out = stored(both.where(9 * shared >= 4 * (F.size("ta") + F.size("tb"))).select("a", "b"))
    dropped(pairs, stored_ends)
    return out


def _counted(postings: DataFrame) -> DataFrame:
    """Postings whose shingle has others, with the number of them (cnt)."""
    several = postings.groupBy("token").agg(F.count("*").alias("cnt")).where("cnt > 1")
    return postings.join(several, "token")


def _meet(x: DataFrame, y: DataFrame, extra: Column | None = None) -> DataFrame:
    """Rows of x and y (columns with these letters) at one shingle whose sizes, and if they have them places, allow similarity."""
    fits = (x["token"] == y["token"]) & _sizes_fit("nx", "ny")
    if "ix" in x.columns:  # the places of the first shared shingle: at most what follows can be shared
        fits = fits & (9 * (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) + 1) >= 4 * (F.col("nx") + F.col("ny")))
    return x.join(y, fits if extra is None else fits & extra)


def _side(rows: DataFrame, letter: str, *more: str) -> DataFrame:
    place = [F.col("rank").alias(f"i{letter}")] if "rank" in rows.columns else []
    return rows.select("token", F.col("node").alias(letter), F.col("n").alias(f"n{letter}"), *place, *[F.col(c).alias(f"{c}{letter}") for c in more])


def _candidates(postings: DataFrame, cheap: DataFrame, prefix: str, left_out: str) -> DataFrame:
    """Pairs (a, b) of a cheap document and any other that share as many prefix shingles as a similar pair must."""
    rows = postings.join(cheap.select("node", F.lit(True).alias("c")), "node", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    other = (F.col("x") != F.col("y")) & (~F.col("cy") | (F.col("x") < F.col("y")))
    met = _meet(_side(rows.where("c"), "x"), _side(rows, "y", "c"), other)
    pair = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if "rank" in rows.columns:
        return met.select(*pair).distinct()
    shared = met.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("k"))
    at = lambda e, n: F.expr(e.replace("{n}", n))
    beyond = F.greatest(F.col("nx") - at(prefix, "nx"), F.col("ny") - at(prefix, "ny"))
    lost = F.greatest(at(left_out, "nx"), at(left_out, "ny"))
    return shared.where(F.col("k") >= _need("nx", "ny") - beyond - lost).select(*pair).distinct()


SHORT, NONE = "{n} - ceil({n} * 4 / 5) + 1", "0"
#: One eighth longer; four fifths of that, for the smallest partner, pay for what is left out.
LONG, LEFT_OUT = "least({n}, {n} - ceil({n} * 4 / 5) + 1 + floor({n} / 8))", "floor(floor({n} * 4 / 5) / 8)"
#: The whole set: all shared shingles but one may be left out.
WHOLE, ALL_BUT_ONE = "{n}", "ceil({n} * 4 / 5) - 1"


def _cost(postings: DataFrame, factor: int) -> tuple[DataFrame, DataFrame]:
    """Documents by what their candidates cost: (cheap ones, costly ones)."""
    cost = postings.groupBy("node", "n").agg(F.sum(F.col("cnt") - 1).alias("cost"))
    limit = 64 + factor * F.expr(SHORT.replace("{n}", "n"))
    return cost.where(F.col("cost") <= limit), cost.where(F.col("cost") > limit)


def _lengthened(sets: DataFrame, prefix: str, left_out: str) -> DataFrame:
    """Postings (token, node, n, cnt) of longer prefixes, each document's most frequent shingles left out; of whole sets also rank, the place from the rarest on."""
    length = F.expr(prefix.replace("{n}", "n")).cast("int")
    own = sets.select("node", "n", F.explode(F.slice("tokens", F.lit(1), length)).alias("token"))
    rows = W.partitionBy("node")
    rare = length - F.count("*").over(rows)  # shingles that no other document has come first
    ranked = _counted(own).withColumn("rank", F.row_number().over(rows.orderBy("cnt", "token")) + rare)
    kept = ranked.where(F.col("rank") <= length - F.expr(left_out.replace("{n}", "n")))
    return kept if prefix == WHOLE else kept.drop("rank")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) when ``links`` (a, b) join some of them. Only components that links touch are looked at."""
    known = comps.withColumnRenamed("component", "c")
    edges = links
    for end in ("a", "b"):
        edges = edges.join(known.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    groups = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    moved = known.join(groups.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("component"))
    out = stored(moved.unionByName(groups.join(comps.select("node"), "node", "left_anti")))
    dropped(groups, comps)
    return out


def _by_pivots(postings: DataFrame, sets: DataFrame, comps: DataFrame, spare: int = 16) -> DataFrame:
    """The components (node, component) when costly documents are linked too.

    A round compares each document with the pivots of its shingles: the members with most postings, which
    are closest to what a group's copies come from, and among equals one of four by hash. Rounds
    go on while all open pairs together would meet more than ``spare`` times for each posting, and each round halves that number.
    """
    weight = postings.groupBy("node").agg(F.count("*").alias("m"))
    open_ = stored(postings.select("token", "node", "n", "rank").join(weight, "node"))
    before, turn = float("inf"), 0
    while True:
        known = comps.withColumnRenamed("component", "comp")
        rows = open_.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        first = F.min(F.struct(-F.col("m"), F.xxhash64("node", F.pmod("token", F.lit(4)), F.lit(turn)), "node", "n", "rank", "comp"))
        several = rows.groupBy("token").agg(first.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "p")
        near = stored(rows.join(several, "token"))  # what stands at shingles of several components, each with the shingle's pivot
        dropped(open_)
        met, n = near.groupBy("token").count().agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
        if not n or met <= spare * n or met > before / 2:
            break
        pivots = near.select("token", F.col("p.node").alias("x"), F.col("p.n").alias("nx"), F.col("p.rank").alias("ix"), F.col("p.comp").alias("cx"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rank").alias("iy"), F.col("comp").alias("cy"))
        fits = _sizes_fit("nx", "ny") & (9 * (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) + 1) >= 4 * (F.col("nx") + F.col("ny")))
        links = _similar(pivots.where((F.col("cx") != F.col("cy")) & fits).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), sets)
        comps = _merged(comps, links)
        open_ = stored(near.where("node != p.node").select("token", "node", "n", "rank", "m"))
        dropped(near, links)
        before, turn = met, turn + 1
    if n:  # all that is still open at once
        apart = (F.col("x") < F.col("y")) & (F.col("compx") != F.col("compy"))
        met = _meet(_side(near, "x", "comp"), _side(near, "y", "comp"), apart)
        links = _similar(met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), sets)
        comps = _merged(comps, links)
        dropped(links)
    dropped(near)
    return comps


def _judged(df: DataFrame, text: str, key: str, factor: int) -> DataFrame:
    """One row for each row: doc, h (hash of the text), n, component (a doc), first."""
    rows = df.select(F.col(quoted(key)).cast("long").alias("doc"), text_hash(F.col(quoted(text))).alias("h"), F.col(quoted(text)).alias("_text"))
    read = stored(_shingled(numbered(rows, "row"), whole=False))
    light = read.select("row", "doc", "h", "n", "set")
    classes = stored(light.where("n > 0").groupBy("set").agg(F.min(F.struct("row", "doc", "h")).alias("r"), F.min(F.struct(F.col("doc").isNull(), "doc", "row")).alias("head"), F.count("*").alias("rows")).select("set", F.col("r.row").alias("node"), "r.doc", "r.h", "head", "rows"))
    copies = light.join(classes.where("rows > 1").select("set", "node"), "set").where("row != node").select("row")
    heads = read.where("n > 0").join(copies, "row", "left_anti").withColumnRenamed("row", "node")
    postings = stored(_counted(heads.select("node", "n", F.explode("tokens").alias("token"))))
    cheap, costly = _cost(postings, factor)
    cheap, costly = cheap.select("node"), stored(costly.select("node"))
    pairs = stored(_candidates(postings, cheap, SHORT, NONE))
    dropped(postings)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(costly).distinct()
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", F.col("doc").alias("d"), F.col("h").alias("g")))
    here = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    found = _shingled(rows.join(here, (F.col("h") == F.col("g")) & F.col("doc").eqNullSafe(F.col("d"))).select("node", "_text"), whole=True).select("node", "n", "tokens")
    if not light.where("n > 0").groupBy("doc", "h").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["node"])  # repeated rows
    sets = stored(found)
    links = _similar(pairs, sets)
    dropped(pairs, wanted)
    for prefix, left_out in ((LONG, LEFT_OUT), (WHOLE, ALL_BUT_ONE)):
        if costly.isEmpty():
            break
        kept = stored(_lengthened(_only(sets, costly), prefix, left_out))
        settled, rest = _cost(kept, factor)
        more = _similar(_candidates(kept, settled.select("node"), prefix, left_out), sets)
        old, links = (links, more, costly), stored(links.union(more))
        costly = stored(rest.select("node"))
        dropped(*old)
        if prefix != WHOLE:
            dropped(kept)
    groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    if not costly.isEmpty():
        groups = _by_pivots(_only(kept, costly), sets, groups)
    joined = classes.join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    heads_of = joined.where("component is not null").groupBy("comp").agg(F.min("head").alias("first"))
    known = joined.where("rows > 1 or component is not null").join(heads_of, "comp", "left").select("set", F.coalesce("first", "head").alias("first"))
    out = held(
        light.join(known, "set", "left").select(
            "doc",
            "h",
            "n",
            F.when(F.col("first").isNull(), F.col("doc")).otherwise(F.col("first.doc")).alias("component"),
            F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("first"),
        )
    )
    dropped(read, classes, sets, links, costly, groups)
    return out


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", factor: int = 4) -> DataFrame:
    """One row for each input row: key, n_shingles, component_id, and first, whether the row stands for its component.

    Documents are linked if their sets of 5-word shingles have a Jaccard similarity of
    0.8 or more (100 * intersection >= 80 * union); component_id is the smallest key that links reach.
    Null keys don't count as smallest; a component of null keys has null. Null and wordless texts have
    no shingles and no links. Rows with equal sets are one class, equal rows too.
    The first row of a component (smallest key, then the order of reading) stands for it. Other columns aren't read. Sets are of 64-bit
    hashes. ``factor``: what candidates may cost, in shingles of the prefix. The result is a stored table; all tables
    made on the way are deleted.
    """
    out = _judged(df, text, key, factor)
    return out.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), "first")


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of ``near_duplicates``, with its own columns, whatever their names.

    Of rows that are equal in key and text one stays. Rows without words all stay.
    """
    judged = _judged(df, text, key, 4)
    return known_again(df, judged.select("doc", "h", F.col("first").alias("kept"), (F.col("n") > 0).alias("linked")), text, key)
