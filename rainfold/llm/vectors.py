"""Near duplicates of embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and rotated to their principal axes, the strongest first; a rotation keeps every product. Tiles of up
to 4096 vectors of one label are compared in pairs: products of the leading dimensions are added up first, and the rest of a product is at most the
product of the two suffix norms, so a pair is dropped as soon as its cosine can't reach the threshold any more. Tiles
are cut along the first axis, and two tiles don't even meet if the boxes around their leading coordinates are too far apart.

A comparison returns how many links each vector has, as one array a tile, and links between
parts that aren't connected yet. So a large group of near copies makes few rows, although every link in it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, held, looked_up, quoted, stored
from .components import connected_components

TILE = 4096
#: Leading coordinates of the box around a tile.
BOX = 8
#: Allowance for rounding in bounds; products this close to the threshold are computed again from the vectors as given.
NEAR = 1e-9


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the axes of all unit vectors, the strongest first, as columns. Only d * d sums come to the driver, whatever the number of vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                x = _unit(_matrix(batch.column("vec").filter(pa.array(dims == d))))
                found[int(d)] = found.get(int(d), 0) + x.T @ x
        for d, m in found.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(i), d, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": m[i, j]})

    total = reps.select("dim", "vec").mapInArrow(sums, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()
    moments: dict[int, np.ndarray] = {}
    for r in total:
        m = moments.setdefault(r.dim, np.zeros((r.dim, r.dim)))
        m[r.i, r.j] = m[r.j, r.i] = r.v
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in moments.items()}


class Tile:
    """Unit vectors on their axes with the norms of what follows each step of dimensions."""

    def __init__(self, given: np.ndarray, axes: np.ndarray):
        self.given, self.x = given, _unit(given) @ axes
        d = given.shape[1]
        self.steps = sorted({-(-d // 8), -(-d // 4), -(-d // 2), d})
        left = np.concatenate([np.cumsum((self.x**2)[:, ::-1], 1)[:, ::-1], np.zeros((len(given), 1))], 1)
        self.rest = {k: np.sqrt(left[:, k]) for k in self.steps}


def links(a: Tile, b: Tile, threshold: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (places in a, places in b) whose cosine reaches the threshold, for some rows of a at a time."""
    first, low = a.steps[0], threshold - NEAR
    for at in range(0, len(a.x), block):
        rows = slice(at, at + block)
        dot = a.x[rows, :first] @ b.x[:, :first].T
        i, j = np.nonzero(dot + a.rest[first][rows, None] * b.rest[first] >= low)
        s = dot[i, j]
        for k, to in zip(a.steps, a.steps[1:], strict=False):
            if len(i) > dot.size // 16:  # dense: a product of matrices is cheaper than pairs
                dot = a.x[rows, :to] @ b.x[:, :to].T
                s = dot[i, j]
            else:
                for p in range(0, len(i), 65_536):
                    q = slice(p, p + 65_536)
                    s[q] += np.einsum("nd,nd->n", a.x[at + i[q], k:to], b.x[j[q], k:to])
            open_ = s + a.rest[to][at + i] * b.rest[to][j] >= low
            i, j, s = i[open_], j[open_], s[open_]
        close = np.flatnonzero(np.abs(s - threshold) <= NEAR)
        if len(close):
            x, y = a.given[at + i[close]], b.given[j[close]]
            x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
            s[close] = np.einsum("nd,nd->n", x, y) / np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y))
        real = s >= threshold
        yield at + i[real], j[real]


def _root(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Unites the parts of u and v; the links that did unite two parts."""
    made = []
    for x, y in {(min(p), max(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}:
        p, q = _root(parent, x), _root(parent, y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            made.append((p, q))
    return made


def _own_links(t: Tile, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a tile, how many rows of others it is linked with, and the first vector of its connected part."""
    count, part = np.zeros(len(copies), np.int64), np.arange(len(copies))
    for i, j in links(t, t, threshold):
        other = i != j
        i, j = i[other], j[other]
        np.add.at(count, i, copies[j])
        u, v, to = part[i], part[j], np.arange(len(copies))
        while len(u):  # the smallest name among linked parts spreads
            least = np.minimum(to[u], to[v])
            np.minimum.at(to, u, least)
            np.minimum.at(to, v, least)
            if (to[u] == to[v]).all():
                break
        part = to[part]
    return count, part


def _cut(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], threshold: float, size: int) -> Iterator[pa.RecordBatch]:
    """Tiles of rows that come in order of label, length and first coordinate."""
    made = 0

    def tile(label, dim, rows: pa.Table) -> pa.RecordBatch:
        nonlocal made
        vec = rows.column("vec").combine_chunks()
        given, copies = _matrix(vec), rows.column("copies").to_numpy()
        t = Tile(given, axes[dim])
        count, part = _own_links(t, copies, threshold)
        name = (TaskContext.get().partitionId() << 32) + made
        made += 1
        out = {
            "label": pa.array([label], rows.schema.field("label").type), "dim": pa.array([dim], pa.int32()), "tile": pa.array([name], pa.int64()),
            "low": [t.x[:, :BOX].min(0).tolist()], "high": [t.x[:, :BOX].max(0).tolist()],
            "ids": [rows.column("id").to_pylist()], "nos": [rows.column("no").to_pylist()], "copies": [copies.tolist()], "counts": [count.tolist()], "part": [part.tolist()],
            "data": pa.array([vec.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(out)

    waiting: list[pa.RecordBatch] = []
    key, n = None, 0
    for batch in batches:
        label, dim = batch.column("label"), batch.column("dim").to_numpy()
        codes = label.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (dim[1:] != dim[:-1])) + 1
        for at, to in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if at == to:
                continue
            here = (label[int(at)].as_py(), int(dim[at]))
            if here != key and n:
                yield tile(*key, pa.Table.from_batches(waiting))
                waiting, n = [], 0
            key = here
            while at < to:
                take = min(int(to - at), size - n)
                waiting.append(batch.slice(int(at), take))
                n, at = n + take, at + take
                if n == size:
                    yield tile(*key, pa.Table.from_batches(waiting))
                    waiting, n = [], 0
    if n:
        yield tile(*key, pa.Table.from_batches(waiting))


def _compared(table: pa.Table, axes: dict[int, np.ndarray], threshold: float, kind: type) -> pa.Table:
    """Two tiles: for each the links of its vectors into the other, and links of ids between their parts."""
    rows = table.to_pylist()
    dim = rows[0]["dim"]
    a, b = (Tile(np.frombuffer(r["data"], kind).astype(np.float64).reshape(-1, dim), axes[dim]) for r in rows)
    copies = [np.array(r["copies"]) for r in rows]
    counts = [np.zeros(len(c), np.int64) for c in copies]
    part = np.concatenate([np.array(rows[0]["part"]), len(copies[0]) + np.array(rows[1]["part"])])
    root, edges = part.copy(), []
    n = len(part)
    for i, j in links(a, b, threshold):
        np.add.at(counts[0], i, copies[1][j])
        np.add.at(counts[1], j, copies[0][i])
        pairs = np.unique(part[i] * n + part[len(copies[0]) + j])  # parts linked, once each
        edges += _joined(root, pairs // n, pairs % n)
    if not any(c.any() for c in counts):
        rows = []
    ids = np.array([*rows[0]["ids"], *rows[1]["ids"]], np.int64) if rows else None
    return pa.table({
        "tile": pa.array([r["tile"] for r in rows], pa.int64()),
        "counts": pa.array([c.tolist() for c in counts[: len(rows)]], pa.list_(pa.int64())),
        "src": pa.array([[int(ids[p]) for p, _ in edges], []][: len(rows)], pa.list_(pa.int64())),
        "dst": pa.array([[int(ids[q]) for _, q in edges], []][: len(rows)], pa.list_(pa.int64())),
    })


def _summed(table: pa.Table) -> pa.Table:
    """The counts of one tile from all comparisons, added up."""
    counts = table.column("counts")
    total = np.zeros(len(counts[0]), np.int64)
    for c in counts:
        total += np.array(c.as_py())
    return pa.table({"tile": table.column("tile").slice(0, 1), "cross": pa.array([total.tolist()], pa.list_(pa.int64()))})


def near_vectors(df: DataFrame, threshold: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id", tile: int = TILE) -> DataFrame:
    """One row for each row: key, n_links, component_id, kept (it is the smallest of its component).

    Two rows are linked if their labels are equal and not null, their vectors have one length and their cosine reaches ``threshold`` (above 0). A
    null, empty or zero vector and one with a null or a number that isn't finite links with nothing, nor does a row without key: its component is its own key, so null.
    n_links counts rows, equal ones too. Rows with one key are one node of the components. Other columns are not read.
    Equal vectors of a label are compared once. The result is a stored table.
    """
    v, inside = F.col("vec"), F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(label)).alias("label"), F.col(quoted(vector)).alias("vec"))
    if dict(rows.dtypes)["vec"] != "array<float>":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    big = F.lit(float("inf"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < big)), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))  # NaN is larger than infinity
    rows = rows.withColumn("known", F.struct(F.xxhash64("label", "vec").alias("a"), F.hash("vec", "label").alias("b")))
    good = F.coalesce(inside & finite, F.lit(False))
    reps = stored(rows.where(good).groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("known").alias("known")).withColumns({"dim": F.size("vec"), "no": F.monotonically_increasing_id()}))
    kind = np.float32 if dict(rows.dtypes)["vec"] == "array<float>" else np.float64
    axes = principal_axes(reps)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, at = batch.column("dim").to_numpy(), np.zeros(batch.num_rows)
            for d in np.unique(dims):
                own = dims == d
                at[own] = _unit(_matrix(batch.column("vec").filter(pa.array(own)))) @ axes[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])

    spark = df.sparkSession
    wanted = reps.select("label", "dim", "id", "no", "copies", "vec")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() // tile)))
    n = max(n, -(-reps.count() // (64 * tile)))
    ordered = wanted.mapInArrow(placed, wanted.withColumn("at", F.lit(0.0)).schema).repartitionByRange(n, "label", "dim", "at", "id").sortWithinPartitions("label", "dim", "at", "id")
    arrays = "low array<double>, high array<double>, ids array<long>, nos array<long>, copies array<long>, counts array<long>, part array<long>, data binary"
    label_kind = dict(rows.dtypes)["label"]
    tiles = stored(ordered.drop("at").mapInArrow(lambda batches: _cut(batches, axes, threshold, tile), f"label {label_kind}, dim int, tile long, {arrays}"))
    meta = tiles.select("label", "dim", "tile", "low", "high")
    other = meta.select("label", "dim", F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    pairs = stored(meta.join(other, ["label", "dim"]).where((F.col("tile") < F.col("tile2")) & (far <= 2 - 2 * threshold + NEAR)).select("tile", "tile2"))
    sides = pairs.select(F.explode(F.array("tile", "tile2")).alias("t"), "tile", "tile2").toDF("t", "a", "b")
    both = sides.join(tiles.select(F.col("tile").alias("t"), "dim", "ids", "copies", "part", "data"), "t").withColumnRenamed("t", "tile")
    compared = stored(both.groupBy("a", "b").applyInArrow(lambda table: _compared(table, axes, threshold, kind), "tile long, counts array<long>, src array<long>, dst array<long>"))
    cross = compared.groupBy("tile").applyInArrow(_summed, "tile long, cross array<long>")
    inner = tiles.select(F.explode(F.arrays_zip("ids", "part")).alias("x"), "ids").select(F.col("x.ids").alias("src"), F.get("ids", F.col("x.part").cast("int")).alias("dst")).where("src != dst")
    edges = stored(inner.union(compared.select(F.explode(F.arrays_zip("src", "dst")).alias("x")).select("x.src", "x.dst")))
    found = connected_components(edges)
    zero = F.coalesce("cross", F.array_repeat(F.lit(0).cast("long"), F.size("ids")))
    counted = tiles.join(cross, "tile", "left").select(F.explode(F.arrays_zip("nos", "copies", "counts", zero.alias("cross"))).alias("x"))
    counted = counted.select(F.col("x.nos").alias("no"), (F.col("x.counts") + F.col("x.cross") + F.col("x.copies") - 1).alias("n_links"))
    return _told(rows, good, reps, counted, found, key, (reps, tiles, pairs, compared, edges, found))


def _told(rows: DataFrame, good, reps: DataFrame, counted: DataFrame, found: DataFrame, key: str, tables: tuple[DataFrame, ...]) -> DataFrame:
    """The results of distinct vectors for all rows."""
    of = stored(
        reps.select("no", "known", "id", "copies").join(counted, "no").join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("known", F.col("copies").alias("weight"), "n_links", F.coalesce("component", "id").alias("component_id"))
    )
    linked = looked_up(rows.where(good).select("id", "known"), of, "known", "weight").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = held(linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))
    dropped(*tables, of)
    return out
