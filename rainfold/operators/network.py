"""Drainage networks: an edge table (cell_id, down_id), NULL for a pit.

Cells fall into blocks: squares of 64 x 64 cells where rows and columns are known, else runs of consecutive ids. Inside a block water is followed at
once, in memory. What leaves a block goes on over the network of the cells at which blocks are entered, which is much smaller, and
in which 8 x 8 blocks are one block; and so on, until one block is left. Then totals come down the same
levels. So the months of a cell, one array a cell, are read twice, however long the rivers are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bucketed, checkpointed, dropped

#: Cells of a block where only ids are known, and rows and columns of a square block: they bound what a task holds at once.
BLOCK = 4096
TILE = 64
#: Rows and columns of blocks that are one block on the next level, and nodes of a network that one task solves.
UP = 8
TOP = 50_000
#: Bits of a block's second coordinate.
BITS = 31


def block_of(c: str) -> Column:
    return F.floor(F.col(c) / BLOCK)


def square(row: Column, col: Column) -> Column:
    """The square block of a cell; rows and columns from 0."""
    return F.shiftleft(F.floor(row / TILE), BITS) + F.floor(col / TILE)


def with_blocks(drain: DataFrame) -> DataFrame:
    """(cell_id, down_id, block, down_block, entered): ``drain`` with the blocks of both cells, by squares if it has them from ``drain_edges``, and whether water of another block enters the cell."""
    if "down_block" not in drain.columns:
        drain = drain.select("cell_id", "down_id", *[F.shiftleft(block_of(c), BITS).alias(k) for c, k in (("cell_id", "block"), ("down_id", "down_block"))])
    if "entered" in drain.columns:
        return drain
    into = drain.where("block != down_block").select(F.col("down_id").alias("cell_id"), F.lit(True).alias("entered")).distinct()
    return drain.select("cell_id", "down_id", "block", "down_block").join(into, "cell_id", "left").withColumn("entered", F.coalesce("entered", F.lit(False)))


class Local:
    """The network inside a block: ids in order, the place of the cell below each one or -1, and where each one's water leaves."""

    def __init__(self, cell: np.ndarray, down: np.ndarray, cut: np.ndarray | None = None):
        """down: ids, -1 for pits; cut: cells at which the way ends, such as gauges."""
        order = np.argsort(cell)
        self.cell, self.down_id = cell[order], down[order]
        place = np.searchsorted(self.cell, self.down_id)
        inside = (place < len(cell)) & (self.down_id >= 0)
        inside[inside] = self.cell[place[inside]] == self.down_id[inside]
        self.below = np.where(inside, place, -1)
        self.cut = np.zeros(len(cell), bool) if cut is None else cut[order]
        self.way = np.where(self.cut, -1, self.below)
        self.levels = []
        todo = np.bincount(self.way[self.way >= 0], minlength=len(cell))
        front, seen = np.flatnonzero(todo == 0), 0
        while len(front):
            seen += len(front)
            front = front[np.argsort(self.way[front], kind="stable")]
            self.levels.append(front)
            to = self.way[front]
            to, times = np.unique(to[to >= 0], return_counts=True)
            todo[to] -= times
            front = to[todo[to] == 0]
        if seen < len(cell):
            raise ValueError("the network has a cycle")

    def add_up(self, values: np.ndarray) -> None:
        """Adds to each row all rows above it."""
        for front in self.levels:
            to = self.way[front]
            front, to = front[to >= 0], to[to >= 0]
            if len(to):
                first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                values[to[first]] += np.add.reduceat(values[front], first, axis=0)

    def sinks(self) -> np.ndarray:
        """Where each cell's water goes first: the cell itself if it is cut, a cut cell below, or the first cell of another block; -1 for a pit."""
        out = np.where(self.cut, self.cell, np.where(self.below < 0, self.down_id, -1))
        for front in reversed(self.levels):
            on = front[self.way[front] >= 0]
            out[on] = out[self.way[on]]
        return out

    def onward(self, sinks: np.ndarray) -> np.ndarray:
        """As sinks, but from behind a cut cell."""
        after = np.where(self.below >= 0, sinks[self.below], self.down_id)
        return np.where(self.cut, after, sinks)


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(-1).to_numpy().astype(np.int64)


def exits(drain: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(cell_id, sink, onward) of every cell, -1 for none: where its water first leaves its block or meets a cell of ``cuts`` (cell_id), itself included, and where it goes from there."""
    marked = drain.select("cell_id", "down_id", F.lit(False).alias("cut")) if cuts is None else drain.join(cuts.select("cell_id").distinct().withColumn("cut", F.lit(True)), "cell_id", "left").select("cell_id", "down_id", F.coalesce("cut", F.lit(False)).alias("cut"))

    def run(table: pa.Table) -> pa.Table:
        net = Local(_ids(table, "cell_id"), _ids(table, "down_id"), table.column("cut").to_numpy())
        sinks = net.sinks()
        return pa.table({"cell_id": net.cell, "sink": sinks, "onward": net.onward(sinks)})

    return marked.groupBy(block_of("cell_id").alias("block")).applyInArrow(run, "cell_id long, sink long, onward long")


def _entries(drain: DataFrame) -> DataFrame:
    """Cells that water of another block enters."""
    return drain.where(block_of("cell_id") != block_of("down_id")).select(F.col("down_id").alias("cell_id")).distinct()


def jump_table(drain: DataFrame) -> list[DataFrame]:
    """Where each cell's water is after 1, 2, 4, ... steps: (cell_id, to), without the cells that have left the table.

    The number of rounds is the logarithm of the longest path; more than the number of cells allows mean a cycle, a ValueError.
    """
    now = checkpointed(drain.where("down_id is not null").select("cell_id", F.col("down_id").alias("to")))
    tables = []
    for _ in range(now.count().bit_length() + 2):
        if now.isEmpty():
            return tables
        tables.append(now)
        onward = now.select(F.col("cell_id").alias("to"), F.col("to").alias("next"))
        now = checkpointed(now.join(onward, "to").select("cell_id", F.col("next").alias("to")))
    raise ValueError("the network has a cycle")


def _doubled(drain: DataFrame, flux: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, v, holes) added up along ``drain`` by pointer doubling: in round k each node adds what the nodes 2**k steps above hold."""
    now = flux
    for jump in jump_table(drain):
        moved = now.join(jump, "cell_id").select(F.col("to").alias("cell_id"), *keys[1:], "v", "holes")
        now = checkpointed(now.unionByName(moved).groupBy(*keys).agg(F.sum("v").alias("v"), F.sum("holes").alias("holes")))
    return now


def _matrix(table: pa.Table, size: int) -> np.ndarray:
    """A row of ``size`` numbers for each row of the table: its array v, or v at the places ``at``; NULL is NaN, no array is zeros."""
    out = np.zeros((table.num_rows, size))
    v = table.column("v").combine_chunks()
    lengths = np.diff(v.offsets.to_numpy())
    row = np.repeat(np.arange(table.num_rows), lengths)
    if "at" in table.column_names:
        at = table.column("at").combine_chunks().flatten().to_numpy()
    else:
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    np.add.at(out, (row, at), v.flatten().to_numpy(zero_copy_only=False))
    return out


def _flows(table: pa.Table, size: int, more: pa.Table | None = None) -> tuple[Local, np.ndarray, pa.Table]:
    """The network of the rows with an edge, all flows in it added up, and these rows in its order. more: (cell_id, v), further flows into cells."""
    edges = table.filter(table.column("edge")) if "edge" in table.column_names else table
    edges = edges.take(pa.array(np.argsort(_ids(edges, "cell_id"), kind="stable")))
    net = Local(_ids(edges, "cell_id"), _ids(edges, "down_id"))
    acc = np.zeros((len(net.cell), size))
    for rows in (table, more):
        if rows is not None and rows.num_rows and len(net.cell):
            cell = _ids(rows, "cell_id")
            place = np.minimum(np.searchsorted(net.cell, cell), len(net.cell) - 1)
            known = net.cell[place] == cell
            np.add.at(acc, place[known], _matrix(rows, size)[known])
    net.add_up(acc)
    return net, acc, edges


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(flat, mask=np.isnan(flat)))


def _leaving(table: pa.Table, size: int, by: tuple[str, ...]) -> pa.Table:
    """What leaves a block, by the cell that it enters, and where the water of the block's own entered cells leaves it."""
    net, acc, edges = _flows(table, size)
    down_block, entered = _ids(edges, "down_block"), edges.column("entered").to_numpy(zero_copy_only=False).astype(bool)
    out = np.flatnonzero((net.below < 0) & (net.down_id >= 0))
    target, first, place = np.unique(net.down_id[out], return_index=True, return_inverse=True)
    total = np.zeros((len(target), size))
    np.add.at(total, place, acc[out])
    leave = np.arange(len(net.cell))
    for front in reversed(net.levels):
        on = front[net.way[front] >= 0]
        leave[on] = leave[net.way[on]]
    own = np.flatnonzero(entered)
    ends = leave[own]
    none = np.full(len(target), -1)
    columns = {
        "cell_id": np.concatenate([target, net.cell[own]]), "block": np.concatenate([down_block[out][first], _ids(edges, "block")[own]]),
        "down_id": np.concatenate([none, net.down_id[ends]]), "down_block": np.concatenate([none, np.where(net.down_id[ends] >= 0, down_block[ends], -1)]),
        "edge": np.arange(len(target) + len(own)) >= len(target),
    }
    made = {k: table.column(k).take(pa.array(np.zeros(len(target) + len(own), np.int64))) for k in by}
    return pa.table(made | {k: pa.array(v) for k, v in columns.items()} | {"v": _lists(np.concatenate([total, np.zeros((len(own), size))]))})


def _kinds(df: DataFrame, names: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"{k} {t}" for k, t in df.select(*names).dtypes)


def _totals(net: DataFrame, size: int, by: tuple[str, ...], hand_on: tuple[str, ...], made: Callable[[pa.Table], pa.Table] | None = None, kinds: str = "") -> DataFrame:
    """(*by, cell_id, *hand_on, v): all flows into each cell of ``net`` and its own. ``net``: a stored table (*by, block, cell_id, down_id, down_block, entered, v, perhaps edge and at).

    With ``made`` these columns, and those to hand on, don't lie in ``net`` but are made of a block's rows in it, twice, so they are never stored. ``kinds`` are then those of cell_id and ``hand_on``.
    """
    needed = [c for c in (*by, "block", "cell_id", "down_id", "down_block", "entered", "edge", "at", "v") if c in net.columns] if made is None else net.columns
    ready = made or (lambda t: t)
    keys = ["block", *by]
    up = checkpointed(net.select(*needed).groupBy(*keys).applyInArrow(lambda t: _leaving(ready(t), size, by), "".join(f"{k} {t}, " for k, t in net.select(*by).dtypes) + "cell_id long, block long, down_id long, down_block long, edge boolean, v array<double>"))
    n = up.count()
    if n > TOP:
        shift = UP.bit_length() - 1
        higher = lambda c: F.shiftleft(F.shiftright(c, BITS + shift), BITS) + F.shiftright(F.col(c).bitwiseAND((1 << BITS) - 1), shift)
        nodes = up.select(*by, F.col("block").alias("home"), higher("block").alias("block"), "cell_id", "down_id", F.when(F.col("down_id") >= 0, higher("down_block")).otherwise(-1).alias("down_block"), "edge", "v")
        into = nodes.where("edge and down_id >= 0 and block != down_block").select(*by, F.col("down_id").alias("cell_id"), F.lit(True).alias("entered")).distinct()
        nodes = checkpointed(nodes.join(into, [*by, "cell_id"], "left").withColumn("entered", F.coalesce("entered", F.lit(False))))
        inflow = checkpointed(_totals(nodes, size, by, ("home",)).select(*by, F.col("home").alias("block"), "cell_id", "v"))
        dropped(nodes, up)
    else:  # one block, or one for each parameter set
        inflow = up.withColumn("_one", F.lit(0)).groupBy("_one", *by).applyInArrow(lambda t: _solved(t, size, by), "".join(f"{k} {t}, " for k, t in net.select(*by).dtypes) + "block long, cell_id long, v array<double>")
    columns = list(dict.fromkeys([*by, "cell_id", *hand_on]))
    kinds = f"{kinds or _kinds(net, columns)}, v array<double>"
    nothing = net.sparkSession.createDataFrame([], kinds).toArrow()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return nothing
        _, acc, edges = _flows(ready(left), size, right)
        return edges.select(columns).append_column("v", _lists(acc))

    left = net.select(*dict.fromkeys([*needed, *(hand_on if made is None else ())]))
    return left.groupBy(*keys).cogroup(inflow.groupBy(*keys)).applyInArrow(run, kinds)


def _solved(table: pa.Table, size: int, by: tuple[str, ...]) -> pa.Table:
    """The flows of a network that is one block: (*by, block, cell_id, v)."""
    _, acc, edges = _flows(table, size)
    return edges.select([*by, "block", "cell_id"]).append_column("v", _lists(acc))


def accumulate_packed(net: DataFrame, size: int, by: tuple[str, ...] = (), hand_on: tuple[str, ...] = (), made: Callable[[pa.Table], pa.Table] | None = None, kinds: str = "") -> DataFrame:
    """(*by, cell_id, *hand_on, v): the arrays ``v`` of ``size`` numbers, own and of all cells upstream added up. ``net``: a stored table with the columns of ``with_blocks`` and v.

    Where ``net`` has buckets by block, its rows aren't shuffled. A NULL makes its place NULL in all cells below. ``made``, ``kinds``: see ``_totals``.
    """
    return _totals(net, size, by, hand_on, made, kinds)


NETWORK = ("block", "down_id", "down_block", "entered")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One row a cell with all its numbers as an array, from rows (cell_id, the columns of NETWORK, _place, v), grouped by block where they lie."""

    def run(table: pa.Table) -> pa.Table:
        ids, first, row = np.unique(_ids(table, "cell_id"), return_index=True, return_inverse=True)
        acc = np.zeros((len(ids), size))
        np.add.at(acc, (row, table.column("_place").to_numpy()), table.column("v").to_numpy())
        return table.select(["cell_id", *NETWORK]).take(pa.array(first)).append_column("v", _lists(acc))

    return rows.groupBy("block").applyInArrow(run, f"{_kinds(rows, ['cell_id', *NETWORK])}, v array<double>")


def accumulate(drain: DataFrame | None, flux: DataFrame, value: str = "value", by: tuple[str, ...] = ("step",), carry: tuple[str, ...] = ()) -> DataFrame:
    """(cell_id, *by, *carry, value): own flux and that of all cells upstream, for every cell of ``drain`` and every ``by`` that occurs.

    ``drain`` may be None if ``flux`` has the columns of ``with_blocks`` itself, as a stored basin has: it isn't shuffled then.
    ``carry``: columns of ``flux``, which then has one row a cell and ``by``, to hand on; only its rows come out then.
    Months are few, so the cells' fluxes become one array a cell. A NULL flux makes all cells below it NULL; a missing row adds nothing. Flux of
    cells without a row in ``drain`` doesn't come out.
    """
    spark = flux.sparkSession
    found = flux.select(*by).distinct().orderBy(*by).collect() if by else [()]  # months and parameter sets
    places = spark.createDataFrame([(k, *r) for k, r in enumerate(found)], f"_place int, {_kinds(flux, by)}" if by else "_place int")
    numbers = flux.select("cell_id", *by, *(NETWORK if drain is None else ()), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"))
    numbered = numbers.join(F.broadcast(places), list(by)) if by else numbers.withColumn("_place", F.lit(0))
    if drain is None:
        net = bucketed(_packed(numbered.drop(*by), len(found)), "block", placed=True)
    else:
        cells = numbered.groupBy("cell_id").agg(F.collect_list("_place").alias("at"), F.collect_list("v").alias("v"))
        none = (F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("v", F.array().cast("array<double>")).alias("v"))
        net = bucketed(with_blocks(drain).join(cells, "cell_id", "left").select("cell_id", *NETWORK, *none), "block")
    out = accumulate_packed(net, len(found)).select("cell_id", F.posexplode("v").alias("_place", value))
    out = (out.join(F.broadcast(places), "_place") if by else out).select("cell_id", *by, value)
    return out.join(flux.select("cell_id", *by, *carry), ["cell_id", *by]).select("cell_id", *by, *carry, value) if carry else out


def gauge_catchments(drain: DataFrame, gauges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catchments without repetition: (cell_id, gauge), the first gauge cell that each cell's water passes, its own included, and the tree (cell_id, down_id) of gauge cells.

    A gauge's whole catchment is its own cells and those of the gauges above it in the tree. Cells whose water passes no gauge have no row.
    """
    ways = checkpointed(exits(drain, gauges))
    at = gauges.select("cell_id").distinct().withColumn("gauge", F.lit(True))
    nodes = ways.join(_entries(drain).union(at.select("cell_id")).distinct(), "cell_id", "left_semi").join(at, "cell_id", "left")
    # each node's first gauge: gauges end the way, all others jump on, twice as far each round
    now = checkpointed(nodes.select("cell_id", F.when(F.col("gauge"), F.col("cell_id")).when(F.col("sink") >= 0, F.col("sink")).alias("to"), F.coalesce("gauge", F.lit(False)).alias("done")))
    for _ in range(now.count().bit_length() + 2):
        if now.where(~F.col("done") & F.col("to").isNotNull()).isEmpty():
            break
        onward = now.select(F.col("cell_id").alias("to"), F.col("to").alias("next"), F.col("done").alias("there"))
        ahead = now.where(~F.col("done") & F.col("to").isNotNull()).join(onward, "to", "left")
        now = checkpointed(now.where(F.col("done") | F.col("to").isNull()).unionByName(ahead.select("cell_id", F.col("next").alias("to"), F.coalesce("there", F.lit(False)).alias("done"))))
    else:
        raise ValueError("the network has a cycle")
    first = now.where("done").select(F.col("cell_id").alias("sink"), F.col("to").alias("gauge"))
    cells = ways.join(first, "sink").select("cell_id", "gauge")
    tree = ways.join(at, "cell_id", "left_semi").select("cell_id", F.col("onward").alias("sink")).join(first, "sink", "left").select("cell_id", F.col("gauge").alias("down_id"))
    return cells, tree


def accumulate_at_gauges(drain: DataFrame, gauges: DataFrame, flux: DataFrame, value: str = "value", by: tuple[str, ...] = ("step",)) -> DataFrame:
    """(station_id, *by, value): flux of each gauge's whole catchment, when station series are all that is wanted.

    One aggregation by first gauge, then sums along the tree of gauges (cell_id, station_id). NULL flux makes all gauges below it NULL.
    """
    cells, tree = gauge_catchments(drain, gauges)
    own = flux.join(cells, "cell_id").groupBy(F.col("gauge").alias("cell_id"), *by).agg(F.sum(F.col(value).cast("double")).alias("v"), F.count_if(F.col(value).isNull()).alias("holes"))
    total = _doubled(tree, checkpointed(own.withColumn("v", F.coalesce("v", F.lit(0.0)))), ["cell_id", *by])
    return total.join(gauges.select("cell_id", "station_id"), "cell_id").select("station_id", *by, F.when(F.col("holes") == 0, F.col("v")).alias(value))


def recession_smooth(df: DataFrame, x: float, value: str = "value", key: str = "cell_id", out: str = "smooth") -> DataFrame:
    """q_t = x * q_(t-1) + (1 - x) * value_t for each key in order of step, from 0. NULL makes the rest of the key NULL.

    One array of months a key (rows that have it already: ``smooth_packed``).
    """
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), F.col(value).cast("double").alias("v")))).alias("s"))
    return smooth_packed(packed, x, value, key, out)


def smooth_packed(packed: DataFrame, x: float, value: str = "value", key: str = "cell_id", out: str = "smooth") -> DataFrame:
    """As ``recession_smooth``, from one row a key with its months as an array ``s`` of (step, v) in order of step, as a packed fold gives them: nothing is shuffled.

    All keys of a batch are smoothed together, month by month, so the work is linear in the months.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column("s")
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            v = flat.field("v").to_numpy(zero_copy_only=False)
            q, sizes = np.full(len(v), np.nan), np.diff(offsets)
            now = np.zeros(len(sizes))
            for t in range(int(sizes.max(initial=0))):
                on = np.flatnonzero(sizes > t)
                now[on] = q[offsets[on] + t] = x * now[on] + (1 - x) * v[offsets[on] + t]
            rows = pa.StructArray.from_arrays([flat.field("step"), flat.field("v"), pa.array(q, mask=np.isnan(q))], ["step", "v", "q"])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], names=["k", "s"])

    kind = dict(packed.dtypes)[key]
    folded = packed.select(F.col(key).alias("k"), "s").mapInArrow(run, f"k {kind}, s array<struct<step:int,v:double,q:double>>")
    return folded.select(F.col("k").alias(key), F.inline("s")).select(key, "step", F.col("v").alias(value), F.col("q").alias(out))
