"""Neighbours, slope, drain directions and depressions of a grid of cells."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import square
from .storage import checkpointed, dropped

#: Keypad code of each neighbour: row and column offset (fixed values; row 0 is the north edge).
OFFSETS = {7: (-1, -1), 8: (-1, 0), 9: (-1, 1), 4: (0, -1), 6: (0, 1), 1: (1, -1), 2: (1, 0), 3: (1, 1)}

#: Rows and columns of a tile.
TILE = 64


def neighbours(cells: DataFrame, value: str = "dem") -> DataFrame:
    """(cell_id, code, neighbour_id, value, neighbour_value) for the up to eight neighbours that exist. One equi-join on (row, col)."""
    moves = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for code, (dr, dc) in OFFSETS.items()])
    around = cells.select("cell_id", F.col(value).alias("value"), "row", "col", F.explode(moves).alias("m"))
    wanted = around.select("cell_id", "value", F.col("m.code").alias("code"), (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"))
    there = cells.select("row", "col", F.col("cell_id").alias("neighbour_id"), F.col(value).alias("neighbour_value"))
    return wanted.join(there, ["row", "col"]).select("cell_id", "code", "neighbour_id", "value", "neighbour_value")


def _tiled(cells: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """(i, j, cell_id, row, col, z): each cell in its tile and in those of its neighbours, so that a tile has the ring of cells around it. A sixteenth of the cells goes to more than one tile."""
    around = F.array_distinct(F.array(*[F.struct(F.floor((F.col("row") + dr) / tile).alias("i"), F.floor((F.col("col") + dc) / tile).alias("j")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]))
    inner = F.pmod("row", F.lit(tile)).between(1, tile - 2) & F.pmod("col", F.lit(tile)).between(1, tile - 2)
    own = F.array(F.struct(F.floor(F.col("row") / tile).alias("i"), F.floor(F.col("col") / tile).alias("j")))
    placed = cells.select("cell_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("z"), F.explode(F.when(inner, own).otherwise(around)).alias("t"))
    return placed.select("t.i", "t.j", "cell_id", "row", "col", "z")


def _grid(table: pa.Table, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tile with its ring as arrays of 66 x 66: heights (NaN where unknown) and whether there is a cell; rows and columns of the tile's own cells in them, and their places in the table."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    row, col = table.column("row").to_numpy() - i * tile + 1, table.column("col").to_numpy() - j * tile + 1
    z, there = np.full((tile + 2, tile + 2), np.nan), np.zeros((tile + 2, tile + 2), bool)
    z[row, col], there[row, col] = table.column("z").to_numpy(), True
    own = np.flatnonzero((row > 0) & (row <= tile) & (col > 0) & (col <= tile))
    return z, there, row[own], col[own], own


def relief(cells: DataFrame, cell_size: float = 1.0, value: str = "dem") -> DataFrame:
    """(cell_id, slope, ldd): slope and drain direction of each cell from one pass over tiles with their rings, as 3 x 3 stencils.

    Slope: third-order finite difference (Horn 1981) as rise over run; a neighbour that is missing or NULL counts as the centre, and a NULL height has no slope.
    ldd: the keypad code of the steepest way down, 5 for a pit and for a NULL height; among equally steep ways the smallest code.
    """

    def run(table: pa.Table) -> pa.Table:
        z, there, row, col, own = _grid(table)
        mid = z[row, col]
        near = {code: z[row + dr, col + dc] for code, (dr, dc) in OFFSETS.items()}
        lift = {code: np.where(np.isnan(n), 0.0, n - mid) for code, n in near.items()}
        east, west, south, north = (2 * lift[a] + lift[b] + lift[c] for a, b, c in ((6, 9, 3), (4, 7, 1), (2, 1, 3), (8, 7, 9)))
        dx, dy = (east - west) / (8 * cell_size), (south - north) / (8 * cell_size)
        best, ldd = np.zeros(len(mid)), np.full(len(mid), 5)
        for code in sorted(OFFSETS):
            drop = (mid - near[code]) / (cell_size * 2**0.5 if code in (7, 9, 1, 3) else cell_size)
            steeper = drop > best  # not where either height is unknown
            best, ldd = np.where(steeper, drop, best), np.where(steeper, code, ldd)
        return pa.table({"cell_id": table.column("cell_id").take(pa.array(own)), "slope": pa.array(np.sqrt(dx * dx + dy * dy), mask=np.isnan(mid)), "ldd": pa.array(ldd.astype(np.int32))})

    return _tiled(cells, value).groupBy("i", "j").applyInArrow(run, f"cell_id {dict(cells.dtypes)['cell_id']}, slope double, ldd int")


def slope(cells: DataFrame, cell_size: float, value: str = "dem") -> DataFrame:
    """(cell_id, slope) as of ``relief``."""
    return relief(cells, cell_size, value).select("cell_id", "slope")


def drain_direction(cells: DataFrame, cell_size: float = 1.0, value: str = "dem") -> DataFrame:
    """(cell_id, ldd) as of ``relief``."""
    return relief(cells, cell_size, value).select("cell_id", "ldd")


def drain_edges(cells: DataFrame, ldd: str = "ldd") -> DataFrame:
    """(cell_id, down_id, block, down_block): where each cell drains, NULL for pits and for directions out of the table, and the square blocks of both."""
    pick = lambda k: F.coalesce(*[F.when(F.col(ldd) == code, F.lit(move[k])) for code, move in OFFSETS.items()])
    to = cells.select("cell_id", square(F.col("row"), F.col("col")).alias("block"), (F.col("row") + pick(0)).alias("row"), (F.col("col") + pick(1)).alias("col"))
    there = cells.select("row", "col", F.col("cell_id").alias("down_id"), square(F.col("row"), F.col("col")).alias("down_block"))
    return to.join(there, ["row", "col"], "left").select("cell_id", "down_id", "block", "down_block")


#: The node outside, to which all water goes.
OUT = -1
#: Tiles along a side of a group on the next level, and edges that one task solves.
UP = 8
TOP = 400_000


def _flood(n: int, near: list[list[int]], z: list[float], start: list[tuple[float, int, int]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Floods a graph of n places from several sources at once (level, place, label), lowest water first.

    Returns each place's level and, for labels that meet, the ways (label, label, level) that join them first: a least
    spanning tree of the labels, by the highest point of a way.
    """
    level, label = [float("inf")] * n, [0] * n
    parent: dict[int, int] = {x: x for _, _, x in start}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    heap = [(h, 0, k, x, -1, 0) for h, k, x in start]
    heapq.heapify(heap)
    ways = []
    while heap:
        h, meeting, k, x, _, y = heapq.heappop(heap)
        if meeting:
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                ways.append((x, y, h))
            continue
        if level[k] <= h and level[k] != float("inf"):
            if label[k] != x:  # two labels at one place
                heapq.heappush(heap, (h, 1, k, x, k, label[k]))
            continue
        level[k], label[k] = h, x
        for m in near[k]:
            if level[m] == float("inf"):
                heapq.heappush(heap, (max(h, z[m]), 0, m, x, k, 0))
            elif label[m] != x:
                heapq.heappush(heap, (max(h, level[m]), 1, m, x, k, label[m]))
    return level, ways


def _cell_graph(table: pa.Table, tile: int) -> tuple:
    """The own cells of a tile as a graph: (ids, heights, neighbours, whether each lacks a neighbour, whether each lies on the tile's border, rows, columns). Cells of NULL height have no neighbours."""
    z, there, row, col, own = _grid(table, tile)
    place = np.full(z.shape, -1, np.int64)
    mid = z[row, col]
    known = ~np.isnan(mid)
    place[row[known], col[known]] = np.flatnonzero(known)
    around = np.stack([place[row + dr, col + dc] for dr, dc in OFFSETS.values()], 1)
    lacks = ~np.all([there[row + dr, col + dc] for dr, dc in OFFSETS.values()], axis=0)
    near = [[m for m in line if m >= 0] if ok else [] for line, ok in zip(around.tolist(), known.tolist(), strict=True)]
    border = (row == 1) | (row == tile) | (col == 1) | (col == tile)
    full = table.take(pa.array(own))
    return full.column("cell_id").to_numpy(), mid, near, lacks & known, border & known, full.column("row").to_numpy(), full.column("col").to_numpy()


WAYS = "kind int, a long, b long, h double, row int, col int"


def _joined(table: pa.Table, tile: int) -> pa.Table:
    """Of a tile: its border cells (kind 0: a, height, row, col) and the lowest ways between them and to the outside (kind 1: a, b, h)."""
    ids, z, near, lacks, border, row, col = _cell_graph(table, tile)
    start = [(float(z[k]), k, int(ids[k])) for k in np.flatnonzero(border)] + [(float(z[k]), k, OUT) for k in np.flatnonzero(lacks)]
    _, ways = _flood(len(ids), near, z.tolist(), start)
    return _ways([(int(ids[k]), float(z[k]), int(row[k]), int(col[k])) for k in np.flatnonzero(border)], ways)


def _ways(nodes: list[tuple[int, float, int, int]], ways: list[tuple[int, int, float]]) -> pa.Table:
    out = [(0, a, 0, h, r, c) for a, h, r, c in nodes] + [(1, a, b, h, 0, 0) for a, b, h in ways]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["kind", "a", "b", "h", "row", "col"])


def _node_graph(table: pa.Table) -> tuple[dict[int, int], list[float], list[list[tuple[int, float]]], list[tuple[int, int, int]]]:
    """Border cells and ways of some tiles as a graph; cells of two tiles that touch are joined at the higher of the two. The outside is place 0."""
    kind, a, b, h, row, col = (table.column(c).to_pylist() for c in ("kind", "a", "b", "h", "row", "col"))
    at, z, spots = {OUT: 0}, [float("-inf")], {}
    places = []
    for k, x, height, r, c in zip(kind, a, h, row, col, strict=True):
        if k == 0:
            at[x] = spots[r, c] = len(z)
            z.append(height)
            places.append((x, r, c))
    near: list[list[tuple[int, float]]] = [[] for _ in z]
    for k, x, y, height in zip(kind, a, b, h, strict=True):
        if k == 1:
            near[at[x]].append((at[y], height))
            near[at[y]].append((at[x], height))
    for (r, c), k in spots.items():
        for dr, dc in OFFSETS.values():
            m = spots.get((r + dr, c + dc))
            if m is not None:
                near[k].append((m, max(z[k], z[m])))
    return at, z, near, places


def _levels(near: list[list[tuple[int, float]]], start: list[tuple[float, int]]) -> list[float]:
    """The lowest level at which water from each place reaches one of ``start``."""
    level = [float("inf")] * len(near)
    heap = list(start)
    heapq.heapify(heap)
    while heap:
        h, k = heapq.heappop(heap)
        if h < level[k]:
            level[k] = h
            for m, height in near[k]:
                if level[m] == float("inf"):
                    heapq.heappush(heap, (max(h, height), m))
    return level


def _contracted(table: pa.Table, side: int) -> pa.Table:
    """Of a group of tiles: its own border cells and the lowest ways between them and to the outside, as a least spanning tree (Kruskal) of which places inside are taken out."""
    at, z, near, places = _node_graph(table)
    border = [(x, z[at[x]], r, c) for x, r, c in places if r % side in (0, side - 1) or c % side in (0, side - 1)]
    wanted = {at[x] for x, *_ in border} | {0}
    edges = sorted((h, k, m) for k, line in enumerate(near) for m, h in line if k < m)
    parent, label = list(range(len(z))), {k: k for k in wanted}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    name = {k: x for x, k in at.items()}
    ways = []
    for h, k, m in edges:
        p, q = root(k), root(m)
        if p != q:
            parent[p] = q
            if p in label and q in label:
                ways.append((name[label[p]], name[label[q]], h))
            elif p in label:
                label[q] = label[p]
    return _ways(border, ways)


def fill_depressions(cells: DataFrame, value: str = "dem", tile: int = TILE, up: int = UP, top: int = TOP) -> DataFrame:
    """(cell_id, filled): the lowest surface not below the ground from which every cell reaches the edge without a rise.

    Edge cells, which lack a neighbour, keep their height. A NULL height stays NULL and lets nothing through; what it shuts in
    has no way out and becomes infinity.

    Two passes over the cells, whatever the grid (after Barnes 2016). The first one floods each tile of 64 x 64 cells from all of its border cells and keeps the lowest ways between them, a tree.
    These trees are a graph of a sixteenth of the cells; groups of 8 x 8 tiles are taken together to the same kind of tree between the border cells of the group, and
    so on until at most ``top`` ways are left, which one task solves. Levels then go down the same groups, and the second pass floods each tile from its border cells' levels.
    """
    tiles = _tiled(cells, value, tile)
    ways = checkpointed(tiles.groupBy("i", "j").applyInArrow(lambda t: _with_group(_joined(t, tile), t), f"{WAYS}, i long, j long"))
    levels = _border_levels(ways, tile, up, top)
    marked = tiles.select("i", "j", "cell_id", "row", "col", "z")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"cell_id": pa.array([], pa.int64()), "filled": pa.array([], pa.float64())})
        ids, z, near, lacks, _, _, _ = _cell_graph(left, tile)
        place = {x: k for k, x in enumerate(ids.tolist())}
        start = [(float(z[k]), int(k), 0) for k in np.flatnonzero(lacks)] + [(h, place[x], 0) for x, h in zip(right.column("a").to_pylist(), right.column("h").to_pylist(), strict=True)]
        level, _ = _flood(len(ids), near, z.tolist(), start)
        return pa.table({"cell_id": ids, "filled": pa.array(np.array(level), mask=np.isnan(z))})

    return marked.groupBy("i", "j").cogroup(levels.groupBy("i", "j")).applyInArrow(run, "cell_id long, filled double")


def _with_group(out: pa.Table, table: pa.Table) -> pa.Table:
    """The rows with the tile that they come from."""
    return out.append_column("i", pa.array([table.column("i")[0].as_py()] * out.num_rows, pa.int64())).append_column("j", pa.array([table.column("j")[0].as_py()] * out.num_rows, pa.int64()))


def _border_levels(ways: DataFrame, side: int, up: int, top: int) -> DataFrame:
    """(i, j, a, h): the level of each border cell of the groups (i, j) of ``ways``, whose sides are so many cells long; a stored table."""
    here = f"{WAYS}, i long, j long"
    if ways.count() <= top or ways.select("i", "j").distinct().limit(5).count() < 5:
        known = ways.sparkSession.createDataFrame([], "p long, q long, a long, h double")
        placed = ways.withColumns({"p": F.lit(0).cast("long"), "q": F.lit(0).cast("long")})
    else:
        placed = ways.withColumns({"p": F.floor(F.col("i") / up), "q": F.floor(F.col("j") / up)})
        higher = checkpointed(placed.groupBy("p", "q").applyInArrow(lambda t: _with_group(_contracted(t, side * up), t.select(["p", "q"]).rename_columns(["i", "j"])), here))
        known = _border_levels(higher, side * up, up, top).select(F.col("i").alias("p"), F.col("j").alias("q"), "a", "h")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, _, near, places = _node_graph(left)
        start = [(float("-inf"), 0)] + [(h, at[x]) for x, h in zip(right.column("a").to_pylist(), right.column("h").to_pylist(), strict=True)]
        level = _levels(near, start)
        own = left.filter(pa.array([k == 0 for k in left.column("kind").to_pylist()]))
        return own.select(["i", "j", "a"]).append_column("h", pa.array([level[at[x]] for x in own.column("a").to_pylist()], pa.float64()))

    out = checkpointed(placed.groupBy("p", "q").cogroup(known.groupBy("p", "q")).applyInArrow(run, "i long, j long, a long, h double"))
    dropped(ways)
    return out
