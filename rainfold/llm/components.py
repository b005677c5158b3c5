"""Connected components by alternating large and small stars (Kiveris et al. 2014), on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


#: Edges that one task takes: a few MB.
FEW = 200_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst), a stored table; the component is its smallest node.

    Edges have no direction; repeated ones, loops and nulls do no harm. Each round
    joins nodes with the minimum of their neighbours, which the engine combines before
    the shuffle and may split where a hub is large; nothing is collected per node. Each
    round is written to the shared folder. The rounds grow with the logarithm of the longest path.
    Up to ``FEW`` edges, counted before, are one partition, so that rounds need no shuffle.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src is not null and dst is not null and src != dst").distinct()
    now = stored(both)
    n = now.count()
    if not n:
        dropped(now)
        return stored(spark.createDataFrame([], f"node {kind}, component {kind}"))
    before, files = None, 1 if n <= FEW else None
    for _ in range(rounds):
        if files:
            now, path = now.coalesce(files), now.rainfold_path
            now.rainfold_path = path
        # large star: each node's larger neighbours go to the smallest of the node and its neighbours
        sym = now.union(now.select("dst", "src")).toDF("u", "v")
        least = sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        small_least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(small_least, "src")
        new = small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst").union(small_least.select("src", F.col("m").alias("dst"))).distinct()
        old, now = now, stored(new, files)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        dropped(old)
        if mark == before:
            out = stored(now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct()), files)
            dropped(now)
            return out
        before = mark
    raise RuntimeError(f"no fixed point after {rounds} rounds")
