"""Quality rules: fixed limits on text statistics, then robust multivariate outliers by language and source.

The statistics of a text are transformed to a vector. For each language and
source the minimum covariance determinant estimate (Rousseeuw and Van Driessen
1999) gives a centre and a scatter that up to a quarter of odd documents can't
move, and a document is rejected if its Mahalanobis distance is too large.

Three starts are robust in different ways, as in the deterministic variant (Hubert, Rousseeuw and
Verdonck 2012): medians and quartiles alone, correlations of squashed scores, and
spatial signs. From each one the estimate takes concentration steps, each an aggregation over all documents:
distances fall into fine bins, the engine sums counts and moments by group
and bin, and the bins up to the wanted share give the next centre and scatter. So no
group's documents ever meet in a task. The start that ends with the least determinant counts, and one
reweighting step takes in all documents that it finds regular. A small ridge is added to the scatter
(Boudt et al. 2020), as many texts have no repetition and no symbol at all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, FEW, dropped, held, named, quoted, slices, stored, text_hash

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
#: Ridge on the scale of each transformed statistic, in its own unit.
FLOORS = np.array([0.5, 0.05, 0.05, 0.08, 0.08, 0.12])
P = len(FLOORS)


def text_statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of STATS for each text; null has no words."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in STATS}
    ids: dict = defaultdict(count().__next__)
    sizes, codes = np.zeros(n, np.int64), []
    for i, text in enumerate(texts):
        if not text:
            continue
        words = text.encode().split()
        sizes[i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        out["n_symbols"][i] = sum(map(text.count, "#*$%&|<>"))
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        codes.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    out["n_words"] = sizes
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    if not len(code):
        return out
    owner = np.repeat(np.arange(n), sizes)
    own = pd.factorize(owner * (int(code.max()) + 1) + code)[0]  # a word of a text
    first = np.unique(own, return_index=True)[1]
    out["n_distinct"] = np.bincount(owner[first], minlength=n)
    window = own
    for step in (1, 2, 4):  # names of runs of 2, 4 and 8 words
        if len(window) <= step:
            return out
        window = pd.factorize(window[:-step] * (int(window.max()) + 1) + window[step:])[0]
    inside = owner[: len(window)] == owner[7 : 7 + len(window)]
    times = np.bincount(window[inside], minlength=int(window.max()) + 1)
    start = np.flatnonzero(inside & (times[window] > 1))
    cover = np.zeros(len(code) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + 8, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of STATS to each row (a map; columns of these names, in either case, are replaced)."""
    keep = [c for c in df.columns if c.lower() not in (*STATS, text.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1_000_000):
            got = text_statistics(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(got[k], pa.int64()) for k in STATS], names=[*keep, *STATS])

    kept = [F.col(quoted(c)) for c in keep]
    schema = df.select(*kept, *[F.lit(None).cast("long").alias(k) for k in STATS]).schema
    return df.select(*kept, quoted(text)).mapInArrow(run, schema)


def _vector() -> list[Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log1p(ratio("word_chars", "n_words")),
        F.sqrt(ratio("n_symbols", "word_chars")),
        F.sqrt(ratio("n_dup_lines", "n_lines")),
        F.sqrt(ratio("n_repeat_words", "n_words")),
        F.log1p("n_words") - F.log1p("n_distinct"),
    ]


def _distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds d2, the squared distance from the group's centre. ``params``: few rows a group; Spark broadcasts it only if it is small."""
    joined = rows.join(params, "grp")
    d = [F.col("x")[i] - F.col("centre")[i] for i in range(P)]
    d2 = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            d2 = d2 + d[i] * d[j] * F.col("inverse")[i * P + j] * F.lit(1.0 if i == j else 2.0)
    return joined.withColumn("d2", d2).drop("centre", "inverse")


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _chi2_even(x: float, dof: int) -> float:
    term, total = 1.0, 0.0
    for j in range(dof // 2):
        total += term
        term *= x / 2 / (j + 1)
    return 1 - float(np.exp(-x / 2)) * total


def chi2_quantile(share: float) -> float:
    """Of the squared distances of P normal numbers."""
    low, high = 0.0, 500.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_even(mid, P) < share else (low, mid)
    return low


def _consistency(share: float) -> float:
    """What makes the scatter of the innermost share of normal vectors the scatter of all."""
    return share / _chi2_even(chi2_quantile(share), P + 2)


def moments(n: float, s: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter from the sums of vectors and of their products, in the order of PAIRS; the ridge is in the scatter."""
    centre, second = s[:P] / n, np.zeros((P, P))
    for k, (i, j) in enumerate(PAIRS):
        second[i, j] = second[j, i] = s[P + k] / n
    return centre, factor * (second - np.outer(centre, centre)) + np.diag(FLOORS**2)


def _row(grp: str, start: int, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"grp": [grp], "start": [start], "logdet": [float(np.linalg.slogdet(scatter)[1])], "centre": [centre.tolist()], "inverse": [np.linalg.inv(scatter).ravel().tolist()]})


def _concentrate(share: float):
    factor = _consistency(share)

    def step(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy(np.float64)
        upto = int(np.searchsorted(np.cumsum(n), share * n.sum())) + 1
        return _row(bins["grp"].iloc[0], int(bins["start"].iloc[0]), *moments(n[:upto].sum(), np.stack(bins["s"].to_numpy())[:upto].sum(0), factor))

    return step


def _started(sums: pd.DataFrame) -> pd.DataFrame:
    """The three starts of a group, from its medians, spreads and the products of squashed scores and of signs."""
    r = sums.iloc[0]
    centre, spread = np.array(r["centre"]), np.array(r["spread"])
    out = [_row(r["grp"], 0, centre, np.diag(spread**2))]
    for start, name in ((1, "squashed"), (2, "signs")):
        scatter = np.zeros((P, P))
        for k, (i, j) in enumerate(PAIRS):
            scatter[i, j] = scatter[j, i] = r[name][k] / r["n"]
        scale = np.sqrt(np.maximum(np.diag(scatter), 1e-12))
        corr = scatter / np.outer(scale, scale)
        out.append(_row(r["grp"], start, centre, 0.95 * corr * np.outer(spread, spread) + 0.05 * np.diag(spread**2)))
    return pd.concat(out)


def _reweighted(share: float):
    factor = _consistency(share)

    def step(sums: pd.DataFrame) -> pd.DataFrame:
        r = sums.iloc[0]
        return _row(r["grp"], 0, *moments(float(r["n"]), np.array(r["s"]), factor))

    return step


PARAMS = "grp string, start int, logdet double, centre array<double>, inverse array<double>"


def _products(v: list[Column]) -> Column:
    return F.array(*[F.sum(v[i] * v[j]) for i, j in PAIRS])


def robust_outliers(rows: DataFrame, by: tuple[str, str] = ("lang", "source"), least: int = 100, share: float = 0.75, steps: int = 6, tail: float = 1e-10) -> DataFrame:
    """Adds to rows with the counts of STATS: d2 (squared distance; null where no estimate is) and outlier.

    The groups are the pairs of ``by`` with ``least`` rows; the rows of smaller
    pairs are taken together by the first of them, and what is still too small in
    one group of all; if that is too small too, nothing in it is an outlier. Null is a value like others.
    An outlier is farther than regular documents are with a probability of ``tail`` (a chi-square quantile,
    55.8 for 1e-10): so among ten billion regular documents about one is lost. Their statistics have longer tails than
    normal ones, which is why usual quantiles such as 0.975 or 0.999 would reject good texts.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    vectors = rows.withColumn("x", F.array(*_vector())).withColumn("_a", name(by[0])).withColumn("_b", name(by[1]))
    pairs = vectors.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    small = F.col("_n") < least
    levels = pairs.join(pairs.where(small).groupBy("_a").agg(F.sum("_n").alias("_na")), "_a", "left")
    group = F.when(~small, F.concat_ws("\1", "_a", "_b")).when(F.col("_na") >= least, F.col("_a")).otherwise(F.lit("all"))
    levels = levels.withColumn("grp", group).withColumn("_size", F.sum("_n").over(_window("grp"))).select("_a", "_b", "grp", "_size")
    placed = stored(vectors.join(levels, ["_a", "_b"]).drop("_a", "_b"))
    fit = placed.where(F.col("_size") >= least).select("grp", "x")
    quart = (
        fit.select("grp", F.posexplode("x").alias("dim", "v")).groupBy("grp", "dim", F.round("v", 3).alias("v")).agg(F.count("*").alias("n"))
        .groupBy("grp", "dim").agg(F.percentile("v", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
        .groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("dim", "q"))).alias("q"))
    )
    spread = F.array(*[F.sqrt(F.pow((F.col("q")[i]["q"][2] - F.col("q")[i]["q"][0]) / 1.349, F.lit(2)) + float(FLOORS[i] ** 2)) for i in range(P)])
    middle = stored(quart.select("grp", F.array(*[F.col("q")[i]["q"][1] for i in range(P)]).alias("centre"), spread.alias("spread")))
    scored = fit.join(middle, "grp").withColumn("z", F.array(*[(F.col("x")[i] - F.col("centre")[i]) / F.col("spread")[i] for i in range(P)]))
    z = [F.col("z")[i] for i in range(P)]
    length = F.greatest(F.sqrt(sum((c * c for c in z), F.lit(0.0))), F.lit(1e-9))
    starts = scored.withColumns({"h": F.array(*[F.tanh(c) for c in z]), "g": F.array(*[c / length for c in z])}).groupBy("grp").agg(
        F.count("*").alias("n"), F.first("centre").alias("centre"), F.first("spread").alias("spread"),
        _products([F.col("h")[i] for i in range(P)]).alias("squashed"), _products([F.col("g")[i] for i in range(P)]).alias("signs"),
    )
    params = stored(starts.groupBy("grp").applyInPandas(_started, PARAMS))
    sums = F.array(*[F.sum(F.col("x")[i]) for i in range(P)], *[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS])
    for _ in range(steps):
        near = _distance(fit, params).withColumn("bin", F.floor(16 * F.log2(F.col("d2") + 1e-6)))
        bins = near.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), sums.alias("s"))
        old, params = params, stored(bins.groupBy("grp", "start").applyInPandas(_concentrate(share), PARAMS))
        dropped(old)
    best = params.groupBy("grp").agg(F.min_by(F.struct("centre", "inverse"), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    regular = _distance(fit, best).where(F.col("d2") <= chi2_quantile(0.975)).groupBy("grp").agg(F.count("*").alias("n"), sums.alias("s"))
    final = stored(regular.groupBy("grp").applyInPandas(_reweighted(0.975), PARAMS))
    known = _distance(placed.where(F.col("_size") >= least), final.select("grp", "centre", "inverse"))
    unknown = placed.where(F.col("_size") < least).withColumn("d2", F.lit(None).cast("double"))
    out = held(known.unionByName(unknown).withColumn("outlier", F.coalesce(F.col("d2") > chi2_quantile(1 - tail), F.lit(False))).drop("x", "grp", "_size"))
    dropped(placed, middle, params, final)
    return out


def _window(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _judged(df: DataFrame, text: str, lang: str, source: str, key: str, **options) -> DataFrame:
    """One row for each row: _key, _lang, _source, h (hash of the text), the counts of STATS, base_failed, d2, outlier, kept."""
    columns = {"_key": key, "_lang": lang, "_source": source, "_text": text}
    rows = df.select(*[F.col(quoted(c)).alias(k) for k, c in columns.items()]).withColumn("h", text_hash(F.col("_text")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    marked = stored(with_statistics(rows, "_text").withColumn("base_failed", failed))
    passed = robust_outliers(marked.where(~F.col("base_failed")), ("_lang", "_source"), **options)
    rest = marked.where("base_failed").withColumns({"d2": F.lit(None).cast("double"), "outlier": F.lit(False)})
    out = held(passed.unionByName(rest).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier")))
    dropped(marked)
    return out


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """One row for each input row: key, the counts of STATS, base_failed, d2, outlier and kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in 8-word
    windows that the text repeats. The estimate is made from all rows that the base passes. A null or empty text has no words
    and fails the base. Equal rows are judged each. Other columns are not read. ``options``: those of ``robust_outliers``.
    The result, which holds no texts, is a stored table.
    """
    out = _judged(df, text, lang, source, key, **options)
    return out.select(F.col("_key").alias(key), *STATS, "base_failed", "d2", "outlier", "kept")


def drop_poor(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows that ``judge`` keeps, with their own columns, whatever their names.

    A verdict follows from text, language and source alone, so it is these that the rejected rows are joined by.
    """
    judged = _judged(df, text, lang, source, key, **options)
    lost = held(judged.where(~F.col("kept")).select(F.col("h").alias("_rf_h"), F.col("_lang").alias("_rf_l"), F.col("_source").alias("_rf_s")).distinct())
    same = text_hash(F.col(quoted(text))).eqNullSafe(F.col("_rf_h")) & F.col(quoted(lang)).eqNullSafe(F.col("_rf_l")) & F.col(quoted(source)).eqNullSafe(F.col("_rf_s"))
    return df.join(F.broadcast(lost) if lost.count() <= FEW else lost, same, "left_anti").select(*named(df))
