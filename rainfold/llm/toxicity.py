"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens score by their log-odds between toxic and other labelled texts, under an
informative Dirichlet prior (Monroe et al. 2008). A linear scan finds all maximal
scoring segments of a text (Ruzzo and Tompa 1999); extreme-value statistics
(Karlin and Altschul 1990) tell how surprising a segment's score is in a text of
that length, and the sum over the significant ones is the text's evidence.

Four fifths of the labelled texts give the log-odds. On the clean ones of the rest the two constants of the
extreme-value law are estimated, and on all of the rest the evidence is calibrated to a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

MARKS = ".,;:!?\"'()[]{}<>«»¿¡-_*#$%&|".encode()


@dataclass(frozen=True)
class Model:
    """scores: of tokens that differ between the classes; rest: of all others. decay and scale: of the extreme-value law; level: expected chance segments that a significant one has at most; bias and slope: of the calibration."""

    scores: dict[bytes, float]
    rest: float
    decay: float
    scale: float
    level: float = 0.05
    bias: float = 0.0
    slope: float = 1.0


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), without marks around them."""
    return [w for x in (text or "").encode().lower().split() if (w := x.strip(MARKS))]


def segments(scored: list[tuple[int, float]], rest: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score) with a positive score, given the tokens whose score isn't ``rest``, by place."""
    found: list[list[float]] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for at, score in scored:
        total += rest * (at - last - 1)
        last = at
        if score <= 0:
            total += score
            continue
        start, left, right = at, total, total + score
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append([start, at + 1, left, right])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(int(a), int(b), r - le) for a, b, le, r in found]


def evidence(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum over the significant segments of ln(level / E), and those segments. E: how many as good ones a clean text of this length has by chance."""
    words = tokens(text)
    get = model.scores.get
    scored = [(k, s) for k, w in enumerate(words) if (s := get(w)) is not None]
    if not scored:
        return 0.0, []
    out, total = [], 0.0
    for a, b, s in segments(scored, model.rest, len(words)):
        bits = model.decay * s - math.log(model.scale * len(words)) + math.log(model.level)
        if bits > 0:
            out.append((a, b, s))
            total += bits
    return total, out


def labelled(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "label", text: str = "text", most: int = 20_000) -> DataFrame:
    """Texts of ``df`` with labels 0 or 1: those of the ``most`` labelled keys that come first by hash.

    The bound keeps the labels small enough to broadcast, so no text is shuffled. A key with
    several labels has the largest; null keys and labels are left out.
    """
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    sample = wanted.orderBy(F.xxhash64(key), key).limit(most)
    return df.select(key, text).join(F.broadcast(sample), key).select(label, text)


def fit(df: DataFrame, label: str = "label", text: str = "text", least_z: float = 3.0, prior: float = 0.05, level: float = 0.05, thin: float = 0.2) -> Model:
    """The model of labelled rows (label 0 or 1; rows with another label or a null are left out).

    The texts of each class that hold a token are counted over four fifths of the labelled texts, by their hash, on the
    executors (so one text that repeats a word isn't many witnesses). A token's prior is
    ``prior`` times its count in both classes. The tokens that differ between the classes by ``least_z`` standard errors
    come to the driver; their number is bounded by the labelled rows. All other tokens share the score that
    makes the expected value of exp(score) 1 over clean tokens, but at most -``thin``, so that a passage has at least
    ``thin`` of evidence a word. Without rows of both
    classes nothing is ever toxic.
    """
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.col(text).alias("t"))
    learn = F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(5)) != 0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            found = list(both[0].keys() | both[1].keys())
            return pa.record_batch([pa.array(found, pa.binary()), *(pa.array([c[w] for w in found], pa.int64()) for c in both)], names=["w", "n0", "n1"])

        for batch in slices(batches, "t"):
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                both[y].update(set(tokens(t)))
            if len(both[0]) + len(both[1]) > 300_000:
                yield flush()
                both[0].clear()
                both[1].clear()
        yield flush()

    counts = rows.where(learn).mapInArrow(counted, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = counts.agg(F.sum("n0"), F.sum("n1")).first()
    n0, n1 = (x or 0 for x in sums)
    if not n0 or not n1:
        return Model({}, -1.0, 1.0, 1.0)
    alpha, mass = F.lit(prior) * (F.col("n0") + F.col("n1")), prior * (n0 + n1)
    odds = lambda c, n: F.log((F.col(c) + alpha) / (n + mass - F.col(c) - alpha))
    delta = odds("n1", n1) - odds("n0", n0)
    z = delta / F.sqrt(1 / (F.col("n1") + alpha) + 1 / (F.col("n0") + alpha))
    strong = counts.select("w", delta.alias("d"), z.alias("z"), ((F.col("n0") + alpha) / (n0 + mass)).alias("p")).where(F.abs("z") >= least_z).collect()
    scores = {bytes(r["w"]): float(np.clip(r["d"], -4, 6)) for r in strong}
    told = sum(r["p"] * math.exp(scores[bytes(r["w"])]) for r in strong)
    left = 1 - sum(r["p"] for r in strong)
    rest = min(-thin, math.log(max(1 - told, 0.5) / max(left, 1e-9)))
    plain = Model(scores, rest, 1.0, 1.0, level)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            out, n = [], 0
            for t in batch.column("t").to_pylist():
                n += len(ws := tokens(t))
                scored = [(k, scores[w]) for k, w in enumerate(ws) if w in scores]
                out += [s for *_, s in segments(scored, rest, len(ws)) if s >= LEAST]
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([len(out)], pa.int64()), pa.array([sum(out) - LEAST * len(out)], pa.float64())], names=["tokens", "segments", "beyond"])

    # above LEAST the scores of chance segments fall off exponentially: the mean excess gives the decay, their number the scale
    chance = rows.where(~learn & (F.col("y") == 0)).mapInArrow(found, "tokens long, segments long, beyond double").agg(F.sum("tokens"), F.sum("segments"), F.sum("beyond")).first()
    total, many, beyond = (x or 0 for x in chance)
    decay = min(1.0, (many + 1) / (beyond + 1))  # as if one more segment had the decay 1 of log-likelihood ratios
    scale = (many + 1) / max(total, 1) * math.exp(decay * LEAST)
    base = replace(plain, decay=decay, scale=scale)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            got = [round(8 * math.log1p(evidence(t, base)[0])) for t in batch.column("t").to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array(got, pa.int32())], names=["y", "e"])

    bins = rows.where(~learn).mapInArrow(rated, "y int, e int").groupBy("y", "e").count().collect()  # steps of an eighth of ln(1 + evidence)
    bias, slope = _logistic([(math.expm1(r["e"] / 8), r["y"], r["count"]) for r in bins]) if bins else (0.0, 1.0)
    return replace(base, bias=bias, slope=slope)


#: Score from which segments tell the extreme-value law.
LEAST = 1.0


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Bias and slope for the evidence by penalised Newton steps."""
    x, y, n = (np.array(c, np.float64) for c in zip(*rows, strict=True))
    n = n / n.sum()
    z, w = np.stack([np.ones_like(x), np.log1p(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (n * (p - y)) + 1e-4 * w
        hessian = (z * (n * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0]), float(w[1])


def score(df: DataFrame, model: Model, text: str = "text", passages: bool = False) -> DataFrame:
    """Adds ``score`` (0 to 1), and with ``passages`` the toxic passages: array<struct<start, end, score>> in words.

    A map over whole texts; null counts as empty, and an empty text has the score of
    a text without evidence. Columns of these names, in either case, are replaced. The model, of bounded size, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        found = [evidence(t, m) for t in texts.to_pylist()]
        rated = [1 / (1 + math.exp(-(m.bias + m.slope * math.log1p(e)))) if m.scores else 0.0 for e, _ in found]
        told = [pa.array([[{"start": a, "end": b, "score": s} for a, b, s in x] for _, x in found], span)] if passages else []
        return [pa.array(rated, pa.float64()), *told]

    return mapped(df, text, {"score": "double"} | ({"passages": "array<struct<start:int,end:int,score:double>>"} if passages else {}), make)
