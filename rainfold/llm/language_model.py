"""Class-based bigram scoring with classes from exchange clustering (Brown et al. 1992; Martin, Liermann and Ney 1998).

P(w | previous) = P(class of w | class of the previous token) * P(w | class of w).

Every word that occurs at least twice in training has a class of its own choice, by exchange in three steps. First the
most frequent words (``heads``) move one after the other between classes as long as the likelihood of the class bigrams rises; the
executors sum their bigrams, a matrix of fixed size is all that the driver sees. Then every word of the lexicon moves: the executors hold the
lexicon's bigrams, dealt by word, and find the best class of each word from its own neighbours; only class by class counts come together. Then
each rarer word, however many there are, takes the best class for its own neighbours in a grouped aggregation by word. Until a word has moved it
stands in a class that all such words share. Words seen once, which have too few neighbours to choose, stay there. That class is also that of the words that training
doesn't hold: its transitions are those of words seen once, who leave half of their probability to all unseen words together, as one more word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, held, numbered, slices, stored, word_places


@dataclass(frozen=True)
class Sizes:
    """heads: words of the first exchange; lexicon: words whose classes and counts each task has (those of rarer words are joined); chooses: occurrences from which on a word has a class of its own choice; rounds: of the first exchange at most; refine: rounds over the lexicon, two at least."""

    heads: int = 1000
    classes: int = 48
    lexicon: int = 60_000
    chooses: int = 2
    rounds: int = 12
    refine: int = 4
    buckets: int = 256
    added: float = 0.5
    backed: float = 20.0

    @property
    def end(self) -> int:
        """The class of the end of a text, which also stands before the first word."""
        return self.classes

    @property
    def open(self) -> int:
        """The class of words that haven't chosen one: provisional, and for good of those seen too rarely or never."""
        return self.classes + 1


def coarse_units(many: int, sizes: Sizes) -> np.ndarray:
    """The unit of the first exchange of each unit of the second one: the heads, then all other words as one, then the end."""
    return np.concatenate([np.minimum(np.arange(many + 1), min(sizes.heads, many)), [min(sizes.heads, many) + 1]])


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): how often each word occurs, A-Z in lower case. Tasks add up what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in slices(batches, text, 4_000_000):
            place, names, _ = word_places(batch.column(text))
            c = np.bincount(place, minlength=len(names))
            kept.append(pa.table({"word": names, "c": c}).filter(pa.array(c > 0)))
            if sum(x.num_rows for x in kept) > 1_000_000:
                kept[:] = [summed()]
                if kept[0].num_rows > 500_000:
                    yield from kept.pop().to_batches()
        if kept:
            yield from summed().to_batches()

    return df.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


BIGRAMS = "bucket int, keys binary, counts binary"
RARE = "word binary, before int, after int, at long"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _units(names: pa.Array, lexicon: pa.Array) -> np.ndarray:
    """The place of each name in the lexicon; its length for all others."""
    return pc.fill_null(pc.index_in(names, value_set=lexicon), len(lexicon)).to_numpy().astype(np.int64)


def observed(df: DataFrame, lexicon, sizes: Sizes, text: str) -> DataFrame:
    """A scan's rows of two kinds, stored: bigrams (bucket, keys, counts) and occurrences of words beyond the lexicon (word, before, after, at).

    Units are the words of the lexicon, one for all others, and the end. A key is (2 * unit + side) * units + other, side 0 if the other one
    follows; each pair stands once for either unit, dealt by that unit, and tasks add up what they read. before and after
    are the units beside an occurrence; ``at`` numbers it, so that of two such words in a row the second one's number is one more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        other = len(known)
        end, n = other + 1, other + 2
        at = TaskContext.get().partitionId() << 40
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = _summed(*(np.concatenate([x[k] for x in kept]) for k in (0, 1)))
            kept.clear()
            for unit, of, side, beside in ((keys // n, counts, 0, keys % n), (keys % n, counts, 1, keys // n)):
                order = np.argsort(unit % sizes.buckets, kind="stable")
                cuts = np.searchsorted((unit % sizes.buckets)[order], np.arange(sizes.buckets + 1))
                both, of = ((2 * unit + side) * n + beside)[order], of[order]
                for part in range(0, sizes.buckets, 32):
                    ks = [k for k in range(part, min(part + 32, sizes.buckets)) if cuts[k + 1] > cuts[k]]
                    blobs = [pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in ks], pa.binary()) for x in (both, of)]
                    empty = [pa.nulls(len(ks), t) for t in (pa.binary(), pa.int32(), pa.int32(), pa.int64())]
                    yield pa.record_batch([pa.array(ks, pa.int32()), *blobs, *empty], names=["bucket", "keys", "counts", "word", "before", "after", "at"])

        for batch in slices(batches, text, 1_000_000):
            place, names, upto = word_places(batch.column(text))
            units = _units(names, known)
            a = np.full(len(place) + len(upto) + 1, end, np.int64)  # ends stand before, between and behind the texts
            where = np.arange(len(place)) + np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0)) + 1
            a[where] = units[place]
            kept.append(np.unique(a[:-1] * n + a[1:], return_counts=True))
            rare = np.flatnonzero(a[where] == other)
            p = where[rare]
            words = names.take(pa.array(place[rare]))
            empty = [pa.nulls(len(rare), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.record_batch([*empty, words, pa.array(a[p - 1], pa.int32()), pa.array(a[p + 1], pa.int32()), pa.array(at + p)], names=["bucket", "keys", "counts", "word", "before", "after", "at"])
            at += len(a) + 1
            if sum(len(x) for x, _ in kept) > 1_500_000:
                kept[:] = [_summed(*(np.concatenate([x[k] for x in kept]) for k in (0, 1)))]
                if len(kept[0][0]) > 750_000:
                    yield from flush()
        if kept:
            yield from flush()

    return stored(df.select(text).mapInArrow(run, f"{BIGRAMS}, {RARE}"))


def word_bigrams(seen: DataFrame) -> DataFrame:
    """(bucket, keys, counts): the bigrams of ``observed``, each bucket's parts added up."""

    def add(table: pa.Table) -> pa.Table:
        keys, counts = _summed(*(np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("keys", "counts")))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": [keys.tobytes()], "counts": [counts.tobytes()]}, schema=pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return seen.where("bucket is not null").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(add, BIGRAMS)


def _rows(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, side, other, count) of each bucket, by unit."""
    for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
        k = np.frombuffer(keys, np.int64)
        yield k // n // 2, k // n % 2, k % n, np.frombuffer(counts, np.int64)


def coarse_bigrams(bigrams: DataFrame, coarse: np.ndarray) -> np.ndarray:
    """How often the units of the first exchange follow each other, as a matrix whose size only the heads fix."""
    known = bigrams.sparkSession.sparkContext.broadcast(coarse)
    units = int(coarse[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        for batch in batches:
            for unit, side, other, count in _rows(batch, len(of)):
                on = side == 0
                keys, n = _summed(of[unit[on]] * units + of[other[on]], count[on])
                yield pa.record_batch([pa.array(keys), pa.array(n, pa.int64())], names=["cell", "n"])

    got = bigrams.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(units * units)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(units, units)


def _flog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(n: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float, free: int) -> int:
    """The class, of the first ``free`` ones, in which a unit of class ``a`` gives the most likely class bigrams.

    n: bigrams by class; right, left: of the unit, by the other token's class; own: the unit after itself.
    """
    r, le = right.astype(np.float64).copy(), left.astype(np.float64).copy()
    r[a] -= own
    le[a] -= own
    m = n.astype(np.float64).copy()
    m[a] -= r
    m[:, a] -= le
    m[a, a] -= own
    base = _flog(m)
    rows = _flog(m + r) - base
    cols = _flog(m + le[:, None]) - base
    d = np.diag(m)
    gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols) + _flog(d + r + le + own) - np.diag(base)
    out, into = m.sum(1) + le, m.sum(0) + r  # pairs with the other classes stand in their sums, wherever the unit goes
    gain -= _flog(out + r.sum() + own) - _flog(out) + _flog(into + le.sum() + own) - _flog(into)
    best = int(np.argmax(gain[:free]))
    return best if gain[best] > gain[a] + 1e-9 else a


def best_classes(n: np.ndarray, a: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, free: int) -> np.ndarray:
    """best_class for many units at once, each as if it alone moved. Units of a class that isn't free leave it in any case."""
    many, k = right.shape
    at = np.arange(many)
    r, le = right.copy(), left.copy()
    r[at, a] -= own
    le[at, a] -= own
    m = np.repeat(n[None], many, 0)
    m[at, a] -= r
    m[at, :, a] -= le
    m[at, a, a] -= own
    np.maximum(m, 0, out=m)
    base = _flog(m)
    rows, cols = _flog(m + r[:, None, :]) - base, _flog(m + le[:, :, None]) - base
    d = np.arange(k)
    inner = m[:, d, d]
    gain = rows.sum(2) - rows[:, d, d] + cols.sum(1) - cols[:, d, d] + _flog(inner + r + le + own[:, None]) - base[:, d, d]
    out, into, o = m.sum(2) + le, m.sum(1) + r, own[:, None]
    gain -= _flog(out + r.sum(1)[:, None] + o) - _flog(out) + _flog(into + le.sum(1)[:, None] + o) - _flog(into)
    best = gain[:, :free].argmax(1)
    return np.where((gain[at, best] > gain[at, a] + 1e-9) | (a >= free), best, a)


def refine(bigrams: DataFrame, classes: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit of the lexicon, bigrams by class). A round moves half of the units at once against the same counts; of the rounds from the second on the best one counts."""
    spark, k, n_units = bigrams.sparkSession, sizes.classes + 2, len(classes)

    def together(classes) -> np.ndarray:
        known = spark.sparkContext.broadcast(classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, total = known.value, np.zeros(k * k)
            for batch in batches:
                for unit, side, other, count in _rows(batch, n_units):
                    on = side == 0
                    total += np.bincount(c[unit[on]] * k + c[other[on]], count[on], k * k)
            yield pa.record_batch([pa.array(np.arange(k * k), pa.int32()), pa.array(total)], names=["cell", "n"])

        out = np.zeros(k * k)
        for row in bigrams.mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[row["cell"]] = row["n"]
        return out.reshape(k, k)

    n = together(classes)
    best, best_n, top = classes, n, -np.inf
    for turn in range(max(2, sizes.refine)):
        state = spark.sparkContext.broadcast((classes, n))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, state=state) -> Iterator[pa.RecordBatch]:
            c, now = state.value
            for batch in batches:
                for unit, side, other, count in _rows(batch, n_units):
                    ids, place = np.unique(unit, return_inverse=True)
                    of = place * k + c[other]
                    right, left = (np.bincount(of[side == x], count[side == x], len(ids) * k).reshape(-1, k) for x in (0, 1))
                    own = np.bincount(place[(unit == other) & (side == 0)], count[(unit == other) & (side == 0)], len(ids))
                    # one half by turns; the end and what stands for all rarer words keep their classes
                    todo = np.flatnonzero(((ids * 2654435761 >> 7) % 2 == turn % 2) & (ids < n_units - 2))
                    for i in range(0, len(todo), 64):
                        t = todo[i : i + 64]
                        to = best_classes(now, c[ids[t]], right[t], left[t], own[t], sizes.classes)
                        yield pa.record_batch([pa.array(ids[t], pa.int32()), pa.array(to, pa.int32())], names=["unit", "k"])

        moved = bigrams.mapInArrow(run, "unit int, k int").toArrow()
        classes = classes.copy()
        classes[moved.column("unit").to_numpy()] = moved.column("k").to_numpy()
        n = together(classes)
        if turn and (now := likelihood(n)) > top:
            best, best_n, top = classes, n, now
    return best, best_n


def likelihood(n: np.ndarray) -> float:
    return float(_flog(n.astype(np.float64)).sum() - _flog(n.sum(1).astype(np.float64)).sum() - _flog(n.sum(0).astype(np.float64)).sum())


def exchange(pairs: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The class of each unit of the first exchange, from a matrix of how often they follow each other.

    Units move one after the other, each to its best class with all counts up to date, until none moves. The last two units keep their classes: all other words, and the end.
    """
    units, k = len(pairs), sizes.classes + 2
    classes = np.arange(units) % sizes.classes
    classes[-2:] = sizes.open, sizes.end
    of = np.eye(k)[classes]
    right, left = pairs @ of, pairs.T @ of
    n = of.T @ right
    for _ in range(sizes.rounds):
        still = True
        for u in range(units - 2):
            a, own = classes[u], pairs[u, u]
            to = best_class(n, a, right[u], left[u], own, sizes.classes)
            if to == a:
                continue
            r, le = right[u].copy(), left[u].copy()
            r[a] -= own
            le[a] -= own
            n[a] -= r
            n[:, a] -= le
            n[a, a] -= own
            n[to] += r
            n[:, to] += le
            n[to, to] += own
            for beside, count in ((right, pairs[:, u]), (left, pairs[u])):
                beside[:, a] -= count
                beside[:, to] += count
            classes[u], still = to, False
        if still:
            break
    return classes


def joined_classes(n: np.ndarray, right: tuple, left: tuple, many: int, free: int) -> np.ndarray:
    """For each of ``many`` words the class, of the first ``free`` ones, in which its bigrams make the likelihood of all class bigrams, ``n`` and its own, highest.

    right, left: (word, class of the token behind or before it, count) as arrays, by word. Of equal classes the first one is taken.
    """
    k, d = len(n), np.diag(n)
    gain, dense = np.zeros((many, k)), []
    for m, (word, beside, count) in ((n, right), (n.T, left)):
        for i in range(0, len(word), 8192):
            w, cells, c = word[i : i + 8192], m[:, beside[i : i + 8192]].T, count[i : i + 8192, None]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            gain[w[first]] += np.add.reduceat(_flog(cells + c) - _flog(cells), first)
        dense.append(np.bincount(word * k + beside, count, many * k).reshape(many, k))
    r, le = dense
    gain += np.where((r > 0) & (le > 0), _flog(d + r + le) - _flog(d + r) - _flog(d + le) + _flog(d), 0)  # both are in the class itself
    for total, beside, own in ((n.sum(1), le, r), (n.sum(0), r, le)):
        gain -= _flog(total + beside + own.sum(1)[:, None]) - _flog(total + beside)
    return gain[:, :free].argmax(1)


def rare_classes(seen: DataFrame, classes: np.ndarray, n: np.ndarray, sizes: Sizes) -> DataFrame:
    """(word, k, c), stored: class and count of each word beyond the lexicon; rows without a word are bigrams of such words with all others, k being before * (classes + 2) + after.

    A word seen at least ``chooses`` times takes the class that is best for its own neighbours that have classes. A word that only ever stands beside other such words takes the
    class that is best for the neighbours of all of them together. Neighbours are counted by class before they
    meet, so a word's row is never longer than the square of the number of classes.
    """
    spark, k, m = seen.sparkSession, sizes.classes + 2, sizes.classes + 1
    at = np.arange(m)
    around = [(np.zeros(m, np.int64), at, x / max(1.0, x.sum())) for x in (n[sizes.open, :m], n[:m, sizes.open])]
    usual = int(joined_classes(n[:m, :m], *around, 1, sizes.classes)[0])
    known = spark.sparkContext.broadcast((classes, n[:m, :m].copy()))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value[0]
        for batch in batches:
            cell = of[batch.column("before").to_numpy()] * k + of[batch.column("after").to_numpy()]
            yield pa.record_batch([batch.column("word"), pa.array(cell, pa.int32())], names=["word", "cell"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = known.value[1], np.zeros((k, k))
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                many, cells = part.num_rows, part.column("cells")
                flat = cells.flatten()
                cell, count = (flat.field(x).to_numpy(zero_copy_only=False).astype(t) for x, t in (("cell", np.int64), ("n", np.float64)))
                row = np.repeat(np.arange(many), np.diff(cells.offsets.to_numpy()))
                sides = []
                for of in (cell % k, cell // k):
                    has = of < m
                    sides.append((row[has], of[has], count[has]))
                to = joined_classes(now, *sides, many, sizes.classes)
                alone = np.ones(many, bool)
                for w, _, _ in sides:
                    alone[w] = False
                to[alone] = usual
                to[part.column("c").to_numpy() < sizes.chooses] = sizes.open
                for turned, (w, of, c) in zip((total, total.T), sides, strict=True):
                    np.add.at(turned, (to[w], of), c)
                yield pa.record_batch([part.column("word"), pa.array(to, pa.int32()), part.column("c")], names=["word", "k", "c"])
        yield pa.record_batch([pa.nulls(k * k, pa.binary()), pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["word", "k", "c"])

    rare = seen.where("word is not null").select("word", "before", "after").mapInArrow(beside, "word binary, cell int")
    cells = rare.repartition("word").groupBy("word", "cell").agg(F.count("*").alias("n"))
    of_word = cells.groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells"), F.sum("n").alias("c"))
    return stored(of_word.mapInArrow(choose, "word binary, k int, c long"))


def _in_a_row(met: DataFrame, *more: Column) -> DataFrame:
    """For each occurrence (at, k, joins: the word before is beyond the lexicon, too) a row for the pair that it begins, with ``more``, and one for the pair that it ends: pair, kl, kr."""
    begins = F.struct(F.col("at").alias("pair"), F.col("k").alias("kl"), F.lit(None).cast("int").alias("kr"), *more)
    names = [f for f in met.select(F.struct(*more).alias("s")).schema["s"].dataType.fields] if more else []
    ends = F.struct((F.col("at") - 1).alias("pair"), F.lit(None).cast("int").alias("kl"), F.col("k").alias("kr"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    return F.explode(F.when(F.col("joins"), F.array(begins, ends)).otherwise(F.array(begins)))


def _literal(values: np.ndarray) -> Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>")


def probabilities(n: np.ndarray, kinds: np.ndarray, s: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the class transitions, and of what the weights of a class's words are divided by.

    Transitions are smoothed by the share of each class. ``kinds``: the words of each class; each weighs its count and ``added``. In the open class a word weighs half
    of its count, and the unseen word half of them all, and one. The end is alone in its class.
    """
    into, out = n.sum(0), n.sum(1)
    prior = (into + 1) / (into.sum() + len(into))
    move = np.log10((n + s.backed * prior) / (out + s.backed)[:, None])
    inner = np.log10(np.maximum(into + s.added * kinds, 1e-300))
    inner[s.end], inner[s.open] = 0.0, np.log10(into[s.open] + 1)
    return move, inner


@dataclass(frozen=True)
class Model:
    """words, counts, classes: of the lexicon; rare: the stored table of all other words (word, k, c); n: bigrams by class; kinds: words of each class."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    rare: DataFrame
    n: np.ndarray
    kinds: np.ndarray
    tokens: int
    distinct: int
    texts: int


def learn(train: DataFrame, text: str = "text", sizes: Sizes | None = None) -> Model:
    """Counts and classes of all words of all texts of ``train``; null texts count as empty. The caller drops ``rare``; all other tables made on the way are deleted."""
    s = sizes or Sizes()
    spark = train.sparkSession
    counts = stored(word_counts(train, text))
    kinds, running = counts.agg(F.count("*"), F.sum("c")).first()
    texts = train.count()
    # words that occur at least ``least`` times are the lexicon; there are as many counts as there are kinds of frequency
    least, room = s.chooses, s.lexicon
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(s.lexicon + 1).collect():
        room -= r["n"]
        if room < 0:
            least = max(least, r["c"] + 1)
            break
    frequent = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").toArrow()
    names, of_name = frequent.column("word").to_pylist(), frequent.column("c").to_numpy()
    many = len(names)
    seen = observed(train, spark.sparkContext.broadcast(pa.array(names, pa.binary())), s, text)
    bigrams = stored(word_bigrams(seen))
    coarse = coarse_units(many, s)
    classes, n = refine(bigrams, exchange(coarse_bigrams(bigrams, coarse), s)[coarse], s)
    rare = rare_classes(seen, classes, n, s)
    k, total = s.classes + 2, n.copy()
    total[s.open], total[:, s.open] = 0, 0  # bigrams of rare words follow with their classes
    words = rare.where("word is not null")
    for r in rare.where("word is null").groupBy("k").agg(F.sum("c").alias("c")).collect():
        total[r["k"] // k, r["k"] % k] += r["c"]
    # pairs of rare words
    joins = F.col("before") == many
    met = seen.where("word is not null").where(joins | (F.col("after") == many)).select("word", "at", joins.alias("joins")).join(words.select("word", "k"), "word")
    ends = met.select(_in_a_row(met).alias("p")).select("p.*").groupBy("pair").agg(F.max("kl").alias("kl"), F.max("kr").alias("kr"))
    for r in ends.where("kl is not null and kr is not null").groupBy("kl", "kr").count().collect():
        total[r["kl"], r["kr"]] += r["count"]
    own = np.bincount(classes[:many], minlength=k).astype(float)
    for r in words.groupBy("k").count().collect():
        own[r["k"]] += r["count"]
    dropped(counts, seen, bigrams)
    return Model(names, of_name, classes, rare, total, own, (running or 0) + texts, kinds + (1 if texts else 0), texts)


def score(df: DataFrame, train: DataFrame, text: str = "text", key: str = "doc_id", sizes: Sizes | None = None) -> DataFrame:
    """One row for each row of ``df``, a stored table: _rf_row (its number in this scan), key, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the words, A-Z in lower case, then one end. base_score is that of add-one unigrams,
    score that of the class bigrams; both are learnt from all texts of ``train``. Null and empty texts
    are an end alone. Equal rows are scored each, texts of any length whole; other columns aren't read. Words beyond the lexicon meet their counts and classes in a join,
    so every count and every class is that word's own.
    """
    s = sizes or Sizes()
    known = learn(train, text, s)
    rows = numbered(df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text")), "_rf_row")
    move, inner = probabilities(known.n, known.kinds, s)
    base_of, texts, m = np.log10(known.tokens + known.distinct + 1), known.texts, s.classes + 2
    model = df.sparkSession.sparkContext.broadcast((pa.array(known.words, pa.binary()), known.counts, known.classes[: len(known.words)], move, inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, class_of, move, inner = model.value
        plain, inside = np.log10(c + 1.0), np.log10(c + s.added)
        end, other, end_base = s.end, len(words), np.log10(texts + 1)
        kind_of = np.append(class_of, m)
        wide = np.zeros((m + 1, m + 1))  # steps from and to rare words are taken after the join
        wide[:m, :m] = move - inner
        for batch in slices(batches, "_text", 1_000_000):
            place, raw, upto = word_places(batch.column("_text"))
            many = len(upto)
            size = np.diff(upto, prepend=0)
            doc_of = np.repeat(np.arange(many), size)
            word = _units(raw, words)[place]
            # ends before and behind each text
            ks = np.full(len(place) + 2 * many, end, np.int64)
            where = np.arange(len(place)) + 2 * doc_of + 1
            ks[where] = kind_of[word]
            step = wide[ks[:-1], ks[1:]]
            step[upto[:-1] + 2 * np.arange(1, many) - 1] = 0.0  # what follows the end of a text is another text
            head = word < other
            at = doc_of[head]
            sums = np.bincount(np.repeat(np.arange(many), size + 2)[:-1], step, many) + np.bincount(at, inside[word[head]], many)
            base = np.bincount(at, plain[word[head]], many) + end_base - (size + 1) * base_of
            known_here = np.bincount(at, minlength=many) + (1 if texts else 0)
            row = batch.column("_rf_row")
            marks = pa.array([b" %d" % r for r in row.to_pylist()], pa.binary())
            none = [pa.nulls(many, t) for t in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([marks, row, *none, batch.column("doc"), pa.array(size + 1, pa.int64()), pa.array(known_here, pa.int64()), pa.array(base), pa.array(sums)], names=NAMES)
            rare = np.flatnonzero(~head)
            if len(rare):
                p = where[rare]
                named = raw.take(pa.array(place[rare]))
                none = [pa.nulls(len(rare), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([named, row.take(pa.array(doc_of[rare])), pa.array(p), pa.array(ks[p - 1], pa.int32()), pa.array(ks[p + 1], pa.int32()), *none], names=NAMES)

    parts = rows.mapInArrow(run, "word binary, _rf_row long, at long, before int, after int, doc long, n long, known long, base double, score double")
    met = parts.join(known.rare.where("word is not null"), "word", "left")
    rare, k = F.col("at").isNotNull(), F.coalesce("k", F.lit(s.open))
    steps, sizes_of = _literal(move), _literal(inner)
    went = lambda a, b: F.when((a < m) & (b < m), F.get(steps, a * m + b)).otherwise(0.0)
    c = F.coalesce("c", F.lit(0))
    weight = F.when(k < s.open, c + s.added).when(c > 0, c / 2).otherwise(float(known.n[:, s.open].sum()) / 2 + 1)
    met = met.select(
        "_rf_row",
        "at",
        F.when(rare, k).alias("k"),
        F.coalesce(rare & (F.col("before") == m), F.lit(False)).alias("joins"),
        "doc",
        "n",
        F.when(rare, (c > 0).cast("long")).otherwise(F.col("known")).alias("known"),
        F.when(rare, F.log10(c + 1.0)).otherwise(F.col("base")).alias("base"),
        F.when(rare, F.log10(weight) - F.get(sizes_of, k) + went(F.col("before"), k) + went(k, F.col("after")) - F.when(F.col("after") < m, F.get(sizes_of, F.col("after"))).otherwise(0.0)).otherwise(F.col("score")).alias("score"),
    )
    more = [F.col(x) for x in ("doc", "n", "known", "base", "score")]
    pairs = met.select("_rf_row", _in_a_row(met, *more).alias("p")).select("_rf_row", "p.*").repartition("_rf_row")
    sums = [F.max("doc").alias("doc"), *[F.sum(x).alias(x) for x in ("n", "known", "base", "score")]]
    of_pair = pairs.groupBy("_rf_row", "pair").agg(F.max("kl").alias("kl"), F.max("kr").alias("kr"), *sums)
    step = F.when(F.col("kl").isNotNull() & F.col("kr").isNotNull(), F.get(steps, F.col("kl") * m + F.col("kr"))).otherwise(0.0)
    out = held(
        of_pair.groupBy("_rf_row").agg(
            F.max("doc").alias(key),
            F.sum("n").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.lit(known.tokens).cast("long").alias("train_tokens"),
            F.sum("base").alias("base_score"),
            F.sum(F.coalesce("score", F.lit(0.0)) + step).alias("score"),
        )
    )
    dropped(known.rare)
    return out


NAMES = ["word", "_rf_row", "at", "before", "after", "doc", "n", "known", "base", "score"]
