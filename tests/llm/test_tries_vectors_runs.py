"""The conversation trie, near vectors and periodic runs against brute force, and on nulls, empty and long rows, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from rainfold.llm import queries, runs, trie, vectors  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = ("node", "depth", "words", "turns", "known", "label2", "a", "b", "tile", "ids", "w", "component", "RUNS", "x")


def with_clashes(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH})


# conversations


def trie_by_hand(convs):
    """convs: id -> list of (role, text)."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        below = children.get(n, [])
        leaves[n] = sum(leaves[k] for k in below) if below else 1
        saved[n] = sum(saved[k] for k in below) + (len(nodes[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0)
    sha = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(nodes[n]) if len(convs[c]) == len(n)).encode()).hexdigest()
    return sorted((min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(children.get(n, [])), leaves[n], saved[n], sha(n)) for n in nodes)


def rows_of(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SAID = "conv_id long, turn long, role string, text string"


def conversations():
    r = random.Random(3)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", " "), (7, 0, "assistant", "tie"), (8, 1, "user", "one two"), (8, 1, "user", "one two"), (-3, 0, "user", "a")]
    for c in range(20, 90):
        for t in range(r.randrange(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"w{r.randrange(2)} and {'x ' * r.randrange(2)}"))
    for c in (200, 201, 202):  # deeper than several bands
        rows += [(c, t, "user", f"turn {t}" if t != 40 or c != 201 else "other") for t in range(75 + c % 2)]
    return rows


@pytest.mark.parametrize("height", [1, 3, 32])
def test_trie(spark, height):
    rows = conversations()
    df = with_clashes(spark.createDataFrame(rows, SAID))
    digest = lambda r, t: hashlib.md5(hashlib.md5(r.encode()).hexdigest().encode() + t.encode()).digest()
    convs = {}
    for c, turn, role, text in sorted(((c, (t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda x: (x[0], x[1], x[2], digest(x[2], x[3]))):
        convs.setdefault(c, []).append((role, text))
    packed = trie.packed_turns(df)
    assert rows_of(trie.prefix_trie(packed, height)) == trie_by_hand(convs)
    if height == 3:
        made = {}
        for c in convs:
            h = zlib.crc32(str(c).encode()) % 4
            base = c - int(math.fmod(c, 20))
            made[c] = convs.get(base, [])[:h] + convs[c][h:]
        got = queries.rebuilt(packed)
        assert rows_of(trie.prefix_trie(got, height)) == trie_by_hand(made)


def test_trie_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], SAID)
    assert trie.prefix_trie(trie.packed_turns(none)).count() == 0
    turnless = spark.createDataFrame([(5, []), (4, [])], f"conv_id long, turns {trie.TURNS}")
    assert rows_of(trie.prefix_trie(turnless)) == trie_by_hand({5: [], 4: []})
    many = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 2 == 0, F.lit("same words")).otherwise(F.col("id").cast("string")).alias("text"))
    want = trie_by_hand({c: [("user", "same words" if c % 2 == 0 else str(c))] for c in range(3000)})
    assert rows_of(trie.prefix_trie(trie.packed_turns(many))) == want


# vectors


def linked_by_hand(rows, threshold):
    """Links, components and the choice for (id, label, vector) rows."""
    good = lambda r: r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])
    unit = [np.array(r[2], np.float64) if good(r) else None for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    n_links = [0] * len(rows)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and rows[i][1] == rows[j][1] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                n_links[i] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    out = []
    for k, r in enumerate(rows):
        c = None if r[0] is None else least[root(k)]
        out.append((r[0], n_links[k], c, r[0] is not None and r[0] == c))
    return sorted(out, key=repr)


def embeddings(kind):
    g = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        centres = g.normal(size=(12, 10))
        for k in range(150):
            v = centres[g.integers(12)] + g.normal(size=10) * g.choice([0.05, 0.15, 0.3, 1.0])
            rows.append((len(rows), label, [float(np.float32(x)) for x in v]))
    v = rows[3][2]
    rows += [(1000 + k, 0, v) for k in range(60)]  # one very common vector
    rows += [(2000, 0, [2 * x for x in v]), (2001, 0, None), (2002, 0, []), (2003, 0, [0.0] * 10), (2004, 0, [float("nan"), *v[1:]]), (2005, 0, [float("inf"), *v[1:]]), (2006, 0, [None, *v[1:]])]
    rows += [(None, 0, v), (2007, 1, v), (2008, 0, v[:5]), (2009, 0, v[:5]), (2010, 0, [-x for x in v]), (2011, None, v)]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind):
    rows = embeddings(kind)
    df = with_clashes(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(3))
    for threshold, tile in ((0.93, 4096), (0.93, 40), (0.8, 25)):
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, threshold, tile=tile).collect()), key=repr)
        assert got == linked_by_hand(rows, threshold)
    assert vectors.near_vectors(df.where("false")).count() == 0
    assert vectors.near_vectors(df.where("vec_id = 2003")).collect()[0][:] == (2003, 0, 2003, True)


def test_bounds_lose_nothing():
    g = np.random.default_rng(5)
    for d in (1, 2, 7, 64):
        x, y = g.normal(size=(300, d)) + 1, g.normal(size=(280, d)) + 1
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        a, b = vectors.Tile(x, axes), vectors.Tile(y, axes)
        for t in (0.3, 0.93):
            found = {(i, j) for p in vectors.links(a, b, t, 64) for i, j in zip(*map(list, p), strict=True)}
            cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
            assert found == set(zip(*map(list, np.nonzero(cos >= t)), strict=True))


# runs


def runs_by_hand(x):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(r):
    k, t = r.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(r.randrange(1, 7)):
        some = [r.randrange(k) for _ in range(r.randrange(1, 40))]
        t += r.choice([some, some * r.randrange(1, 6) + some[: len(some) // 2], t[-r.randrange(1, 100) :], t[: len(t) // 2]])
    return t[:400]


def test_runs_by_brute_force():
    r = random.Random(11)
    for _ in range(150):
        docs = [periodic(r) for _ in range(8)] + [[]]
        starts = np.cumsum([0, *map(len, docs)])
        got = [(s, e - s, q) for s, e, q in runs.find_runs(np.array(sum(docs, []), np.int64), starts).tolist()]
        want = [(s + int(at), n, q) for d, at in zip(docs, starts, strict=False) for s, n, q in runs_by_hand(d)]
        assert got == sorted(want, key=lambda x: (x[0], x[2]))
    for x in ([0, 1] * 60 + [0, 0] + [1, 0] * 60, [0] * 50 + [1] + [0] * 50, ([0] * 20 + [1]) * 10, ([0, 1] * 20 + [0]) * 2 + [0, 1] * 20):
        assert [(s, e - s, q) for s, e, q in runs.find_runs(np.array(x), np.array([0, len(x)])).tolist()] == runs_by_hand(x)


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_of_texts(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t ", "a", "A a A a A a A a A a A a", "x " * 12, "naïve café " * 15, "\x00 b " * 20, "w " * 60_000, " ".join(str(k % 1001) for k in range(30_000)), " ".join(str(r.random()) for _ in range(30_000))]
    texts += [" ".join(map(str, periodic(r))) for _ in range(40)]
    df = with_clashes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "x " * 12), (3, "a")], "doc_id long, text string"))
    rows = runs.collapse_runs(df).collect()
    assert len(rows) == len(texts) + 2 and rows[0].tile == "mine"
    for row in rows:
        words = WORD.findall(row.text or "")
        if len(words) < 1000:
            assert [tuple(x) for x in row.runs] == runs_by_hand(words)
        assert row.collapsed == collapsed(words, [tuple(x) for x in row.runs])
    by = {row.doc_id: row for row in rows}
    assert [tuple(x) for x in by[8].runs] == [(0, 60_000, 1)] and [tuple(x) for x in by[9].runs] == [(0, 30_000, 1001)] and by[10].runs == []
    assert runs.collapse_runs(df.where("false")).count() == 0


def test_planted_runs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_runs(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = runs_by_hand(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
