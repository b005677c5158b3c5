"""The pipeline's stages one after the other, and the registered queries with SQL."""

import random

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from rainfold.llm import dedup, jaccard, pii, quality  # noqa: E402
from rainfold.llm.queries import oracle_sql, queries  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if name == "quality rules":
            want = {r.doc_id for r in quality.judge(before).where("kept").collect()}
        elif name == "exact dedup":
            want = {r.doc_id for r in dedup.exact_groups(before).where("kept").collect()}
        elif name == "n-gram Jaccard join":
            want = {r.component_id for r in jaccard.near_duplicates(before).collect()}
        else:
            want = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} == want and want
        if k < 4:
            assert docs.columns == columns
        if name == "PII":
            assert not any(s[0] == "email" for r in docs.collect() for s in pii.find(r.text))
    assert docs.where("length > 2048 or offset + length > 2048").isEmpty()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, SCORE string, _rf_row long"


def _words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def _awkward():
    """Nulls in any column, empty, long and repeated texts, ties and columns whose names the stages might use."""
    base = _words(1, 150)
    near = base.split()
    rows = [(k, _words(100 + k, 60 + k), "en" if k % 2 else None, None if k % 3 else "s") for k in range(40)]
    rows += [(900, None, "en", "s"), (901, "", None, None), (None, base, "en", "s"), (902, base.upper(), "en", "s"), (902, base, "en", "s"), (902, base, "en", "s")]
    rows += [(903, " ".join([*near[:70], "other", *near[71:]]), "en", "s"), (904, _words(7, 30_000), "en", "s"), (905, "too short", "en", "s"), (906, _words(9, 80) + " ann@example.org", "en", "s")]
    return [(d, t, a, b, None if t is None else len(t), 1, "x", 5) for d, t, a, b in rows]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(_awkward(), SCHEMA)
    rows = _awkward()
    fold = lambda t: t.encode().lower()
    kept = [r for r in rows if r[1] and len(r[1].split()) >= 20]  # no text repeats itself, and there are too few for outliers
    best = {}
    for r in kept:
        best[fold(r[1])] = max(best.get(fold(r[1]), -1), -1 if r[0] is None else r[0])
    unique = [(d, t) for t, d in best.items()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in unique for w in [t.split()]}
    first = {d: min(e for e in sets if 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])) for d in sets}  # no chains here
    want = [sorted(-1 if r[0] is None else r[0] for r in kept), sorted(sets), sorted(set(first.values())), sorted(set(first.values()))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == [c.split()[0].strip("`") for c in SCHEMA.split(", ")]
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect()) == want[k]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == set(want[3])
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_columns_of_any_name(spark):
    from rainfold.llm import pieces, toxicity

    df = spark.createDataFrame([(1, "some words here", 1, 2, 3)], "doc_id long, text string, `a.b` int, SCORE int, IDS int")
    got = toxicity.score(df, toxicity.Model({b"words": 3.0}, -0.2, 1.0, 0.01)).first()
    assert got["a.b"] == 1 and got["IDS"] == 3 and 0 <= got["score"] <= 1
    import public_tokenizers

    assert pieces.encode(df, public_tokenizers.path("piece_bpe_32k.model")).columns == ["doc_id", "text", "a.b", "SCORE", "ids"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
