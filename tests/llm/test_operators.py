"""Each text operator against a brute-force version, and on nulls, empty and long texts, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from rainfold.llm import chat, common, components, dedup, jaccard, language_model, packing, pieces, pii, quality, toxicity, urls  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def documents():
    base = words(1, 120, 10_000)
    near = base.split()
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, "  \n ", None, "a"),
        (4, base, "en", "a"),
        (5, base, "en", "a"),
        (5, base, "en", "a"),
        (None, base.upper(), "en", "a"),
        (6, " ".join([*near[:60], "other", *near[61:]]), "de", "b"),
        (7, words(2, 30_000, 3000), "en", "a"),
        (8, "one two", "en", "a"),
        (9, "ONE  two", "en", "a"),
        (10, "mail to ann@example.org or +1 (555) 123-4567, from 10.0.0.1 with 4111 1111 1111 1111", "en", "a"),
        (11, "naïve café ▁ 日本語 😀 \x00 <s> <|endoftext|> ok\r\n\tx", "fr", "b"),
        (12, words(3, 50), None, None),
    ]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(documents(), SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in ("kept", "score", "ids", "spans", "key", "token", "component", "n", "entity", "grp", "word", "best", "x")})


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


def test_pieces(spark, docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode(docs, PIECES, decoded="back").collect()
    assert len(rows) == len(documents())
    for r in rows:
        want = lib.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.back == lib.decode(want)
    table = pieces.PrefixTable(open(PIECES, "rb").read())
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b", " ", "the", "▁", "\n", "é", "=-", "😀", "12"]) for _ in range(r.randrange(14)))
        assert table.encode(text) == lib.encode(text, add_eos=True)
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randrange(7))]
        assert table.decode(ids) == lib.decode(ids)
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text"), PIECES).drop("text"), PIECES)
    assert back.where("doc_id = 4").first().text == documents()[3][1]
    assert pieces.encode(none, PIECES).count() == 0


def test_pieces_of_long_runs_without_blanks():
    """Far more places that no piece spans than Python recurses."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.PrefixTable(open(PIECES, "rb").read())
    r = random.Random(6)
    for letters in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "😀日本語中文", "0123456789"):
        text = "".join(r.choice(letters) for _ in range(100_000))
        for t in (text, f"{text}\n {text[:5000]}"):
            ids = table.encode(t)
            assert ids == lib.encode(t, add_eos=True) and table.decode(ids) == lib.decode(ids)


def test_urls(spark):
    html = '<html><link href="{}" rel="canonical"></html>'
    rows = [
        (1, "http://bad.net/x", None, None),
        (2, "http://A.example.org/1?q#f", html.format("http://bad.net/x"), None),
        (3, "http://b.example.org/2", html.format("/3"), None),
        (4, "http://b.example.org/3", '<META http-equiv="refresh" content="0; URL=http://a.example.org/1?q">', None),
        (5, "http://www.example.net/en/1", html.format("http://bad.net/x"), None),
        (6, "http://c.example.org/fr/1", None, None),
        (7, "http://c.example.org/4", html.format("//c.example.org/fr/1"), None),
        (8, "http://d.net/4", html.format("http://c.example.org/fr/1"), None),
        (9, None, html.format("http://bad.net/x"), None),
        (10, "no scheme", "", None),
        (11, "http://net", None, None),
        (12, "http://x.example.com/de/", None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    rules = spark.createDataFrame([("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)], "rule_host string, rule_path string, allow boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()}
    # 1-5 are one group: 5 is allowed by its own rule, so the members without a rule are allowed
    assert got[1] == ("net/", "block") and got[5] == ("example.net/en/", "allow") and got[2] == (None, "allow") and got[3] == (None, "allow")
    assert got[6] == ("org/fr/", "allow") and got[7] == (None, "allow") and got[8] == ("net/", "block")
    assert got[9] == got[10] == got[11] == (None, "allow") and got[12] == ("example.com/de/", "block")
    fewer = {r.page_id: r.verdict for r in urls.filter_urls(pages.where("page_id != 5"), rules).collect()}
    assert [fewer[k] for k in (1, 2, 3, 4)] == ["block"] * 4  # the block reaches aliases of aliases
    assert urls.filter_urls(pages.where("false"), rules).count() == 0
    long = [(1, "http://q.test/1", "x" * 500_000 + html.format("http://bad.net/x"), None)] * 3 + [(2, "http://tie.test/a", None, None), (None, None, None, None)]
    tied = rules.union(spark.createDataFrame([("tie.test", "/a", False), ("tie.test", "/a", True)], rules.schema))
    got = sorted((r.page_id or 0, r.verdict) for r in urls.filter_urls(spark.createDataFrame(long, pages.schema), tied).collect())
    assert got == [(0, "allow"), (1, "block"), (1, "block"), (1, "block"), (2, "allow")]


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_quality(spark, docs, none):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not got[1].kept and not got[2].kept and not got[8].kept and got[4].kept and got[7].n_words == 30_000
    assert quality.judge(none).count() == 0
    many = [(k, words(k, 60 + k % 50, 900) + ("\n" + "#$% " * 200 if k % 50 == 0 else ""), "en", "a" if k % 3 else None) for k in range(600)]
    rows = quality.judge(spark.createDataFrame(many, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in rows if not r.base_failed and not r.kept} <= {k for k in range(600) if k % 50 == 0}
    assert all(r.kept for r in rows if r.doc_id % 50) and any(not r.kept for r in rows)
    kept = quality.drop_poor(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 1


def _brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts():
    r = random.Random(3)
    texts = [None, "", "a", " \n ", "x\x85y \xa0 z"] + [" ".join(r.choice("ab#c é\n") for _ in range(r.randrange(70))) for _ in range(400)]
    got = quality.text_statistics(texts)
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == _brute_counts(t)


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def _brute_spans(t):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(t or "") if _valid(k, m[0])]
    return sorted(found, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


def test_pii_spans():
    r = random.Random(5)
    bits = ["@", ".", "a", "b-", "+1", " ", "4", "192.168.0.1", "4111 1111 1111 1111", "x@y.z", "(555) 123-4567", "é", "%", "1", "2", "-"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        assert pii.find(t) == _brute_spans(t)


def test_pii_terms(spark, docs, none):
    """A name that stands close to one address in many documents gives it away; frequent words and copies don't."""
    rows = [(k, f"{words(k, 12)} Zarquon wrote {words(k + 500, 2)} zq@example.org today {words(k + 900, 12)}") for k in range(8)]
    rows += [(100 + k, "copied Hapax text ab@example.org here") for k in range(6)] + [(200 + k, f"today wrote {words(k, 30)}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.protect(df).collect()}
    for k in range(8):
        text = rows[k][1]
        assert [text[s.start : s.end] for s in out[k].spans if s.kind == "term"] == ["Zarquon"]
        assert "Zarquon" not in out[k].clean and "<EMAIL>" in out[k].clean and "<TERM>" in out[k].clean
    assert all([s.kind for s in out[100 + k].spans] == ["email"] for k in range(6))
    assert all(not out[200 + k].spans and out[200 + k].clean == rows[14 + k][1] for k in range(300))
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count() and pii.redact(none).count() == 0
    line = got.where("doc_id = 10").first()
    assert line.text == "mail to <EMAIL> or <PHONE>, from <IP> with <CARD>" and line.n_chars == len(line.text)
    assert got.where("doc_id = 1").first().text is None


def _brute_terms(rows, width, alpha, support):
    """{doc: {term: kind it is generalised to, or None}} by plain counting."""
    import re
    from math import log2

    near, df = [], {}
    for doc, text in rows:
        for w in {x.strip(pii.EDGES).lower() for x in text.split()}:
            df.setdefault(w, set()).add(doc)
        spans = pii.find(text)
        free = [(m.start(), m.end(), "" if any(a < m.end() and m.start() < b for _, a, b in spans) else m[0].strip(pii.EDGES).lower()) for m in re.finditer(pii.WORD, text)]
        for kind, a, b in spans:
            left, right = [w for _, e, w in free if e <= a][-width:], [w for s, _, w in free if s >= b][:width]
            words_ = tuple(w for w in left + right if w)
            value = f"{kind}:{text[a:b].lower()}"
            near += [(doc, e, words_) for e in (value, *pii.levels(value))]
    n, out = len(rows), {}
    for e in {e for _, e, _ in near}:
        docs = {d for d, x, _ in near if x == e}
        p = len(docs) / n
        for t in {w for _, x, ws in near if x == e for w in ws}:
            firsts = {}  # of a document its first surroundings that hold the term
            for d, x, ws in near:
                if x == e and t in ws:
                    firsts.setdefault(d, ws)
            k = pii.PRIOR if "/" in e.split(":")[0] else 0.0
            share = (len(firsts) + k * p) / (len(df[t]) + k)
            if p < 1 and len(set(firsts.values())) >= support and log2(share / p) >= alpha * -log2(p) - 1e-12:
                for d in firsts:
                    level = e.split(":")[0]
                    kind = level.split("/")[0] if "/" in level else None
                    old = out.setdefault(d, {})
                    order = lambda x: -1 if x is None else pii.KINDS.index(x)
                    old[t] = kind if t not in old else min(old[t], kind, key=order)
    return out


@pytest.mark.parametrize("support", [1, 2])
def test_pii_terms_by_counting(spark, support):
    """PMI at values and levels against plain counting: domains, networks and issuers recur, most values don't."""
    r = random.Random(11)
    firms = ["alpha.example.org", "beta.example.org", "gamma.test"]
    rows = []
    for k in range(120):
        bits = [f"w{r.randrange(40)}" for _ in range(r.randrange(4, 30))]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            f = r.randrange(3)
            word, mark = r.choice([(f"Firm{f}", f"u{r.randrange(50)}@{firms[f]}"), (f"net{f},", f"10.{f}.{r.randrange(3)}.{r.randrange(90)}"), (f"rare{r.randrange(60)}", f"+{1 + f} 555 {r.randrange(100, 999)} {r.randrange(1000, 9999)}")])
            bits[r.randrange(len(bits)) : 0] = [word, mark]
        rows.append((k, " ".join(bits)))
    want = _brute_terms(rows, 8, 0.9, support)
    assert {x for d in want.values() for x in d.values()} >= ({None, "email"} if support == 1 else {"email"})
    for got in pii.protect(spark.createDataFrame(rows, "doc_id long, text string"), support=support).collect():
        text = rows[got.doc_id][1]
        assert {text[s.start : s.end].lower() for s in got.spans if s.kind == "term"} == set(want.get(got.doc_id, {})), got
        for kind in {x for x in want.get(got.doc_id, {}).values() if x}:
            assert f"<{kind.upper()} TERM>" in got.clean


def test_pii_levels():
    assert pii.levels("email:a@x.y.example.org") == ["email/domain:x.y.example.org", "email/domain:example.org"] and pii.levels("email:a@b.cc") == ["email/domain:b.cc"]
    assert pii.levels("ip:010.2.3.4") == ["ip/24:10.2.3", "ip/16:10.2"] and pii.levels("card:4111 1111-11111111") == ["card/issuer:411111"]
    assert pii.levels("phone:+44 20 1234 5678") == ["phone/code:44"] and pii.levels("phone:+12025550123") == ["phone/code:120"]


def test_pii_is_linear_and_looks_far_left(spark):
    """No cut of the words to the left, and long lines of digits or entities cost no more than their sum."""
    import time

    text = "secretname " + "x" * 330 + " ann@example.org z"
    assert next(iter(pii.around(text, pii.find(text), 8)))[1] == ["secretname", "x" * 330, "z"]
    began = time.process_time()
    for hard in ("1" * 300_000 + ".1.1.", "a@b.cc," * 40_000, "1.1.1.1." * 40_000, "+1" * 100_000):
        list(pii.around(hard, pii.find(hard), 8))
    assert time.process_time() - began < 20


def test_pii_terms_of_unique_entities(spark, tmp_path):
    """The query and the pipeline judge an entity that occurs once, too."""
    import corpus_pipeline
    from rainfold.llm.queries import queries

    text = "plain words stand here Xylophant plain words una@example.org plain words stand here"
    rows = [(1, text)] + [(10 + k, f"plain words stand here {words(k, 20)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, mail = text.index("Xylophant"), text.index("una@")
    got = {r.doc_id: r.spans for r in queries()["op4_pii"](spark, str(tmp_path)).collect()}
    assert got[1] == f"term:{at}:{at + 9},email:{mail}:{mail + 15}" and all(got[10 + k] == "" for k in range(300))
    clean = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, str(tmp_path)).collect()}
    assert clean[1] == "plain words stand here <TERM> plain words <EMAIL> plain words stand here"


def test_rows_keep_their_identity_when_splits_change(spark, tmp_path, monkeypatch):
    """Executors come and go, so each scan of the same files may have other splits."""
    base = words(70, 60, 10_000)
    rows = [(k, f"{words(k, 60, 10_000)} Zarquon{k} u{k}@example.org" if k % 3 == 0 else "too short" if k % 3 == 1 else f"{base} copy{k}", "en", "a", k) for k in range(60)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(12, "doc_id").write.parquet(path)
    df = spark.read.parquet(path)
    real, turns = common.stored, []

    def stored(x):
        out = real(x)
        turns.append(0)
        spark.conf.set("spark.sql.files.openCostInBytes", ("1k", "4m", "64m")[len(turns) % 3])
        spark.conf.set("spark.sql.files.maxPartitionBytes", ("128m", "1k", "64m")[len(turns) % 3])
        return out

    for module in (dedup, jaccard, pii, quality):
        monkeypatch.setattr(module, "stored", stored, raising=False)
    try:
        near = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
        assert near == {k: (k, 1, 2)[k % 3] for k in range(60)}
        assert sorted(r.doc_id for r in jaccard.drop_near_copies(df).collect()) == sorted([1, 2, *range(0, 60, 3)])
        assert sorted(r.doc_id for r in quality.drop_poor(df).collect()) == [k for k in range(60) if k % 3 != 1]
        assert sorted(r.doc_id for r in dedup.drop_copies(df).collect()) == [k for k in range(60) if k % 3 != 1 or k == 58]
        for r in pii.protect(df, support=1).collect():
            found = [rows[r.doc_id][1][s.start : s.end] for s in r.spans]
            assert (f"Zarquon{r.doc_id}" in found and f"u{r.doc_id}@example.org" in found) if r.doc_id % 3 == 0 else not found
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _brute_components(rows):
    def shingles(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                old = comp[i]
                comp = [comp[j] if c == old else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    return sorted((d is None, d, len(s), least[c]) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def test_shingles_of_few_words():
    """A batch may hold fewer words than a shingle, or none."""
    import pyarrow as pa

    for texts in (["a b"], [None, "", "x"], [], ["a b c d", "A  B\nc D "]):
        sets = jaccard.shingle_sets(pa.array(texts, pa.string()))
        assert [len(s) for s in sets] == [int(bool(t)) for t in texts]
    assert (sets[0] == sets[1]).all()


def test_jaccard(spark, docs, none):
    r = random.Random(9)
    common = words(77, 60, 10_000).split()
    rows = [(d[0], d[1]) for d in documents()]
    base = [words(s, 100, 10_000).split() for s in range(6)]
    for k in range(160):  # a large group of near copies, borderline ones among them
        w = list(base[0] if k < 110 else r.choice(base))
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    for k in range(40):  # a passage that many otherwise different texts share
        rows.append((2000 + k, " ".join([*common, *words(3000 + k, 20 + k, 10_000).split()])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for factor in (4, -1000):  # the second one makes every document costly
        got = jaccard.near_duplicates(df, factor=factor).collect()
        assert sorted((x.doc_id is None, x.doc_id, x.n_shingles, x.component_id) for x in got) == _brute_components(rows)
        assert Counter(x.component_id for x in got if x.first and x.n_shingles).most_common(1)[0][1] <= 1
    assert jaccard.near_duplicates(none).count() == 0
    left = jaccard.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.where("doc_id in (4, 5, 6, 8, 9)").collect()) == [4, 8]


def test_language_model(spark, docs, none):
    rows = [(k, f"{'red green blue'.split()[k % 3]} {'cat dog'.split()[k % 2]} runs {words(k, 5, 30)}") for k in range(120)] + [(500, None), (501, ""), (None, "unseen words"), (7, rows7 := "red cat runs")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows7
    train = df.where("doc_id % 3 != 1")
    sizes = language_model.Sizes(heads=10, classes=4, lexicon=20, rounds=4, buckets=4)
    got = language_model.score(df, train, sizes=sizes).collect()
    texts = [t for d, t in rows if d is not None and d % 3 != 1]
    count = Counter(w for t in texts for w in (t or "").split())
    total, kinds = sum(count.values()) + len(texts), len(count) + 1
    by = {}
    for d, t in rows:
        w = (t or "").split()
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((len(texts) + 1) / (total + kinds + 1))
        by.setdefault(d, []).append((len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(base, 6)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) in by[r.doc_id] and r.score < 0
    assert language_model.score(none, none, sizes=sizes).count() == 0
    assert language_model.score(docs, docs, sizes=sizes).count() == docs.count()  # clashing names, long texts, nulls, repeated rows
    assert language_model.score(df.limit(3), none, sizes=sizes).count() == 3


def test_exchange_moves_are_best():
    """One unit at a time and many at once, against the likelihood of each class that it could move to."""
    import numpy as np

    r = np.random.default_rng(4)
    pairs = r.integers(0, 40, (12, 12))
    of = r.integers(0, 4, 12)
    n = np.zeros((4, 4))
    np.add.at(n, (of[:, None], of[None, :]), pairs)
    right, left = np.zeros((12, 4)), np.zeros((12, 4))
    for u in range(12):
        np.add.at(right[u], of, pairs[u])
        np.add.at(left[u], of, pairs[:, u])
    own = np.diag(pairs).astype(float)
    many = language_model.best_classes(n, of, right, left, own, 4)
    for u in range(12):
        moved = []
        for to in range(4):
            c = of.copy()
            c[u] = to
            m = np.zeros((4, 4))
            np.add.at(m, (c[:, None], c[None, :]), pairs)
            moved.append(language_model.likelihood(m))
        assert moved[many[u]] == pytest.approx(max(moved)) and language_model.best_class(n, of[u], right[u], left[u], own[u], 4) == many[u]


def _class_pairs(texts, of, k, end):
    import numpy as np

    n = np.zeros((k, k))
    for t in texts:
        at = end
        for w in [*t.split(), None]:
            to = end if w is None else of[w]
            n[at, to] += 1
            at = to
    return n


def test_exchange_against_plain_exchange():
    """The same classes as moving one unit after the other with the whole likelihood reckoned anew for each class."""
    import numpy as np

    r = np.random.default_rng(8)
    pairs = r.poisson(r.gamma(0.4, 6, (14, 14))).astype(float)
    sizes = language_model.Sizes(heads=12, classes=3, rounds=20)

    def total(of):
        n = np.zeros((5, 5))
        np.add.at(n, (of[:, None], of[None, :]), pairs)
        return language_model.likelihood(n)

    of = np.arange(14) % 3
    of[-2:] = 4, 3
    for _ in range(20):
        old = of.copy()
        for u in range(12):
            tried = []
            for to in range(3):
                other = of.copy()
                other[u] = to
                tried.append(total(other))
            if max(tried) > tried[of[u]] + 1e-7:
                of[u] = int(np.argmax(tried))
        if (old == of).all():
            break
    assert language_model.exchange(pairs, sizes).tolist() == of.tolist()


def test_language_model_scans_without_an_object_for_each_word(spark, monkeypatch):
    import sys
    from types import SimpleNamespace

    import pyarrow as pa

    class Scan:
        def select(self, *_):
            return self

        groupBy = agg = select

        def mapInArrow(self, run, _):
            self.run = run
            return self

    monkeypatch.setattr(language_model, "stored", lambda df: df)
    monkeypatch.setattr(language_model, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [None, "", " \n ", *(" ".join(f"The W{i}x{k}" for k in range(40)) for i in range(1000))]
    batches = [pa.record_batch([pa.array(texts[i : i + 100], pa.string())], names=["text"]) for i in range(0, len(texts), 100)]
    lexicon = SimpleNamespace(value=pa.array([b"the"] + [f"w{i}x0".encode() for i in range(1000)], pa.binary()))

    def made(scan):
        before, out, most = sys.getallocatedblocks(), [], 0
        for batch in scan.run(iter(batches)):
            out.append(batch)
            most = max(most, sys.getallocatedblocks() - before)
        assert most < 15_000  # over 40 000 distinct words
        return pa.Table.from_batches(out).to_pylist()

    want = Counter(w for t in texts for w in (t or "").encode().lower().split())
    assert Counter({r["word"]: r["c"] for r in made(language_model.word_counts(Scan()))}) == want
    rare = [r["word"] for r in made(language_model.observed(Scan(), lexicon, language_model.Sizes(buckets=8), "text")) if r["word"]]
    known = set(lexicon.value.to_pylist())
    assert Counter(rare) == Counter({w: c for w, c in want.items() if w not in known})


@pytest.mark.parametrize("lexicon", [6, 20])
def test_language_model_is_a_distribution(spark, lexicon):
    """Every word has the class that is best for its own neighbours, bigrams by class are those of plain counting, transitions and the words of a class sum to one, and scores follow word by word."""
    import numpy as np

    r = random.Random(12)
    texts = [" ".join(r.choice("the a cat dog runs sleeps".split() + [f"rare{r.randrange(12)}"]) for _ in range(r.randrange(1, 9))) for _ in range(80)]
    sizes = language_model.Sizes(heads=3, classes=3, lexicon=lexicon, rounds=4, refine=3, buckets=4)
    asked = [*texts[:20], "cat cat", "the", "", "zzz the", "dog zzz zzz rare1 rare2 the", "rare3"]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    known: list = []
    real, language_model.dropped = language_model.dropped, lambda *a: None
    real_learn, language_model.learn = language_model.learn, lambda *a: known.append(real_learn(*a)) or known[-1]
    try:
        scored = language_model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), train, sizes=sizes)
        got = {x.doc_id: x.score for x in scored.collect()}
    finally:
        language_model.dropped, language_model.learn = real, real_learn
    m = known[0]
    count = Counter(w for t in texts for w in t.split())
    of = {w.decode(): int(c) for w, c in zip(m.words, m.classes[: len(m.words)], strict=True)}
    rare = {x.word.decode(): x for x in m.rare.where("word is not null").collect()}
    assert not set(of) & set(rare) and set(of) | set(rare) == set(count) and all(x.c == count[w] for w, x in rare.items())
    assert len(rare) > 4 or lexicon == 20, (len(rare), len(of), count)
    assert all(0 <= k < 3 for k in of.values())
    # a rare word's class, by the whole likelihood
    first, of_lexicon = _class_pairs(texts, {w: of.get(w, 4) for w in count}, 5, 3)[:4, :4], dict(of)
    for w, x in rare.items():
        beside = []
        for t in texts:
            line = [3, *("w" if v == w else of_lexicon.get(v, 4) for v in t.split()), 3]
            beside += [(a, b) for a, b in zip(line, line[1:], strict=False) if ("w" in (a, b)) and 4 not in (a, b) and a != b]
        tried = []
        for to in range(3):
            n = first.copy()
            for a, b in beside:
                n[to if a == "w" else a, to if b == "w" else b] += 1
            tried.append(language_model.likelihood(n))
        assert x.k == 4 if count[w] < 2 else not beside or tried[x.k] == pytest.approx(max(tried), abs=1e-7)
        of[w] = x.k
    assert 1 in count.values() and np.array_equal(m.n, _class_pairs(texts, of, 5, 3))
    move, inner = language_model.probabilities(m.n, m.kinds, sizes)
    assert np.allclose((10**move).sum(1), 1)
    for k in range(3):
        own = [w for w in count if of[w] == k]
        assert sum(count[w] + sizes.added for w in own) == pytest.approx(10 ** inner[k], abs=1e-9)
    open_ = [w for w in count if of[w] == 4]
    unseen = len(open_) / 2 + 1
    assert sum(count[w] / 2 for w in open_) + unseen == pytest.approx(10 ** inner[4])
    for d, t in enumerate(asked):
        at, total = 3, 0.0
        for w in t.split():
            k = of.get(w, 4)
            total += move[at, k] + math.log10(count[w] + sizes.added if k < 4 else count[w] / 2 or unseen) - inner[k]
            at = k
        assert got[d] == pytest.approx(total + move[at, 3])


def test_exact_dedup(spark, docs, none):
    rows = documents() + [(k, f"copy {k % 7}", None, None, None) for k in range(100, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    fold = lambda t: (t or "").encode().lower()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(fold(t), []).append(d)
    got = dedup.exact_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    small = dedup.exact_groups(df, fit=2000).collect()  # every task spills
    key = lambda r: (r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept)
    assert sorted(map(key, small)) == sorted(map(key, got))
    assert dedup.exact_groups(none).count() == 0
    assert dedup.drop_copies(docs).columns == docs.columns and dedup.drop_copies(docs).count() == 10


def test_grace_recursion():
    rows = [(dedup.content_hash(c), c, k, 1) for k, c in enumerate([b"%d" % (k % 500) * 20 for k in range(3000)])]
    tables = list(dedup.grace(iter(rows), 5000))
    found = [r for t in tables for r in t.rows()]
    assert len(tables) > 16 and len(found) == 500 and all(n == 6 for *_, n in found) and {b for _, _, b, _ in found} == set(range(2500, 3000))


def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n### User:\nhi", "\\b\\e\\h\\c", "a:\n", "", None, "###", "\\", "é😀"]
    rows = [(1, 0, "system", "be"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "assistant", "x"), (3, 0, "user", "q"), (4, None, None, None), (None, 1, "user", "u"), (None, 2, "assistant", "v")]
    rows += [(10 + k, t, ("user", "assistant", "tool:\n###")[t % 3], x) for k, x in enumerate(hard) for t in range(3)] + [(5, 1, "user", "b"), (5, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).withColumn("loss", chat.loss_text()).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda y: (y[0] is not None, y[0] or 0, *y[1:]))
        assert [(x.role, x.text) for x in got[conv].read_turns] == [(r, x) for _, r, x in own]
        assert got[conv].loss == "".join(x for _, r, x in own if r == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
    assert got[1].valid and not got[2].valid and not got[3].valid and not got[4].valid and got[None].valid and not got[5].valid
    assert chat.format_chats(df.where("false")).count() == 0
    assert [x.state for x in got[1].segments[1::3]] == ["system", "user", "assistant"] and [x.state for x in got[5].segments[1::3]] == ["user", "!"]
    odd = chat.Template(mark="[[", colon="|>", tail="]]\n", roles={"user": ("U", True), "assistant": ("A", False)}, moves={"": ("user",), "user": ("user",)}, ends=("user",))
    texts = ["]]", "]]\n[[A|>x", "|>", "\\b\\]]", "[[", "]", "|", ""]
    other = spark.createDataFrame([(1, k, "user", x) for k, x in enumerate(texts)] + [(2, 0, "[[r|>", "y]]" * 50_000)], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(other, odd), odd).withColumn("loss", chat.loss_text(odd)).collect()}
    assert [x.text for x in back[1].read_turns] == texts and back[1].loss == "".join(texts) and back[1].valid
    assert back[2].read_turns[0].role == "[[r|>" and back[2].read_turns[0].text == "y]]" * 50_000 and back[2].state == "!"
    for bad in ({"tail": "aa"}, {"colon": ""}, {"mark": "e>"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_segments():
    r = random.Random(2)
    for _ in range(300):
        s = [r.choice([-3.0, -1.0, -1.0, 2.0, 4.0]) for _ in range(r.randrange(1, 25))]
        got = toxicity.segments([(k, x) for k, x in enumerate(s) if x != -1.0], -1.0, len(s))

        def maximal(a, b):  # the definition, by recursion on the best segment
            best = max(((round(sum(s[i:j]), 9), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = best[3], best[4]
            return [*maximal(a, i), (i, j, best[0]), *maximal(j, b)]

        assert [x for *_, x in got] == pytest.approx([x for *_, x in maximal(0, len(s))])
        for a, b, x in got:  # maximal: no proper part is better, and no other segment overlaps
            assert x == pytest.approx(sum(s[a:b])) and s[a] > 0 and s[b - 1] > 0
            assert all(sum(s[a:k]) > 0 and sum(s[k:b]) > 0 for k in range(a + 1, b))
        assert all(a2 >= b1 for (_, b1, _), (a2, _, _) in zip(got, got[1:]))


def test_extreme_value_law(spark):
    """Decay and scale come from chance segments of clean texts that made no lexicon; the evidence follows from them."""
    model = toxicity.Model({b"bad": 2.0}, -0.5, 0.8, 0.01, level=0.05)
    found, parts = toxicity.evidence("ok bad bad bad ok " + "ok " * 95, model)
    assert parts == [(1, 4, 6.0)] and found == pytest.approx(0.8 * 6 - math.log(0.01 * 100) + math.log(0.05))
    assert toxicity.evidence("ok bad ok", model)[0] == 0.0 or toxicity.evidence("ok bad ok", model)[1]
    r = random.Random(1)
    rows = [(k, " ".join("slur" if r.random() < (0.1 if k % 4 == 0 else 0.002) else f"w{r.randrange(400)}" for _ in range(60)), int(k % 4 == 0)) for k in range(800)]
    got = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert got.scores[b"slur"] > 0 > got.rest and 0 < got.decay <= 1 and got.scale > 0 and got.slope > 0


def test_toxicity(spark, none):
    rows = [(k, words(k, 80, 300) + (" you idiot fool" * (1 + k % 3) if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = df.where(~held).select("doc_id", "label").union(spark.createDataFrame([(None, 1), (3, None), (5, 0)], "doc_id long, label int"))
    model = toxicity.fit(toxicity.labelled(df, labels))
    got = toxicity.score(df.where(held), model, passages=True).collect()
    assert len(got) > 100 and all((r.score >= 0.7) == (r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in got)
    toxic = next(r for r in got if r.doc_id % 5 == 0)
    assert any("idiot" in toxic.text.split()[p.start : p.end] for p in toxic.passages)
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 50_000)], "doc_id long, text string"), model).collect()
    assert [r.score >= 0.7 for r in odd] == [False, False, True]
    empty = toxicity.fit(df.where("false"))
    assert all(r.score == 0 for r in toxicity.score(df.limit(2), empty).collect()) and toxicity.score(none, model).count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    rows = [(d, t) for d, t, *_ in documents() if d not in (5, None)] + [(100 + k, words(k, 40 * (k % 9))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, BYTES, ids=True, shard_docs=16).collect()
    ids = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs, BYTES).count() >= docs.count() and packing.pack(none, BYTES).count() == 0


def test_packing_codes_without_an_object_for_each_chunk():
    import sys

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = open(BYTES, encoding="utf-8").read()
    lib, coder = Tokenizer.from_str(spec), packing.ByteBPE(spec, memo=30_000)
    for turn in range(3):  # the second turn meets chunks again, the third one a table begun anew
        texts = [None, "", *(" ".join(f"wörd{turn // 2}q{i}x{k}, it's\nW{k}." for k in range(40)) for i in range(500)), "a\x00 b  c"]
        arrow, before = pa.array(texts, pa.string()), sys.getallocatedblocks()
        ids, ends = coder.encode_all(arrow, 1)
        assert sys.getallocatedblocks() - before < 10_000  # over 20 000 distinct chunks
        want = [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_packing_prefers_neighbours():
    import numpy as np

    a, b = [np.array([1, 2, 3, k + 50] * 10, np.uint16) for k in range(4)], [np.array([7, 8, 9, k + 80] * 10, np.uint16) for k in range(4)]
    mixed = [x for pair in zip(a, b, strict=True) for x in pair]
    got = list(packing.order(mixed, 160, 0))
    assert {k % 2 for k in got[:4]} == {0} and {k % 2 for k in got[4:]} == {1} and sorted(got) == list(range(8))


def test_packing_finds_neighbours_across_partitions(spark):
    """Topics lie as far apart as the input allows; figures are those of the corpus and windows hold one topic."""
    import numpy as np

    rows = [(k, " ".join(f"{'alpha beta gamma delta'.split()[k % 4]}{w}" for w in words(k, 60, 30).split())) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    windows = {}
    for r in packing.pack(df, BYTES, shard_docs=100).collect():
        windows.setdefault(r.sequence_id, []).append((r.length, r.doc_id % 4))
    tokens = sum(n for w in windows.values() for n, _ in w)
    assert sum(max(sum(n for n, t in w if t == topic) for topic in range(4)) for w in windows.values()) > 0.9 * tokens
    docs = [np.array([1, 2, 3]), np.array([1, 2, 4])]
    rare, common = packing.Corpus(100, 3.0, np.array([0, 99, 1, 5, 5])), packing.Corpus(100, 3.0, np.array([0, 1, 99, 5, 5]))
    assert packing.Index(docs, corpus=rare).weight[1] > packing.Index(docs, corpus=common).weight[1]
    every = [np.arange(k, k + 40) for k in (0, 20)]  # half of the terms are shared, not only the first ones
    assert packing.Index(every, corpus=packing.Corpus(100, 40.0, np.ones(60))).scores(0)[1] == pytest.approx(20 * packing.Index(every, corpus=packing.Corpus(100, 40.0, np.ones(60))).weight[0])
