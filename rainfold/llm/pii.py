"""Personal data: patterns first, then terms that give the protected entities away.

After Sanchez and Batet's C-sanitisation (2016): a term t discloses an entity e as far as
their pointwise mutual information reaches e's own information, PMI(t; e) >= alpha * IC(e). Both come
from co-occurrence in the corpus: p(t) and p(e) are shares of all documents, p(t, e) is
the share of documents in which t stands close to e. A term beyond the threshold is
protected wherever it stands in a text that has it close to the entity.

Most entities occur once, so the corpus says little of them. What they belong to does recur: an address's domain,
a network, a card's issuer, a phone's calling code. PMI and IC are taken at each such level too, as if it were an entity. There a term needs
witnesses: p(e | t) is drawn towards p(e) as by ``PRIOR`` further documents with t. A term that gives away the value
is removed; one that gives away a level only is generalised to that kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, dropped, held, named, quoted, slices, stored, text_hash

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, so each run is walked once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>"
#: Documents of no evidence that every term is given at a level.
PRIOR = 1.0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain; the local part reaches back as far as it can."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) in code points, by start, then kind as listed."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    if text.count(".") > 2:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def around(text: str, spans: list[tuple[str, int, int]], width: int) -> Iterator[tuple[str, list[str]]]:
    """Each entity (as kind:value) with the terms close to it: up to ``width`` words on each side that hold no part of an entity.

    The text's words are found once, so long texts, long words and many entities cost no more than their sum.
    """
    if not spans:
        return
    words = _words(text, spans)
    starts, ends = [a for a, _, _ in words], [b for _, b, _ in words]
    for kind, a, b in spans:
        k, j = bisect_right(ends, a), bisect_left(starts, b)
        near = [w for *_, w in (*words[max(0, k - width) : k], *words[j : j + width]) if w]
        yield f"{kind}:{_lower(text[a:b])}", near


def levels(entity: str) -> list[str]:
    """What an entity (kind:value) belongs to, as kind/level:value: the domain and the last two labels of an address, an IP's /24 and /16 networks, a card's first six digits, a phone's digits up to the first mark, at most three."""
    kind, value = entity.split(":", 1)
    if kind == "email":
        domain = value.rsplit("@", 1)[1]
        return list(dict.fromkeys([f"email/domain:{domain}", f"email/domain:{'.'.join(domain.split('.')[-2:])}"]))
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in value.split(".")]
        return [f"ip/24:{'.'.join(parts[:3])}", f"ip/16:{'.'.join(parts[:2])}"]
    if kind == "card":
        return [f"card/issuer:{re.sub('[^0-9]', '', value)[:6]}"]
    return [f"phone/code:{re.match('[0-9]*', value[1:])[0][:3]}"]


def _with_content(met: DataFrame, ce: DataFrame) -> DataFrame:
    """``met`` with the documents of each entity (ce). At most ``FEW`` entities hold more than their share of all documents: these are broadcast, so no key of the shuffle is large."""
    total = ce.agg(F.sum("ce")).first()[0] or 0
    often = F.col("ce") > total / FEW
    heavy = F.broadcast(ce.where(often))
    return met.join(heavy, "entity").unionByName(met.join(heavy, "entity", "left_anti").join(ce.where(~often), "entity"))


def _words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of each word; the term, without marks around it and in lower case, is empty where a part of the word is an entity's."""
    out, k, reach = [], 0, -1
    for m in WORD.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][1] < b:
            reach = max(reach, spans[k][2])
            k += 1
        out.append((a, b, "" if reach > a else _lower(m[0].strip(EDGES))))
    return out


def _lower(x: str) -> str:
    return x.encode().lower().decode()


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
def document_frequency(df: DataFrame, text: str = "_text") -> DataFrame:
    """(term, docs): documents that hold each term, added up in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        strip = EDGES.encode()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "docs"])

        for batch in slices(batches, text):
            for t in batch.column(text).to_pylist():
                if t:
                    found.update({w.strip(strip) for w in set(t.encode().lower().split())})
            if len(found) > 400_000:
                yield flush()
                found.clear()
        yield flush()

    return df.mapInArrow(run, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def protect(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 8, alpha: float = 0.9, support: int = 3, placeholders: dict[str, str] | None = None, whole: bool = False) -> DataFrame:
    """One row for each input row: key, spans (array<struct<kind, start, end>>), clean, the text with placeholders, and with ``whole`` the row itself.

    ``spans`` are the base spans and one of kind ``term`` for each word that gives away an
    entity close to it, by start, then kind. A term counts as close within ``width`` words, and discloses
    an entity if PMI >= ``alpha`` * IC in at least ``support`` different surroundings. With 3, copies of
    one text prove nothing, but entities that occur once or twice get no terms; with 1, PMI alone decides
    for every entity, as in the registered query and the pipeline. ``levels`` of an entity are judged like it, their PMI with ``PRIOR``. In ``clean`` entities are generalised to their kind's
    placeholder, terms are removed to theirs, and terms that give away a level only become ``<EMAIL TERM>`` and the like; overlapping spans become the first one's. A null text
    has no spans and stays null; equal rows have a result each. Texts are known again by their
    hash, so none is written. Nothing is collected per entity: pairs are at most 2 * ``width`` for each entity in a
    text. The terms of up to ``FEW`` texts are broadcast; with more, the texts that have an entity, and no others, are joined with theirs.
    """
    marks = {k: f"<{k.upper()}>" for k in (*KINDS, *(f"{k} term" for k in KINDS))} | (placeholders or {})
    own = [F.struct(*named(df)).alias("_row")] if whole else []
    rows = df.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).cast("string").alias("_text"), *own)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "_text"):
            out: list[tuple] = []
            for h, t in zip(batch.column("h").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                seen: dict[str, set] = {}  # of a document: each entity and level with its terms
                for value, near in around(t, find(t), width) if t else ():
                    place = xxhash.xxh3_64_intdigest(" ".join(near).encode()) - (1 << 63)
                    for entity in (value, *levels(value)):
                        terms = seen.setdefault(entity, set())
                        out += [(h, entity, None, place, 1)] * (not terms) + [(h, entity, w, place, 1) for w in dict.fromkeys(near) if w not in terms]
                        terms.update(["", *near])
            kinds = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["h", "entity", "term", "place", "n"])

    near = stored(rows.select("_text", text_hash(F.col("_text")).alias("h")).mapInArrow(scan, "h binary, entity string, term string, place long, n long"))
    ce = stored(near.where("term is null").groupBy("entity").agg(F.sum("n").alias("ce")))
    places = [F.count_distinct("place").alias("places")] if support > 1 else [F.lit(1).alias("places")]
    met = stored(near.where("term is not null").groupBy("entity", "term").agg(F.sum("n").alias("cte"), *places).where(F.col("places") >= support))
    suspects = stored(_with_content(met, ce))
    total = rows.count()
    known = document_frequency(rows.select("_text"))
    n, (ct, ce_, cte) = F.lit(float(total)), (F.col(c).cast("double") for c in ("docs", "ce", "cte"))
    level = F.split_part("entity", F.lit(":"), F.lit(1))  # kind, or kind/level
    drawn = F.when(level.contains("/"), PRIOR).otherwise(0.0)
    pmi, content = F.log2((cte + drawn * ce_ / n) / (ct + drawn) * n / ce_), F.log2(n / ce_)
    disclosing = stored(suspects.join(known, "term").where((pmi >= alpha * content) & (content > 0)).select("entity", "term", F.when(level.contains("/"), F.split_part(level, F.lit("/"), F.lit(1))).alias("kind")))
    told = F.broadcast(disclosing) if disclosing.count() <= FEW else disclosing
    # a term's least kind: null, the value itself, before the first kind as listed
    kinds_of = near.where("term is not null").join(told, ["entity", "term"]).groupBy("h", "term").agg(F.min(F.struct(F.col("kind").isNotNull(), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "kind")).alias("least"))
    extra = held(kinds_of.groupBy("h").agg(F.collect_list(F.struct("term", F.col("least.kind").alias("kind"))).alias("terms")))
    dropped(near, ce, met, suspects, disclosing)

    def with_entities(want: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                yield batch.filter(pa.array([bool(find(t)) is want for t in batch.column("_text").to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            spans, clean = [], []
            for t, terms in zip(batch.column("_text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                own, general = find(t), {}
                if terms:
                    terms = {x["term"]: x["kind"] for x in terms}
                    for a, b, w in _words(t, own):
                        if w in terms:
                            at = a + len(t[a:b]) - len(t[a:b].lstrip(EDGES))
                            own.append(("term", at, at + len(w)))
                            general[at] = terms[w]
                    own.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                if own:
                    parts, at = [], 0
                    for k, a, b in own:
                        if a >= at:
                            parts += [t[at:a], marks[f"{general[a]} term" if k == "term" and general[a] else k]]
                        at = max(at, b)
                    t = "".join([*parts, t[at:]])
                clean.append(t)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, pa.list_(SPAN)), pa.array(clean, pa.string())], names=[*keep, "spans", "clean"])

    keep = ["_key", *(["_row"] if whole else [])]
    schema = rows.drop("_text").withColumns({"spans": F.lit(None).cast(SPANS), "clean": F.lit(None).cast("string")}).schema
    terms_of = lambda x, few: x.withColumn("h", text_hash(F.col("_text"))).join(F.broadcast(extra) if few else extra, "h", "left").drop("h").mapInArrow(mark, schema)
    if extra.count() <= FEW:
        out = terms_of(rows, True)
    else:
        free = with_entities(False).withColumns({"spans": F.array().cast(SPANS), "clean": F.col("_text")}).drop("_text")
        out = terms_of(with_entities(True), False).unionByName(free)
    return out.withColumnRenamed("_key", key)


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", chars: str = "n_chars", support: int = 3) -> DataFrame:
    """The rows, with columns of any names, with the text that ``protect`` leaves, and its length in ``chars`` where there is such a column."""
    out = protect(df, text, key, support=support, whole=True)
    new = {text: F.col("clean")} | ({chars: F.length("clean").cast(df.schema[chars].dataType)} if chars in df.columns else {})
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in df.columns])
