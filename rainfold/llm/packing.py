"""Packing of documents into training windows by lexical retrieval.

Document frequencies and the mean length are those of the whole corpus. Documents
are dealt to shards of bounded size by content: vectors of their BM25 weights meet clusters
that lie in an order of similarity, and then their strongest terms. A seed document opens a window; the unused
documents of its shard that score best against it, by all its terms, fill the rest. A document that
a window cuts goes on in the next one, as its seed. The window that a shard leaves open is filled
by the next shard of the same partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

SPECIAL = "<|endoftext|>"
#: How byte-level tokenizers split texts before their merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The Unicode property White_Space, as the split pattern of the tokenizer has it.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What makes a text more than words parted by single blanks or single line feeds, or may hold the special token (RE2).
ODD = r"  | \n|\n |\n\n|^\n|[ \n]\z|\x00|" + SPECIAL.replace("|", r"\|") + r"|[\t\r\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A comma or full stop behind a word, which the pattern parts from it (RE2).
MARK = r"([\pL\pN])([.,])( |\z)"
CUTS = re.compile(f"(?= [^{SPACES}])")


class ByteBPE:
    """Ids of texts by a tokenizers file of the byte-level kind.

    The split pattern never joins what stands on both sides of a blank before a word,
    so chunks between those places are independent. Each chunk is coded once and its ids
    lie in one table; texts are lists of places in that table, which numpy gathers. Chunks stay in
    Arrow arrays, from the split to the call that codes new ones: none becomes a Python object.
    The merges of a chunk run in tiktoken, with the ranks that the file gives; a file
    whose ids aren't in the order of its merges raises ValueError. ``memo``: chunks that the table
    holds before it is begun anew.
    """

    def __init__(self, spec: str, memo: int = 600_000):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_str(spec), memo
        model, pre = json.loads(spec)["model"], json.loads(spec)["pre_tokenizer"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(model["vocab"][m.replace(" ", "", 1)] != 256 + k for k, m in enumerate(merges)) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("packing takes byte-level tokenizers whose ids follow their merges")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in x): i for x, i in model["vocab"].items() if i < 256 + len(merges)}
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.feed = self.coder.encode_single_token("\n")
        self.chunks = _Chunks()

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Where the chunks lie in the table: a blank and a word, a line feed and a word, or, behind a zero character, what no blank precedes.

        New ones are coded in one call, each in a line of its own, which no chunk shares with another.
        """
        at = pc.index_in(keys, value_set=self.chunks.keys)
        if not at.null_count:
            return at.to_numpy()
        unknown = pc.is_null(at)
        new = keys.filter(unknown)
        fed = pc.starts_with(new, "\n")
        blank = pc.if_else(pc.or_(fed, pc.starts_with(new, "\0")), "", " ")
        lines = pc.binary_join_element_wise(blank, pc.replace_substring_regex(new, r"^[\x00\n]", ""), "\n", "")
        upto = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
        ids = self.coder.encode_to_numpy(lines.buffers()[2][upto[0] : upto[-1]].to_pybytes().decode(), disallowed_special=())
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = self.chunks.add(new, ids, np.flatnonzero(ids == self.feed), fed.to_numpy(zero_copy_only=False))
        return place

    def _odd(self, text: str) -> list[int]:
        if SPECIAL in text or "\0" in text:  # the special token's string is a token by itself, wherever it stands
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return list(chain.from_iterable(self.coder.encode_ordinary_batch(CUTS.split(text), num_threads=1)))

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, each followed by ``end_id``, and where each text ends. Null counts as empty."""
        if len(self.chunks.keys) > self.memo:
            self.chunks = _Chunks()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.replace_substring(pc.binary_join_element_wise("\0", pc.if_else(odd, "", texts), ""), "\n", " \n")
        words = pc.split_pattern(pc.replace_substring_regex(plain, MARK, "\\1 \0\\2\\3"), " ")
        known = words.flatten().dictionary_encode()
        place = self._places(known.dictionary)[known.indices.to_numpy()]
        upto = words.offsets.to_numpy() - words.offsets[0].as_py()
        own = [np.array(self._odd(t), np.uint32) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)] if pc.any(odd).as_py() else []
        flat, start, sizes = self.chunks.ids, self.chunks.start, self.chunks.size[place]
        after = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(start[place] - after[:-1], sizes) + np.arange(after[-1])]
        cuts = after[upto]
        parts, close = [], np.array([end_id], np.uint32)
        for k in range(len(texts)):
            parts += [own[k] if own and own[k] is not None else ids[cuts[k] : cuts[k + 1]], close]
        out = np.concatenate([np.zeros(0, np.uint32), *parts])
        return out, np.cumsum([len(a) + 1 for a in parts[::2]], dtype=np.int64)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without special tokens added; null counts as empty."""
        return self.encode_all(pa.array([text], pa.string()), 0)[0][:-1].tolist()


class _Chunks:
    """The chunks of a table of ids, and where each one's ids lie; the empty text's place is 0."""

    def __init__(self):
        self.keys = pa.array(["\0"], pa.string())
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, close: np.ndarray, fed: np.ndarray) -> np.ndarray:
        """The places of new chunks, whose ids end before the line feeds at ``close``; that of a key with a line feed (``fed``) begins with the one before it."""
        start = np.concatenate([[0], close[:-1] + 1])
        place = np.arange(len(self.keys), len(self.keys) + len(keys))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.start = np.concatenate([self.start, len(self.ids) + start + 1 - fed])
        self.size = np.concatenate([self.size, close - start + fed])
        self.ids = np.concatenate([self.ids, ids[close[:1]], ids])
        return place


_TOKENIZERS: dict[str, ByteBPE] = {}


def tokenizer(spec: str) -> ByteBPE:
    if spec not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[spec] = ByteBPE(spec)
    return _TOKENIZERS[spec]


@dataclass(frozen=True)
class Corpus:
    """Number and mean length of all documents, and in how many each token id occurs."""

    docs: int
    mean: float
    df: np.ndarray

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | int, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        idf = np.log1p((self.docs - self.df[term] + 0.5) / (self.df[term] + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.mean))


def terms_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) for the distinct terms of each document, in this order."""
    if not docs:
        return (np.zeros(0, np.int64),) * 3
    sizes = [len(d) for d in docs]
    keys = (np.repeat(np.arange(len(docs), dtype=np.int64), sizes) << 32) | np.concatenate(docs)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first] >> 32, keys[first] & 0xFFFFFFFF, np.diff(np.append(first, len(keys)))


def corpus_of(docs: list[np.ndarray]) -> Corpus:
    """The figures of documents that are at hand."""
    return Corpus(len(docs), float(np.mean([max(1, len(d)) for d in docs])) if docs else 1.0, np.bincount(terms_of(docs)[1]))


class Index:
    """BM25 over the token ids of a shard's documents, by the figures of the corpus.

    Terms that many of the documents have are rows of a matrix, all others are inverted lists; a query reads its own terms alone.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        corpus, self.n = corpus or corpus_of(docs), len(docs)
        doc, term, tf = terms_of(docs)
        self.first = np.searchsorted(doc, np.arange(self.n + 1))
        self.weight = corpus.weights(term, tf, np.array([max(1, len(d)) for d in docs], np.float64)[doc])
        of = np.full(int(term.max(initial=-1)) + 1, -1, np.int64)
        names = np.flatnonzero(np.bincount(term)) if len(term) else np.zeros(0, np.int64)
        of[names] = np.arange(len(names))
        self.term = of[term]
        self.size = np.bincount(self.term, minlength=len(names))
        order = np.argsort(self.term, kind="stable")
        self.docs, self.weights, self.start = doc[order], self.weight[order], np.cumsum(self.size) - self.size
        wide = np.flatnonzero(self.size > max(8, self.n // 8))
        self.row = np.full(len(names), -1, np.int64)
        self.row[wide] = np.arange(len(wide))
        self.matrix = np.zeros((len(wide), self.n))
        inside = self.row[self.term] >= 0
        self.matrix[self.row[self.term[inside]], doc[inside]] = self.weight[inside]

    def scores(self, doc: int) -> np.ndarray:
        """The scores of all documents against this one's terms, all of them."""
        asked = self.term[self.first[doc] : self.first[doc + 1]]
        row = self.row[asked]
        mask = np.zeros(len(self.matrix))
        mask[row[row >= 0]] = 1
        lists = asked[row < 0]
        sizes = self.size[lists]
        upto = np.cumsum(sizes)
        at = np.repeat(self.start[lists] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        return mask @ self.matrix + np.bincount(self.docs[at], self.weights[at], self.n)


@lru_cache(maxsize=1)
def _directions(terms: int, size: int = 128) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((terms, size), np.float32)


def vectors(docs: list[np.ndarray], corpus: Corpus, shard_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document a random projection of its BM25 weights, of length 1, and its strongest term that several shards don't share."""
    of, n = _directions(len(corpus.df)), len(docs)
    doc, term, tf = terms_of(docs)
    weight = corpus.weights(term, tf, np.array([len(d) for d in docs], np.float64)[doc])
    first = np.searchsorted(doc, np.arange(n + 1))
    light = weight.astype(np.float32)
    out = np.zeros((n, of.shape[1]), np.float32)
    for k in range(n):
        a, b = first[k], first[k + 1]
        out[k] = light[a:b] @ of[term[a:b]]
    df = corpus.df[term]
    own = (df > 1) & (df <= shard_docs)
    strongest = np.full(n, -1, np.int64)
    rank = np.lexsort((-term[own], weight[own], doc[own]))  # a document's last one is its strongest, of equal ones the smallest id
    strongest[doc[own][rank]] = term[own][rank]
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9), strongest


def centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; each centre is followed by the one most similar to it that isn't placed."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]), np.float32)
    found = sample[np.random.default_rng(3).choice(len(sample), min(clusters, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        found = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)
    left, at, placed = np.ones(len(found), bool), 0, []
    for _ in found:
        left[at] = False
        placed.append(at)
        at = int(np.argmax(np.where(left, found @ found[at], -2.0)))
    return found[placed]


def order(docs: list[np.ndarray], window: int, filled: int, corpus: Corpus | None = None) -> Iterator[int]:
    """Documents of a shard in the order in which they fill windows; ``filled``: tokens that the open window has."""
    index = Index(docs, corpus)
    unused = np.ones(len(docs), bool)
    next_seed, left = 0, window - filled
    score: np.ndarray | None = None
    for _ in docs:
        if score is None:
            while not unused[next_seed]:
                next_seed += 1
            pick = next_seed
            score = index.scores(pick)
        else:
            pick = int(np.argmax(score))  # the first of equal ones
        unused[pick] = False
        yield pick
        size = len(docs[pick])
        if size > left:  # the window closes; what is left of this document opens the next one
            left = window - (size - left) % window
            score = index.scores(pick) if left < window else None
        elif size == left:
            left, score = window, None
        else:
            left -= size
        if score is not None:
            score[~unused] = -1


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each document; they are stored in two bytes each if the vocabulary allows it, else in four."""
    wide = batch.column("_wide")[0].as_py()
    return [np.frombuffer(x, "<u4" if wide else "<u2") for x in batch.column("_ids").to_pylist()]


def _figures(coded: DataFrame) -> Corpus:
    """One number for each token id of the vocabulary, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, tokens = np.zeros(0, np.int64), 0, 0
        for batch in slices(batches, "_ids"):
            got = _ids(batch)
            new = np.bincount(terms_of(got)[1])
            found = np.pad(found, (0, max(0, len(new) - len(found))))
            found[: len(new)] += new
            docs, tokens = docs + len(got), tokens + sum(map(len, got))
        term = np.flatnonzero(found)
        yield pa.record_batch([pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([[docs, tokens], found[term]]))], names=["term", "n"])

    rows = {r["term"]: r["n"] for r in coded.select("_ids", "_wide").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs, tokens = rows.pop(-2, 0) or 0, rows.pop(-1, 0) or 0
    df = np.zeros(max(rows, default=0) + 1, np.int64)
    df[list(rows)] = list(rows.values())
    return Corpus(docs, tokens / docs if docs else 1.0, df)


def routed(coded: DataFrame, corpus: Corpus, shard_docs: int, sample: int = 10_000) -> DataFrame:
    """The coded rows, those alike close to each other: dealt and sorted by cluster and strongest term.

    Centres come from about ``sample`` documents (fixed size); every document meets all centres. The hash
    in the order lets any number of equal documents go to several partitions.
    """
    spark = coded.sparkSession
    known = spark.sparkContext.broadcast(corpus)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_ids"):
            yield pa.record_batch([pa.array([v.tobytes() for v in vectors(_ids(batch), known.value, shard_docs)[0]], pa.binary())], names=["v"])

    taken = coded.select("_ids", "_wide").where(F.pmod(F.xxhash64("_key", "_ids"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, corpus.docs))) + 1)
    got = sorted(r["v"] for r in taken.mapInArrow(project, "v binary").collect())
    points = np.frombuffer(b"".join(got), np.float32).reshape(-1, 128)
    found = spark.sparkContext.broadcast(centres(points, min(1024, max(1, corpus.docs // 64))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_ids"):
            v, strongest = vectors(_ids(batch), known.value, shard_docs)
            near = (v @ found.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(strongest, pa.int32())], names=[*batch.schema.names, "_cluster", "_strongest"])

    placed = coded.mapInArrow(place, coded.withColumns({"_cluster": F.lit(0).cast("int"), "_strongest": F.lit(0).cast("int")}).schema)
    by = ["_cluster", "_strongest", "_salt"]
    return placed.withColumn("_salt", F.xxhash64("_key")).repartitionByRange(*by).sortWithinPartitions(*by).select("_key", "_ids", "_wide")


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = 1, window: int = 2048, shard_docs: int = 1024, shard_tokens: int = 4_000_000, ids: bool = False) -> DataFrame:
    """Pieces of documents in windows: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``ids`` the ids.

    Each document's ids, followed by ``end_id``, are cut into pieces; a piece lies in
    one sequence, without gaps between the pieces. All sequences of a partition but the
    last are full. A null or empty text is its end id alone; equal rows are packed each;
    other columns are not read. Memory is bounded by a shard: it closes at ``shard_docs``
    documents or ``shard_tokens`` tokens. All terms of a seed query the index. Texts
    are coded once and written. The tokenizer file (fixed size, 1.5 MB) is broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(spec.value)
        for batch in slices(batches, "_text", 8_000_000):
            flat, ends = coder.encode_all(batch.column("_text"), end_id)
            wide = max(end_id, coder.coder.max_token_value, coder.tokenizer.get_vocab_size()) > 0xFFFF
            flat = flat.astype("<u4" if wide else "<u2")
            offsets = np.concatenate([[0], ends * flat.itemsize]).astype(np.int32)
            got = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), got, pa.array([wide] * len(ends))], names=["_key", "_ids", "_wide"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = figures.value
        state = {"sequence": TaskContext.get().partitionId() << 33, "filled": 0}
        keys: list = []
        docs: list[np.ndarray] = []
        tokens, kind = 0, None

        def shard() -> pa.RecordBatch:
            rows: list[tuple] = []
            for k in order(docs, window, state["filled"], corpus):
                doc, start = docs[k], 0
                while start < len(doc):
                    n = min(len(doc) - start, window - state["filled"])
                    part = doc[start : start + n]
                    rows.append((keys[k], start, n, zlib.crc32(part.astype("<u4").tobytes()), len(doc), state["sequence"], state["filled"], *([part.tolist()] if ids else [])))
                    start += n
                    state["filled"] += n
                    if state["filled"] == window:
                        state["sequence"] += 1
                        state["filled"] = 0
            kinds = [kind, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if ids else [])]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in slices(batches, "_ids", 2_000_000):
            kind = batch.column("_key").type
            for k, got in zip(batch.column("_key").to_pylist(), _ids(batch), strict=True):
                keys.append(k)
                docs.append(got)
                tokens += len(got)
                if len(docs) >= shard_docs or tokens >= shard_tokens:
                    yield shard()
                    keys, docs, tokens = [], [], 0
        if docs:
            yield shard()

    read = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = read.schema["_key"].dataType.simpleString()
    coded = stored(read.mapInArrow(code, f"_key {kind}, _ids binary, _wide boolean"))
    corpus = _figures(coded)
    figures = df.sparkSession.sparkContext.broadcast(corpus)
    return routed(coded, corpus, shard_docs).mapInArrow(run, f"`{key}` {kind}, {PIECES}" + (", ids array<int>" if ids else ""))
