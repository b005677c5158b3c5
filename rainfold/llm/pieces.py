"""Encoding and decoding with merge-type subword models through a prefix table.

A prefix of a text has one encoding, so it has one last token. A token t that
ends at p is the last token of that prefix exactly if t follows the last token
of the prefix before it without a merge across their border, which is a test on
the pair alone. So one scan with an automaton over the vocabulary fills a table
of last tokens, and walking it backwards from the end gives the ids.

The automaton is made as texts ask for it. A state is the longest suffix that
begins a piece, with the last tokens at its places: all that later places can
depend on. So a step is one look into a table, and the tests on pairs are done
once for each step that is new.
"""

from __future__ import annotations

import codecs
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
codecs.register_error("rainfold_byte", lambda e: ("�", e.start + 1))


class PrefixTable:
    """Encoder and decoder of one model, given as the bytes of its file.

    Models with merge type, no character map, no user-defined or unused pieces
    and byte pieces for unknown characters are taken; others raise ValueError.
    """

    def __init__(self, model: bytes, memo: int = 500_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds & {USER, UNUSED} or BYTE not in kinds:
            raise ValueError("the prefix table takes merge-type models with identity normalisation and byte pieces")
        self.dummy = norm.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.surface = [self._surface(p) for p in proto.pieces]
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.blank_first = {i for x, i in self.id.items() if x[0] == SPACE}
        self.chars = {x for x in self.id if len(x) == 1}
        inside = set(chain.from_iterable(self.id))
        #: Pieces hold a blank only at their start (or are all blanks), and no line feed: then texts fall into independent segments.
        self.by_blank = not any(SPACE in x.lstrip(SPACE) for x in self.id)
        self.by_line = "\n" not in inside
        self.base = len(self.names)
        self.width = self.base + 0x110000
        self.lives: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}
        #: Pieces that merges reach, and what they begin with.
        self.live = {x: i for x, i in self.id.items() if len(x) == 1 or self._life(x)[0] is None}
        self.begins = {x[:k] for x in self.live for k in range(1, len(x) + 1)}
        self.states: dict[tuple, _State] = {}
        self.root = self.state("", (-1,))
        borders = {a + b for p in self.id for a, b in zip(p, p[1:], strict=False)}
        self.words = _Memo(lambda x: self._segment(x if x[:1] == "\n" else SPACE + x), self._segment, borders, memo)
        self.parts = _Memo(self._segment, self._segment, borders, memo // 20)

    @staticmethod
    def _surface(p) -> bytes:
        if p.type == BYTE:
            return bytes([int(p.piece[1:-1], 16)])
        return b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()

    def _life(self, text: str) -> tuple:
        """What merges make of a text alone: (None or what is left, scores of the merges, left ends, right ends after each)."""
        parts, scores, left, right = list(text), [], [text[0]], [text[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, scores, left, right
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            left.append(parts[0])
            right.append(parts[-1])
        return None, scores, left, right

    def _token_life(self, token: int) -> tuple:
        if (life := self.lives.get(token)) is None:
            life = self.lives[token] = self._life(chr(token - self.base) if token >= self.base else self.names[token])
        return life

    def _pair_fits(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their joint text: no merge across the border comes first at any time."""
        _, sa, _, right = self._token_life(a)
        _, sb, left, _ = self._token_life(b)
        i = j = 0
        while True:
            cross = self.score.get(right[i] + left[j])
            own = sa[i] if i < len(sa) else None
            other = sb[j] if j < len(sb) else None
            if cross is not None and (own is None or cross > own) and (other is None or cross >= other):
                return False
            if own is None and other is None:
                return True
            if other is None or own is not None and own >= other:
                i += 1
            else:
                j += 1

    def state(self, suffix: str, lasts: tuple[int, ...]) -> _State:
        """The state with these last tokens; those at places where no token can start don't count."""
        key = (suffix, *(x if suffix[k:] in self.begins else None for k, x in enumerate(lasts[:-1])), lasts[-1])
        if (state := self.states.get(key)) is None:
            state = self.states[key] = _State(self, suffix, key[1:])
        return state

    def fit(self, a: int, b: int) -> bool:
        key = a * self.width + b
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            ok = self.fits[key] = self._pair_fits(a, b)
        return ok

    def _segment(self, text: str) -> tuple[int, ...]:
        """Ids of a text in which blanks are already escaped, without a leading one added."""
        if not text:
            return ()
        state, last = self.root, []
        for c in text:
            state = state[c]
            last.append(state.token)
        if len(self.states) > 300_000:
            self.states = {}
            self.root = self.state("", (-1,))
        ids, at = [], len(text)
        while at:
            token = last[at - 1]
            if token >= self.base:
                ids.extend(self.byte_ids[b] for b in reversed(chr(token - self.base).encode()))
                at -= 1
            else:
                ids.append(token)
                at -= len(self.names[token])
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """Ids of a text; null counts as empty. ``end`` appends the end id."""
        ids: list[int] = []
        if text:
            if self.dummy:
                text = SPACE + text
            text = text.replace(" ", SPACE)
            if not self.by_blank:
                ids = list(self._segment(text))
            elif self.by_line and SPACE * 2 not in (marked := text.replace("\n", f"{SPACE}\n")):
                parts = marked.split(SPACE)
                ids = list(self.parts[parts[0]]) if parts[0] else []
                ids.extend(chain.from_iterable(map(self.words.__getitem__, parts[1:])))
            else:
                parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
                ids = list(chain.from_iterable(map(self.parts.__getitem__, parts)))
        if end:
            ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are joined to characters, the blank put before a text is taken off."""
        if ids and ids[-1] == self.end:
            ids = ids[:-1]
        surface, runs = self.surface, [ids]
        if not self.control.isdisjoint(ids):  # they show nothing, but part runs of bytes
            runs = [[]]
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
        out = "".join(b"".join(map(surface.__getitem__, run)).decode("utf-8", "rainfold_byte") for run in runs)
        if self.dummy and out[:1] == " ":
            first = next((i for i in ids if surface[i]), None)
            if first is not None and first in self.blank_first:
                return out[1:]
        return out


class _State(dict):
    """Next states by character, made when first asked for."""

    __slots__ = ("lasts", "suffix", "table", "token")

    def __init__(self, table: PrefixTable, suffix: str, lasts: tuple[int, ...]):
        self.table, self.suffix, self.lasts, self.token = table, suffix, lasts, lasts[-1]

    def __missing__(self, c: str) -> _State:
        table, text, lasts = self.table, self.suffix + c, self.lasts
        token = None if c in table.chars else table.base + ord(c)
        if token is None:
            for k in range(len(text)):
                new = table.live.get(text[k:])
                if new is not None and (lasts[k] == -1 or table.fit(lasts[k], new)):
                    token = new
                    break
        k = 0
        while k < len(text) and text[k:] not in table.begins:
            k += 1
        self[c] = state = table.state(text[k:], (*lasts[k:], token))
        return state


class _Memo(dict):
    """Ids by segment. Two generations of bounded size, so that what is frequent stays."""

    def __init__(self, segment, rest, borders: set[str], bound: int):
        self.segment, self.rest, self.borders, self.bound, self.old = segment, rest, borders, bound // 2, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(key)) is None:
            cuts = [k for k in range(1, len(key)) if key[k - 1 : k + 1] not in self.borders]  # no piece spans these places
            if cuts:
                rest = map(self.rest, (key[a:b] for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True)))
                value = self[key[: cuts[0]]] + tuple(chain.from_iterable(rest))
            else:
                value = self.segment(key)
        if len(key) <= 64:
            self[key] = value
        return value


_TABLES: dict[bytes, PrefixTable] = {}


def prefix_table(model: bytes) -> PrefixTable:
    """The encoder of a model, made once in each Python worker."""
    if model not in _TABLES:
        _TABLES.clear()
        _TABLES[model] = PrefixTable(model)
    return _TABLES[model]


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, end: bool = True) -> DataFrame:
    """Adds the ids of each text (array<int>), and with ``decoded`` also the text that these ids decode to.

    A map over the rows, without a shuffle. Null and empty texts have the end id
    alone; an input column that has the name of a new one, in either case, is replaced. The model
    file is read on the driver (its size is fixed: half a MB) and broadcast.
    """
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def make(texts: pa.Array) -> list[pa.Array]:
        table = prefix_table(model.value)
        got = [table.encode(x, end) for x in texts.to_pylist()]
        back = [pa.array([table.decode(x) for x in got], pa.string())] if decoded else []
        return [pa.array(got, pa.list_(pa.int32())), *back]

    return mapped(df, text, {ids: "array<int>"} | ({decoded: "string"} if decoded else {}), make)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of each array of ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def make(lists: pa.Array) -> list[pa.Array]:
        table = prefix_table(model.value)
        return [pa.array([None if x is None else table.decode(x) for x in lists.to_pylist()], pa.string())]

    return mapped(df, ids, {text: "string"}, make)
