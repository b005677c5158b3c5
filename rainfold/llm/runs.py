"""Runs of words that repeat with a period, found by multi-scale minimizers.

In a run of period q each window of words comes again q words later, and so does the smallest of its k-word sequences. So
for each scale (periods from Q up to 2 Q, sequences and windows of Q / 2 words) equal window minima between Q and 2 Q words apart are the seeds, each of which is
extended to both sides. Periods under 8 are found by comparing the words with themselves at each such lag.

Sequences of 1, 2, 4, ... words get names by doubling, so a minimum is compared and a seed extended by whole sequences, exactly and without hashes. A sequence
that occurs once in its text has no name, and a scale without names ends the search; in plain texts that is soon.
Inside a run of a short period minima stand close together. Those of one run make no other run; between two such runs of the same root one
seed for each lag suffices. So seeds stay few, whatever the text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped

#: Periods from here on are found by minimizers.
SHORT = 8
LEAST = 12


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts, their codes, and where each text's words begin and the last ones end."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    flat = flat.filter(pa.array(real))
    return flat, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), before[words.offsets.to_numpy() - words.offsets[0].as_py()]


class Names:
    """names[l][i]: the sequence of 2 ** l words from place i on, equal numbers for equal sequences of one text; -1 if it occurs once."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n = len(codes)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.names = [self._repeated(owner * (int(codes.max(initial=0)) + 1) + codes, np.arange(n), n)]
        while True:
            size, last = 1 << (len(self.names) - 1), self.names[-1]
            at = np.flatnonzero((last[: n - size] >= 0) & (last[size:] >= 0) & (owner[: n - size] == owner[size:])) if n > size else np.zeros(0, np.int64)
            if not len(at):
                break
            names = self._repeated(last[at].astype(np.int64) * (int(last.max()) + 1) + last[at + size], at, n)
            if names.max(initial=-1) < 0:
                break
            self.names.append(names)

    @staticmethod
    def _repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        named = pd.factorize(keys)[0]
        out = np.full(n, -1, np.int32)
        often = np.bincount(named)[named] > 1 if len(named) else np.zeros(0, bool)
        out[at[often]] = named[often]
        return out

    def ahead(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words from p and from q on are the same (p < q)."""
        total, n = np.zeros(len(p), np.int64), len(self.names[0])
        for level in range(len(self.names) - 1, -1, -1):
            for _ in range(2):  # the highest level may fit twice
                x, y = p + total, q + total
                inside = y < n
                a, b = self.names[level][np.where(inside, x, 0)], self.names[level][np.where(inside, y, 0)]
                same = inside & (a >= 0) & (a == b)
                total[same] += 1 << level
                if level < len(self.names) - 1 or not same.any():
                    break
        return total

    def behind(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words before p and before q are the same (p < q)."""
        total = np.zeros(len(p), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size = 1 << level
            for _ in range(2):
                x, y = p - total - size, q - total - size
                inside = x >= 0
                a, b = self.names[level][np.where(inside, x, 0)], self.names[level][np.where(inside, y, 0)]
                same = inside & (a >= 0) & (a == b)
                total[same] += size
                if level < len(self.names) - 1 or not same.any():
                    break
        return total


def _short_runs(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """(start, end, period) of runs with periods under SHORT, by direct comparison at each lag."""
    owner, found = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), []
    for q in range(1, SHORT):
        if len(codes) <= q:
            break
        same = (codes[:-q] == codes[q:]) & (owner[:-q] == owner[q:])
        edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first + q >= max(LEAST, 2 * q)
        found.append(np.stack([first[long], last[long] + q, np.full(int(long.sum()), q)], 1))
    return found


def _minima(names: np.ndarray, k: int) -> np.ndarray:
    """Places that hold the smallest of k sequences in a row; windows with a sequence that occurs once have none."""
    v = names.astype(np.int64)
    order = (v * 2_654_435_761 % (1 << 31)) << 32 | np.arange(len(v))
    order[v < 0] = -1
    width = 1
    while width < k and len(order) > width:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    order = order[order >= 0] if width == k else order[:0]
    return np.unique(order & 0xFFFFFFFF)


def _pairs(at: np.ndarray, names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of all pairs of places with one name and a lag in low .. high - 1."""
    at = at[np.lexsort((at, names[at]))]
    name, places, lags = names[at], [], []
    for k in range(1, len(at)):
        lag = at[k:] - at[:-k]
        near = (name[k:] == name[:-k]) & (lag < high)
        if not near.any():
            break
        use = np.flatnonzero(near & (lag >= low))
        places.append(at[use])
        lags.append(lag[use])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *lags])


def _first_of_chains(place: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of seeds of one lag that follow within k words, and so have the same extension, the first one."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    first = np.concatenate([[True], (lag[1:] != lag[:-1]) | (place[1:] - place[:-1] > k)])
    return place[first], lag[first]


def _least_rotation(root: tuple) -> int:
    """Where the smallest rotation of a sequence begins."""
    n, i, j, k = len(root), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = root[(i + k) % n], root[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    return min(i, j)


def _between(runs: np.ndarray, codes: np.ndarray, owner: np.ndarray, roots: dict, k: int, low: int, high: int) -> list[tuple[int, int]]:
    """(place, lag): one seed for each two runs of one root and each lag at which sequences of k words inside them are equal."""
    groups: dict[tuple, list] = defaultdict(list)
    for s, e, q in runs.tolist():
        if (s, q) not in roots:
            root = tuple(codes[s : s + q].tolist())
            at = _least_rotation(root)
            roots[s, q] = (int(owner[s]), root[at:] + root[:at]), at
        name, at = roots[s, q]
        groups[name].append((s, e, q, at))
    out = []
    for members in groups.values():
        members.sort()
        for x, (s, e, q, at) in enumerate(members):
            for s2, e2, _, at2 in members[x + 1 :]:
                if s2 > e - k + high:
                    break
                least, most = max(low, s2 - (e - k)), min(high - 1, e2 - k - s)
                lag = least + (s2 + at2 - s - at - least) % q
                out += [(max(s, s2 - g), g) for g in range(lag, most + 1, q)]
    return out


def find_runs(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of some texts, in order of start and period.

    codes: the words of the texts one after the other; starts: where each text begins, and the end. A run is as long as it can be, at least max(12, twice its smallest period).
    """
    found = _short_runs(codes, starts)
    every = Names(codes, starts)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    roots: dict = {}
    low = SHORT
    while (level := low.bit_length() - 2) < len(every.names):
        k, names = low // 2, every.names[level]
        at = _minima(names, k)
        known = np.unique(np.concatenate(found), axis=0)
        known = known[(known[:, 2] <= k // 2) & (known[:, 1] - known[:, 0] >= k)]
        if k < LEAST:  # shorter ones are no runs, and lags are few here
            known = known[:0]
        if len(known) and len(at):  # what lies inside a run of a short period is left to pairs of runs
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, known[:, 0], 1)
            np.add.at(cover, known[:, 1] - k + 1, -1)
            at = at[np.cumsum(cover)[at] == 0]
        place, lag = _pairs(at, names, low, 2 * low)
        if len(known) > 1:
            more = np.array(_between(known, codes, owner, roots, k, low, 2 * low), np.int64).reshape(-1, 2)
            place, lag = np.concatenate([place, more[:, 0]]), np.concatenate([lag, more[:, 1]])
        if len(place):
            place, lag = _first_of_chains(place, lag, k)
            start = place - every.behind(place, place + lag)
            end = place + lag + every.ahead(place, place + lag)
            long = end - start >= np.maximum(LEAST, 2 * lag)
            found.append(np.unique(np.stack([start[long], end[long], lag[long]], 1), axis=0))
        low *= 2
    every_run = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    every_run = every_run[np.lexsort((every_run[:, 2], every_run[:, 1], every_run[:, 0]))]
    first = np.concatenate([[True], (every_run[1:, :2] != every_run[:-1, :2]).any(1)]) if len(every_run) else np.zeros(0, bool)
    every_run = every_run[first]  # one stretch: its smallest period
    return every_run[np.lexsort((every_run[:, 2], every_run[:, 0]))]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _judged(texts: pa.Array) -> list[pa.Array]:
    words, codes, starts = _words(texts)
    runs = find_runs(codes, starts)
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    kept = np.cumsum(cover)[:-1] == 0
    counts = np.concatenate([[0], np.cumsum(kept)])[starts]
    lists = pa.LargeListArray.from_arrays(pa.array(counts, pa.int64()), words.filter(pa.array(kept)))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    rows = pa.StructArray.from_arrays([pa.array(runs[:, 0] - starts[owner]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
    return [pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(starts))), pa.int32()), rows), collapsed]


def collapse_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Adds the runs of each text (start and length in words, period; in order of start, then period) and the text without repetitions.

    A word goes if a run contains it behind the run's first period; the others are joined by one blank. Words are what stands between blanks and are
    compared as they are. A null or empty text has no runs and an empty collapsed text. Columns of the two new names, in either case, are replaced; all others are kept, whatever their names.
    """
    return mapped(df, text, {runs: RUNS, collapsed: "string"}, _judged)
