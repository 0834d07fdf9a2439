"""Periodic runs of words, found by string synchronising sets.

A run is a maximal stretch of words with smallest period q that is at least 2q long. Periods
below 8 are found by comparing words q apart. For the scales l = 4, 8, 16, ... every word starts
a context of l words, named by a hash that doubles from scale to scale. Contexts inside a highly
periodic region (period up to l / 3) are set aside; of the others those of least hash in some
window of l starts are the scale's synchronising set. Its choice depends on the words around a
place only. So a run of period q, 2l <= q < 4l, either holds a chosen context in its first
q - l + 1 starts and the same one q words on, or its first q words are highly periodic. In the
first case a pair of equal contexts proposes q. In the second the run lies across two regions of
one small period p that touch, and q is one of the distances, p apart, at which they match.
Every proposal is extended word by word, so what is returned is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlode.llm.common import small

#: Periods below twice this one are compared directly; it is the first scale.
FIRST_SCALE = 4
MIN_LENGTH = 12
#: Words of several documents that are searched at once.
BATCH_WORDS = 60_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(values: np.ndarray) -> np.ndarray:
    out = values * MIX[0]
    out ^= out >> MIX[2]
    out *= MIX[1]
    out ^= out >> MIX[2]
    return out


def _stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """[start, stop) around at in which words[i] == words[i + period]; empty if not at at."""
    stop, step, last = at, 64, len(words) - period
    while stop < last:
        same = words[stop:min(stop + step, last)] == words[stop + period:min(stop + step, last) + period]
        if not same.all():
            stop += int(same.argmin())
            break
        stop, step = stop + len(same), step * 4
    start, step = at, 64
    while start > 0 and stop > at:
        low = max(0, start - step)
        same = (words[low:start] == words[low + period:start + period])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = low, step * 4
    return start, stop


class _Found:
    """Runs by (start, stop) with their smallest period, and what was tried already."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.period: dict[tuple[int, int], int] = {}
        self.reach: dict[int, list[tuple[int, int]]] = {}

    def add(self, start: int, stop: int, period: int) -> None:
        known = self.period.get((start, stop))
        if known is None or period < known:
            self.period[(start, stop)] = period

    def propose(self, places: np.ndarray, periods: np.ndarray) -> None:
        """Extend each place at its period; those inside a stretch seen before are skipped."""
        order = np.lexsort((places, periods))
        last_period, done = 0, 0
        for at, period in zip(places[order].tolist(), periods[order].tolist()):
            if period != last_period:
                last_period, done = period, 0
            if at < done:
                continue
            start, stop = _stretch(self.words, at, period)
            done = max(stop, at + 1)
            if stop - start >= period:
                self.add(start, stop + period, period)

    def arrays(self) -> np.ndarray:
        """Rows of (start, stop, period)."""
        rows = [(start, stop, period) for (start, stop), period in self.period.items()]
        return np.array(rows, np.int64).reshape(-1, 3)


def _short_periods(words: np.ndarray, found: _Found, below: int) -> None:
    for period in range(1, min(below, len(words))):
        same = np.flatnonzero(words[:-period] == words[period:])
        if len(same) < period:
            continue
        breaks = np.flatnonzero(np.diff(same) > 1)
        starts = same[np.concatenate([[0], breaks + 1])]
        stops = same[np.concatenate([breaks, [len(same) - 1]])] + 1
        long = stops - starts >= period
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            found.add(start, stop + period, period)


def _window(values: np.ndarray, size: int, least: bool, pad: int) -> np.ndarray:
    """Least or largest of values[i:i + size] for a power of two; beyond the end counts pad."""
    take = np.minimum if least else np.maximum
    out, step = values, 1
    while step < size:
        shifted = np.full_like(out, pad)
        shifted[:-step] = out[step:]
        out = take(out, shifted)
        step *= 2
    return out


def synchronising(contexts: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """Places whose context is least in some window of as many starts as the scale; contexts
    marked periodic never are, and end no window's choice among the others."""
    masked = np.where(periodic, NONE, contexts)
    least = _window(masked, scale, True, NONE)
    # A place is chosen if the largest of the windows' minima that hold it is its own value.
    held = np.where(least == NONE, 0, least).astype(np.uint64)
    backward = _window(held[::-1], scale, False, 0)[::-1]
    return np.flatnonzero((backward == masked) & ~periodic)


def _pairs(contexts: np.ndarray, chosen: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, 2 to 4 scales, of chosen places with one context.

    Equal contexts that are not highly periodic lie over a third of a scale apart, so a dozen
    steps in the sorted order see all of them. A pair is kept if blocks of one context around
    it leave room for a stretch of its distance.
    """
    names = contexts[chosen]
    order = np.lexsort((chosen, names))
    at, names = chosen[order], names[order]
    places, periods, step = [], [], 1
    while step < len(at):
        near = (names[step:] == names[:-step]) & (at[step:] - at[:-step] < 4 * scale)
        if not near.any():
            break
        left, apart = at[:-step][near], (at[step:] - at[:-step])[near]
        far = apart >= 2 * scale
        places.append(left[far])
        periods.append(apart[far])
        step += 1
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, periods = np.concatenate(places), np.concatenate(periods)
    room = np.full(len(places), 2 * scale)
    for steps in (range(4), range(-1, -5, -1)):
        alive = np.ones(len(places), bool)
        for block in steps:
            one = places + block * scale
            alive &= (one >= 0) & (one + periods < len(contexts))
            alive[alive] = contexts[one[alive]] == contexts[(one + periods)[alive]]
            room += alive * scale
    keep = room > periods
    return places[keep], periods[keep]


def _touching(words: np.ndarray, runs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, 2 to 4 scales, at which two touching runs of one period match."""
    places, periods = [], []
    small_runs = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= 2 * scale)]
    small_runs = small_runs[np.lexsort((small_runs[:, 0], small_runs[:, 2]))]
    touch = (small_runs[1:, 2] == small_runs[:-1, 2]) & (small_runs[1:, 0] <= small_runs[:-1, 1])
    for row in np.flatnonzero(touch).tolist():
        (b1, e1, p), (b2, e2, _) = small_runs[row].tolist(), small_runs[row + 1].tolist()
        wide, narrow = words[b1:b1 + 2 * p].tobytes(), words[b2:b2 + p].tobytes()
        turn = wide.find(narrow)
        while turn >= 0 and turn % words.itemsize:
            turn = wide.find(narrow, turn + 1)
        if turn < 0:
            continue
        phase = (b2 - b1 - turn // words.itemsize) % p
        first = 2 * scale + (phase - 2 * scale) % p
        for period in range(first, min(4 * scale, min(e1 - b1, e2 - b2) + p + 1), p):
            at = max(b1, b2 - period)
            if at + period < len(words):
                places.append(at)
                periods.append(period)
    return np.array(places, np.int64), np.array(periods, np.int64)


def find_runs(words: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Rows (start, stop, period) of all runs of a sequence of numbers, in no order.

    With ends, the sequence holds several texts, each closed by a number found nowhere else;
    ends are the places behind those. Large scales then look at the long texts only.
    """
    found = _Found(words)
    _short_periods(words, found, 2 * FIRST_SCALE)
    longest = len(words) if ends is None else int(np.diff(ends, prepend=0).max(initial=0))
    contexts = _mixed(words.astype(np.uint64) + np.uint64(1))
    scale = 1
    while 4 * scale <= longest:
        if scale >= FIRST_SCALE:
            runs = found.arrays()
            periodic = np.zeros(len(words) + 1, np.int64)
            inside = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
            np.add.at(periodic, inside[:, 0], 1)
            np.add.at(periodic, inside[:, 1] - scale + 1, -1)
            mask = np.cumsum(periodic)[:-1] > 0
            found.propose(*_pairs(contexts, synchronising(contexts, mask, scale), scale))
            found.propose(*_touching(words, runs, scale))
        # Contexts that would pass the end get names of their own and never match.
        shifted = np.arange(len(contexts), dtype=np.uint64) + np.uint64(1 << 62)
        shifted[:-scale] = contexts[scale:]
        contexts = _mixed(_mixed(contexts) + shifted)
        scale *= 2
    return found.arrays()


def repeated(n: int, start: int, period: int) -> np.ndarray:
    """Places of n words once all from start on repeat the first period of them."""
    places = np.arange(n)
    places[start:] = start + (places[start:] - start) % period
    return places


def _batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) by start, then period, of every text's runs."""
    names: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(words) + 1 for words in texts])
    ends = np.cumsum(sizes)
    codes = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for words, end in zip(texts, ends.tolist()):
        codes[end - len(words) - 1:end - 1] = [names[word] for word in words]
    codes[ends - 1] = -1 - np.arange(len(ends))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for group, of in _by_length(codes, ends, sizes):
        found = find_runs(group, np.cumsum(sizes[of]))
        found = found[found[:, 1] - found[:, 0] >= np.maximum(MIN_LENGTH, 2 * found[:, 2])]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        closed = np.cumsum(sizes[of])
        text = np.searchsorted(closed, found[:, 0], side="right")
        begin = closed[text] - sizes[of][text]
        for at, start, stop, period in zip(text.tolist(), (found[:, 0] - begin).tolist(),
                                           (found[:, 1] - begin).tolist(), found[:, 2].tolist()):
            out[of[at]].append((start, stop - start, period))
    return out


def _by_length(codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
    """Texts of like length together, so that short ones don't pass through large scales."""
    level = np.floor(np.log2(sizes)).astype(int)
    for one in np.unique(level).tolist():
        of = np.flatnonzero(level == one)
        yield np.concatenate([codes[ends[at] - sizes[at]:ends[at]] for at in of.tolist()]), of


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    stay = np.cumsum(dropped)[:-1] == 0
    return [word for word, keep in zip(words, stay.tolist()) if keep]


def runs_of(
    frame: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
    tail: tuple[str, Callable[[int, int], tuple[int, int] | None]] | None = None,
) -> DataFrame:
    """All columns of frame and two more: runs, an array of (start, length, period) by start and
    period, and collapsed, the words joined by single blanks without repeats.

    Words are what stands between ASCII blanks. A run has smallest period q, at least
    max(12, 2q) words, and no neighbouring word that continues it. A word goes if some run holds
    it past that run's first q words. Null, empty and blank texts have no words, no runs and an
    empty collapsed text. tail names a column and a rule: rule(value, number of words) gives the
    place from which on the words are first replaced by repeats, and how many are repeated; where
    the value is null or the rule gives None, a text stays as it is. A row is one text, searched
    whole; rows don't depend on each other, so repeated rows, an empty table and any further
    columns need no care, but the two new names must be free.
    """
    fields = ("start", "length", "period")
    run_type = T.ArrayType(T.StructType([T.StructField(name, T.LongType(), False) for name in fields]), False)
    schema = T.StructType([*frame.schema.fields, T.StructField(runs, run_type), T.StructField(collapsed, T.StringType())])
    place = frame.columns.index(text)
    seed = frame.columns.index(tail[0]) if tail else None
    arrow_runs = pa.list_(pa.struct([pa.field(name, pa.int64(), False) for name in fields]))

    def run(batches):
        for batch in small(batches):
            texts = [(value or b"").split() for value in batch.column(place).cast(pa.binary()).to_pylist()]
            if tail:
                for at, value in enumerate(batch.column(seed).to_pylist()):
                    span = tail[1](value, len(texts[at])) if value is not None else None
                    if span:
                        texts[at] = [texts[at][i] for i in repeated(len(texts[at]), *span).tolist()]
            found, begin, held = [], 0, 0
            for at, words in enumerate(texts):
                held += len(words)
                if held >= BATCH_WORDS or at + 1 == len(texts):
                    found += _batch_runs(texts[begin:at + 1])
                    begin, held = at + 1, 0
            kept = pa.array([b" ".join(_kept(words, own)) for words, own in zip(texts, found)], pa.binary())
            rows = pa.array([[dict(zip(fields, one)) for one in own] for own in found], arrow_runs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, rows, kept.view(pa.string())], [*batch.schema.names, runs, collapsed]
            )

    return frame.mapInArrow(run, schema)


def every_tenth(crc: int, n: int) -> tuple[int, int] | None:
    """The rule of op13: texts whose crc ends in 0 repeat from a word on that the crc names."""
    if crc % 10 or not n:
        return None
    start = crc // 10 % n
    return start, 1 + (n - start) // (3 + crc // 10 % 8)


def digests(docs: DataFrame) -> DataFrame:
    """A row for each row of documents: its number of runs, the longest one (ties: smallest
    start, then period; four nulls without runs) and digests of all runs and of the kept words.

    Texts are searched after every_tenth has changed them. A null doc_id has no crc, so its
    text stays as it is.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("crc"),
    )
    found = runs_of(slim, tail=("crc", every_tenth))
    least = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", F.array_max(least)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
