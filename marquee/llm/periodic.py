"""Runs of repeated words: recursive splitting by frequency, then a scan of lags.

A run is a maximal stretch of words with smallest period q whose length is at least ``exponent``
times q.  Each of its words then occurs at least ``exponent`` times in it, so a word that is rarer
than that within a segment lies in no run there and splits the segment.  The parts are counted
again until no word splits; few short segments are left of ordinary text.

Surviving segments are scanned for lags in octaves.  For periods q from B to 2B, every B-th word is
an anchor: a run with four periods holds an anchor whose 2B words return q words later.  Hashes of
all stretches of 2B words show which lags do that, at the cost of the segment's length per octave.
Two lags at one anchor share a smaller period that divides both, so such an anchor names no run of
this octave.  Anchors that follow each other with one lag are one stretch, whose ends are found by
comparing fewer than B more words; what is long enough is verified word by word.

Nulls and empty texts have no words and no runs; a null key is kept.  Repeated rows are answered
each, and ties between words cannot occur: words are equal or not, byte by byte.  An empty table
gives an empty result.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrays import mix64
from marquee.llm.word_ids import spans

#: Pairs of anchor and lag that are compared at once.
PAIRS = 2_000_000


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts, number of words of each); words are parted by ASCII white space alone."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = words.flatten()
    real = np.asarray(pc.binary_length(flat).to_numpy(zero_copy_only=False)) > 0  # the ends may give empty ones
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))))
    counts = np.diff(np.concatenate(([0], np.cumsum(real)))[ends])
    return flat.filter(pa.array(real)).dictionary_encode(), counts


def survivors(codes: np.ndarray, counts: np.ndarray, times: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the segments in which every word occurs ``times`` times or more."""
    place = np.arange(len(codes))
    segment = np.repeat(np.arange(len(counts)), counts)
    different = int(codes.max()) + 1 if len(codes) else 1
    begins, ends = [], []
    while len(place):
        _, which, count = np.unique(segment * different + codes[place], return_inverse=True, return_counts=True)
        rare = count[which] < times
        splits = np.bincount(segment, weights=rare) > 0
        edge = np.flatnonzero(np.diff(segment, prepend=-1))
        last = np.concatenate((edge[1:], [len(segment)])) - 1
        done = ~splits[segment[edge]]
        begins.append(place[edge[done]])
        ends.append(place[last[done]] + 1)
        kept = splits[segment] & ~rare
        place, segment = place[kept], segment[kept]
        # Words that stay next to each other in one segment make a new one.
        segment = np.cumsum((np.diff(place, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0)) - 1
        long = np.bincount(segment, minlength=1)[segment] >= shortest if len(segment) else np.zeros(0, dtype=bool)
        place, segment = place[long], segment[long]
        segment = np.cumsum(np.diff(segment, prepend=-1) != 0) - 1
    if not begins:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begins, ends = np.concatenate(begins), np.concatenate(ends)
    long = ends - begins >= shortest
    order = np.argsort(begins[long])
    return begins[long][order], ends[long][order]


def _octave(codes: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, step: int):
    """Stretches (begin, end, lag) in which every word returns ``lag`` words later, step <= lag < 2 * step.

    ``hashes`` are those of the 2 * step words from each place on.
    """
    window = 2 * step
    many = np.maximum((ends - begins - step - window) // step + 1, 0)
    anchors = np.repeat(begins, many) + step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    limit = np.repeat(ends, many)
    lags = np.zeros(len(anchors), dtype=np.int64)
    rows = max(1, PAIRS // step)
    offsets = step + np.arange(step)
    for a in range(0, len(anchors), rows):
        at, to = anchors[a : a + rows, None] + offsets, limit[a : a + rows, None] - window
        same = (at <= to) & (hashes[np.minimum(at, len(hashes) - 1)] == hashes[anchors[a : a + rows], None])
        lags[a : a + rows] = np.where(same.sum(axis=1) == 1, step + same.argmax(axis=1), 0)
    # Neighbouring anchors of one segment with the same lag belong together.
    joined = (np.diff(anchors, prepend=-window) == step) & (np.diff(lags, prepend=0) == 0) & (np.diff(limit, prepend=-1) == 0)
    first = np.flatnonzero(~joined & (lags > 0))
    following = np.flatnonzero(~joined)
    last = np.append(following, len(anchors))[np.searchsorted(following, first, side="right")] - 1
    lag, low, high = lags[first], np.repeat(begins, many)[first], limit[first]
    left, right = anchors[first], anchors[last] + window
    more = np.arange(step)
    for a in range(0, len(first), rows):
        part = slice(a, a + rows)
        back = left[part, None] - 1 - more
        same = (back >= low[part, None]) & (codes[np.maximum(back, 0)] == codes[np.minimum(np.maximum(back, 0) + lag[part, None], len(codes) - 1)])
        left[part] -= np.where(same.all(axis=1), step, same.argmin(axis=1))
        ahead = right[part, None] + more
        inside = ahead + lag[part, None] < high[part, None]
        ahead = np.where(inside, ahead, 0)
        same = inside & (codes[ahead] == codes[ahead + np.where(inside, lag[part, None], 0)])
        right[part] += np.where(same.all(axis=1), step, same.argmin(axis=1))
    return left, right + lag, lag


def _is_run(codes: np.ndarray, begin: int, end: int, lag: int) -> bool:
    """Whether the words repeat with this lag and no smaller one."""
    if not (codes[begin : end - lag] == codes[begin + lag : end]).all():
        return False
    period = codes[begin : begin + lag]
    rest, factor = lag, 2
    while rest > 1:
        if rest % factor:
            factor = factor + 1 if factor * factor <= rest else rest
            continue
        while rest % factor == 0:
            rest //= factor
        part = lag // factor
        if (period[:-part] == period[part:]).all():
            return False
    return True


def find_runs(codes: np.ndarray, counts: np.ndarray, shortest: int = 6, exponent: int = 4) -> np.ndarray:
    """Rows (begin, length, period) of all runs, by begin and period; texts lie one after another."""
    begins, ends = survivors(codes, counts, exponent, max(shortest, exponent))
    found = set()
    lengths = ends - begins
    taken = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    held, origin, step = codes[taken], taken, 1
    ends = np.cumsum(lengths)
    begins = ends - lengths
    hashes = mix64(held.astype(np.uint64) + np.uint64(1))
    while len(held):
        # Hashes of twice the words; places whose words would leave the array are never asked for.
        ahead = np.append(hashes[step:], np.zeros(min(step, len(hashes)), dtype=np.uint64))
        hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + mix64(ahead ^ np.uint64(step)))
        left, right, lag = _octave(held, hashes, begins, ends, step)
        enough = right - left >= np.maximum(shortest, exponent * lag)
        for begin, end, period in zip(left[enough].tolist(), right[enough].tolist(), lag[enough].tolist(), strict=True):
            if _is_run(held, begin, end, period):
                found.add((int(origin[begin]), end - begin, period))
        step *= 2
        stay = ends - begins >= 4 * step
        if not stay.all():
            lengths = (ends - begins)[stay]
            taken = np.arange(lengths.sum()) + np.repeat(begins[stay] - (np.cumsum(lengths) - lengths), lengths)
            held, origin, hashes = held[taken], origin[taken], hashes[taken]
            ends = np.cumsum(lengths)
            begins = ends - lengths
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def periodic_runs(
    docs: DataFrame, shortest: int = 6, exponent: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: key, ``n_words``, ``runs`` (start, length, period in words) and ``collapsed``.

    Runs are at least ``shortest`` words and ``exponent`` periods long (4 or more, which the anchors
    need) and ordered by start, then period.  ``collapsed`` is the text without every word that a run
    repeats, its first period being kept, joined by single blanks.  Documents never leave their task:
    there is no shuffle, and a task holds one part of a batch or one long text.
    """
    if exponent < 4:
        raise ValueError("anchors find runs of four periods or more")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    runs_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in spans(batch.column(1)):
                words, counts = split_words(batch.column(1).slice(a, b - a))
                codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs = find_runs(codes, counts, shortest, exponent)
                ends = np.cumsum(counts)
                owner = np.searchsorted(ends, runs[:, 0], side="right")
                change = np.zeros(len(codes) + 1, dtype=np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(change[:-1]) == 0
                bounds = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))].astype(np.int32)
                text_words = words.filter(pa.array(kept)).dictionary_decode()
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), text_words), " ")
                entries = pa.StructArray.from_arrays(
                    [pa.array(runs[:, 0] - (ends - counts)[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                    fields=list(runs_type.value_type),
                )
                cuts = np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cuts), entries), collapsed.cast(pa.string())],
                    ["_key", "n_words", "runs", "collapsed"],
                )

    schema = f"_key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("_key", key)
