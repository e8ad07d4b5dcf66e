"""Periodic runs of words by maximal-pair enumeration (operator 13).

A run is a stretch of words with smallest period q and length >= max(MIN_LENGTH, 3 q) that no
neighbouring word extends.  Two equal stretches of l words that begin q <= l / 2 apart and
differ in the words before and after them are a maximal pair, and the words from the first
one's start to the second one's end are exactly a run of length l + q.  So:

1. A batch's texts get word numbers; only texts in which SEED consecutive words return
   can hold a run, and those get a suffix array (prefix doubling) with its longest common
   prefixes, texts kept apart by end marks of their own.
2. The LCP-interval tree is walked bottom up.  An interval's list holds the starts of
   its prefix in text order, each start carrying its left-word class; the smaller child list goes into the
   larger one.
3. A start is paired with its nearest neighbour on either side, if that came from another child and the
   left words differ.  Nearer starts than q would give the stretch a smaller period, so no
   pair of a run is missed, and no interval emits all its pairs.

A period that is a multiple of a smaller one gives the same stretch again; the smallest
stays.  A text's collapsed form drops every word that a run contains after its first
period.

Edge cases: null and empty texts, and texts without words, have no run; repeated rows get
the same result each; rows are judged by themselves, so null and shared ids are kept; an
empty table gives no rows; very long texts are one batch of their own, in numpy arrays of some
hundred bytes a word; other columns stay aside, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, shingles, slices, text_bytes, text_column, words

MIN_LENGTH, MIN_REPEATS = 24, 3


def seed_length(min_length: int, repeats: int) -> int:
    """Words that surely return within any run: length - period where length is least."""
    return -(-min_length * (repeats - 1) // repeats)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of numbers (each text ends in a number of its own), and the ranks of the
    stretches of 1, 2, 4, ... numbers that it is made from."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:n - step] = rank[step:]
        both = rank * (n + 1) + after + 1
        order = np.argsort(both, kind="stable")
        sorted_ = both[order]
        new = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        if new[-1] == n - 1 or step >= n:
            return order, ranks
        rank = np.empty(n, np.int64)
        rank[order] = new
        ranks.append(rank)
        step *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order (first: 0)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        out[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def maximal_pairs(starts: list[int], prefixes: list[int], left: np.ndarray, repeats: int) -> list[tuple[int, int, int]]:
    """(start, distance, common length) of the maximal pairs that are runs: ``starts`` are the suffixes
    of one stretch of the suffix array in order, ``prefixes[i]`` the common prefix of starts[i - 1] and
    starts[i]."""
    out = []

    def pair(x: int, y: int, depth: int) -> None:
        if (y - x) * (repeats - 1) <= depth and left[x] != left[y]:
            out.append((x, y - x, depth))

    def merged(big: list[int], small: list[int], depth: int) -> list[int]:
        if len(big) < len(small):
            big, small = small, big
        at = [bisect_left(big, x) for x in small]
        for i, x in enumerate(small):  # neighbours among the other child's starts, nearer than any own one
            k = at[i]
            if k and not (i and at[i - 1] == k):
                pair(big[k - 1], x, depth)
            if k < len(big) and not (i + 1 < len(small) and at[i + 1] == k):
                pair(x, big[k], depth)
        if len(small) * 8 < len(big):
            for x in small:
                insort(big, x)
            return big
        return sorted(big + small)

    # each list waits on the stack with its common prefix with the list below it
    stack: list[tuple[int, list[int]]] = []
    for start, depth in zip([*starts, -1], [*prefixes, -1]):
        while len(stack) > 1 and stack[-1][0] > depth:
            at, last = stack.pop()
            link, below = stack.pop()
            stack.append((link, merged(below, last, at)))
        stack.append((depth, [start]))
    return out


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of the runs in numbers with end marks."""
    least = seed_length(min_length, repeats)
    order, ranks = suffix_array(ids)
    lcp = common_prefixes(order, ranks)
    left = np.concatenate((ids[-1:], ids[:-1]))
    deep = np.flatnonzero(lcp >= least)
    found: dict[tuple[int, int], int] = {}
    for part in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []:
        a, b = part[0] - 1, part[-1] + 1
        starts = order[a:b].tolist()
        # nothing to pair where no two starts lie near enough
        near = np.diff(np.sort(order[a:b]))
        if near.min() * (repeats - 1) > lcp[a + 1:b].max():
            continue
        for x, q, depth in maximal_pairs(starts, [0, *lcp[a + 1:b].tolist()], left, repeats):
            if depth + q >= min_length:
                key = (x, depth + q)
                found[key] = min(q, found.get(key, q))
    rows = sorted((x, q, length) for (x, length), q in found.items())
    return np.array([(x, length, q) for x, q, length in rows], np.int64).reshape(-1, 3)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equals the first, then the one of least period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text", reorder=None, keep_text: bool = False,
              min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> DataFrame:
    """Per row: doc_id, runs (start, length, period), n_words, n_runs, the best run's start, length, period and
    exponent_milli, runs_sha256, collapsed_sha256; ``keep_text`` adds the collapsed text.

    ``reorder(id, n)``, if given, returns the numbers of the words that a text of n words is read as (None: as it is)."""
    least = seed_length(min_length, repeats)

    def run(batches):
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            data, offsets = text_bytes(batch.column("text"))
            _, _, h, first = words(data, offsets)
            read = [reorder(i, int(n)) if reorder else None for i, n in zip(ids, np.diff(first))]
            for r, at in enumerate(read):
                if at is not None:
                    h[first[r]:first[r + 1]] = h[first[r]:first[r + 1]][at]
            runs = _batch_runs(h, first, least, min_length, repeats)
            out = {name: [] for name in NAMES}
            for r, i in enumerate(ids):
                parts = data[offsets[r]:offsets[r + 1]].tobytes().split()
                if read[r] is not None:
                    parts = [parts[k] for k in read[r].tolist()]
                own = runs.get(r, [])
                n_words = len(parts)
                best = best_run(own) or (None, None, None)
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in own)
                if own:
                    keep = np.ones(n_words + 1, np.int64)
                    for a, n, q in own:
                        keep[a + q:a + n] = 0
                    parts = [parts[k] for k in np.flatnonzero(keep[:n_words]).tolist()]
                collapsed = b" ".join(parts)
                milli = 1000 * best[1] // best[2] if own else None
                row = (i, [dict(zip(("start", "length", "period"), x)) for x in own], n_words, len(own), *best, milli,
                       hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), collapsed.decode() if keep_text else None)
                for name, value in zip(NAMES, row):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in zip(NAMES, KINDS)], names=NAMES)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    found = in_arrow(rows, run, SCHEMA)
    return found if keep_text else found.drop("collapsed")


def _batch_runs(h: np.ndarray, first: np.ndarray, least: int, min_length: int, repeats: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by row, for the rows in which ``least`` words return."""
    grams = shingles(h, least)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(np.arange(len(grams)) + least <= first[1:][row[:len(grams)]])
    order = inside[np.lexsort((grams[inside], row[inside]))]
    again = (grams[order[1:]] == grams[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    out = {}
    for r in np.unique(row[order[1:][again]]).tolist():
        own = np.unique(h[first[r]:first[r + 1]], return_inverse=True)[1].astype(np.int64)
        found = runs_of(np.append(own, own.max() + 1), min_length, repeats)
        if len(found):
            out[r] = [tuple(x) for x in found.tolist()]
    return out


NAMES = ["doc_id", "runs", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
KINDS = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), *[pa.int64()] * 6, pa.string(), pa.string(), pa.string()]
SCHEMA = ("doc_id long, runs array<struct<start:long,length:long,period:long>>, n_words long, n_runs long, start long, length long, period long, "
          "exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string")


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that a text is read as in op13: every tenth by crc32 of its id repeats a stretch; null ids stay."""
    if doc_id is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at
