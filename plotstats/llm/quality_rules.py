"""Quality rules as a short-circuit cascade (operator 9).

Every document gets its base counts; a document that fails the base rule is rejected
with no further work.  The other rules run one after the other on what the rules before
them left, ordered greedily by rejections per second: each next rule is the one that rejects most, for its time,
of what the base rule and the rules before it leave.  Times and rejections are measured on a sample of about
``SAMPLE_ROWS`` whole documents, in the tasks that read them; the driver gets one number for each rule and each set
of rejecting rules.  The verdict is that of all rules together, so it does not depend on the order, only the time does.

Words are separated by ASCII white space.  Base: word_chars (code points in words),
n_symbols, n_dup_lines (lines with a word that equal an earlier line of the document),
n_repeat_words (words inside five-word windows that the document holds more than once).
Equality of lines and windows is equality of 64-bit hashes within one document.

Edge cases: null and empty texts have no words, all counts 0, and fail; a null id is
kept; repeated rows are judged each on its own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WHITE, flags, in_arrow, runs, shingles, slices, span_hashes, sums, text_bytes, text_column

SYMBOLS = flags(b"#*$%&|<>")
UPPER, LOWER, DIGIT = flags(bytes(range(65, 91))), flags(bytes(range(97, 123))), flags(bytes(range(48, 58)))
LETTER = UPPER | LOWER | flags(bytes(range(128, 256)))
POINT = ~flags(bytes(range(128, 192)))  # bytes that begin a code point
WINDOW = 5
SAMPLE_ROWS = 2000
#: Fixed values of the rules.
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
MAX_SYMBOLS_PER_WORD, WORD_LENGTH, MAX_DUP_LINE_SHARE, MAX_UPPER_SHARE, MIN_LETTER_WORDS, MAX_TOP_WORD_SHARE = 0.3, (2.0, 20.0), 0.5, 0.7, 0.6, 0.4


class Texts:
    """A batch of texts with their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.white = WHITE[data]
        self.starts, self.ends = runs(~self.white, offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first)
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def take(self, rows: np.ndarray) -> Texts:
        if rows.all():
            return self
        lens = np.diff(self.offsets)
        return Texts(self.data[np.repeat(rows, lens)], np.concatenate(([0], np.cumsum(lens[rows]))))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)


def _again(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Marks entries whose (row, hash) occurred before, in order of position."""
    order = np.lexsort((hashes, rows))  # stable, so the first of equals comes first
    same = np.zeros(len(rows), bool)
    same[order[1:]] = (rows[order[1:]] == rows[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    return same


def word_chars(t: Texts) -> np.ndarray:
    return sums(~t.white & POINT[t.data], t.offsets)


def symbols(t: Texts) -> np.ndarray:
    return sums(SYMBOLS[t.data], t.offsets)


def duplicate_lines(t: Texts) -> np.ndarray:
    if not len(t.data):
        return np.zeros(t.n, np.int64)
    starts, ends = runs(t.data != 10, t.offsets)
    worded = sums(~t.white, np.concatenate((starts, ends[-1:]))) > 0  # a gap between lines is white
    starts, ends = starts[worded], ends[worded]
    rows = np.searchsorted(t.offsets, starts, "right") - 1
    return np.bincount(rows[_again(rows, span_hashes(t.data, starts, ends))], minlength=t.n)


def repeated_words(t: Texts) -> np.ndarray:
    """Words inside windows that occur twice or more in their row."""
    owner = t.owner()
    h = shingles(t.hashes, WINDOW)
    at = np.flatnonzero(owner[:len(h)] == owner[len(owner) - len(h):]) if len(h) else np.empty(0, np.int64)
    rows, h = owner[at], h[at]
    order = np.lexsort((h, rows))
    equal = (rows[order[1:]] == rows[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    inside = np.zeros(len(owner) + WINDOW, np.int32)
    np.add.at(inside, at[twice], 1)
    np.add.at(inside, at[twice] + WINDOW, -1)
    return sums(np.cumsum(inside)[:len(owner)] > 0, t.first)


# ---- further rules: True rejects -------------------------------------------

def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def odd_word_length(t: Texts) -> np.ndarray:
    mean = _share(word_chars(t), t.n_words)
    return (mean < WORD_LENGTH[0]) | (mean > WORD_LENGTH[1])


def many_symbols(t: Texts) -> np.ndarray:
    return _share(symbols(t), t.n_words) > MAX_SYMBOLS_PER_WORD


def many_duplicate_lines(t: Texts) -> np.ndarray:
    starts, ends = runs(t.data != 10, t.offsets)
    lines = np.diff(np.searchsorted(starts, t.offsets))
    return _share(duplicate_lines(t), lines) > MAX_DUP_LINE_SHARE


def mostly_upper(t: Texts) -> np.ndarray:
    return _share(sums(UPPER[t.data], t.offsets), sums((UPPER | LOWER)[t.data], t.offsets)) > MAX_UPPER_SHARE


def few_letter_words(t: Texts) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(LETTER[t.data])))
    return _share(sums(total[t.ends] > total[t.starts], t.first), t.n_words) < MIN_LETTER_WORDS


def one_word(t: Texts) -> np.ndarray:
    """One word makes up most of the text."""
    owner = t.owner()
    order = np.lexsort((t.hashes, owner))
    if not len(order):
        return np.zeros(t.n, bool)
    new = np.concatenate(([True], (owner[order[1:]] != owner[order[:-1]]) | (t.hashes[order[1:]] != t.hashes[order[:-1]])))
    at = np.flatnonzero(new)
    top = np.zeros(t.n, np.int64)
    np.maximum.at(top, owner[order[at]], np.diff(np.concatenate((at, [len(order)]))))
    return _share(top, t.n_words) > MAX_TOP_WORD_SHARE


RULES: dict[str, Callable[[Texts], np.ndarray]] = {f.__name__: f for f in (
    odd_word_length, many_symbols, many_duplicate_lines, mostly_upper, few_letter_words, one_word)}


def greedy_order(seconds: dict[str, float], rejected: dict[int, int]) -> list[str]:
    """Rule names, each the one with most rejections per second of what those before it leave; ties by name.
    ``rejected`` counts texts by the set of rules (bits in the order of ``seconds``) that reject them."""
    bit, order = {name: 1 << i for i, name in enumerate(seconds)}, []
    while len(order) < len(bit):
        rate = {name: sum(n for m, n in rejected.items() if m & bit[name]) / max(seconds[name], 1e-9) for name in bit if name not in order}
        order.append(min(rate, key=lambda name: (-rate[name], name)))
        rejected = {m: n for m, n in rejected.items() if not m & bit[order[-1]]}
    return order


def measured(t: Texts, rules: dict = RULES) -> tuple[np.ndarray, np.ndarray]:
    """(seconds of each rule, set of rejecting rules of each text), every rule on all texts."""
    seconds, sets = np.zeros(len(rules)), np.zeros(t.n, np.int64)
    for i, rule in enumerate(rules.values()):
        fresh = Texts(t.data, t.offsets)  # a rule pays for the hashes it needs
        began = time.perf_counter()
        if t.n:
            sets |= rule(fresh).astype(np.int64) << i
        seconds[i] = time.perf_counter() - began
    return seconds, sets


def rule_order(sample: list[str], rules: dict = RULES) -> list[str]:
    """The order for texts at hand."""
    seconds, sets = measured(Texts(*text_bytes(pa.array(sample, pa.string()))), rules)
    found, n = np.unique(sets, return_counts=True)
    return greedy_order(dict(zip(rules, seconds.tolist())), dict(zip(found.tolist(), n.tolist())))


def base_rule(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(words in repeated windows, texts that fail)."""
    repeat = repeated_words(t)
    return repeat, (t.n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * t.n_words)


def rule_facts(rows: DataFrame, rules: dict = RULES) -> tuple[dict[str, float], dict[int, int]]:
    """What :func:`greedy_order` takes, measured by Spark tasks on those of ``rows`` (text) that pass the base rule."""
    def run(batches):
        seconds, counts = np.zeros(len(rules)), {}
        for batch in slices(batches, "text"):
            t = Texts(*text_bytes(batch.column("text")))
            spent, sets = measured(t.take(~base_rule(t)[1]), rules)
            seconds += spent
            for m, n in zip(*np.unique(sets, return_counts=True)):
                counts[int(m)] = counts.get(int(m), 0) + int(n)
        facts = [(i, None, x) for i, x in enumerate(seconds.tolist())] + [(None, m, float(n)) for m, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*facts), (pa.int32(), pa.int64(), pa.float64()))], names=["rule", "rejecting", "amount"])

    facts = in_arrow(rows.select("text"), run, "rule int, rejecting long, amount double").groupBy("rule", "rejecting").agg(F.sum("amount").alias("amount"))
    got = facts.collect()  # a row for each rule, and for each set of rules met in the sample
    spent = {r.rule: r.amount for r in got if r.rule is not None}
    return {name: spent.get(i, 0.0) for i, name in enumerate(rules)}, {r.rejecting: int(r.amount) for r in got if r.rule is None}


def cascade(t: Texts, order: list[str], rules: dict = RULES) -> tuple[np.ndarray, dict[str, int]]:
    """(kept, rows judged by each rule): each rule sees only what the rules before it left."""
    alive, judged = np.arange(t.n), {}
    for name in order:
        judged[name] = len(alive)
        if not len(alive):
            continue
        good = ~rules[name](t)
        alive, t = alive[good], t.take(good)
    return alive, judged


def apply_rules(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    total = rows.count()
    order = greedy_order(*rule_facts(rows.sample(sample_rows / total, seed=7) if total > sample_rows else rows))

    def judge(batches):
        for batch in slices(batches, "text"):
            t = Texts(*text_bytes(batch.column("text")))
            repeat, failed = base_rule(t)
            kept = np.zeros(t.n, bool)
            left = np.flatnonzero(~failed)
            if len(left):
                alive, _ = cascade(t.take(~failed), order)
                kept[left[alive]] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (t.n_words, word_chars(t), symbols(t), duplicate_lines(t), repeat)), pa.array(failed), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return in_arrow(rows, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
