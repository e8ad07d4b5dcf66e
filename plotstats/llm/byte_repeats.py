"""Removal of repeated byte strings by deep-shallow suffix sorting (operator 11).

A byte goes if some ``length``-byte string over it also starts earlier (smaller id, or same id and smaller
start).  Texts are UTF-8 bytes; strings never cross texts and are judged on the input.

1. *Anchors.*  Every window of ``length`` bytes has the k-gram of least hash in it as its anchor (the
   first of equals), so equal windows have equal anchors at equal offsets.  Neighbouring windows with one
   anchor form a *stretch*; a window lies in exactly one.  Equal stretches of a batch of texts are settled
   at once: all but the earliest are repeats, and only the earliest goes on.
2. *Meeting.*  Anchors are counted (partial sums first); those met once hold no repeat.  The others' places go back to
   their texts, and further scans send their stretches, bytes included, to the anchor's group: in so many rounds,
   by the hash of the anchor, that none sends more than about ROUND_X times the bytes of the texts, however many
   anchors meet.  Each step's shuffle files go when it is written (``released``), so disk stays in proportion to the texts.
3. *Deep-shallow sort.*  In a group the suffixes from the anchor on, and the reversed prefixes before
   it, are sorted: multikey quicksort to SHALLOW bytes, then a blind trie for each set of suffixes that
   still agree.  The common prefixes of neighbours give, for every offset of a window to its
   anchor, the class of its left and of its right part; windows equal in both are
   equal, and all but the earliest are repeats.
4. *Hot anchors*, met more than HOT times (the rim of a passage that a large share of all texts hold), never
   form a group: their windows are dealt out one by one, by the hash of all their bytes, and read in the order of their
   bytes and places, so the first of equal ones is known without holding them.  A batch sends equal windows
   once.  Nothing is dropped or capped.
5. *Removal.*  A text's repeats are merged and joined to it by id and text hash.

Broadcasts are counted in bytes first (BROADCAST_BYTES), otherwise joined by shuffle.

Edge cases: null and empty texts have no bytes and nothing removed, the digest of nothing; texts shorter
than ``length`` stay whole; rows that share an id count as one document (a string starts earlier in any of them only
at a smaller start), so equal rows get equal results; null ids come first and count as one id; an
empty table gives no rows; texts of any length are cut into overlapping parts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotstats.plans.session import released

from .common import in_arrow, mix, slices, text_bytes, text_column
from .components import dropped, saved

LENGTH, ANCHOR = 100, 20
SHALLOW, WORD = 16, 8
HOT = 16_384  # at 1024 the windows dealt one by one outgrew the texts as tables grew
BLOCK = 20_000
ROUND_X = 1.5  # bytes sent in a round, of the texts' bytes
SENT_BYTES = 72  # of a row that is sent, besides its string
PART = 2 << 20  # windows of a text that are handled at once
BROADCAST_BYTES = 64 << 20
NULL_ID = -(1 << 63)

_SEED, _BASE = 0x9FB21C651E98DF25, 0xD1342543DE82EF95


class Grams:
    """64-bit hashes of the bytes from any place on: stretches of 1, 2, 4, ... bytes by doubling, others put together
    from those (hash(a + b) = hash(a) * base ** len(b) + hash(b))."""

    def __init__(self, data: np.ndarray, longest: int):
        power = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))[data]
        self.levels = [power]
        while (size := 1 << len(self.levels)) <= longest:
            m = max(0, len(power) - size // 2)
            power = power[:m] * np.uint64(pow(_BASE, size // 2, 1 << 64)) + power[size // 2:]
            self.levels.append(power)

    def at(self, places: np.ndarray | slice, length: int) -> np.ndarray:
        """The hash of ``length`` bytes from each place; a slice is read as all places with room."""
        out, got = None, 0
        for k in range(length.bit_length() - 1, -1, -1):
            size = 1 << k
            if length & size:
                if isinstance(places, slice):
                    part = self.levels[k][got:max(got, len(self.levels[0]) - length + 1 + got)]
                else:
                    part = self.levels[k][places + got]
                out = part if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + part
                got += size
        return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:max(0, len(values) - size)], values[size:])
        size *= 2
    if size < width:
        rest = width - size
        values = np.minimum(values[:max(0, len(values) - rest)], values[rest:])
    return values


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int, k: int, identity: bool) -> dict[str, np.ndarray]:
    windows = len(data) - length + 1
    if windows <= 0:
        return {c: np.empty(0, np.uint64 if c in ("key", "all") else np.int64) for c in ("row", "start", "n", "before", "key", *(["all"] * identity))}
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    grams = Grams(data, length if identity else k)
    key = grams.at(slice(None), k)
    bits = np.uint64((1 << int(len(data)).bit_length()) - 1)
    least = sliding_min((key & ~bits) | np.arange(len(key), dtype=np.uint64), length - k + 1)
    at = np.flatnonzero(np.arange(windows) + length <= offsets[1:][row])
    anchor = (least[at] & bits).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start, anchor = at[first], anchor[first]
    out = {"row": row[start], "start": start - offsets[row[start]], "n": n, "before": anchor - start, "key": key[anchor]}
    if identity:  # the first and the last window together cover all bytes
        shape = mix((n * length + out["before"]).astype(np.uint64))
        out["all"] = mix(grams.at(start, length) ^ shape) + grams.at(start + n - 1, length)
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, k: int, identity: bool = False) -> dict[str, np.ndarray]:
    """The stretches of all rows in order: row, start of the first window, n windows, bytes ``before`` the anchor
    from there, key (hash of the anchor), on demand all (hash of the stretch).  Long rows in parts of PART windows."""
    if len(offsets) != 2 or len(data) < PART + length:
        return _stretches(data, offsets, length, k, identity)
    parts = []
    for at in range(0, len(data) - length + 1, PART):
        piece = data[at:at + PART + length - 1]
        parts.append(_stretches(piece, np.array([0, len(piece)]), length, k, identity))
        parts[-1]["start"] += at
        parts[-1]["row"][:] = 0
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a and from b are equal, pair by pair."""
    if not len(a):
        return np.empty(0, bool)
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    return np.logical_and.reduceat(data[np.repeat(a, n) + step] == data[np.repeat(b, n) + step], first)


def settled(data: np.ndarray, place: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Which of a batch's strings (``place`` and ``size`` in data; equal ones have equal ``alike``) are also found earlier
    in the batch.  Bytes are compared, so a shared hash alone settles nothing."""
    order = np.lexsort((start, doc, alike))
    new = np.ones(len(order), bool)
    new[1:] = alike[order[1:]] != alike[order[:-1]]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = np.flatnonzero(((doc[order] != doc[first]) | (start[order] != start[first])) & (size[order] == size[first]))
    later = later[same_bytes(data, place[order[later]], place[first[later]], size[order[later]])]
    out = np.zeros(len(order), bool)
    out[order[later]] = True
    return out


def gram_keys(data: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place, for few places."""
    out = np.zeros(len(places), np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + data[places + i]
    return mix(out)


def units(length: int) -> tuple[int, int]:
    """(w, unit): a stretch's place is (start * w + before) * w + n, below unit; multiples of unit tell its round, and whether its anchor is hot."""
    w = length + 1
    if w * w >= 1 << 31:
        raise ValueError(f"strings of {length} bytes are too long to look for")
    return w, w * w << 31


def pack(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return starts.astype(np.int64) << 32 | ends.astype(np.int64)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal spans of packed ones."""
    if not len(spans):
        return spans
    spans = np.sort(spans)
    starts, ends = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.append(True, starts[1:] > ends[:-1])
    return pack(starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)])


# --- deep-shallow sorting ----------------------------------------------------------------


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` in order of their strings (of equal length): a blind trie keeps branching bytes and depths only;
    a string is compared with one leaf, then hung in at the depth where it differs."""
    root: list = [None, [members[0]]]  # leaf: [None, members]; node: [depth, {byte: child}]
    for m in members[1:]:
        s, at = strings[m], root
        while at[0] is not None:
            at = at[1].get(s[at[0]]) or next(iter(at[1].values()))
        other = strings[at[1][0]]
        if s == other:
            at[1].append(m)
            continue
        x = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = len(s) - (x.bit_length() + 7) // 8
        at = root
        while at[0] is not None and at[0] < depth:
            at = at[1][s[at[0]]]
        if at[0] == depth:
            at[1][s[depth]] = [None, [m]]
        else:  # what hangs here goes below the new node
            at[0], at[1] = depth, {other[depth]: [at[0], at[1]], s[depth]: [None, [m]]}
    out, stack = [], [root]
    while stack:
        depth, below = stack.pop()
        if depth is None:
            out += below
        else:
            stack += [below[b] for b in sorted(below, reverse=True)]
    return out


def deep_shallow_order(strings: list[bytes], members: list[int], shallow: int = SHALLOW) -> list[int]:
    """``members`` in order of their strings: multikey quicksort by WORD bytes down to ``shallow`` bytes, then blind tries."""
    out: list[int] = []
    stack = [(members, 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            out += blind_trie_order(strings, group)
        else:
            end = depth + WORD
            pivot = strings[group[len(group) // 2]][depth:end]
            less, equal, greater = [], [], []
            for m in group:
                word = strings[m][depth:end]
                (equal if word == pivot else less if word < pivot else greater).append(m)
            stack += [(g, d) for g, d in ((greater, depth), (equal, end), (less, depth)) if g]
    return out


def _classes(strings: list[bytes], group: np.ndarray, width: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row in the order by group and string, common prefix with the row before: -1 at a new group)."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    order = []
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(group)).tolist()):
        order += deep_shallow_order(strings, list(range(a, b)), shallow) if b - a > 1 else [a]
    order = np.array(order, np.int64)
    table = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), width)[order]
    differ = table[1:] != table[:-1]
    common = np.full(len(order), -1, np.int64)
    common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, common


def group_repeats(group: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, before: np.ndarray, raw: list[bytes],
                  length: int, k: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(row, packed span) of the repeats among stretches sorted by ``group`` (equal anchors)."""
    rooms = length - k + 1
    right = [s[b:b + length].ljust(length, b"\0") for s, b in zip(raw, before.tolist())]
    left = [s[:b][::-1].ljust(rooms, b"\0") for s, b in zip(raw, before.tolist())]
    r_place, r_common = _classes(right, group, length, shallow)
    l_place, l_common = _classes(left, group, rooms, shallow)
    anchor = start + before
    rows = np.lexsort((anchor, doc))
    repeat = np.zeros((len(group), rooms), bool)
    for o in range(rooms):  # windows that begin o bytes before their anchor
        at = rows[(before[rows] >= o) & (before[rows] - n[rows] < o)]
        if len(at) < 2:
            continue
        same = np.cumsum(r_common < length - o)[r_place[at]] * (len(group) + 1) + np.cumsum(l_common < o)[l_place[at]]
        _, first, which = np.unique(same, return_index=True, return_inverse=True)
        first = at[first[which]]
        repeat[at, rooms - 1 - o] = (doc[at] != doc[first]) | (anchor[at] != anchor[first])
    edge = np.diff(np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, pack(anchor[row] - (rooms - 1 - low), anchor[row] - (rooms - high) + length)


# --- the job -----------------------------------------------------------------------------


def _by_row(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """Lists of each row's values (``row`` ascending)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def _anchors(rows: DataFrame, length: int, k: int) -> DataFrame:
    """doc, hash, bytes, local (repeats settled in the batch), keys and places of the stretches that go on."""
    w, _ = units(length)

    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            s = stretches(data, offsets, length, k, identity=True)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[s["row"]]
            size = s["n"] - 1 + length
            later = settled(data, offsets[s["row"]] + s["start"], size, doc, s["start"], s["all"])
            spans = pack(s["start"], s["start"] + size)
            place = (s["start"] * w + s["before"]) * w + s["n"]
            n = batch.num_rows
            local = [merged(x) for x in np.split(spans[later], np.searchsorted(s["row"][later], np.arange(1, n)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("hash"), pa.array(np.diff(offsets), pa.int64()), pa.array(local, pa.list_(pa.int64())),
                 _by_row(s["row"][~later], s["key"][~later].view(np.int64), n), _by_row(s["row"][~later], place[~later], n)],
                names=["doc", "hash", "bytes", "local", "keys", "places"])

    return in_arrow(rows, run, "doc long, hash long, bytes long, local array<long>, keys array<long>, places array<long>")


STRETCH, WINDOW, SETTLED = 0, 1, 2
SENT = ["kind", "key", "doc", "hash", "start", "n", "before", "raw"]
SENT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _send(marked: DataFrame, length: int, k: int) -> DataFrame:
    """What meets others, with its bytes: STRETCH by anchor; at hot anchors each WINDOW by the hash of its bytes, unless an earlier
    one in the batch settles it (SETTLED: raw holds packed spans).  ``marked``: doc, hash, text, met (see ``units``)."""
    w, unit = units(length)

    def batch_of(kind: int, batch: pa.RecordBatch, key, row, start, n, before, raw) -> pa.RecordBatch:
        take, size = pa.array(row), len(row)
        columns = [np.full(size, kind), key, batch.column("doc").take(take), batch.column("hash").take(take), start, n, before, raw]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, SENT_TYPES)], names=SENT)

    def bytes_at(data, low, size):
        return [data[a:b].tobytes() for a, b in zip(low.tolist(), (low + size).tolist())]

    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("met")
            met = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            is_hot, met = met // unit % 2 == 1, met % unit

            def listed(which: np.ndarray) -> tuple[np.ndarray, ...]:
                return at[which], met[which] // (w * w), met[which] // w % w, met[which] % w

            row, start, before, n = listed(~is_hot)
            key = gram_keys(data, offsets[row] + start + before, k)
            yield batch_of(STRETCH, batch, key.view(np.int64), row, start, n, before, bytes_at(data, offsets[row] + start, n - 1 + length))
            row, start, before, n = listed(is_hot)
            if not len(row):
                continue
            row = np.repeat(row, n)
            start = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place, doc = offsets[row] + start, batch.column("doc").to_numpy(zero_copy_only=False)[row]
            alike = np.concatenate([g.at(p, length) for g, p in _parts(data, place, length)])
            later = settled(data, place, np.full(len(place), length), doc, start, alike)
            on = np.flatnonzero(~later)
            one = np.ones(len(on), np.int64)
            yield batch_of(WINDOW, batch, alike[on].view(np.int64), row[on], start[on], one, 0 * one, bytes_at(data, place[on], length * one))
            spans, head = pack(start, start + length)[later], np.unique(row[later])
            lists = np.split(spans, np.searchsorted(row[later], head[1:])) if len(head) else []
            none = 0 * head
            yield batch_of(SETTLED, batch, batch.column("hash").to_numpy(zero_copy_only=False)[head], head, none, none, none, [merged(x).tobytes() for x in lists])

    return in_arrow(marked, run, "kind int, key long, doc long, hash long, start long, n int, before int, raw binary")


def _parts(data: np.ndarray, place: np.ndarray, length: int):
    """(hashes of a part of the data, the ascending places in it), for places in all of it."""
    for low in range(0, len(data), PART):
        inside = place[np.searchsorted(place, low):np.searchsorted(place, low + PART)]
        if len(inside):
            yield Grams(data[low:low + PART + length - 1], length), inside - low


def _met(sent: DataFrame, length: int, k: int) -> DataFrame:
    """doc, hash, spans of the repeats: stretches by sorting each anchor's group, windows by their earliest place."""
    def lists_of(doc, text, row, spans) -> pa.RecordBatch:
        order = np.lexsort((text[row], doc[row]))
        row, spans = row[order], spans[order]
        cut = np.flatnonzero((doc[row[1:]] != doc[row[:-1]]) | (text[row[1:]] != text[row[:-1]])) + 1
        head = np.append(0, cut)[:len(row)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(spans, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(doc[row[head]]), pa.array(text[row[head]]), lists], names=["doc", "hash", "spans"])

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        group, doc, text, start = (table[c].to_numpy() for c in ("key", "doc", "hash", "start"))
        n, before = (table[c].to_numpy().astype(np.int64) for c in ("n", "before"))
        return lists_of(doc, text, *group_repeats(group, doc, start, n, before, table["raw"].to_pylist(), length, k))

    def windows(batch: pa.RecordBatch, last: tuple) -> tuple[pa.RecordBatch, tuple]:
        """Sorted by bytes, id and start: whatever follows the first of equal bytes is a repeat."""
        raw, doc, text, start = batch.column("raw").to_pylist(), *(batch.column(c).to_numpy() for c in ("doc", "hash", "start"))
        later = []
        for i, own in enumerate(zip(raw, doc.tolist(), start.tolist())):
            if own[0] != last[0]:
                last = own
            elif own[1:] != last[1:]:
                later.append(i)
        later = np.array(later, np.int64)
        return lists_of(doc, text, later, pack(start[later], start[later] + length)), last

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, last = 0, (None,)
        for whole in batches:
            kinds = whole.column("kind").to_numpy()
            a, b = np.searchsorted(kinds, [WINDOW, SETTLED]).tolist()
            if batch := whole.slice(0, a) if a else None:
                keys = batch.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on; a group holds about HOT rows at most
                if cut and rows + cut >= BLOCK:
                    yield settle([*held, batch.slice(0, cut)])
                    held, rows, batch = [], 0, batch.slice(cut)
                held.append(batch)
                rows += batch.num_rows
            if a < b:
                found, last = windows(whole.slice(a, b - a), last)
                yield found
            if b < whole.num_rows:
                rest = whole.slice(b)
                spans = [np.frombuffer(x, np.int64) for x in rest.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays([rest.column("doc"), rest.column("hash"), pa.array(spans, pa.list_(pa.int64()))], names=["doc", "hash", "spans"])
        if held:
            yield settle(held)

    by_bytes = F.when(F.col("kind") == WINDOW, F.col("raw"))
    dealt = sent.repartition("key").sortWithinPartitions("kind", "key", by_bytes, "doc", "start")
    return in_arrow(dealt, run, "doc long, hash long, spans array<long>")


def _joined(rows: DataFrame, lists: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``rows`` with the lists of their id and hash: broadcast if the lists are counted small."""
    held = lists.agg(F.sum(sum((F.size(c) * 8 for c in columns), F.lit(64)))).first()[0] or 0
    return rows.join(F.broadcast(lists) if held <= BROADCAST_BYTES else lists, ["doc", "hash"], how)


def _merged_lists(found: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            spans = [merged(np.array(x, np.int64)) for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("hash"), pa.array(spans, pa.list_(pa.int64()))], names=["doc", "hash", "spans"])

    whole = found.groupBy("doc", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return in_arrow(whole, run, "doc long, hash long, spans array<long>")


def rounds_of(sent: int, text_bytes: int, length: int) -> int:
    """Rounds in which ``sent`` bytes go, ROUND_X times the texts' bytes at most in each; as many as a place can tell apart."""
    most = (1 << 62) // units(length)[1]
    return max(1, min(most, -int(-sent // max(1, ROUND_X * text_bytes))))


def _spans(texts: DataFrame, length: int, k: int) -> DataFrame:
    _, unit = units(length)
    anchors = saved(_anchors(texts, length, k), "repeat-anchors")
    found = [saved(anchors.filter(F.size("local") > 0).select("doc", "hash", F.col("local").alias("spans")), "repeat-local")]
    met = anchors.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = saved(met.select("key", "n", (F.col("n") > HOT).alias("is_hot")), "repeat-keys")
    cold, hot = met.agg(F.sum(F.when(~F.col("is_hot"), F.col("n"))), F.sum(F.when(F.col("is_hot"), F.col("n")))).first()
    size, count = anchors.agg(F.sum("bytes"), F.sum(F.size("keys"))).first()
    windows = (size or 0) / max(1, count or 0)  # of a stretch
    rounds = rounds_of((cold or 0) * (SENT_BYTES + windows + length) + (hot or 0) * windows * (SENT_BYTES + length), size or 0, length)
    placed = anchors.select("doc", "hash", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("doc", "hash", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    code = F.col("place") + unit * (2 * F.pmod("key", F.lit(rounds)) + F.col("is_hot").cast("long"))
    # equal rows list their places twice
    flags = saved(placed.join(met.select("key", "is_hot"), "key").groupBy("doc", "hash").agg(F.sort_array(F.collect_set(code)).alias("met")), "repeat-flags")
    dropped(anchors, met)
    for turn in range(rounds):
        low = 2 * unit * turn
        own = flags if rounds == 1 else flags.select("doc", "hash", F.filter("met", lambda x: (x >= low) & (x < low + 2 * unit)).alias("met")).filter(F.size("met") > 0)
        found.append(saved(_met(_send(_joined(texts, own, ["met"], "inner"), length, k), length, k), "repeat-found"))
    dropped(flags)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spans = saved(_merged_lists(every), "repeat-spans")
    dropped(*found)
    return spans


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(rows: id, doc, hash, text; spans: doc, hash, merged packed spans to remove, where there are any)."""
    own = F.col(id_column).cast("long")
    rows = docs.select(own.alias("id"), F.coalesce(own, F.lit(NULL_ID)).alias("doc"), text_column(docs, text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = rows.select("doc", "hash", "text").filter(F.octet_length("text") >= length)
    with released(docs.sparkSession):
        return rows, _spans(texts, length, anchor)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, on demand kept (the remaining bytes)."""
    rows, spans = repeated_spans(docs, id_column, text_col, length, anchor)

    def run(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, kept, at = text.encode(), [], 0
                for span in cuts or []:
                    kept.append(data[at:span >> 32])
                    at = span & 0xFFFFFFFF
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(cuts or []), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((*[pa.int64()] * 3, pa.string(), pa.binary())))], names=NAMES)

    joined = _joined(rows, spans, ["spans"], "left").select("id", "text", "spans")
    found = in_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found if keep_text else found.drop("kept")


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
