"""SentencePiece encoding by forward filtering and backward sampling, and decoding
(operator 1).

The pieces of a SentencePiece model that match a text form a lattice over its characters.
Forward filtering adds up, for each position, the weight of all segmentations that end there;
backward sampling then draws pieces from the end with their exact posterior
probabilities.  The draw at a position is a hash of the row's key, the seed and the position, so
a row is segmented alike in every run, batch and partition.

Weights: a unigram model's scores are log probabilities; a BPE model's are merge
ranks, read as Zipf weights 1 / (rank + 1).  ``alpha`` is the exponent on them (large: the best
segmentation, 0: uniform).  A character without a piece of its own is also an edge of its UTF-8
bytes' pieces.

No piece holds a space behind another character, so the lattice falls apart at each
run of spaces; it is built once for every distinct unit (spaces and the word behind
them) of a batch, and all occurrences are sampled together.  As in SentencePiece a space is
put before the text and taken off by decoding.  A U+2581 in the text itself is written in bytes, as
it would otherwise come back as a space.  Decoding joins the pieces' bytes, so every text is
given back as it was.

Edge cases: a null text has null ids and decodes to null; an empty text has no ids; repeated
rows with one key are segmented alike; a null key is a key; an empty table gives no rows; all
other columns are kept (a column named like a result is replaced).
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, mix, slices, with_fields, worker_memo

SLICE = 1 << 19  # bytes of text sampled at a time
IDS = 1 << 18  # ids decoded at a time, unless one row has more
CHUNK = 1 << 16  # characters of units whose lattices are built at a time
SPACE = "▁"
UNIT = re.compile(r" +[^ ]*")
GAP = "\0"  # between units when they are matched; no piece holds it


class Pieces:
    """A model's pieces: a trie, log weights, byte pieces and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ordinary = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranks = bool(np.all(scores[ordinary] == np.round(scores[ordinary])))
        self.weight = -np.log(np.maximum(-scores, 0) + 1) if ranks else scores.copy()
        self.length = np.array([len(x) for x in names])
        self.byte_ids = np.zeros(256, np.int32)
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value], raw[i] = i, bytes([value])
                self.weight[i] = self.weight[ordinary].min()
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw[i] = names[i].replace(SPACE, " ").encode()
        self.byte_weight = float(self.weight[ordinary].min())
        # a trie of the pieces: edges (node, character class) -> node
        chars = sorted({c for i in ordinary for c in names[i].replace(SPACE, " ")} - {GAP})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        width, edges, ends = len(chars) + 1, {}, {}
        for i in ordinary:
            if SPACE in names[i].lstrip(SPACE):
                raise ValueError("a piece holds a space behind another character")
            node = 0
            for c in names[i].replace(SPACE, " "):
                node = edges.setdefault(node * width + int(self.classes[ord(c)]), len(edges) + 1)
            ends[node] = i
        self._lay_out(edges, width)
        self.ends = np.full(len(edges) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.raw_length = np.array([len(x) for x in raw])
        self.raw_start = np.concatenate(([0], np.cumsum(self.raw_length)))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _lay_out(self, edges: dict[int, int], width: int) -> None:
        """The trie as a table: the edge of class ``c`` out of a node lies in slot ``base[node] + c`` if ``owner``
        names the node there.  Nodes of many edges are laid down first, those of one take the slots left."""
        keys = np.array(sorted(edges), np.int64)
        to = np.array([edges[k] for k in keys.tolist()], np.int32)
        nodes, kinds = np.divmod(keys, width)
        owners, first, n = np.unique(nodes, return_index=True, return_counts=True)
        free, low, bases = np.ones(len(keys) + 4 * width, bool), width, np.zeros(len(owners), np.int64)
        for i in np.argsort(-n, kind="stable")[:int((n > 1).sum())].tolist():
            kind, at = kinds[first[i]:first[i] + n[i]], low
            kind = kind - kind[0]
            while True:
                if at + 256 + width > len(free):
                    free = np.concatenate((free, np.ones(len(free), bool)))
                places = at + np.flatnonzero(free[at:at + 256])
                fits = free[places[:, None] + kind].all(1)
                if fits.any():
                    break
                at += 256
            place = int(places[fits.argmax()])
            free[place + kind] = False
            bases[i] = place - kinds[first[i]]
            if free[low:low + 256].sum() < 128:  # the rest is for nodes of one edge
                low += 256
        alone = np.flatnonzero(n == 1)
        left = width + np.flatnonzero(np.concatenate((free[width:], np.ones(len(alone), bool))))[:len(alone)]
        bases[alone] = left - kinds[first[alone]]
        slots = int(bases.max(initial=0)) + width
        self.base = np.full(len(edges) + 1, slots, np.int32)  # a node without edges: slots of nobody
        self.base[owners] = bases
        self.owner, self.edge_to = np.full(slots + width, -1, np.int32), np.zeros(slots + width, np.int32)
        slot = self.base[nodes] + kinds
        self.owner[slot], self.edge_to[slot] = nodes, to

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece at every place, all places walking the trie at once."""
        kinds = np.append(self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)], np.int32(0))
        start, node, length, out = np.arange(len(text), dtype=np.int32), np.zeros(len(text), np.int32), 0, []
        while len(start):
            slot = self.base[node] + kinds[start + length]
            go = np.flatnonzero(self.owner[slot] == node)
            start, node, length = start[go], self.edge_to[slot[go]], length + 1
            piece = self.ends[node]
            hit = np.flatnonzero(piece >= 0)
            at = start[hit]
            out.append((at, at + np.int32(length), piece[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))


def pieces(path: str) -> Pieces:
    return worker_memo(f"pieces {path}", lambda: Pieces(path))


class Lattice:
    """The lattices of distinct units, side by side; node i lies before character i.

    Only what sampling needs is kept of each chunk of units: the edges' sources and
    pieces, and the list to search."""

    def __init__(self, units: list[str], p: Pieces, alpha: float):
        lens = np.array([len(u) for u in units])
        self.start = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
        self.end = self.start + lens
        self.text = GAP.join(units) + GAP
        chunk = self.start // CHUNK
        cuts = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(units)]
        keys, sources, ids, edges = [], [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = _Part(units[a:b], lens[a:b], p, alpha)
            base = int(self.start[a])
            keys.append(part.key + base)
            sources.append(part.source + np.int32(base))
            ids.append(part.piece)
            edges.append(part.edges)
        # one after another, as they are the most of a task's memory
        self.key = np.concatenate(keys)
        del keys, part
        self.source = np.concatenate(sources)
        del sources
        self.piece, edges = np.concatenate(ids), np.concatenate(edges)
        self.first = np.concatenate(([0], np.cumsum(edges, dtype=np.int32)))  # first edge into each node

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each node, drawn with its posterior probability: the first whose running share
        exceeds u, else the last.  Longer pieces come last and are mostly drawn, so the search runs backwards."""
        at, low, high = self.first[node + 1] - 1, self.first[node], node + u
        live = np.flatnonzero(at > low)
        while len(live):
            live = live[self.key[at[live] - 1] > high[live]]
            at[live] -= 1
            live = live[at[live] > low[live]]
        return at


class _Part:
    """Forward filtering over the lattices of some units."""

    def __init__(self, units: list[str], lens: np.ndarray, p: Pieces, alpha: float):
        text = GAP.join(units) + GAP
        self.start = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
        self.end = self.start + lens
        source, node, piece = p.find(text)
        # characters that no piece covers alone go in bytes
        single = np.ones(len(text), bool)
        single[source[node - source == 1]] = False
        single[self.end] = False
        alone = np.flatnonzero(single).astype(np.int32)
        size = np.array([len(text[i].encode()) for i in alone], np.int64)
        node = np.concatenate((node, alone + 1))
        source = np.concatenate((source, alone))
        piece = np.concatenate((piece, np.full(len(alone), -1, np.int32)))
        weight = alpha * np.concatenate((p.weight[piece[:len(piece) - len(alone)]], p.byte_weight * size))
        order = np.argsort(node, kind="stable")
        self.node, self.source, self.piece, weight = node[order], source[order], piece[order], weight[order]
        self._filter(weight)

    def _filter(self, weight: np.ndarray) -> None:
        total = np.zeros(int(self.end[-1]) + 2)
        first = np.flatnonzero(np.concatenate(([True], self.node[1:] != self.node[:-1])))
        ends = np.concatenate((first[1:], [len(self.node)]))
        # nodes at one distance from their unit's start are filtered together
        nodes = self.node[first]
        distance = nodes - self.start[np.searchsorted(self.start, nodes - 1, "right") - 1]
        by = np.argsort(distance, kind="stable")
        cuts = np.flatnonzero(np.diff(distance[by], prepend=-1, append=-1))
        n = (ends - first)[by]
        head = np.concatenate(([0], np.cumsum(n)))
        edge = np.arange(len(self.node)) - np.repeat(head[:-1] - first[by], n)  # edges in this order of their nodes
        source, weight, nodes_by, part = self.source[edge], weight[edge], nodes[by], np.empty(len(edge))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            to = slice(int(head[a]), int(head[b]))
            heads, many = head[a:b] - head[a], n[a:b]
            value = total[source[to]]
            value += weight[to]
            top = np.maximum.reduceat(value, heads)
            value -= np.repeat(top, many)
            np.exp(value, out=value)
            whole = np.add.reduceat(value, heads)
            total[nodes_by[a:b]] = top + np.log(whole)
            part[to] = value / np.repeat(whole, many)
        share = np.empty(len(edge))
        share[edge] = part
        # running shares inside each node, offset by the node, and the number of edges into each of the part's nodes
        run = np.cumsum(share)
        before = np.concatenate(([0.0], run[ends[:-1] - 1])) if len(first) else np.zeros(0)
        self.key = self.node + np.minimum(run - np.repeat(before, ends - first), 1.0)
        self.edges = np.zeros(int(self.end[-1]) + 1, np.int32)  # nodes up to the last unit's end
        self.edges[nodes] = ends - first


def sample(texts: list[str], keys: np.ndarray, p: Pieces, alpha: float, seed: int) -> list[np.ndarray]:
    """Ids of each text; ``keys`` are 64-bit row keys."""
    split = [UNIT.findall(" " + t) if t else [] for t in texts]
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    n_units = np.array([len(x) for x in split], np.int64)
    unit = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n_units.sum()))
    index.default_factory = None  # it holds the index, which would outlive this call until a garbage collection
    if not len(unit):
        return [np.empty(0, np.int32) for _ in texts]
    del split  # every unit's own string; the distinct ones stay
    lattice = Lattice(list(index), p, alpha)
    row = np.repeat(np.arange(len(texts)), n_units)
    lens = (lattice.end - lattice.start)[unit]
    place = np.cumsum(lens) - lens
    place -= place[np.concatenate(([0], np.cumsum(n_units)))[:-1].clip(max=len(unit) - 1)][row]  # in its row
    salt = mix(keys.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))[row]
    node, live, steps = lattice.end[unit], np.arange(len(unit)), []
    count = np.zeros(len(unit), np.int64)
    while len(live):
        at = (place[live] + node - lattice.start[unit[live]]).astype(np.uint64)
        u = (mix(salt[live] ^ mix(at)) >> np.uint64(12)) / float(1 << 52)
        edge = lattice.draw(node, u)
        steps.append((live, edge))
        count[live] += 1
        node = lattice.source[edge]
        go = node > lattice.start[unit[live]]
        live, node = live[go], node[go]
    edges = np.empty(int(count.sum()), np.int64)
    stop = np.cumsum(count)
    for k, (who, edge) in enumerate(steps):
        edges[stop[who] - 1 - k] = edge
    ids, size = lattice.piece[edges], np.ones(len(edges), np.int64)
    raw = np.flatnonzero(ids < 0)
    if len(raw):
        spelled = [lattice.text[lattice.source[e]].encode() for e in edges[raw]]
        size[raw] = [len(x) for x in spelled]
        places = np.flatnonzero(np.repeat(ids < 0, size))
        ids = np.repeat(ids, size)
        ids[places] = p.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], stop))]
    bounds = ends[np.concatenate(([0], np.cumsum(n_units)))]
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def encode(docs: DataFrame, model_path: str, key_column: str = "doc_id", text_col: str = "text",
           out: str = "ids", alpha: float = 1.0, seed: int = 0, keep_text: bool = True,
           lossless: str | None = None) -> DataFrame:
    """``docs`` with sampled piece ids (array<int>), on request without the text and with
    a column ``lossless`` that tells whether the ids decode to the text."""
    rest = docs.drop(out, *([lossless] if lossless else []))
    kept = rest if keep_text else rest.drop(text_col)
    names = kept.columns
    key = "key"
    while key in rest.columns:
        key += "_"
    keyed = rest.withColumn(key, F.xxhash64(F.coalesce(F.col(key_column).cast("string"), F.lit("")), F.col(key_column).isNull()))

    def run(batches):
        p = pieces(model_path)
        for batch in slices(batches, text_col, SLICE):
            texts = batch.column(text_col).to_pylist()
            got = sample([t or "" for t in texts], batch.column(key).to_numpy(zero_copy_only=False).view(np.uint64), p, alpha, seed)
            stops = np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
            flat = np.concatenate(got)
            del got
            offsets = pa.array(stops, pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))
            same = []
            if lossless:
                data, bounds = decode_ids(flat, stops, p)
                back = data.tobytes()
                same.append(pa.array([back[a:b] == (t or "").encode() for a, b, t in zip(bounds[:-1], bounds[1:], texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, *same], names=[*names, out, *([lossless] if lossless else [])])

    return in_arrow(keyed, run, with_fields(kept, (out, "array<int>"), *([(lossless, "boolean")] if lossless else [])))


def decode_ids(ids: np.ndarray, offsets: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of the texts of rows of ids."""
    n = p.raw_length[ids]
    ends = np.concatenate(([0], np.cumsum(n)))
    data = p.raw[np.arange(int(ends[-1])) - np.repeat(ends[:-1] - p.raw_start[ids], n)]
    bounds = ends[offsets]
    keep = np.ones(len(data), bool)
    keep[bounds[:-1][bounds[1:] > bounds[:-1]]] = False  # the space put before the text
    return data[keep], bounds - np.concatenate(([0], np.cumsum(bounds[1:] > bounds[:-1])))


def decode(rows: DataFrame, model_path: str, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids."""
    rest = rows.drop(out)
    names = rest.columns

    def run(batches):
        p = pieces(model_path)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(whole.column(ids_column).value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            to = 0
            while to < whole.num_rows:
                at, to = to, max(to + 1, int(np.searchsorted(ends, (ends[to - 1] if to else 0) + IDS, "right")))
                batch = whole.slice(at, to - at)
                column = batch.column(ids_column)
                missing = column.is_null()
                flat = column.flatten().to_numpy(zero_copy_only=False)
                lens = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
                data, bounds = decode_ids(flat, np.concatenate(([0], np.cumsum(lens))), p)
                texts = pa.StringArray.from_buffers(len(column), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pc.if_else(missing, pa.scalar(None, pa.string()), texts)], names=[*names, out])

    return in_arrow(rest, run, with_fields(rest, (out, "string")))
