"""Exact n-gram Jaccard join with a count-vector R-tree (operator 8).

A document's set is its distinct ``k``-word shingles (64-bit hashes; a text of fewer
words is one shingle).  Documents link when ``den * |A & B| >= num * |A | B|``.

1. *Points.*  A set's shingles are hashed into DIMENSIONS groups and counted by group: a point whose coordinates
   add up to the set's size.  Two sets have in common what the coordinates' minima add up to, at most.
2. *Meeting.*  Shingles are counted by bucket over all texts (a table of fixed size).  Of each distinct set of a task the
   n - ceil(n * num / den) + 1 rarest shingles by (bucket's count, hash) go out: linked sets have one of them
   in common, as they share the order.  Passages that many texts hold are common, so they bring no sets together unless the
   sets hold little else.  Keys with the same members are met once.
3. *Index.*  What meets is bounded before any set moves, by points alone: first each key's least row against its
   others; then, where a key's rows are not connected yet, all of them, in pages of bounded size (by size of set, then hash; page
   pairs whose sizes can link) with an R-tree of several levels over the points.  Only connections that the bound lets pass stay, and no
   more of them than connect the rows.  Their components are *cells*: groups of texts that are alike by count.
4. *Verification.*  Cells get their sets, once for each page pair, and the R-tree's surviving pairs are intersected exactly,
   unless links found already connect them; so a group of m copies yields m - 1 links, not m * m / 2.

Components of the links give the classes.  Count boxes alone cannot distribute the join: in many dimensions a page's box
covers most points, whatever the order they are packed in, and the work would grow with the square of the texts.  So rare shingles
bring texts together, and the points decide which of these need a closer look.

Edge cases: null and empty texts have an empty set, link with nothing and are their own
component; equal sets (repeated rows) form one class; a null id never becomes a component id
unless all ids of the class are null; rows that share an id but not a text are
separate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, mix, shingles, slices, text_bytes, text_column, words
from .components import components, dropped, saved

PAGE, PAGE_SHINGLES = 4096, 1 << 21  # a page holds about so many points, and shingles, at most
NODE = 16
DIMENSIONS, PER_COORDINATE = (64, 4096), 6  # least and most coordinates; between them so many shingles to each, at most
BUCKETS = 1 << 18
SMALL = 48  # groups up to this size are compared without a tree
SEEN_LIMIT = 500_000
BROADCAST_ROWS = 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; A-Z folded."""
    _, _, h, first = words(data, offsets, lower=True)
    grams = shingles(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            whole = mix(np.array([b - a], np.uint64))
            for x in h[a:b]:
                whole = mix(whole ^ x)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def buckets_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) % BUCKETS


def rare_keys(s: np.ndarray, num: int, den: int, load: np.ndarray | None = None) -> np.ndarray:
    """The shingles of step 2 for one set; ``load`` is the number of shingles in each bucket."""
    order = np.lexsort((s, load[buckets_of(s)])) if load is not None else np.argsort(s)
    return s[order[:len(s) - -(-len(s) * num // den) + 1]]


def counts_of(s: np.ndarray) -> np.ndarray:
    """A set's point.  Its coordinates, a power of two, grow with the set, so that the bound stays sharp; points fold onto fewer."""
    d = DIMENSIONS[0]
    while d < DIMENSIONS[1] and d * PER_COORDINATE < len(s):
        d *= 2
    return np.bincount((s >> np.uint64(17)).astype(np.int64) % d, minlength=d)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points of as many coordinates as the one of fewest."""
    d = min(map(len, points), default=DIMENSIONS[0])
    return np.array([x if len(x) == d else x.reshape(-1, d).sum(0) for x in points], np.int64).reshape(-1, d)


class CountTree:
    """R-tree over count vectors, packed by size and then by coordinates: NODE points to a leaf, NODE nodes to
    the node above, each node with the largest coordinates and the sizes of what lies below."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*counts.T[::16], sizes))
        self.counts, self.sizes, self.levels = counts, sizes, []
        high, small, large = counts[self.order], sizes[self.order], sizes[self.order]
        while not self.levels or len(high) > NODE:
            first = np.arange(0, len(high), NODE)
            high, small, large = np.maximum.reduceat(high, first), np.minimum.reduceat(small, first), np.maximum.reduceat(large, first)
            self.levels.append((high, small, large))

    def near(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Points whose overlap may reach the threshold, the likeliest first."""
        least, most = -(-size * num // den), size * den // num
        at = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, small, large = (x[at] for x in self.levels[k])
            need = -(-num * (size + np.maximum(small, least)) // (num + den))
            at = at[(np.minimum(high, point).sum(1) >= need) & (small <= most) & (large >= least)]
            at = (at[:, None] * NODE + np.arange(NODE)).ravel()
            at = at[at < (len(self.levels[k - 1][1]) if k else len(self.order))]
        at = self.order[at]
        slack = np.minimum(self.counts[at], point).sum(1) * (num + den) - num * (size + self.sizes[at])
        ok = (slack >= 0) & (self.sizes[at] >= least) & (self.sizes[at] <= most)
        return at[ok][np.argsort(-slack[ok], kind="stable")]


def bound_links(counts: np.ndarray, sizes: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of positions ``left`` and ``right`` that the bound lets pass, as many as connect what ``label``
    (changed on the way) does not connect yet."""
    links = []
    if len(left) == len(right) <= SMALL and (left == right).all():
        pass_ = np.minimum(counts[left][:, None], counts[left][None]).sum(2) * (num + den) >= num * (sizes[left][:, None] + sizes[left][None])
        for i, j in np.argwhere(np.triu(pass_, 1)).tolist():
            a, b = left[i], left[j]
            if label[a] != label[b]:
                links.append((a, b))
                label[label == label[b]] = label[a]
        return links
    tree = CountTree(counts[right], sizes[right])
    for a in left:
        near = right[tree.near(counts[a], sizes[a], num, den)]
        while len(near := near[label[near] != label[a]]):
            links.append((a, near[0]))
            label[label == label[near[0]]] = label[a]
    return links


def page_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between positions ``left`` and ``right`` (equal arrays: within one page) that
    connect what no earlier link connects."""
    counts, sizes = folded([counts_of(s) for s in sets]), np.array([len(s) for s in sets])
    tree, label, links = CountTree(counts[right], sizes[right]), np.arange(len(sets)), []
    for a in left:
        near = right[tree.near(counts[a], sizes[a], num, den)]
        near = near[label[near] != label[a]]
        while len(near):
            b = near[0]
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if den * both >= num * (sizes[a] + sizes[b] - both):
                links.append((a, b))
                label[label == label[b]] = label[a]
                near = near[label[near] != label[a]]
            else:
                near = near[1:]
    return links


def _loads(rows: DataFrame, k: int) -> np.ndarray:
    """Shingles of all texts by bucket."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            for s in shingle_sets(*text_bytes(batch.column("text")), k):
                np.add.at(total, buckets_of(s), 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])

    table = in_arrow(rows.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def _packed(counts: np.ndarray) -> bytes:
    """The coordinates in 1, 2 or 4 bytes each, after a byte that tells which."""
    width = 1 if (most := counts.max(initial=0)) < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64) for x in column.to_pylist()]


def _sketch(rows: DataFrame, k: int, num: int, den: int, load: np.ndarray) -> DataFrame:
    """doc_id, text_hash, v (number of the row), n, set_id, counts, keys (null for a copy of a set met in the task)."""
    def run(batches):
        seen, v = set(), TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            ids, keys, sizes, counts = [], [], [], []
            for s in shingle_sets(*text_bytes(batch.column("text")), k):
                sizes.append(len(s))
                if not len(s):
                    ids.append(None), keys.append(None), counts.append(None)
                    continue
                two = [int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64)) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
                ids.append((two[0] << 64 | two[1]).to_bytes(16, "big"))
                new = ids[-1] not in seen
                if new:
                    if len(seen) >= SEEN_LIMIT:
                        seen.clear()
                    seen.add(ids[-1])
                keys.append(rare_keys(s, num, den, load).view(np.int64) if new else None)
                counts.append(_packed(counts_of(s)) if new else None)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.arange(v, v + n)), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(counts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "v", "n", "set_id", "counts", "keys"])
            v += n

    return in_arrow(rows, run, "doc_id long, text_hash long, v long, n long, set_id binary, counts binary, keys array<long>")


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _paged(points: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(points (cell, v, n, ...) with page, uses: cell, page, i, j): sizes of a cell within the threshold's ratio, dealt out by hash into
    pages; the pairs i <= j of pages whose sizes can link, a page's own pair among them, each with the pages that it reads."""
    points = points.withColumn("band", F.floor(F.log("n") / math.log(den / num)).cast("long"))
    bands = points.groupBy("cell", "band").agg(F.count("*").alias("points"), F.sum("n").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    several = bands.groupBy("cell").agg(F.sum("points").alias("all")).filter("all > 1").select("cell")
    parts = F.ceil(F.greatest(F.col("points") / PAGE, F.col("size") / PAGE_SHINGLES))
    bands = saved(bands.join(several, "cell").select("cell", "band", "low", "high", (F.col("points") > 1).alias("several"), parts.alias("parts")), "jaccard-bands")
    page = F.col("band") * (1 << 32) + F.pmod(F.xxhash64("v"), F.col("parts"))
    dealt = points.join(bands.select("cell", "band", "parts"), ["cell", "band"]).withColumn("page", page).drop("band", "parts")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    # a page's own pair needs two points in its band
    pages = bands.select("cell", "low", "high", "band", "several", number.alias("part")).select("cell", "low", "high", "several", (F.col("band") * (1 << 32) + F.col("part")).alias("page"))
    other = pages.select("cell", F.col("page").alias("to"), F.col("low").alias("to_low"))
    pairs = pages.join(other, "cell").filter("page < to or page = to and several").filter(F.col("to_low") * num <= F.col("high") * den)
    pairs = pairs.select("cell", F.col("page").alias("i"), F.col("to").alias("j"))
    uses = pairs.select("cell", F.col("i").alias("page"), "i", "j").unionByName(pairs.filter("i <> j").select("cell", F.col("j").alias("page"), "i", "j"))
    return dealt, saved(uses, "jaccard-uses")


def _bounded_edges(edges: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Those of edges (a, b, and their sizes m, n) that the bound on their points lets pass."""
    def run(batches):
        for batch in batches:
            x, y = _unpacked(batch.column("x")), _unpacked(batch.column("y"))
            shared = np.array([np.minimum(*folded([p, q])).sum() for p, q in zip(x, y)], np.int64)
            sizes = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            ok = np.flatnonzero(shared * (num + den) >= num * sizes)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    first = points.select(F.col("v").alias("a"), F.col("counts").alias("x"))
    second = points.select(F.col("v").alias("b"), F.col("counts").alias("y"))
    return in_arrow(edges.join(first, "a").join(second, "b"), run, "a long, b long")


def _bounded_groups(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges of labels that connect the rows (cell, page, i, j, v, label, n, counts) of each page pair as far as the bound lets pass."""
    def settle(table: pa.Table) -> list[tuple[int, int]]:
        table = table.combine_chunks()
        label, n, page, i, j = (table[c].to_numpy() for c in ("label", "n", "page", "i", "j"))
        counts = _unpacked(table["counts"])
        names, label = np.unique(label, return_inverse=True)
        out = []
        cuts = np.flatnonzero((table["cell"].to_numpy()[1:] != table["cell"].to_numpy()[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
            own = label[a:b].copy()
            if b - a > 1 and (own != own[0]).any():
                left, right = np.flatnonzero(page[a:b] == i[a]), np.flatnonzero(page[a:b] == j[a])
                before = label[a:b]
                out += [(names[before[x]], names[before[y]]) for x, y in bound_links(folded(counts[a:b]), n[a:b], own, left, right, num, den)]
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("cell", "i", "j")]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0  # the last group may go on
            if cut:
                found = settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                yield _edge_batch(found)
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield _edge_batch(settle(pa.Table.from_batches(held)))

    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return in_arrow(dealt, run, "a long, b long")


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _alike(sketch: DataFrame, num: int, den: int) -> DataFrame:
    """(v, root): the cells of rows that keys bring together and the bound does not part."""
    spark = sketch.sparkSession
    keyed = sketch.filter("keys is not null").select(F.explode("keys").alias("key"), "v", "n").filter("key is not null").repartition("key")  # one exchange for both uses
    # keys with the same rows are one: least and greatest row, number and two sums of hashes
    same = [F.min(F.struct("v", "n")).alias("least"), F.max("v").alias("z"), F.count("*").alias("rows"), *(F.bit_xor(F.xxhash64(F.lit(i), "v")).alias(f"x{i}") for i in (1, 2))]
    met = keyed.groupBy("key").agg(*same).filter("least.v < z")
    met = met.groupBy("least", "z", "rows", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.col("least.v").alias("a"), F.col("least.n").alias("m"))
    members = saved(keyed.join(met, "key").select("key", "a", "m", "v", "n"), "jaccard-keys")
    points = sketch.filter("keys is not null").select("v", "counts")

    alike = (F.col("m") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("m") * den)
    edges = members.filter("a <> v").filter(alike).select("a", "m", F.col("v").alias("b"), "n").distinct()
    stars = saved(_bounded_edges(edges, points, num, den), "jaccard-stars")
    near = components(spark, stars)
    labelled = saved(members.join(near, "v", "left").select(F.col("key").alias("cell"), "v", "n", F.coalesce("root", "v").alias("label")), "jaccard-labelled")
    # of two rows the star has told all; of more, only if they are one component
    open_ = labelled.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).filter("low < high and rows > 2").select("cell")
    dealt, uses = _paged(labelled.join(open_, "cell"), num, den)
    rest = saved(dealt.join(_small(uses), ["cell", "page"]).join(points, "v"), "jaccard-open")
    more = components(spark, _bounded_groups(rest, num, den))
    # components of components: labels that the groups connect
    up = more.select(F.col("v").alias("root"), F.col("root").alias("top"))
    cells = near.join(up, "root", "left").select("v", F.coalesce("top", "root").alias("root")).unionByName(more.join(near.select("v"), "v", "left_anti"))
    cells = saved(cells, "jaccard-cells")
    dropped(members, stars, labelled, rest, uses)
    return cells


def _page_sets(rows: DataFrame, k: int) -> DataFrame:
    """Adds the set, as bytes, to rows with text."""
    def run(batches):
        for batch in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(*text_bytes(batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "page", "v")), pa.array(sets, pa.binary())], names=["cell", "page", "v", "set"])

    return in_arrow(rows, run, "cell long, page long, v long, set binary")


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_column: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id, component_v and
    v; the row with v = component_v represents its class."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = saved(_sketch(rows, k, num, den, _loads(rows, k)), "jaccard-sketch")
    sets = sketch.filter("set_id is not null").groupBy("set_id").agg(F.min("v").alias("rep"), F.min("doc_id").alias("least_id"))
    sets = saved(sets, "jaccard-sets")

    cells = _alike(sketch, num, den)
    members = cells.join(sketch.select("v", "set_id", "n", "doc_id", "text_hash"), "v").select("set_id", F.col("root").alias("cell"), "n", "doc_id", "text_hash", "v")
    members = members.join(sets.select("set_id", F.col("rep").alias("v")), ["set_id", "v"])
    dealt, uses = _paged(members, num, den)
    members = saved(dealt, "jaccard-members")

    wanted = _small(members.select("cell", "page", "v", "doc_id", "text_hash"))  # a row is under 100 bytes; beyond the bound the texts are shuffled
    picked = rows.alias("r").join(wanted.alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.text_hash") == F.col("w.text_hash")))
    points = _page_sets(picked.select("cell", "page", "v", "text"), k).join(_small(uses), ["cell", "page"])

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        v, page = group["v"].to_numpy(), group["page"].to_numpy()
        _, once = np.unique(v, return_index=True)  # a repeated row comes once for each repetition
        v, page = v[once], page[once]
        raw = group["set"]
        sets_ = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in once]
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        links = page_links(sets_, np.flatnonzero(page == i), np.flatnonzero(page == j), num, den)
        return pa.table({"a": pa.array([v[a] for a, _ in links], pa.int64()), "b": pa.array([v[b] for _, b in links], pa.int64())})

    links = points.groupBy("cell", "i", "j").applyInArrow(verify, "a long, b long")
    classes = components(spark, links)
    dropped(members, uses)
    sets = sets.join(classes.withColumnRenamed("v", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = sets.groupBy("root").agg(F.min("least_id").alias("component_id"))
    sets = sets.join(least, "root").select("set_id", "component_id", F.col("root").alias("component_v"))
    out = ["doc_id", "text_hash", "n_shingles", "component_id", "component_v", "v"]
    light = sketch.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_id", "v")
    alone = light.filter("set_id is null").withColumn("component_id", F.col("doc_id")).withColumn("component_v", F.col("v"))
    return light.filter("set_id is not null").join(sets, "set_id").select(*out).unionByName(alone.select(*out))
