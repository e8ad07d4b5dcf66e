"""Merkle manifest of a dataset with octopus multiproofs (operator 12).

Each row is a leaf.  The leaves of a group (a source) in order of their ids make a tree of arity
ARITY, and the groups' subroots in order make the tree of the root.  All trees are
built and proved by the same steps, so a group may hold any share of the rows and
the groups may be any number:

1. *Order.*  Rows are range partitioned by (group, id, leaf as it was and as found, row), so a hot group or id is
   split.  A leaf's number in its group is its place in its leaf partition, plus the rows
   of the group in the partitions before.  Only hashes are shuffled, never texts.
2. *Build.*  Aligned blocks of ARITY ** LEVELS nodes make the next LEVELS levels in one task
   each, then blocks of their tops the levels above, up to the single node.
3. *Octopus.*  A leaf partition needs the minimal union of nodes that its leaves' proofs use and
   that do not follow from its own leaves.  It computes their coordinates alone (at most 2 (ARITY - 1)
   a level for a range of leaves), they are fetched by one join, the shared interior nodes are hashed
   once, and every proof is cut out of them locally.

A verifier folds a leaf with its proof: ``folded`` does so for the leaf of the row as it is
found again (``again``), which tells a changed row from an unchanged one.

Digests are lower-case hex SHA-256 of concatenated text, digests as hex; a field is ``-`` if null, else its
UTF-8 length, ``:`` and its value.

Edge cases: null ids come first, a null group is a group of its own and comes first; rows that share an id
stand in order of their leaves, equal rows next to each other, each with its own proof; empty and very long texts
are hashed whole by Spark; a group of one row has the leaf as its subroot and proof elements
from the upper tree only; one row alone has an empty proof; an empty table gives no rows; columns
other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import in_arrow, with_fields
from .components import saved

ARITY = 3
LEVELS = 7
PART_ROWS = 1 << 16
BROADCAST_ROWS = 100_000


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def level_sizes(n: int, arity: int = ARITY) -> list[int]:
    """Nodes of each level above n leaves, the leaves first, the single node last."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def parents(nodes: list[str], arity: int = ARITY) -> list[str]:
    """The level above nodes that begin at a multiple of ``arity``."""
    return [digest(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]


def missing(low: int, high: int, n: int, arity: int = ARITY) -> list[tuple[int, int]]:
    """Coordinates (level, number) of the least nodes that, with the leaves low..high of n, give the
    proofs of them all: what lies between a range's ends follows from its own leaves."""
    out = []
    for level, size in enumerate(level_sizes(n, arity)[:-1]):
        out += [(level, i) for i in range(low - low % arity, low)]
        out += [(level, i) for i in range(high + 1, min(size, high - high % arity + arity))]
        low, high = low // arity, high // arity
    return out


def interior(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int, arity: int = ARITY) -> list[dict[int, str]]:
    """The nodes of each level that the proofs of ``leaves`` touch: given, fetched or derived."""
    levels, own = [], dict(leaves)
    for level, size in enumerate(level_sizes(n, arity)):
        levels.append(own | {i: h for (at, i), h in fetched.items() if at == level})
        if size > 1:
            up = sorted({i // arity for i in own})
            own = {i: digest(*[levels[-1][k] for k in range(i * arity, min(size, (i + 1) * arity))]) for i in up}
    return levels


def proof(levels: list[dict[int, str]], i: int, n: int, arity: int = ARITY) -> list[tuple[int, list[str]]]:
    """For each level below the top: the place in the run, and the siblings left to right."""
    out = []
    for level, size in enumerate(level_sizes(n, arity)[:-1]):
        low = i - i % arity
        out.append((i - low, [levels[level][k] for k in range(low, min(size, low + arity)) if k != i]))
        i //= arity
    return out


def fold(node: str, steps: Sequence[tuple[int, list[str]]]) -> str:
    for place, siblings in steps:
        node = digest(*siblings[:place], node, *siblings[place:])
    return node


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (grp, node, ...) with part, at (number in the group) and total (rows of the group); saved."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "node", "again", "tie")]
    dealt = dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def places(batches):
        last, place = (), 0  # no group has been met
        for batch in batches:
            groups = batch.column("grp").to_pylist()
            out = []
            for g in groups:
                place = place + 1 if (g,) == last else 0
                last = (g,)
                out.append(place)
            yield batch.append_column("place", pa.array(out, pa.int64()))

    dealt = dealt.drop("tie").withColumn("part", F.spark_partition_id())
    dealt = saved(in_arrow(dealt, places, with_fields(dealt, ("place", "long"))), name)
    counts = dealt.groupBy("grp", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp")  # a row for each leaf partition of the group
    counts = saved(counts.select("grp", "part", F.sum("n").over(w).alias("total"),
                                 (F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")), f"{name}-counts")
    d, c = dealt.alias("d"), _small(counts).alias("c")
    same = F.col("d.grp").eqNullSafe(F.col("c.grp")) & (F.col("d.part") == F.col("c.part"))
    return d.join(c, same).select("d.*", (F.col("place") + F.col("before")).alias("at"), "total").drop("place")


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if counted small (short rows of numbers and digests), else shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def _build(leaves: DataFrame, name: str, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Nodes (grp, level, at, node, total) of all trees: the leaves and all above; saved."""
    block = arity ** levels

    def climb(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["at"].to_pylist(), table["node"].to_pylist()))
        grp, level, total = (table[c][0].as_py() for c in ("grp", "level", "total"))
        size, at, nodes = level_sizes(total, arity), rows[0][0], [x[1] for x in rows]
        out = []
        for up in range(level + 1, min(level + levels, len(size) - 1) + 1):
            nodes, at = parents(nodes, arity), at // arity
            out += [(grp, up, at + i, h, total) for i, h in enumerate(nodes)]
        return pa.Table.from_pylist([dict(zip(NODE.names, x)) for x in out], schema=NODE)

    now = leaves.select("grp", F.lit(0).cast("long").alias("level"), "at", "node", "total")
    found, level = [now], 0
    while True:
        # trees that end below this level have no node left to climb from
        rest = now.filter(F.col("level") == level).filter(F.col("total") > float(arity ** level))
        if rest.isEmpty():
            break
        groups = rest.withColumn("block", F.floor(F.col("at") / block)).groupBy("grp", "block")
        now = saved(groups.applyInArrow(climb, "grp string, level long, at long, node string, total long"), name)
        found.append(now)
        level += levels
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


NODE = pa.schema([("grp", pa.string()), ("level", pa.int64()), ("at", pa.int64()), ("node", pa.string()), ("total", pa.int64())])


def _tops(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """(grp, node): the single node on top of each tree."""
    ends = F.expr(f"total <= power({arity}, level) and (level = 0 or total > power({arity}, level - 1))")
    return nodes.filter(ends & (F.col("at") == 0)).select("grp", "node")


def _fetched(leaves: DataFrame, nodes: DataFrame, name: str, arity: int = ARITY) -> DataFrame:
    """(grp, part, fetched): the missing nodes of each leaf partition, by one join."""
    ranges = leaves.groupBy("grp", "part").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.first("total").alias("total"))
    ranges = saved(ranges, f"{name}-ranges")

    def coordinates(batches):
        for batch in batches:
            out = []
            for grp, part, low, high, total in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "low", "high", "total"))):
                out += [(grp, part, level, at) for level, at in missing(low, high, total, arity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["grp", "part", "level", "at"])

    wanted = saved(in_arrow(ranges, coordinates, "grp string, part int, level long, at long"), f"{name}-wanted")
    n, w = nodes.alias("n"), _small(wanted).alias("w")
    same = F.col("n.grp").eqNullSafe(F.col("w.grp")) & (F.col("n.level") == F.col("w.level")) & (F.col("n.at") == F.col("w.at"))
    got = w.join(n, same).select("w.grp", "w.part", F.struct("w.level", "w.at", "n.node").alias("got"))
    # every leaf partition has a row, also one that needs nothing
    got = got.unionByName(ranges.select("grp", "part", F.lit(None).cast(got.schema["got"].dataType).alias("got")))
    return got.groupBy("grp", "part").agg(F.collect_list("got").alias("fetched"))


STEPS = "array<struct<place:int,siblings:array<string>>>"
STEPS_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def _proved(leaves: DataFrame, fetched: DataFrame, keep_proof: bool, arity: int = ARITY) -> DataFrame:
    """The leaves with proof_sha256, folded_root (of ``again``) and, if kept, proof, expanded by leaf partition.
    ``fetched`` may hold ``above``, the proof of the tree's own top."""
    extra = [c for c in fetched.columns if c not in ("grp", "part", "fetched", "above")]

    def expand(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        found = found.to_pylist()[0]
        at, total = table["at"].to_pylist(), table["total"][0].as_py()
        given = {(x["level"], x["at"]): x["node"] for x in found["fetched"]}
        levels = interior(dict(zip(at, table["node"].to_pylist())), given, total, arity)
        above = [(s["place"], s["siblings"]) for s in found.get("above") or []]
        sums, folded, proofs = [], [], []
        for i, again in zip(at, table["again"].to_pylist()):
            steps = proof(levels, i, total, arity) + above
            sums.append(digest(*[h for _, siblings in steps for h in siblings]))
            folded.append(fold(again, steps))
            proofs.append([{"place": p, "siblings": x} for p, x in steps] if keep_proof else None)
        for c in extra:
            table = table.append_column(c, pa.array([found[c]] * len(at), pa.string()))
        for c, values, kind in (("proof_sha256", sums, pa.string()), ("folded_root", folded, pa.string()), ("proof", proofs, STEPS_ARROW)):
            table = table.append_column(c, pa.array(values, kind))
        return table

    # a null group does not meet itself in a cogroup's keys, so keys are never null
    left, right = (df.select("*", F.col("grp").isNull().alias("no_grp"), F.coalesce("grp", F.lit("")).alias("key")) for df in (leaves, fetched))
    schema = with_fields(left, *[(c, "string") for c in extra], ("proof_sha256", "string"), ("folded_root", "string"), ("proof", STEPS))
    both = left.groupBy("no_grp", "key", "part").cogroup(right.groupBy("no_grp", "key", "part"))
    return both.applyInArrow(expand, schema).drop("no_grp", "key", "part", "at", "total", *([] if keep_proof else ["proof"]))


def manifest(rows: DataFrame, keep_proof: bool = False) -> DataFrame:
    """``rows``: doc_id, grp (string), node (the leaf) and again (the leaf as found later).

    Per row: doc_id, grp, leaf, subroot, root, proof_sha256, folded_root (from ``again``),
    verified, and on demand proof (places and siblings from leaf to root)."""
    rows = saved(rows.select("doc_id", F.col("grp").cast("string").alias("grp"), "node", "again"), "merkle-rows")
    leaves = _numbered(rows, ["doc_id"], "merkle-leaves")
    nodes = _build(leaves, "merkle-nodes")
    # the trees' tops are the leaves of the upper tree
    tops = saved(_tops(nodes).select(F.col("grp").alias("source"), F.lit("").alias("grp"), "node", F.col("node").alias("again")), "merkle-tops")
    upper = _numbered(tops, ["source"], "merkle-upper")
    upper_nodes = _build(upper, "merkle-upper-nodes")
    ends = _proved(upper, _fetched(upper, upper_nodes, "merkle-upper"), True)
    ends = saved(ends.select(F.col("source").alias("grp"), F.col("node").alias("subroot"), F.col("folded_root").alias("root"), F.col("proof").alias("above")), "merkle-ends")
    f, e = _fetched(leaves, nodes, "merkle-leaves").alias("f"), ends.alias("e")
    fetched = f.join(e, F.col("f.grp").eqNullSafe(F.col("e.grp"))).select("f.*", "subroot", "root", "above")
    out = _proved(leaves, fetched, keep_proof)
    return out.withColumnRenamed("node", "leaf").drop("again").withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Rows for ``manifest`` of documents; ``tampered`` is the text as found later (default: unchanged)."""
    fields = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    own = fields(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("grp"), own.alias("node"),
                       (own if tampered is None else fields(tampered)).alias("again"))


def without_newlines(docs_id: Column, text: Column) -> Column:
    """The tampering of op12: half of the rows by crc32 of the id lose their line feeds."""
    return F.when(F.crc32(docs_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
