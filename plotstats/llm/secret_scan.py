"""Secret scanning with multipart credential linking (operator 7).

Base spans, leftmost and non-overlapping for each kind: ``assign`` (a secret's name, a
separator, a value of 8 characters or more), ``access`` (access identifiers of 16 or
more) and ``hex`` (32 or more hexadecimal digits).  They are always reported.

Weak parts say little alone: an ``identity`` (a user, client or account name that is
assigned), a ``secret`` (a long mixed token or a short assigned password) and an ``endpoint``
(an address with a scheme, or an assigned host or bucket).  Each part opens a scope of
``REACH`` code points before its start and after its end, and parts are joined by interval
inside their document: a weak identity is reported when a secret lies in its scope, a
weak secret when an identity does, a weak endpoint when both do.  Base spans count
as parts (access: identity; assign and hex: secret), and a weak part that overlaps a
base span is left out.  The interval join is a running window over sorted starts (the last end behind, the
first start ahead), so no pairs arise.

All of it is DataFrame functions.  A pattern's matches are wrapped in a mark, the text is split at the
marks, and running lengths give the offsets, in code points, end exclusive; all of it is near linear in the
number of matches.  The mark
is a private-use character; in the text itself it is first replaced by another one, which
no pattern matches either.

Edge cases: a null text is empty; empty texts have no spans; repeated rows get the
same result each; rows that share an id are judged each on its own text; null ids are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pinned, text_column

REACH = 200
CHUNK = 512  # pieces of a text whose lengths are summed up at a time
MARK, OTHER = "\ue000", "\ue001"
#: Kinds in order of report, with their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
IDENTITY = r"""((?i:user|username|login|client_?id|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
SECRET = r"""[A-Za-z0-9+/]{20,}=*|((?i:pwd|pass|auth))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._:@-]+|((?i:host|endpoint|server|bucket))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._:-]{3,})"""
KINDS = ("assign", "access", "hex", "identity", "secret", "endpoint")
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _running(values: Column) -> Column:
    """Sums of an array's values up to and with each place, from sums of CHUNK values and of their sums:
    appending within a chunk only keeps the work near the array's length."""
    def upto(array: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all"))
        add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all"))
        return F.aggregate(array, first, add, lambda acc: acc["all"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, CHUNK))
    inner = F.transform(chunks, lambda c: upto(c, F.lit(0)))
    outer = upto(F.transform(inner, lambda c: F.element_at(c, -1)), F.lit(0))
    before = F.slice(F.concat(F.array(F.lit(0)), outer), 1, F.size(inner))
    return F.flatten(F.zip_with(inner, before, lambda c, n: F.transform(c, lambda x: x + n)))


def with_matches(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``rows`` (text, without MARK) with spans: those of the kinds' matches that hold, by start and kind."""
    columns, found = rows.columns, []
    for kind in kinds:
        pattern, keep = RULES[kind]
        # a text is split at the marks once; every second piece is a match
        pieces = F.when(F.col("text").rlike(pattern), F.split(F.regexp_replace("text", F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK))
        rows = pinned(rows, "pieces", pieces)
        rows = pinned(rows, "sizes", F.transform("pieces", F.char_length))
        rows = pinned(rows, "ends", _running(F.col("sizes")))
        span = lambda piece, end: F.struct((end - F.char_length(piece)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))  # noqa: E731,B023
        every = F.zip_with("pieces", "ends", lambda piece, end: F.when(keep(piece), span(piece, end)))  # noqa: B023
        hits = F.filter(every, lambda x, i: (i % 2 == 1) & x.isNotNull())
        rows = pinned(rows, f"{kind} spans", F.coalesce(hits.cast(_SPAN), F.array().cast(_SPAN))).drop("pieces", "sizes", "ends")
        found.append(F.col(f"{kind} spans"))
    return rows.select(*columns, F.sort_array(F.concat(*found)).alias("spans"))


_MIXED = lambda m: m.rlike("[=:]") | (m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))
_ANY = lambda m: F.lit(True)
RULES = {
    "assign": (ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    "access": (ACCESS, lambda m: F.char_length(m) >= 16),
    "hex": (HEX, _ANY),
    "identity": (IDENTITY, _ANY),
    "secret": (SECRET, _MIXED),
    "endpoint": (ENDPOINT, _ANY),
}


def _rows(docs: DataFrame, id_column: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("raw"))
    return rows.select("doc_id", F.xxhash64("raw").alias("text_hash"), F.translate("raw", MARK, OTHER).alias("text"))


def linked_parts(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Weak parts whose complements lie in scope: doc_id, text_hash and the span."""
    # every link needs an identity, so other texts have none
    rows = _rows(docs, id_column, text_col).filter(F.col("text").rlike(f"{ACCESS}|{IDENTITY}"))
    spans = with_matches(rows, KINDS)
    parts = spans.select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.*").distinct()
    ordered = Window.partitionBy("doc_id", "text_hash").orderBy("start", "rank")
    past, ahead = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(0, Window.unboundedFollowing)
    strong = F.col("rank") < 3

    def near(*kinds: str) -> Column:
        """Whether one of the kinds lies in scope: of those that start no later the one that ends last, of the others the first."""
        mine = F.col("kind").isin(*kinds)
        behind, next_ = F.max(F.when(mine, F.col("end"))).over(past), F.min(F.when(mine, F.col("start"))).over(ahead)
        return F.coalesce(behind >= F.col("start") - REACH, F.lit(False)) | F.coalesce(next_ <= F.col("end") + REACH, F.lit(False))

    parts = parts.withColumns({
        "has_identity": near("access", "identity"), "has_secret": near("assign", "hex", "secret"),
        "taken_to": F.max(F.when(strong, F.col("end"))).over(past), "taken_from": F.min(F.when(strong, F.col("start"))).over(ahead)})
    free = ~(F.coalesce(F.col("taken_to") > F.col("start"), F.lit(False)) | F.coalesce(F.col("taken_from") < F.col("end"), F.lit(False)))
    wanted = F.when(F.col("kind") == "identity", F.col("has_secret")).when(F.col("kind") == "secret", F.col("has_identity")).otherwise(F.col("has_identity") & F.col("has_secret"))
    return parts.filter(~strong & free & wanted).select("doc_id", "text_hash", "start", "rank", "end", "kind")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, base (array of spans), linked (array of spans)."""
    base = with_matches(_rows(docs, id_column, text_col), KINDS[:3]).select("doc_id", "text_hash", F.col("spans").alias("base")).alias("b")
    linked = linked_parts(docs, id_column, text_col).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "rank", "end", "kind")).alias("linked")).alias("k")
    joined = base.join(linked, F.col("b.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("b.text_hash") == F.col("k.text_hash")), "left")
    return joined.select("b.doc_id", "b.text_hash", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.sort_array(F.concat("base", "linked"))).alias("spans"))
