"""Benchmark decontamination by winnowing (operator 6).

Words are runs of 0-9, a-z and characters beyond ASCII, after folding A-Z.  A window is
``WINDOW`` consecutive words of an item; an item of fewer words is one window.

Every window of a text is fingerprinted by the least of its ``K``-word hashes (winnowing:
neighbouring windows mostly share their least hash, so a text keeps about 2 / (WINDOW - K + 2)
fingerprints a word).  Equal windows have equal fingerprints, so every shared span
of WINDOW words or more is found.  Fingerprints of documents and items are joined; the
hits, stretches of windows that share a fingerprint, are extended to the windows' words,
which must equal a window of an item.  Items shorter than WINDOW are looked up as they
are, by their length.

All of it is DataFrame functions.  Item tables are broadcast only when counted to be at most
``BROADCAST_ROWS`` rows, and are joined by shuffle beyond that.

Edge cases: a null text has no words; a text shorter than WINDOW can only hold short items;
repeated rows and rows that share an id are judged each on its own text; null ids are
kept; an item with a null id counts as an item but its id is left out of the list; empty
tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pinned, text_column
from .components import saved

WINDOW = 10
K = 5
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """The words of a text in order."""
    folded = F.translate(text, _UPPER, _LOWER)
    return F.filter(F.split(folded, _GAPS), lambda w: w != "")


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows, or the sum of ``size`` over them, allow it."""
    total = df.agg(F.count("*") if size is None else F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_ROWS else df


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows with ``words`` become one row per stretch of windows that share a fingerprint:
    first (window number, from 1), last, fp; the other columns stay."""
    n = F.size("words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: F.xxhash64(F.slice("words", i, K))))
    least = F.transform(F.sequence(F.lit(1), F.size("grams") - (WINDOW - K)), lambda i: F.array_min(F.slice("grams", i, WINDOW - K + 1)))
    heads = F.filter(F.sequence(F.lit(1), F.size("least")), lambda i: (i == 1) | (F.element_at("least", i) != F.element_at("least", F.greatest(i - 1, F.lit(1)))))
    keep = [c for c in docs.columns if c != "words"]
    rows = pinned(docs, "grams", grams).drop("words")
    rows = pinned(rows, "least", F.when(F.col("grams").isNotNull(), least)).drop("grams")
    rows = pinned(rows, "heads", F.when(F.col("least").isNotNull(), heads))
    rows = rows.select(*keep, "least", "heads", F.posexplode("heads").alias("at", "first"))
    last = F.coalesce(F.get("heads", F.col("at") + 1) - 1, F.size("least"))
    return rows.select(*keep, "first", last.alias("last"), F.element_at("least", F.col("first")).alias("fp"))


def contaminated_words(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Hit windows: doc_id, text_hash, first, length (in words), window."""
    return _hits(*_prepared(docs, items, id_column, text_col, item_id, item_text)[:2])


def _spans(length: int) -> Column:
    """All runs of ``length`` words, as text."""
    return F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.array_join(F.slice("words", i, length), " "))


def _prepared(docs, items, id_column, text_col, item_id, item_text):
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    parts = pinned(items.select(F.col(item_id).alias("item_id"), text_column(items, item_text).alias("item_text")), "words", word_list(F.col("item_text")))
    n = F.size("words")
    windows = parts.select("item_id", F.least(n, F.lit(WINDOW)).alias("length"), F.explode(F.when(n >= WINDOW, _spans(WINDOW)).otherwise(F.array(F.array_join("words", " ")))).alias("window"))
    return rows, saved(windows.filter("length > 0").distinct(), "decontamination-windows")


def _hits(rows: DataFrame, windows: DataFrame) -> DataFrame:
    distinct = windows.select("length", "window").distinct()
    # fingerprints of the items' full windows, and the lengths of the short ones
    full = pinned(distinct.filter(F.col("length") == WINDOW).select("window"), "words", F.split("window", " ")).select("words")
    targets = _small(fingerprints(full).select("fp").distinct())
    lengths = sorted(r.length for r in distinct.filter(F.col("length") < WINDOW).select("length").distinct().collect())  # nine at most

    worded = pinned(rows, "words", word_list(F.col("text"))).select("doc_id", "text_hash", "words")
    stretches = fingerprints(worded).join(targets, "fp", "left_semi").select("doc_id", "text_hash", F.lit(WINDOW).alias("length"), "first", "last")
    for length in lengths:
        short = _small(distinct.filter(F.col("length") == length).select("window"))
        n = F.size("words")
        spans = F.when(n >= length, _spans(length))
        found = worded.select("doc_id", "text_hash", F.posexplode(spans).alias("at", "window")).join(short, "window", "left_semi")
        stretches = stretches.unionByName(found.select("doc_id", "text_hash", F.lit(length).alias("length"), (F.col("at") + 1).alias("first"), (F.col("at") + 1).alias("last")))
    # the hits of a document, then its words once more to extend them
    hits = saved(stretches.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("length", "first", "last")).alias("hits")), "decontamination-hits")
    hits = _small(hits, F.size("hits"))
    r, h = rows.alias("r"), hits.alias("h")
    texts = r.join(h, F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.text_hash") == F.col("h.text_hash")))
    texts = texts.select("r.doc_id", "r.text_hash", "text", "hits").dropDuplicates(["doc_id", "text_hash"])
    spans = pinned(texts, "words", word_list(F.col("text"))).select("doc_id", "text_hash", "words", F.explode("hits").alias("hit"))
    spans = spans.select("doc_id", "text_hash", "words", F.col("hit.length").alias("length"), F.explode(F.sequence("hit.first", "hit.last")).alias("first"))
    spans = spans.select("doc_id", "text_hash", "length", "first", F.array_join(F.slice("words", F.col("first"), F.col("length")), " ").alias("window"))
    return spans.join(_small(distinct), ["length", "window"], "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items (sorted ids as
    text), contaminated."""
    rows, windows = _prepared(docs, items, id_column, text_col, item_id, item_text)
    hits = saved(_hits(rows, windows), "decontamination-spans")
    key = ["doc_id", "text_hash"]
    # words covered by the windows, each counted once
    before = Window.partitionBy(*key).orderBy("first", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("first") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest("first", F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = hits.select(*key, new.alias("new")).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    pairs = hits.select(*key, "length", "window").distinct().join(_small(windows), ["length", "window"]).select(*key, "item_id").distinct()
    found = pairs.groupBy(*key).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    found = covered.join(found, [covered[c].eqNullSafe(found[c]) for c in key]).select(*(covered[c] for c in key), "n_hit", "n_items", "items")
    base = rows.select("doc_id", "text_hash", F.size(word_list(F.col("text"))).cast("long").alias("n_words")).alias("b")
    f = found.alias("f")
    joined = base.join(f, F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_hash") == F.col("f.text_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("b.doc_id", "b.text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
