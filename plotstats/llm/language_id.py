"""Language identification by fusing evidence (operator 2).

For each page the posterior over languages is the product of
- a text likelihood: hashed byte trigrams (A-Z folded) against profiles counted over all
  documents with a declared language, to the power ``TEMPER`` as trigrams overlap;
- the declared markup language (``<html lang=...>``), right with a probability that is
  estimated from all pages, wrong ones being equally likely;
- the address suffix, where it belongs to one language (``SUFFIXES``);
- a host prior: expected language counts of the host's other pages (by text alone), smoothed by
  those of its domain, then of its suffix, then of all pages, ``STRENGTH`` pseudo-counts at each
  level.  The counts are grouped sums; a level is built from the one below, so a host with a
  third of all pages is one row for each task.

Profiles are languages x TRIGRAMS numbers with ``MAX_LANGUAGES`` languages at most (else an
error), and are broadcast as such.

Edge cases: null or empty html has no text evidence; a null, empty or unreadable url has no host
and takes the prior of all pages; unknown declared languages count as none; documents with a
null language or text give no profile; without any profile lang and prob are null; equal
posteriors go to the first language by name; repeated rows are judged each (and counted
each); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, slices, text_bytes, text_column
from .components import saved

TRIGRAMS = 1 << 13
TEMPER = 0.25
STRENGTH = 5.0
SUFFIX_TRUST = 0.8
MAX_LANGUAGES = 256
#: Country suffixes of mostly one language.
SUFFIXES = {"at": "de", "au": "en", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "jp": "ja",
            "mx": "es", "nl": "nl", "nz": "en", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en"}
TAGS = r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>"


def trigram_ids(data: np.ndarray) -> np.ndarray:
    """A row of the profiles for the trigram at each place but the last two."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Marks trigrams that do not cross a row's end."""
    ok = np.ones(max(n - 2, 0), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def profiles(docs: DataFrame, text_col: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram row) over all documents."""
    rows = docs.select(F.lower(F.trim(F.col(lang_column).cast("string"))).alias("lang"), text_column(docs, text_col).alias("text")).filter("lang <> ''")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            if len(data) < 3:
                continue
            ids, ok = trigram_ids(data), _inside(offsets, len(data))
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), np.diff(offsets))[:-2] & ok
                total[lang] = total.get(lang, 0) + np.bincount(ids[mine], minlength=TRIGRAMS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "trigram", "n"])

    counts = saved(in_arrow(rows, run, "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n")), "language-profiles")
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(langs), TRIGRAMS), 0.5)
    got = counts.toPandas()  # languages x TRIGRAMS rows at most
    table[[langs.index(x) for x in got["lang"]], got["trigram"].to_numpy(np.int64)] += got["n"].to_numpy(float)
    return langs, np.log(table / table.sum(1, keepdims=True))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def text_evidence(pages: DataFrame, langs: list[str], log_p: np.ndarray, html_column: str, url_column: str, id_column: str) -> DataFrame:
    """page_id, host, domain, suffix, markup, ll (array by language), p0, p1 ... (posterior by text alone)."""
    host = F.lower(F.expr(f"try_parse_url(cast(`{url_column}` as string), 'HOST')"))
    html = text_column(pages, html_column)
    markup = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1))
    rows = pages.select(F.col(id_column).alias("page_id"), F.nullif(host, F.lit("")).alias("host"), F.nullif(markup, F.lit("")).alias("markup"), F.regexp_replace(html, TAGS, " ").alias("text"))
    parts = F.split("host", r"\.")
    rows = rows.withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(parts, -1))
    keep = ["page_id", "host", "domain", "suffix", "markup"]

    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ll = np.zeros((batch.num_rows, len(langs)))
            if len(data) >= 3:
                ids, ok = trigram_ids(data), _inside(offsets, len(data))
                for i in range(len(langs)):
                    run_ = np.concatenate(([0.0], np.cumsum(np.where(ok, log_p[i][ids], 0.0)), [0.0, 0.0]))
                    run_[-2:] = run_[-3]
                    ll[:, i] = run_[offsets[1:]] - run_[offsets[:-1]]
            p = _softmax(TEMPER * ll)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(list(ll), pa.list_(pa.float64())), *(pa.array(p[:, i]) for i in range(len(langs)))],
                                             names=[*keep, "ll", *(f"p{i}" for i in range(len(langs)))])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "ll array<double>", *(f"p{i} double" for i in range(len(langs)))])
    return in_arrow(rows.select(*keep, "text"), run, schema)


def identify(pages: DataFrame, docs: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
             text_col: str = "text", lang_column: str = "lang") -> DataFrame:
    """Per page: page_id, host, markup, text_lang, lang, prob."""
    langs, log_p = profiles(docs, text_col, lang_column)
    out = "page_id {}, host string, markup string, text_lang string, lang string, prob double".format(pages.schema[id_column].dataType.simpleString())
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(F.col(id_column).alias("page_id"), none.alias("host"), none.alias("markup"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("prob"))
    n = len(langs)
    evidence = saved(text_evidence(pages, langs, log_p, html_column, url_column, id_column), "language-evidence")

    # expected counts, each level from the one below
    added = lambda df, *keys: df.groupBy(*keys).agg(*(F.sum(f"p{i}").alias(f"p{i}") for i in range(n)))
    hosts = added(evidence.filter("host is not null"), "suffix", "domain", "host")
    domains = added(hosts, "suffix", "domain")
    suffixes = added(domains, "suffix")
    whole = evidence.agg(*(F.coalesce(F.sum(f"p{i}"), F.lit(0.0)).alias(f"p{i}") for i in range(n)),
                         F.sum(F.coalesce(*(F.when(F.col("markup") == x, F.col(f"p{i}")) for i, x in enumerate(langs)))).alias("right"),
                         F.count(F.when(F.col("markup").isin(langs), 1)).alias("declared")).first()
    everywhere = np.array([whole[f"p{i}"] for i in range(n)]) + 1.0
    everywhere /= everywhere.sum()
    trust = min(0.99, max(1 / n, ((whole["right"] or 0.0) + 1) / (whole["declared"] + 2)))

    def smoothed(df, counts, above):
        total = sum(F.col(c) for c in counts)
        return df.withColumns({f"s{i}": (F.col(c) + STRENGTH * above(i)) / (total + STRENGTH) for i, c in enumerate(counts)})

    own = [f"p{i}" for i in range(n)]
    share = [f"s{i}" for i in range(n)]
    upper = [F.col(f"s{i}").alias(f"u{i}") for i in range(n)]
    suffixes = smoothed(suffixes, own, lambda i: F.lit(float(everywhere[i]))).select("suffix", *upper)
    domains = smoothed(domains.join(suffixes, "suffix"), own, lambda i: F.col(f"u{i}")).select("suffix", "domain", *share).select("suffix", "domain", *upper)
    hosts = hosts.join(domains, ["suffix", "domain"]).select("host", F.array(*own).alias("counts"), F.array(*(f"u{i}" for i in range(n))).alias("above"))

    rows = evidence.select("page_id", "host", "suffix", "markup", "ll", F.array(*own).alias("p")).join(hosts, "host", "left")

    def fuse(batches):
        for batch in batches:
            ll = np.array(batch.column("ll").to_pylist()).reshape(-1, n)
            p = np.array(batch.column("p").to_pylist()).reshape(-1, n)
            score = TEMPER * ll
            for r, (counts, above, markup, suffix) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("counts", "above", "markup", "suffix")))):
                if counts is None:
                    prior = everywhere
                else:
                    rest = np.maximum(np.array(counts) - p[r], 0)  # the host's other pages
                    prior = (rest + STRENGTH * np.array(above)) / (rest.sum() + STRENGTH)
                score[r] += np.log(np.maximum(prior, 1e-12))
                for said, sure in ((markup, trust), (SUFFIXES.get(suffix), SUFFIX_TRUST)):
                    if said in langs and n > 1:
                        score[r] += np.log(np.where(np.arange(n) == langs.index(said), sure, (1 - sure) / (n - 1)))
            post = _softmax(score) if len(score) else score
            best, by_text = post.argmax(1), ll.argmax(1)
            text_lang = [langs[b] if x.any() else None for b, x in zip(by_text, ll)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("markup"), pa.array(text_lang, pa.string()),
                                              pa.array([langs[b] for b in best], pa.string()), pa.array(post[np.arange(len(best)), best], pa.float64())], names=["page_id", "host", "markup", "text_lang", "lang", "prob"])

    return in_arrow(rows, fuse, out)
