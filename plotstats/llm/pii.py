"""Personal data by candidate gradient boosting (operator 5).

Base spans (strict forms of email, ip, card and phone, leftmost and non-overlapping for each kind)
are always reported.  Beyond them high-recall generators propose overlapping
candidates: addresses written apart or with a bracketed "at", card numbers with loose
separators, phone numbers without a country code, colon-separated addresses.  Boosted trees score
each candidate by its format and its context, and a threshold for each kind, calibrated
on rows not used for fitting, selects; of overlapping candidates the likelier stays, and
none overlaps a base span.

Training needs no labels by hand.  On a bounded sample (for each kind ``SAMPLE_DOCS`` documents
with a base span of it, and as many with a digit or an at sign; of either label
``TRAIN_ROWS`` by twice the number of kinds for each kind) base spans, rewritten in
the generators' looser forms (an address of four numbers as one of hexadecimal groups), are
positive.  Rewritten numbers that fail the checks and candidates that are known to be something else
(``ordinary``: failed checks, dates, years, versions, times, hardware addresses, names
joined by "::", ends of sentences) are negative.  Any other candidate may well be personal
data written loosely, so it has no label.  Without five positives among the rows held back
(a quarter) nothing is added of a kind.

Offsets are code points, end exclusive.  Edge cases: null and empty texts have no
spans; repeated rows get the same result each; null ids are kept; an empty table gives
no rows; other columns stay as they are (``find_pii``: one named pii_base or pii_added gives way to the result).
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import BoostedTrees
from .common import in_arrow, slices, text_column, with_fields
from .components import dropped, saved

SAMPLE_DOCS = 4000
TRAIN_ROWS = 40_000
PRECISION = 0.98
#: Kinds in order of report, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A zone holds every base match of the numeric kinds whole.
ZONE = re.compile(r"[0-9+][0-9 .()+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Generators of loose forms.
LOOSE_MARK = re.compile(r"@|[(\[{][Aa][Tt][)\]}]")
LOOSE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]++)+", re.I)
LOOSE_IP = re.compile(r"(?<![0-9A-Za-z])(?<![0-9A-Fa-f:]:)(?:[0-9A-Fa-f]{1,4})?(?:::?[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?!:?[0-9A-Za-z])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ ./-]{0,2}[0-9]{2,4}(?:[ ./-]{1,2}[0-9]{2,5}){1,3}(?![0-9])")
LOOSE_ZONE = re.compile(r"[0-9(][0-9 ./()-]{6,}")
#: Known forms of something else, and what such forms lack: a name of a domain, an issuer of short card numbers.
TOP_LEVEL = re.compile(r"[A-Za-z][A-Za-z0-9-]+\Z")
SENTENCE = re.compile(r"[A-Za-z0-9]\. ")
ISSUER = re.compile(r"4[0-9]{12}|3[068][0-9]{12}|3[47][0-9]{13}")
DATE = re.compile(r"(?:1[5-9]|20)[0-9]{2}([ ./-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])(?![0-9])|(?:0?[1-9]|[12][0-9]|3[01])([ ./-])(?:0?[1-9]|[12][0-9]|3[01])\2(?:1[5-9]|20)[0-9]{2}(?![0-9])")
#: A version of four numbers, or a list of decimal fractions.
NUMBERS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]+\.[0-9]+(?: [0-9]+\.[0-9]+)+")
CONTEXT = (re.compile(r"mail|contact|write", re.I), re.compile(r"host|addr|server|\bip\b", re.I), re.compile(r"card|visa|pay|credit", re.I),
           re.compile(r"tel|phone|call|fax|mobil", re.I), re.compile(r"order|invoice|\bid\b|version|page|[#$%&|=_]", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def ipv6(span: str) -> bool:
    """Whether groups of hexadecimal digits form an address of version 6."""
    head, gap, tail = span.partition("::")
    groups = [g for part in (head, tail) if part for g in part.split(":")]
    return all(0 < len(g) < 5 for g in groups) and (0 < len(groups) < 8 if gap else len(groups) == 8)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind and start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    ips, cards, phones = [], [], []
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                ips.append((1, *m.span()))
        if b - a >= 9:
            for m in CARD.finditer(text, a, b):
                if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    cards.append((2, *m.span()))
            for m in PHONE.finditer(text, a, b):
                if 8 <= len(_digits(m[0])) <= 15:
                    phones.append((3, *m.span()))
    return out + ips + cards + phones


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) proposed by the generators; they may overlap."""
    out = []
    if "@" in text or "at)" in text or "at]" in text or "at}" in text:
        # outward from each mark, to the marks beside it at most, so a text is walked through about twice
        for mark in LOOSE_MARK.finditer(text):
            end = mark.start() - (text[mark.start() - 1:mark.start()] == " ")
            start = end
            while start > 0 and text[start - 1] in LOCAL:
                start -= 1
            if start < end and (m := LOOSE_DOMAIN.match(text, mark.end())):
                out.append((0, start, m.end()))
    if "::" in text or re.search(r":[0-9A-Fa-f]{1,4}:", text):
        out += [(1, *m.span()) for m in LOOSE_IP.finditer(text) if m[0].count(":") > 1]
    for zone in LOOSE_ZONE.finditer(text):
        for kind, pattern in ((2, LOOSE_CARD), (3, LOOSE_PHONE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text, *zone.span())]
    return sorted(set(out))


def features(text: str, kind: int, start: int, end: int, before: str | None = None) -> list[float]:
    """Format and context of a span."""
    span = text[start:end]
    before = text[max(0, start - 30):start] if before is None else before
    groups = [len(x) for x in re.findall(r"[0-9]+", span)] or [0]
    digits = sum(groups)
    return [kind, len(span), digits, len(groups), min(groups), max(groups), groups[0], groups[-1], span.count(" "), span.count("."), span.count("-") + span.count("/"), span.count("("), span.count(":"),
            sum(c.isalpha() for c in span), float("@" in span), float(bool(re.search(r"[(\[{](at|dot)[)\]}]", span, re.I))), len(re.split(r"[ .)\]}]+", span)[-1]), float(kind == 2 and luhn(_digits(span)) or kind == 1 and ipv6(span)),
            float(before[-1:].isalnum()), float(text[end:end + 1].isalnum()), *(float(bool(c.search(before))) for c in CONTEXT)]


def ordinary(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a candidate fails the check of its kind or has a known form of something else."""
    span = text[start:end]
    digits = _digits(span)
    if kind == 0:
        return not TOP_LEVEL.search(span) or bool(SENTENCE.search(span))
    if kind == 1:
        return not ipv6(span) or not digits
    if kind == 2:
        return not luhn(digits) or len(set(digits)) == 1 or (len(digits) < 16 and not ISSUER.fullmatch(digits))
    groups = re.findall(r"[0-9]+", span)
    return (len(digits) < 7 or all(len(g) == 4 and 1500 <= int(g) < 2100 for g in groups) or bool(DATE.match(span)) or bool(NUMBERS.fullmatch(span))
            or text[start - 1:start] in tuple("$€£#") or text[end:end + 1] in tuple("$€£%"))


def training_rows(text: str) -> list[tuple[list[float], int]]:
    """Features and label of a text's candidates, base spans rewritten in loose forms."""
    base, rows = base_spans(text), []
    taken = [(a, b) for _, a, b in base]
    for kind, start, end in base:
        span, before = text[start:end], text[max(0, start - 30):start]
        if kind == 0:
            local, _, domain = span.partition("@")
            loose = [f"{local} @ {domain}", f"{local}[at]{domain}", f"{local} (at) {domain.replace('.', ' (dot) ')}"]
            first = domain.split(".")[0]
            wrong = [f"{local} @ {first} . ", f"{local} @ {first}. The", f"{local} @ 5.30"]
        elif kind == 2:
            d = _digits(span)
            loose = [d, ".".join(d[i:i + 4] for i in range(0, len(d), 4)), "  ".join(d[i:i + 4] for i in range(0, len(d), 4))]
            bad = d[:-1] + str((int(d[-1]) + 5) % 10)
            wrong = [bad, ".".join(bad[i:i + 4] for i in range(0, len(bad), 4))]
        elif kind == 3:
            d = _digits(span)[-10:]
            local = span.split(" ", 1)[-1].lstrip("+") if " " in span else f"{d[:-7]} {d[-7:-4]} {d[-4:]}"
            loose = [local, f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}"]
            year, month, day = 1950 + int(d[-2:]) % 80, 1 + int(d[-3]) % 12, 1 + int(d[-5:-3]) % 28
            wrong = [f"{d[:2]} {d[2:4]} {d[4:6]}", f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:2]}.{d[2:4]}.{d[4:8]}", f"{year}-{month:02}-{day:02}", f"{day:02}/{month:02}/{year}", f"{year} {year + 1} {year + 2}"]
        else:
            a, b, c, d = (int(x.lstrip("0") or 0) for x in span.split("."))
            g = [f"{x:x}" for x in (0x2001, a << 8 | b, c << 8 | d, a << 8 | c, b << 8 | d, a, b, d + 1)]
            loose = [":".join(g), ":".join(x.zfill(4) for x in g), f"{g[0]}:{g[1]}::{g[2]}:{g[7]}", f"{g[0]}:{g[1]}::{g[7]}", f"fe80::{g[3]}:{g[4]}:{g[2]}:{g[1]}", f"fe80::{g[7]}"]
            names = ["".join("abcdef"[x % 6] for x in y) for y in ((a, b), (c, d, a))]
            wrong = [f"{a % 24:02}:{b % 60:02}:{c % 60:02}", f"{a % 24:02}:{b % 60:02}:{c % 60:02}:{d % 60:02}", ":".join(f"{x:02x}" for x in (a, b, c, d, b, a)), ":".join(g[:5]), f"{g[0]}::{g[1]}::{g[7]}", "::".join(names)]
        rows += [(features(x, kind, 0, len(x), before), 1) for x in loose] + [(features(x, kind, 0, len(x), before), 0) for x in wrong]
    rows += [(features(text, *c), 0) for c in candidates(text) if not any(a < c[2] and c[1] < b for a, b in taken) and ordinary(text, *c)]
    return rows


def select(text: str, base: list[tuple[int, int, int]], model: dict | None) -> list[tuple[int, int, int, float]]:
    """Candidates that the model adds: (kind, start, end, probability)."""
    found = candidates(text) if model else []
    if not found:
        return []
    p = model["trees"].probability(np.array([features(text, *c) for c in found]))
    out, taken = [], sorted((a, b) for _, a, b in base)
    chosen = sorted((-q, c) for q, c in zip(p, found) if q >= model["thresholds"][c[0]])
    for q, (kind, a, b) in chosen:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b, float(-q)))
    return sorted(out)


def fit(rows: list[tuple[list[float], int]]) -> dict | None:
    """Trees and the thresholds of the kinds, from features and labels."""
    x, y = np.array([r for r, _ in rows], float), np.array([v for _, v in rows], float)
    held = np.arange(len(y)) % 4 == 3
    if len(y) < 40 or not 0 < y[~held].sum() < (~held).sum() or not 0 < y[held].sum() < held.sum():
        return None
    trees = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, thresholds = trees.probability(x[held]), []
    for kind in range(len(KINDS)):
        mine = x[held][:, 0] == kind
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[held][mine][order])
        good = np.flatnonzero(right >= PRECISION * np.arange(1, len(order) + 1)) if len(order) else []
        enough = len(good) and right[good[-1]] >= 5
        thresholds.append(max(0.5, float(p[mine][order][good[-1]])) if enough else 2.0)
    return {"trees": trees, "thresholds": thresholds}


def train(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, train_rows: int = TRAIN_ROWS) -> dict | None:
    """A model from bounded samples of rows (doc_id, text), one for each kind, so that a kind
    which is rare by share is learned from as many documents as a common one."""
    space = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(space))
    rows = rows.filter(F.col("text").rlike("[0-9@]")).select("text", place.alias("place"))

    def count(batches):
        n = np.zeros(len(KINDS) + 1, np.int64)
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                n[[*{k for k, _, _ in base_spans(text)}, -1]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in n.tolist()], names=[f"n{i}" for i in range(len(n))])

    names = [f"n{i}" for i in range(len(KINDS) + 1)]
    counts = in_arrow(rows, count, ", ".join(f"{c} long" for c in names)).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()
    # a document is in the sample of a kind (or in the general one) if its place lies before the cut
    cuts = [int(min(1, sample_docs / max(n, 1)) * space) if n else 0 for n in counts]
    if not any(cuts[:-1]):
        return None

    def run(batches):
        for batch in slices(batches, "text"):
            got = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist()):
                kinds = {k for k, _, _ in base_spans(text)}
                # candidates of kinds without a base span here come with the general sample
                wanted = {k for k in range(len(KINDS)) if at < (cuts[k] if k in kinds else cuts[-1])}
                got += [(int(x[0]), at, x, y) for x, y in training_rows(text) if x[0] in wanted] if wanted else []
            kind, at, x, y = zip(*got) if got else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["kind", "place", "x", "y"])

    sampled = saved(in_arrow(rows.filter(F.col("place") < max(cuts)), run, "kind int, place long, x array<double>, y int"), "pii-rows")
    got, bound = [], max(1, train_rows // (2 * len(KINDS)))
    for kind in range(len(KINDS)):
        for y in (0, 1):
            some = sampled.filter((F.col("kind") == kind) & (F.col("y") == y))
            got += some.orderBy(F.xxhash64("place", "x")).limit(bound).select("x", "y").collect()
    dropped(sampled)
    return fit(sorted((list(r.x), r.y) for r in got)) if got else None


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with base and added (arrays of kind, start, end, score; by kind, start).

    Rows keep all their columns.  Without a model one is trained on a sample of ``docs``."""
    if model is None:
        model = train(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in slices(batches, text_col):
            base, added = [], []
            for text in batch.column(text_col).to_pylist():
                spans = base_spans(text or "")
                base.append([{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for k, a, b in spans])
                added.append([{"kind": KINDS[k], "start": a, "end": b, "score": p} for k, a, b, p in select(text or "", spans, model)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(added, kind)], names=[*batch.schema.names, "pii_base", "pii_added"])

    rest = docs.drop("pii_base", "pii_added")
    return in_arrow(rest, run, with_fields(rest, ("pii_base", SPANS), ("pii_added", SPANS)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    both = F.transform(F.concat("pii_base", "pii_added"), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(id_column).alias("doc_id"), *map(count, KINDS), F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.sort_array(both)).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind's name."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join((*out, text[at:]))


def redacted(docs: DataFrame, id_column: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all personal data replaced in the text; a null text stays null, and all other
    columns stay as they are, whatever their names."""
    model = train(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text")))

    def run(batches):
        for batch in slices(batches, text_col):
            texts = []
            for t in batch.column(text_col).to_pylist():
                base = base_spans(t or "")
                spans = base + [x[:3] for x in select(t or "", base, model)]
                texts.append(t if t is None else redact(t, [(KINDS[k], a, b) for k, a, b in spans]))
            kept = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names)

    return in_arrow(docs, run, docs.schema)
