"""Byte repeats (11), Merkle manifest (12) and periodic runs (13) against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotstats.llm import byte_repeats as br
from plotstats.llm import merkle_manifest as mm
from plotstats.llm import periodic_runs as pr

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- byte repeats --------------------------------------------------------------------------


def brute_removed(docs, length):
    """(id, bytes, kept, spans) of each row, from the earliest place of every string."""
    first = {}
    for d, t in docs:
        for p in range(len(t) - length + 1):
            first[t[p:p + length]] = min(first.get(t[p:p + length], (d, p)), (d, p))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < (d, p):
                gone[p + 1:p + length + 1] = 1
        out.append((d, t, bytes(np.frombuffer(t, np.uint8)[gone[1:-1] == 0]), int((np.diff(gone) == 1).sum())))
    return out


def repeated_texts(seed, n):
    random.seed(seed)
    parts = ["".join(random.choice("abcé \n") for _ in range(random.randint(20, 300))) for _ in range(6)]
    out = []
    for i in range(n):
        text = "".join(random.choice(parts)[random.randint(0, 40):] + "".join(random.choice("xyz") for _ in range(random.randint(0, 30))) for _ in range(random.randint(0, 5)))
        out.append((random.randint(0, n), text))
    return out


def removed(spark, docs_of, pairs, **more):
    got = br.remove_repeats(docs_of(pairs, extra=True), keep_text=True, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str)


def expected(pairs, length=100):
    rows = brute_removed([(br.NULL_ID if i is None else i, (t or "").encode()) for i, t in pairs], length)
    return sorted(((i, len(t), len(t) - len(kept), n, sha(kept), kept) for (i, _), (_, t, kept, n) in zip(pairs, rows)), key=str)


@pytest.mark.parametrize("hot", [1024, 2])
def test_byte_repeats_match_brute_force(spark, docs_of, monkeypatch, hot):
    monkeypatch.setattr(br, "HOT", hot)  # 2: nearly all strings go the way of hot anchors
    pairs = repeated_texts(hot, 60)
    assert removed(spark, docs_of, pairs) == expected(pairs)
    assert any(x[2] for x in expected(pairs))


def test_byte_repeats_without_broadcasts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(br, "BROADCAST_BYTES", -1)
    pairs = repeated_texts(5, 40)
    assert removed(spark, docs_of, pairs) == expected(pairs)


def counted_sends(spark, monkeypatch):
    """(rows, bytes of strings) that each round sends, filled in as rounds run; no batch settles repeats between texts."""
    sends, met = [], br._met

    def counted(sent, *rest):
        sends.append(tuple(x or 0 for x in sent.agg(F.count("*"), F.sum(F.octet_length("raw"))).first()))
        return met(sent, *rest)

    monkeypatch.setattr(br, "_met", counted)
    monkeypatch.setattr(br, "slices", lambda batches, column: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    return sends


@pytest.mark.parametrize("hot, times", [(16_384, 1.5), (2, 40)])
def test_bytes_sent_at_once_keep_to_the_texts(spark, docs_of, monkeypatch, hot, times):
    monkeypatch.setattr(br, "HOT", hot)
    monkeypatch.setattr(br, "ROUND_X", times)
    sends = counted_sends(spark, monkeypatch)
    random.seed(8)
    texts = ["".join(random.choice("abcdefgh ") for _ in range(1500)) for _ in range(12)]
    pairs = [(12 * copy + i, t) for copy in range(5) for i, t in enumerate(texts)]  # every stretch meets others
    assert removed(spark, docs_of, pairs) == expected(pairs)
    assert len(sends) > 1 and max(n for _, n in sends) < times * sum(len(t) for _, t in pairs)


def test_a_passage_of_many_texts_is_not_sent_window_by_window(spark, docs_of, monkeypatch):
    sends = counted_sends(spark, monkeypatch)
    random.seed(9)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = word(300)
    pairs = [(i, word(60) + passage + word(60)) for i in range(1100)]
    assert removed(spark, docs_of, pairs) == expected(pairs)
    assert sum(n for n, _ in sends) < 20 * len(pairs)


def test_shuffle_files_go_with_each_step(spark, docs_of):
    shuffles = lambda: {i for i in range(10_000) if spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().containsShuffle(i)}
    before = shuffles()
    br.repeated_spans(docs_of(repeated_texts(6, 40)))
    assert not shuffles() - before


def test_byte_repeats_of_awkward_rows(spark, docs_of, awkward):
    awkward = [*awkward, (9, "y" * 99), (10, "y" * 100), (11, "y" * 101), (11, "y" * 101)]
    assert removed(spark, docs_of, awkward) == expected(awkward)
    assert removed(spark, docs_of, []) == []


def test_long_texts_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(br, "PART", 500)
    data = np.random.default_rng(1).integers(0, 3, 5000).astype(np.uint8)
    s = br.stretches(data, np.array([0, len(data)]), 100, 20, identity=True)
    assert s["n"].sum() == len(data) - 99
    assert (np.diff(s["start"]) == s["n"][:-1]).all()


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_sort(seed):
    random.seed(seed)
    strings = ["".join(random.choice("ab") for _ in range(random.randint(0, 30))).encode() for _ in range(150)]
    strings = [(b"common prefix of more than twenty bytes" if random.random() < 0.6 else b"") + s for s in strings]
    strings = [s.ljust(70, b"\0") for s in strings]
    for order in (br.deep_shallow_order(strings, list(range(150)), random.choice([0, 8, 16])), br.blind_trie_order(strings, list(range(150)))):
        assert sorted(order) == list(range(150)) and [strings[i] for i in order] == sorted(strings)


# --- Merkle manifest -----------------------------------------------------------------------


def up(nodes, arity):
    return [sha("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]


def brute_path(nodes, i, again):
    """(top, siblings level by level, top folded from ``again``)."""
    seen = []
    while len(nodes) > 1:
        run = nodes[i - i % 3:i - i % 3 + 3]
        seen += run[:i % 3] + run[i % 3 + 1:]
        again = sha("".join([*run[:i % 3], again, *run[i % 3 + 1:]]))
        nodes, i = up(nodes, 3), i // 3
    return nodes[0], seen, again


def brute_manifest(rows):
    """rows (id, group, leaf, again) -> the same with subroot, root, proof and folded root."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[2:]))
    tops = [brute_path([r[2] for r in groups[g]], 0, "")[0] for g in order]
    out = []
    for k, g in enumerate(order):
        for i, (doc, _, leaf, again) in enumerate(groups[g]):
            top, seen, folded = brute_path([r[2] for r in groups[g]], i, again)
            root, above, folded = brute_path(tops, k, folded)
            out.append((doc, g, leaf, top, root, sha("".join(seen + above)), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(rows, spark, **more):
    df = spark.createDataFrame(rows, "doc_id long, grp string, node string, again string")
    return mm.manifest(df, **more)


@pytest.mark.parametrize("n,levels,part_rows", [(1, 7, 1 << 16), (130, 2, 10), (400, 1, 50)])
def test_manifest_matches_brute_force(spark, monkeypatch, n, levels, part_rows):
    random.seed(n)
    monkeypatch.setattr(mm, "PART_ROWS", part_rows)
    monkeypatch.setattr(mm._build, "__defaults__", (3, levels))
    rows = []
    for i in range(n):
        leaf = sha(str(random.randint(0, n)))
        rows.append((random.choice([None, i, 7]), random.choice([None, "", "a", "b", "hot", "hot", "hot", f"s{i}"]), leaf, leaf if random.random() < 0.6 else sha("other" + leaf)))
    rows += rows[:2]
    got = manifest_rows(rows, spark, keep_proof=True).collect()
    assert sorted(((r.doc_id, r.grp, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str) == brute_manifest(rows)
    for r in got:  # the proof itself verifies the leaf
        assert mm.fold(r.leaf, [(s.place, list(s.siblings)) for s in r.proof]) == r.root


def test_manifest_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(mm, "_small", lambda df, rows=0: df)
    rows = [(i, None if i % 3 else f"g{i % 2}", sha(str(i)), sha(str(i))) for i in range(40)]
    assert sorted((r.doc_id, r.root) for r in manifest_rows(rows, spark).collect()) == sorted((x[0], x[4]) for x in brute_manifest(rows))


def test_multiproof_is_the_least_union_of_nodes():
    for n in range(1, 60):
        for low in range(0, n, 3):
            for high in range(low, n, 4):
                given, need, at = set(), set(), set(range(low, high + 1))
                for level, size in enumerate(mm.level_sizes(n)[:-1]):
                    given |= {(level, i) for i in at}
                    need |= {(level, k) for i in at for k in range(i - i % 3, min(size, i - i % 3 + 3))}
                    at = {i // 3 for i in at}
                assert sorted(mm.missing(low, high, n)) == sorted(need - given)


def test_document_leaves(spark, docs_of, awkward):
    docs = docs_of([*awkward, (20, "a\nb"), (21, "a\nb"), (22, "a\nb")], extra=True)
    got = mm.document_leaves(docs, mm.without_newlines(F.col("doc_id"), F.col("text"))).collect()
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t: sha(part(i) + "1:s2:en-" + part(t))
    want = [(i, t, t.replace("\n", "") if t and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t) for i, t in [*awkward, *[(i, "a\nb") for i in (20, 21, 22)]]]
    assert sorted((r.node, r.again) for r in got) == sorted((leaf(i, t), leaf(i, other)) for i, t, other in want)
    assert mm.manifest(mm.document_leaves(docs_of([]))).count() == 0
    assert mm.manifest(mm.document_leaves(docs)).filter("verified").count() == docs.count()


# --- periodic runs -------------------------------------------------------------------------


def brute_runs(w, least=24, repeats=3):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_row(text, at=None):
    w = (text or "").encode().split()
    w = w if at is None else [w[i] for i in at]
    runs = brute_runs(w)
    best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_texts(seed, n):
    random.seed(seed)
    out = []
    for i in range(n):
        w = [random.choice("abcdefghij") for _ in range(random.randint(0, 200))]
        for _ in range(random.randint(0, 3)):
            a, p = random.randint(0, len(w)), random.randint(1, 15)
            for k in range(a + p, min(len(w), a + p * random.randint(2, 9) + random.randint(0, p))):
                w[k] = w[k - p]
        out.append((i, random.choice([" ", "\n", " \t"]).join(w)))
    return out


def test_runs_match_brute_force(spark, docs_of):
    pairs = periodic_texts(3, 300)
    got = pr.find_runs(docs_of(pairs, extra=True), keep_text=True).collect()
    row = lambda r: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
    assert {r.doc_id: row(r) for r in got} == {i: brute_row(t) for i, t in pairs}
    assert sum(r.n_runs for r in got) > 100 and all(sha(r.collapsed) == r.collapsed_sha256 for r in got)
    assert all([tuple(x) for x in r.runs] == brute_runs(dict(pairs)[r.doc_id].split()) for r in got)


def test_runs_of_planted_periods(spark, docs_of):
    pairs = periodic_texts(4, 200)
    got = pr.find_runs(docs_of(pairs), reorder=pr.planted_period).collect()
    changed = 0
    for r in got:
        text = dict(pairs)[r.doc_id]
        n, h = len(text.split()), zlib.crc32(str(r.doc_id).encode())
        g, at = h // 10, None
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at, changed = [i if i < a else a + (i - a) % p for i in range(n)], changed + 1
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == brute_row(text, at)
    assert changed > 5


def test_runs_of_awkward_rows(spark, docs_of, awkward):
    got = pr.find_runs(docs_of(awkward, extra=True)).collect()
    fields = lambda r: (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
    short = [x for x in awkward if len(x[1] or "") < 1000 or x[0] == 8]
    assert sorted(map(str, map(fields, (r for r in got if r.doc_id != 4)))) == sorted(str((i, *brute_row(t))) for i, t in short)
    long = next(r for r in got if r.doc_id == 4)
    assert (long.n_runs, long.start, long.length, long.period, long.n_words) == (1, 0, 20000, 5, 20000)
    assert long.collapsed_sha256 == sha("lorem ipsum dolor sit amet")
    assert pr.find_runs(docs_of([])).collect() == []


@pytest.mark.parametrize("least,repeats", [(24, 3), (6, 3), (9, 2), (12, 4)])
def test_runs_of_small_alphabets(least, repeats):
    random.seed(least)
    for _ in range(300):
        w = [random.randrange(random.choice([1, 2, 3])) for _ in range(random.randint(1, 120))]
        ids = np.append(np.unique(w, return_inverse=True)[1], len(w) + 5)
        assert [tuple(x) for x in pr.runs_of(ids, least, repeats).tolist()] == brute_runs(w, least, repeats)
