"""N-gram join (8), decontamination (6) and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plotstats.llm import components, decontamination
from plotstats.llm import ngram_join as nj
from plotstats.llm.common import LETTERED  # noqa: F401  (the module imports on its own)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_classes(pairs, k, num, den):
    """Row -> (set size, least id of its class)."""
    sets = []
    for _, text in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(pairs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(parent, i)] = find(parent, j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(pairs):
        ids[find(parent, i)].append(doc_id)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(doc_id, len(sets[i]), least[find(parent, i)]) for i, (doc_id, _) in enumerate(pairs)]


def near_copies(seed, n):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(random.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        if out and random.random() < 0.6:
            w = random.choice(out)[1].split(" ")
            for _ in range(random.randint(0, max(1, len(w) // 25))):
                w[random.randrange(len(w))] = random.choice(words)
            text = " ".join(w)
        else:
            text = " ".join(random.choice(words) for _ in range(random.choice([1, 2, 4, 10, 30, 120, 300])))
            text = f"{text} {shared}" if random.random() < 0.3 else text
        out.append((i, text.upper() if random.random() < 0.1 else text))
    return out


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(3, 9, 10, 1), (5, 4, 5, 2), (1, 1, 2, 3)])
def test_classes_equal_brute_force(docs_of, k, num, den, seed):
    pairs = near_copies(seed, 220)
    got = nj.jaccard_classes(docs_of(pairs, extra=True), k, num, den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(pairs, k, num, den))
    # exactly one row represents each class
    assert len({r.component_id for r in got}) == sum(r.v == r.component_v for r in got)


def test_paged_cells_lose_no_link(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "PAGE", 4)
    pairs = near_copies(5, 150)
    got = nj.jaccard_classes(docs_of(pairs), 3, 9, 10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(pairs, 3, 9, 10))


def test_classes_of_awkward_rows(docs_of, awkward):
    got = nj.jaccard_classes(docs_of(awkward, extra=True), 3, 9, 10).collect()
    text = lambda rows: sorted(map(str, rows))
    assert text((r.doc_id, r.n_shingles, r.component_id) for r in got) == text(
        (i, n, c if n else i) for i, n, c in brute_classes(awkward, 3, 9, 10))
    assert nj.jaccard_classes(docs_of([]), 3, 9, 10).count() == 0


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_linked_pairs_share_a_key(num, den):
    random.seed(num)
    load, linked = np.random.default_rng(num).integers(0, 5, nj.BUCKETS), 0
    for _ in range(1500):
        a = {random.getrandbits(64) for _ in range(random.choice([random.randint(1, 40), random.randint(10, 300)]))}
        b = set(a)
        for _ in range(random.randint(0, max(1, len(a) * (den - num) // den))):
            if random.random() < 0.6 and len(b) > 1:
                b.remove(random.choice(sorted(b)))
            if random.random() < 0.6:
                b.add(random.getrandbits(64))
        if a != b and den * len(a & b) >= num * len(a | b):
            linked += 1
            keys = [set(nj.rare_keys(np.array(sorted(x), np.uint64), num, den, load).tolist()) for x in (a, b)]
            assert keys[0] & keys[1], (len(a), len(b), len(a & b))
    assert linked > 300


def test_tree_bound_never_drops_a_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(100, 200), replace=False), rng.integers(0, 2**63, 5).astype(np.uint64)))) for _ in range(80)]
    counts, sizes = np.array([nj.counts_of(s) for s in sets]), np.array([len(s) for s in sets])
    tree = nj.CountTree(counts, sizes)
    for i, s in enumerate(sets):
        near = set(tree.near(counts[i], sizes[i], 4, 5).tolist())
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            assert 5 * both < 4 * (len(s) + len(t) - both) or j in near


def test_components_equal_union_find(spark):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(50)]
    parent = {v: v for e in edges for v in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.root for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(parent, v) for e in edges if e[0] != e[1] for v in e}


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i:i + k])].add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        out.append((doc_id, len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(map(str, out))


def contaminated(spark, docs_of, docs, items):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontamination.decontaminate(docs_of(docs, extra=True), table).collect()
    return sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated)) for r in got)


def test_decontamination_equals_brute_force(spark, docs_of, awkward):
    random.seed(6)
    w = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(random.choice(w) for _ in range(random.choice([3, 9, 10, 11, 25, 40])))) for i in range(30)] + [(30, None), (31, ""), (2, "v1 v2 V3"), (32, "the the the the the the the the the the the")]
    docs = list(awkward)
    for i in range(100, 180):
        parts = [" ".join(random.choice(w + ["the"]) for _ in range(random.randint(0, 40)))]
        for _ in range(random.randint(0, 3)):
            span = (random.choice(items)[1] or "").split(" ")
            a = random.randrange(len(span))
            parts += [" ".join(span[a:a + random.randint(5, 30)]).upper(), " ".join(random.choice(w) for _ in range(random.randint(0, 5)))]
        docs.append((i, ", ".join(parts)))
    docs += [(200, "the " * 200), docs[-1]]
    assert contaminated(spark, docs_of, docs, items) == brute_hits(docs, items)


def test_decontamination_by_shuffle_and_of_empty_tables(spark, docs_of, monkeypatch):
    docs, items = [(1, "a b c d e f g h i j k l"), (2, "z")], [(5, "b c d e f g h i j k l"), (6, "Z!")]
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    assert contaminated(spark, docs_of, docs, items) == brute_hits(docs, items)
    monkeypatch.undo()
    assert contaminated(spark, docs_of, docs, []) == brute_hits(docs, [])
    assert contaminated(spark, docs_of, [], items) == []


def test_every_long_shared_span_is_found(spark, docs_of):
    """The winnowing guarantee: whatever surrounds a window, its fingerprint is selected."""
    random.seed(9)
    item = " ".join(f"q{random.randint(0, 9)}" for _ in range(10))
    docs = [(i, " ".join([f"r{random.randint(0, 99)}" for _ in range(i)] + [item] + [f"r{random.randint(0, 99)}" for _ in range(30 - i)])) for i in range(30)]
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert all(r.n_hit >= 10 for r in decontamination.decontaminate(docs_of(docs), table).collect())


def test_leaders_of_keys_are_joined_without_a_window(docs_of, monkeypatch):
    plans, real = [], nj.components
    monkeypatch.setattr(nj, "components", lambda spark, edges: (plans.append(edges._jdf.queryExecution().executedPlan().toString()), real(spark, edges))[1])
    pairs = near_copies(21, 80)
    got = nj.jaccard_classes(docs_of(pairs)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(pairs, 3, 9, 10))
    assert plans and not any("Window" in p for p in plans)
