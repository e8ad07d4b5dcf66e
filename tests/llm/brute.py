"""Brute-force versions shared by the tests."""

from collections import defaultdict

from test_matching import brute_classes as classes  # noqa: F401
from test_matching import fold
from test_spans import brute_pii as pii  # noqa: F401


def hits(docs, items):
    """Row id -> whether a window of an item occurs."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = defaultdict(set)
    for _, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[k].add(tuple(w[i:i + k]))
    out = {}
    for doc_id, text in docs:
        w = words(text)
        out[doc_id] = any(tuple(w[i:i + k]) in s for k, s in windows.items() for i in range(len(w) - k + 1))
    return out
