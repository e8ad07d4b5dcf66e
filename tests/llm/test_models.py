"""Sampled pieces (1), language (2) and quality (3)."""

import gc
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from plotstats.llm import language_id, quality_model
from plotstats.llm import sampled_pieces as sp
from plotstats.llm.catalog import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(MODEL)


def segmentations(text, names):
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        if text[:k] in names:
            for rest in segmentations(text[k:], names):
                yield (names[text[:k]], *rest)


@pytest.mark.parametrize("alpha", [0.5, 1.0])
def test_samples_follow_the_lattice_distribution(pieces, alpha):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = {model.id_to_piece(i).replace("▁", " "): i for i in range(259, model.get_piece_size())}
    n = 20000
    got = Counter(tuple(x.tolist()) for x in sp.sample(["hello"] * n, np.arange(n), pieces, alpha, 3))
    weight = {s: math.exp(alpha * sum(pieces.weight[i] for i in s)) for s in segmentations(" hello", names)}
    total = sum(weight.values())
    assert set(got) <= set(weight)
    assert max(abs(got[s] / n - w / total) for s, w in weight.items()) < 0.02


def test_sharp_weights_give_one_segmentation_and_sentencepiece_decodes_it(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "The quick brown fox, naïve café 漢字"
    a, b = (sp.sample([text], np.array([k]), pieces, 60.0, 0)[0].tolist() for k in (1, 2))
    assert a == b and model.decode(a) == text


def test_round_trip_and_reproducible_samples(spark, docs_of, awkward):
    docs = docs_of(awkward, extra=True)
    back = sp.decode(sp.encode(docs, MODEL), MODEL)
    rows = back.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, awkward))
    assert all(r.decoded == r.text for r in rows)
    assert all((r.ids is None) == (r.text is None) and (r.text != "" or r.ids == []) for r in rows)
    again = {(r.doc_id, r.text): r.ids for r in sp.encode(docs.repartition(7), MODEL).collect()}
    assert all(again[r.doc_id, r.text] == r.ids for r in rows)
    other = {(r.doc_id, r.text): r.ids for r in sp.encode(docs, MODEL, seed=1).collect()}
    assert any(other[r.doc_id, r.text] != r.ids for r in rows)
    assert sp.encode(docs_of([]), MODEL).count() == 0


def test_slices_do_not_add_up_in_memory(pieces):
    """What a slice held is free when it has been sampled, without a run of the garbage collector."""
    def slice_of(k):
        texts = [" ".join(f"w{(k * 20 + i) * 500 + j}x" for j in range(500)) for i in range(20)]
        return sum(len(ids) for ids in sp.sample(texts, np.arange(20), pieces, 1.0, 0))

    slice_of(0)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        assert all(slice_of(k) for k in range(1, 6))
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held < 200_000


EN = "the of and to in is that for it was on are as with his they at be this have from or had by"
FR = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas que vous"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")


def test_language_evidence_is_fused(spark, docs_of):
    docs = docs_of([(i, EN) for i in range(30)]).unionByName(docs_of([(i, FR) for i in range(30)]).replace("en", "fr", "lang"))
    rows = [(i, f"http://www.site{i % 3}.fr/a", f"<html lang='fr'><p>{FR}</p><script>the of and to</script></html>") for i in range(30)]
    rows += [(100 + i, "https://b.org/x", f"<html lang=en><body>{EN}</body></html>") for i in range(30)]
    rows += [(200, "http://www.site1.fr/b", "<html></html>"),  # the host alone tells
             (201, "https://b.org/y", "<html><p>123</p></html>"), (202, "http://www.site2.fr/c", f"<html lang='fr'>{EN} {EN}</html>"),  # text outweighs the rest
             (203, None, None), (204, "::not a url::", ""), (205, "http://b.org/", "<html lang='xx'></html>"), (None, "http://b.org/", EN), (100, "https://b.org/x", f"<html lang=en><body>{EN}</body></html>")]
    got = language_id.identify(pages(spark, rows), docs).collect()
    assert len(got) == len(rows)
    lang = {r.page_id: r.lang for r in got}
    assert all(lang[i] == "fr" for i in range(30)) and all(lang[100 + i] == "en" for i in range(30))
    assert lang[200] == "fr" and lang[201] == "en" and lang[202] == "en" and lang[205] == "en" and lang[None] == "en"
    assert all(0.5 <= r.prob <= 1 for r in got) and {r.text_lang for r in got if r.page_id in (200, 203, 204)} == {None}
    assert language_id.identify(pages(spark, []), docs).count() == 0
    assert {r.lang for r in language_id.identify(pages(spark, rows[:3]), docs_of([])).collect()} == {None}


def test_language_of_the_test_pages(spark):
    from plotstats.llm.catalog import op2_language_id
    from pyspark.sql import functions as F

    got = op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), "page_id")
    right = got.select(F.avg((F.regexp_extract("url", "/(en|fr|de|es)/", 1) == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.95


def test_quality_scores_hold_out_labels(spark):
    from plotstats.llm.catalog import op3_quality_model

    sf = "/root/testdata/sf0.01"
    got = op3_quality_model(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() >= 0.97
    assert (held.predicted == held.quality).mean() >= 0.95


def test_scores_do_not_depend_on_held_out_labels(spark, docs_of):
    docs = docs_of([(i, ("plain words in a row " if i % 2 else "### %%% *** $$$ ") * (1 + i % 7)) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    flipped = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in quality_model.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b) and a[1] > 0.5 > a[2]


def test_quality_of_awkward_rows(spark, docs_of, awkward):
    docs = docs_of(awkward, extra=True)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (5, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    got = quality_model.score_documents(docs, labels)
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score", "held_out", "predicted"]
    rows = got.collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score_documents(docs_of([]), labels).count() == 0


def test_context_vectors_add_up_over_slices():
    from plotstats.llm.common import text_bytes
    import pyarrow as pa

    index = quality_model.index_vectors()
    texts = ["a b c a b", "", "c c!", "é x"]
    whole = quality_model.context_sums(*quality_model.tokens(*text_bytes(pa.array(texts))), index)
    assert (whole == sum(quality_model.context_sums(*quality_model.tokens(*text_bytes(pa.array([t]))), index) for t in texts)).all()
    bucket, _ = quality_model.tokens(*text_bytes(pa.array(["a b c"])))
    one = quality_model.context_sums(*quality_model.tokens(*text_bytes(pa.array(["a b c"]))), index)
    assert (one[bucket[0]] == index[bucket[1]] + index[bucket[2]]).all()


def test_lossless_is_told_in_the_same_pass(docs_of, awkward):
    rows = sp.encode(docs_of(awkward, extra=True), MODEL, keep_text=False, lossless="same").collect()
    assert len(rows) == len(awkward) and all(r.same for r in rows) and "text" not in rows[0]
    both = {str(r.doc_id): r.ids for r in sp.encode(docs_of(awkward), MODEL).collect()}
    assert both[str(7)] == next(r.ids for r in rows if r.doc_id == 7)


def test_a_draw_stays_among_its_nodes_own_edges(pieces, monkeypatch):
    # a slice of full size, so that node numbers leave few bits for the draw
    words = [f"word{i:06x}" for i in range(60_000)]
    lattice = sp.Lattice([" " + w for w in words], pieces, 1.0)
    node = np.arange(len(lattice.first) - 1)
    node = node[lattice.first[node + 1] > lattice.first[node]]
    assert node[-1] > 500_000
    for u in (0.0, 1 - 2.0 ** -52, 1.0):
        edge = lattice.draw(node, np.full(len(node), u))
        assert (edge >= lattice.first[node]).all() and (edge < lattice.first[node + 1]).all()
        assert u < 1 or (edge == lattice.first[node + 1] - 1).all()
        assert (lattice.source[edge] < node).all()


def test_the_largest_draws_end_and_stay_lossless(pieces, monkeypatch):
    text = " ".join(f"word{i:05x}" for i in range(20_000))
    real = sp.Lattice.draw
    monkeypatch.setattr(sp.Lattice, "draw", lambda self, node, u: real(self, node, np.full(len(u), 1 - 2.0 ** -52)))
    ids = sp.sample([text], np.array([7], np.uint64), pieces, 0.5, 1)[0]
    raw = b"".join(pieces.raw[pieces.raw_start[i]:pieces.raw_start[i + 1]].tobytes() for i in ids)
    assert raw.decode() == " " + text


def test_the_table_of_the_trie_finds_every_piece(pieces):
    """Every ordinary piece is found where it stands, and nothing else; a search of the text costs no bisection."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = {m.id_to_piece(i).replace(sp.SPACE, " "): i for i in range(m.get_piece_size())
             if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    longest = max(map(len, names))
    for text in (sp.GAP.join(names), " the \U0001f642 caf\u00e9 \u6f22\u5b57\0 in\ud7ff\uffff", "x"):
        got = sorted(zip(*(x.tolist() for x in pieces.find(text))))
        assert got == sorted((a, b, names[text[a:b]]) for a in range(len(text)) for b in range(a + 1, min(a + longest, len(text)) + 1) if text[a:b] in names)
    assert not hasattr(pieces, "edge_key")


def test_a_sample_of_a_slice_holds_little(pieces):
    """Peak of the arrays and strings for one slice of varied text: two workers share an executor with the JVM."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(200)) for _ in range(sp.SLICE // 1100)]
    sp.sample(texts[:2], np.arange(2), pieces, 1.0, 0)
    tracemalloc.start()
    sp.sample(texts, np.arange(len(texts)), pieces, 1.0, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
