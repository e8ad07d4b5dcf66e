"""Token files (10) and WARC archives (4): exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from plotstats.llm import token_files as tf
from plotstats.llm import warc
from plotstats.llm.catalog import tokenizer_path
from plotstats.plans.session import scratch_path

BPE = tokenizer_path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    global _TOKENIZER
    if "_TOKENIZER" not in globals():
        _TOKENIZER = Tokenizer.from_file(BPE)
    return [*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_random_access(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    levels = tf.encode_levels(ids)
    assert (tf.decode_levels(levels) == ids).all()
    assert all(tf.access(levels, i) == ids[i] for i in range(0, n, 7))
    part, ordinal, doc_ids, counts, back = tf.unpack_shard(tf.pack_shard(3, 4, [None, 7], [1, max(n - 1, 0)], ids) + b"\n")
    assert (part, ordinal, doc_ids, counts.tolist()) == (3, 4, [None, 7], [1, max(n - 1, 0)])
    assert (tf.decode_levels(back) == ids).all() and all(tf.access(back, i) == ids[i] for i in range(0, n, 11))


def test_word_memory_equals_whole_texts():
    encode = tf.WordEncoder(BPE, limit=50)
    assert encode.splits
    random.seed(3)
    marks = [*"aAbzZ'<>|.,!?;:-_\"()[]{}@#$%^&*+=~`/\\ \n\t09", "é", "É", "ß", "×", "K", "́", "漢", "🙂", "\xa0", "'s", "'re", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(random.choice(marks) for _ in range(random.randint(0, 14)))
        assert [*encode(text), 1] == ids_of(text), repr(text)


def test_word_memory_keeps_capitals_that_compose_in_lower_case_only():
    encode = tf.WordEncoder(BPE, limit=50)
    assert encode.splits
    pairs = ["J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a"]
    for pair in pairs:
        for text in (pair, f"The {pair}a, SAT. {pair.lower()}", f"a{pair}, B"):
            assert [*encode(text), 1] == ids_of(text), repr(text)
    random.seed(4)
    marks = [*"aAbJTHWYjthwy'<.,! \n9", "é", "É", "\u030c", "\u0308", "\u0331", "\u030a", "\u0323", "\u0301", "漢", *pairs]
    for _ in range(3000):
        text = "".join(random.choice(marks) for _ in range(random.randint(0, 14)))
        assert [*encode(text), 1] == ids_of(text), repr(text)


def test_new_words_of_many_texts_are_encoded_together():
    """One call of the tokenizer for a thousand new words, with the ids of each text as a whole."""
    encode = tf.WordEncoder(BPE)
    assert encode.splits
    whole, calls = encode.tokenizer, []

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return whole.encode(text, **options)

    odd = ["J\u030c, SAT. T\u0308", "", " \u00a0 \u2028 x\u00a0", "\u0301 alone e\u0301\u0323x", "\u6f22\u5b57 \U0001f642\u200d\U0001f525 \u1100\u1161", "it's 12,5 \x00\x1c \ufffd", "<|endoftext|> A b", "\u0130 \u1e9e \ufb01"]
    texts = [f"w{i} common n{i * 7}x, {odd[i % len(odd)]} q{i % 13}!" for i in range(300)] + odd
    encode.tokenizer = Counted()
    got = encode.batch(texts)
    assert len(calls) <= 3 + sum("<|" in t for t in texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t
    small = tf.WordEncoder(BPE, limit=20)
    assert [x.tolist() for x in small.batch(texts[:50])] == [x.tolist() for x in got[:50]]
    assert [x.tolist() for x in small.batch(texts[40:])] == [x.tolist() for x in got[40:]]


def test_new_words_are_told_apart_by_the_bytes_of_their_tokens():
    """Offsets, which cost as much as the ids, are asked for only where bytes don't tell the words apart."""
    encode = tf.WordEncoder(BPE)
    whole, asked = encode.tokenizer, []

    class Offsets:
        def encode(self, text, **options):
            asked.append(text)
            return whole.encode(text, **options)

    encode.tokenizer = Offsets()
    random.seed(5)
    letters = [*"abcdeghorstuyzAEK019", "'", "-", "_", ".", "é", "É", "ß", "漢", "🙂", "J\u030c", "e\u0301", "\u0130", "\u1e9e", "\x00", "\x1c", "\ufffd"]
    texts = [" ".join("".join(random.choices(letters, k=random.randint(1, 12))) for _ in range(40)) for _ in range(100)]
    got = encode.batch(texts)
    assert not asked
    odd = ["x\u00a0y \u00a0 \u2028z", "Prix\u00a0: 12\u00a0€, l\u2019été\u202f!", "\u0085 a\u3000b"]
    got += encode.batch(odd)
    assert asked
    shifted = [x.encode() for x in ("é", "\u00a0", "x\u00a0y", "É", "\u2003\u2003")]
    assert encode._each(shifted) == [encode._ids(w.decode()) for w in shifted]
    off = tf.WordEncoder(BPE)
    off.sizes[:] = 0  # as if the vocabulary were not byte-level
    for t, ids, other in zip(texts + odd, got, off.batch(texts + odd), strict=True):
        assert ids.tolist() == other.tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("shard", [1, 40, 1 << 20])
def test_token_files_round_trip(spark, docs_of, awkward, shard):
    path = scratch_path(spark, "test-tokens")
    tf.write_token_files(docs_of(awkward, extra=True), path, BPE, tokens_per_shard=shard)
    got = [(r.doc_id, list(r.ids)) for r in tf.read_token_files(spark, path).orderBy("part", "ordinal", "position").collect()]
    assert [i for i, _ in got] == sorted((i for i, _ in awkward), key=lambda i: (i is not None, i))
    assert sorted(map(str, got)) == sorted(str((i, ids_of(t))) for i, t in awkward)
    start = 0
    index = tf.token_index(spark, path).orderBy("start").collect()
    for (doc_id, ids), r in zip(got, index, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_an_empty_table(spark, docs_of):
    path = scratch_path(spark, "test-tokens")
    tf.write_token_files(docs_of([]), path, BPE)
    assert tf.token_index(spark, path).count() == 0


PAGES = "page_id long, url string, html string, digest string, first_id long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], PAGES)


def tricky_pages():
    random.seed(1)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    body = "<html>" + "é漢" * 60 + "</html>"
    rows = [(10, "http://a/1", body), (3, "http://a/2", body), (7, None, body), (1, "http://a/\r\nx", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""),
            (6, "u", fake), (8, "u", fake * 3), (9, "u", "WARC/1.0\r\n"), (11, "u", "xWARC/1.0\r\n\r\n\r\n"), (12, "u", "\r\n\r\nWARC/1.0\r\nfoo" * 50), (13, "é", fake + "\r\n\r\n"),
            (14, "u", "Content-Length: 5\r\n\r\n" + fake), (3, "http://a/2", body)]
    for i in range(20, 60):
        rows.append((i, "u", "".join(random.choice(["WARC/1.0\r\n", "\r\n\r\n", "text ", fake, "WARC/1."]) for _ in range(random.randint(0, 9)))))
    return rows


def expected_pages(rows):
    first, out = {}, []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page_id is not None:
            first[raw] = min(first.get(raw, page_id), page_id)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        to = first.get(raw, page_id)
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to == page_id else "revisit", None if to == page_id else to))
    return sorted(map(str, out))


def read_back(spark, path):
    got = warc.page_records(warc.read_warc(spark, path, payload=False))
    return sorted(str(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize(("compression", "split"), [("none", "128m"), ("none", "300"), ("gzip", "128m")])
def test_warc_round_trip_with_magic_in_payloads(spark, compression, split):
    rows, path = tricky_pages(), scratch_path(spark, "test-warc")
    warc.write_warc(pages_of(spark, rows).coalesce(2), path, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert read_back(spark, path) == expected_pages(rows)
        if split == "128m":
            full = warc.read_warc(spark, path).collect()
            assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in full)
            urls = {r.record_id: r.target_uri for r in full}
            assert urls["<urn:page:13>"] == "é" and urls["<urn:page:1>"] == "http://a/%0D%0Ax" and urls["<urn:page:7>"] is None
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_null_ids_and_empty_table(spark):
    body = "b" * 200
    path = scratch_path(spark, "test-warc")
    warc.write_warc(pages_of(spark, [(None, "u", body), (5, "u", body), (None, "u", "x")]), path)
    assert read_back(spark, path) == expected_pages([(5, "u", body), (None, "u", "x")]) + [] or len(read_back(spark, path)) == 3
    path = scratch_path(spark, "test-warc")
    warc.write_warc(pages_of(spark, []), path)
    assert read_back(spark, path) == []


def test_truncated_archive_gives_the_records_before(spark, tmp_path):
    path = scratch_path(spark, "test-warc")
    warc.write_warc(pages_of(spark, [(i, "u", "y" * 50) for i in range(20)]).coalesce(1), path)
    import glob
    raw = open(glob.glob(f"{path.replace('file:', '')}/part-*")[0], "rb").read()
    (tmp_path / "part-0.txt").write_bytes(raw[:len(raw) - 30])
    assert warc.read_warc(spark, str(tmp_path)).count() == 19


def test_long_urls_keep_the_records_behind_them(spark):
    body = "b" * 200
    rows = [(1, "http://a/" + "x" * 70_000, "first"), (2, "u", "second"), (3, "http://é/" + "é" * 200_000, body), (4, "u", body), (5, "u", "last")]
    path = scratch_path(spark, "test-warc")
    warc.write_warc(pages_of(spark, rows).coalesce(1), path)
    assert read_back(spark, path) == expected_pages(rows)
    urls = {r.record_id: r.target_uri for r in warc.read_warc(spark, path).collect()}
    assert all(urls[f"<urn:page:{i}>"] == url for i, url, _ in rows)


def test_warc_repeats_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    path, body = scratch_path(spark, "test-warc"), "z" * 200
    warc.write_warc(pages_of(spark, [(3, "u", body), (1, "u", body), (2, "u", "short"), (4, "u", "short"), (5, "u", None)]), path)
    got = warc.page_records(warc.read_warc(spark, path, payload=False)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [
        (1, "response", None, 200), (2, "response", None, 5), (3, "revisit", 1, 200), (4, "response", None, 5), (5, "response", None, 0)]
