"""Token-id files with directly addressable codes (operator 10).

An id is split into chunks of ``CHUNK`` bits.  Level 0 holds the lowest chunk of
every id, level ``l`` the next chunk of the ids that need one; a continuation
bitmap per level marks them, and a rank directory holds the number of set bits
before each 512-bit block.  Token ``i`` is read by one byte per level and one
rank per continuation, with no block to decode.

A shard file holds consecutive documents (ascending id, nulls first):

    magic "DAC1" | uint32 header bytes | header | arrays

The header lists, as little-endian uint64: range partition, ordinal in it,
documents, tokens, levels, then for each level the chunks in it.  The arrays are
the document ids (int64), their null flags (uint8), the tokens of each document
(uint64) and, per level, chunks (uint8), bitmap (uint8, little bit order) and
directory (uint64).  Bytes behind the arrays are ignored: the writer ends
every record with a line feed.

Shards are rows of binary that Spark's file committer writes, one row to a
file, so lost tasks are repeated safely and any file system that Spark knows
will do.  ``tokens_per_shard`` bounds a file unless one document is longer.

Edge cases: a null text is empty and yields the end id alone; repeated rows and
repeated or null ids are all kept, ordered by id and then by text hash; an empty
table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import in_arrow, slices, text_column, worker_memo
from .components import saved

CHUNK = 8
BLOCK = 512
MAGIC = b"DAC1"


# ---- codes ---------------------------------------------------------------

def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level; at least one level."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(CHUNK)
        go = more > 0
        bits = np.packbits(go, bitorder="little")
        counts = np.add.reduceat(go, np.arange(0, len(go), BLOCK), dtype=np.uint64) if len(go) else np.zeros(0, np.uint64)
        directory = np.concatenate((np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)))
        out.append(((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8), bits, directory))
        rest = more[go]
        if not len(rest):
            return out


def decode_levels(levels) -> np.ndarray:
    """All ids, from the last level up."""
    above = None
    for chunks, bits, _ in reversed(levels):
        ids = chunks.astype(np.uint32)
        if above is not None:
            go = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            ids[go] |= above << np.uint32(CHUNK)
        above = ids
    return above


def access(levels, i: int) -> int:
    """Id number ``i`` alone: a chunk per level and a rank per continuation."""
    value = shift = 0
    for chunks, bits, directory in levels:
        value |= int(chunks[i]) << shift
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        block = i // BLOCK
        before = np.unpackbits(bits[block * BLOCK >> 3:(i >> 3) + 1], bitorder="little")[:i - block * BLOCK]
        i, shift = int(directory[block]) + int(before.sum()), shift + CHUNK
    raise ValueError("a continuation bit without a further level")


# ---- shard files ---------------------------------------------------------

def pack_shard(part: int, ordinal: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    header = [part, ordinal, len(doc_ids), len(ids), len(levels), *(len(x[0]) for x in levels)]
    blocks = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.array(counts, "<u8")]
    for chunks, bits, directory in levels:
        blocks += [chunks, bits, directory.astype("<u8")]
    return b"".join((MAGIC, struct.pack("<I", 8 * len(header)), struct.pack(f"<{len(header)}Q", *header), *(x.tobytes() for x in blocks)))


def unpack_shard(raw: bytes):
    """(part, ordinal, doc ids with None for null, counts, levels)."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token shard")
    size, = struct.unpack_from("<I", raw, 4)
    part, ordinal, docs, _, n_levels, *lens = struct.unpack_from(f"<{size // 8}Q", raw, 8)
    at = 8 + size

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, null, counts = take("<i8", docs), take(np.uint8, docs), take("<u8", docs)
    levels = [(take(np.uint8, n), take(np.uint8, -(-n // 8)), take("<u8", -(-n // BLOCK) + 1)) for n in lens[:n_levels]]
    return part, ordinal, [None if x else int(d) for d, x in zip(doc_ids, null)], counts, levels


# ---- encoding ------------------------------------------------------------

def _is_folded(word: str) -> bool:
    """Whether composing and lower case leave the word as it is; only words of one kind share a text."""
    return unicodedata.normalize("NFC", word.lower()) == word


class WordEncoder:
    """Ids of whole texts by a memory of word encodings.

    The tokenizer composes characters, folds case and splits at white space before anything else,
    and no part of it reaches across ASCII white space, so a text's ids are those of its words,
    joined.  A-Z are folded beforehand, except in texts where one precedes a character that it
    could compose with (``PAIR``): some pairs compose in lower case only.  A run
    of ASCII punctuation (but ' and <) between a letter and white space is always split off
    the word, so it is cut off first.  Texts with the mark of a special string are encoded
    whole.  The memory holds ``limit`` words at most, so it stays bounded on any corpus: a
    new generation begins at half of them, into which the words still in use move over.  Whether a tokenizer file allows this is checked once (``splits``).
    """

    #: Behind A-Z, a-z or a letter of U+00C0 to U+00FF; the search begins at the punctuation, which is rare.
    STOP = re.compile(rb"([!-&(-/:;=-@\[-`{-~](?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:;=-@\[-`{-~]*)(?=[ \n]|\Z)", re.S)

    #: What composes with a letter before it lies at U+0300 or above.
    PAIR = re.compile(rb"[A-Z][\xcc-\xf4]")

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit, self.known, self.older = Tokenizer.from_file(path), limit, {}, {}
        self.normalizer, bare = self.tokenizer.normalizer, Tokenizer.from_file(path)
        bare.normalizer = None
        self.bare = bare.encode_batch_fast  # of text that is normalized already, without looking for where tokens begin
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "", self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token, one a character as in a byte-level vocabulary
        self.sizes[list(vocab.values())] = [len(name.removesuffix(suffix)) for name in vocab]
        probes = ("The cat, that SAT's ÉTÉ. \"q.\" 12,5 a_b... x.y né** ab|| l'été!? x_ y<", "The J\u030c, SAT. T\u0308 H\u0331! W\u030a Y\u030a")
        words = [self._words(probe) for probe in probes]
        self.splits = all(b"".join(self._each(w)) == self._ids(probe) and self._each(w) == [self._ids(x.decode()) for x in w] for w, probe in zip(words, probes))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, text: str) -> list[bytes]:
        raw = text.encode()
        return self.STOP.sub(rb" \1", raw if not text.isascii() and self.PAIR.search(raw) else raw.lower()).split()

    def __call__(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the words that are new in all of them are encoded together."""
        split = [self._words(t) if self.splits and "<|" not in t else None for t in texts]
        known = self.known
        got = [None if words is None else list(map(known.get, words)) for words in split]
        holes = [(i, [k for k, ids in enumerate(found) if ids is None]) for i, found in enumerate(got) if found is not None and None in found]
        missing = {split[i][k] for i, ks in holes for k in ks}
        if missing:
            if len(known) + len(missing) > self.limit // 2:
                self.older, self.known = known, {}
                known, missing = self.known, set().union(*(words for words in split if words))
            old = self.older
            known.update((w, old[w]) for w in missing if w in old)
            folded, other = [], []
            for w in missing:
                if w not in old:
                    (folded if w.isascii() or _is_folded(w.decode()) else other).append(w)
            for group in (folded, other):
                for i in range(0, len(group), 1000):
                    known.update(zip(group[i:i + 1000], self._each(group[i:i + 1000])))
            for i, ks in holes:
                found, words = got[i], split[i]
                for k in ks:
                    found[k] = known[words[k]]
        return [np.frombuffer(self._ids(t) if ids is None else b"".join(ids), "<u4") for t, ids in zip(texts, got)]

    def _each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: all are encoded as one text and told apart by the bytes of their tokens.  Words for
        which those don't add up, as with white space beyond ASCII inside, are told apart by where the tokens begin."""
        text = b" ".join(words).decode()
        alone, shown = words, text if self.normalizer is None else self.normalizer.normalize_str(text)
        if shown != text:  # each by itself, as white space that is put in or taken out would shift the words
            alone = [self.normalizer.normalize_str(w.decode()).encode() for w in words]
            shown = b" ".join(alone).decode()
        ids = np.array(self.bare([shown], add_special_tokens=False)[0].ids, "<u4")
        ends, stops = np.cumsum(self.sizes[ids]), np.cumsum([len(w) for w in alone])
        cuts = np.searchsorted(ends, stops)  # the last token of each word
        if len(ends) and ends[-1] == stops[-1] and (ends[cuts] == stops).all():
            return self._cut(ids, [0, *(cuts + 1).tolist()])
        found = self.tokenizer.encode(text, add_special_tokens=False)
        starts = np.fromiter(itertools.chain((0,), itertools.accumulate(len(w.decode()) + 1 for w in words)), np.int64, len(words) + 1)
        begin = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        return self._cut(np.array(found.ids, "<u4"), np.searchsorted(begin, starts).tolist())

    @staticmethod
    def _cut(ids: np.ndarray, cuts: list[int]) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(cuts[:-1], cuts[1:])]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_column: str = "doc_id",
                      text_col: str = "text", end_id: int = 1, tokens_per_shard: int = 1 << 22) -> None:
    """Encode every text, append ``end_id`` and write shards in ascending id order.

    The texts, not the ids, are range-partitioned, since Spark evaluates the input of a
    range shuffle once more to find its bounds."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def shards(batches):
        encode = worker_memo(f"encoder {tokenizer_path}", lambda: WordEncoder(tokenizer_path))
        part, ordinal = TaskContext.get().partitionId(), 0
        ids, docs_in, counts, held = [], [], [], 0

        def close():
            return pa.RecordBatch.from_pydict({"shard": pa.array([pack_shard(part, ordinal, docs_in, counts, np.concatenate(ids))], pa.binary())})

        for batch in slices(batches, "text"):
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encode.batch(batch.column("text").to_pylist())):
                if docs_in and held + len(got) + 1 > tokens_per_shard:
                    yield close()
                    ids, docs_in, counts, held, ordinal = [], [], [], 0, ordinal + 1
                ids += [got, np.array([end_id], np.uint32)]
                docs_in.append(doc_id)
                counts.append(len(got) + 1)
                held += len(got) + 1
        if docs_in:
            yield close()

    out = in_arrow(rows, shards, "shard binary").select(F.col("shard").cast("string"))
    out.write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: part, ordinal, position (in its shard), doc_id,
    n_tokens, ids (array of int), ids_crc32, shard_tokens."""
    return _read(spark, path, True)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_token_files` without the ids, plus ``start``, the number of
    tokens of all documents before.  The prefix sum runs over one row per range
    partition and, inside each, over its shards' documents."""
    docs = saved(_read(spark, path, False), "token-index")  # used three times below
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    shards = docs.groupBy("part", "ordinal").agg(F.sum("n_tokens").alias("in_shard"))
    inside = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("part", "ordinal", F.coalesce(F.sum("in_shard").over(inside), F.lit(0)).alias("shard_start"))
    bases = shards.join(parts, "part").select("part", "ordinal", (F.col("part_start") + F.col("shard_start")).alias("base"))
    return docs.join(bases, ["part", "ordinal"]).withColumn("start", F.col("base") + F.col("offset")).drop("base")


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "part long, ordinal long, position long, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches):
        for batch in batches:
            for raw in batch.column("content"):
                if len(raw.as_py()) < len(MAGIC):  # an empty task's file
                    continue
                part, ordinal, doc_ids, counts, levels = unpack_shard(raw.as_py())
                ids = decode_levels(levels).astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts.astype(np.int64)
                n = len(doc_ids)
                out = {"part": [part] * n, "ordinal": [ordinal] * n, "position": list(range(n)), "doc_id": doc_ids, "offset": starts, "n_tokens": counts.astype(np.int64),
                       "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]}
                kinds = [(k, pa.int64()) for k in out]
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
                    kinds.append(("ids", pa.list_(pa.int32())))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(kinds))

    return in_arrow(files, decode, schema)
