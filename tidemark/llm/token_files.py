"""Token-id files: canonical length-limited Huffman coding of ids.

Ids are counted over the corpus and get canonical codes of bounded length.
Segments of whole documents, in ascending order of id, are coded into binary
images: a document table, the bit offsets of independent blocks, and the
bits. Decoding runs all blocks of an image in step, with one table look-up an
id. Images and the code lengths are kept in Parquet, so that any store that
Spark reaches can hold them.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.shared import shared_dir, whole_text, write_table

#: Bound of a code's length, ids of an independent block, ids from which a segment is closed.
MOST_BITS, BLOCK_IDS, SEGMENT_IDS = 18, 256, 1 << 20
#: Ids aimed at in a shard of the ordered files.
SHARD_IDS = 8 << 20
#: Words that a Python worker keeps with their ids, and the longest one kept.
CACHE_WORDS, CACHE_CHARS = 600_000, 64

_MAGIC = b"TMID\x01"


# -- codes ------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits by package-merge; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need codes of more than {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    row, rows = leaves, [np.ones(len(leaves), bool)]
    for _ in range(most - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        row = merged[order]
        rows.append(order < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(rows):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in ascending order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - before
        ids = np.flatnonzero(lengths == n)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code, before = code + len(ids), n
    return codes


class Coder:
    """Encodes and decodes arrays of ids by their code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.width = max(1, int(self.lengths.max(initial=0)))
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.length = np.ones(1 << self.width, np.uint8)
        for i in np.flatnonzero(self.lengths):
            gap = self.width - int(self.lengths[i])
            first = int(self.codes[i]) << gap
            self.symbol[first : first + (1 << gap)] = i
            self.length[first : first + (1 << gap)] = self.lengths[i]

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks and the bits, most significant first."""
        n = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(n)
        at = ends - n
        if not len(ids):
            return at, b""
        words = np.zeros((int(ends[-1]) >> 6) + 1, np.uint64)
        word, shift = at >> 6, 64 - (at & 63) - n
        code = self.codes[ids]
        fits = shift >= 0
        high = np.where(fits, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return at[::BLOCK_IDS], words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8]

    def decode(self, offsets: np.ndarray, bits: bytes, count: int) -> np.ndarray:
        """All ids: the blocks step together, each from its own bit offset."""
        if not count:
            return np.zeros(0, np.uint32)
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at, last = offsets.astype(np.int64).copy(), len(window) - 1
        out = np.empty((min(BLOCK_IDS, count), len(at)), np.uint32)
        down = np.uint32(32 - self.width)
        for k in range(len(out)):
            code = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> down
            out[k] = self.symbol[code]
            at += self.length[code]
        return out.T.reshape(-1)[:count] if len(at) == 1 or count % BLOCK_IDS == 0 else np.concatenate([out[:, :-1].T.reshape(-1), out[: count % BLOCK_IDS, -1]])


# -- images -----------------------------------------------------------------------------------


def write_image(coder: Coder, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment: header, document ids (with a byte that tells null), their lengths, block offsets, bits."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    offsets, bits = coder.encode(every)
    return b"".join(
        [
            _MAGIC,
            struct.pack("<QQQ", len(ids), len(every), len(offsets)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], "u1").tobytes(),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            offsets.astype("<u8").tobytes(),
            bits,
        ]
    )


def read_image(coder: Coder, image: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if image[: len(_MAGIC)] != _MAGIC:
        raise ValueError("not a token-id image")
    at = len(_MAGIC) + 24
    docs, count, blocks = struct.unpack("<QQQ", image[len(_MAGIC) : at])
    doc_ids = np.frombuffer(image, "<i8", docs, at).tolist()
    null = np.frombuffer(image, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(image, "<u8", docs, at + 9 * docs).astype(np.int64)
    offsets = np.frombuffer(image, "<u8", blocks, at + 17 * docs)
    ids = coder.decode(offsets, image[at + 17 * docs + 8 * blocks :], count)
    return [None if n else i for i, n in zip(doc_ids, null, strict=True)], np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


# -- tokens -----------------------------------------------------------------------------------


def id_type(size: int) -> str:
    """How ids below ``size`` are held before they are coded."""
    return "<u2" if size <= 1 << 16 else "<u4"


class WordTokenizer:
    """Ids of whole texts by a tokenizer that folds case, drops white space and marks the ends of words.

    Blanks part the text, and each part is encoded once and kept. A new part
    of letters, with or without ASCII signs behind, is looked up and kept by
    its lower-case letters and its signs; letters not met before are encoded
    together, as words of one text. All other parts are encoded one by one.
    """

    LETTERS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, definition: str, held_as: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.type = Tokenizer.from_str(definition), held_as
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters: each ends with the one token that says so."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.type)
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(words):
            return {w: self._ids(w) for w in words}
        data, size = ids.tobytes(), ids.itemsize
        return {w: data[a * size : b * size] for w, a, b in zip(words, [0, *stops], stops, strict=False)}

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        known, found, open_ = self.known, {}, {}
        for part in parts:
            m = self.LETTERS.fullmatch(part)
            # Lower case is sure to be the tokenizer's own where it is one letter for one.
            if m and m[1].isalpha() and (m[1].isascii() or max(m[1]) <= "\xff"):
                low, tail = m[1].lower(), known.get(m[2])
                if tail is None:
                    tail = known[m[2]] = self._ids(m[2])
                ids = known.get(low)
                if ids is None:
                    open_[part] = low, tail
                else:
                    found[part] = ids + tail
            else:
                found[part] = self._ids(part)
        if open_:
            new = self._letters(list(dict.fromkeys(low for low, _ in open_.values())))
            found.update((part, new[low] + tail) for part, (low, tail) in open_.items())
            found.update(new)
        if len(known) < CACHE_WORDS:
            known.update((w, x) for w, x in found.items() if len(w) <= CACHE_CHARS)
        return found

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        parts = list(map(self.known.get, words))
        if None in parts:
            new = [k for k, x in enumerate(parts) if x is None]
            found = self._learn({words[k] for k in new})
            for k in new:
                parts[k] = found[words[k]]
        return b"".join(parts)


_tokenizers: dict[int, WordTokenizer] = {}


def _tokenizer(definition: str, held_as: str) -> WordTokenizer:
    key = zlib.crc32((held_as + definition).encode())
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(definition, held_as)
    return _tokenizers[key]


def vocabulary(definition: str, end_id: int) -> int:
    return max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1)


def tokenise(docs: DataFrame, definition: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, tie, ids): ids of ``id_type`` with the end id, tie 64 bits of their digest."""
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    held_as = id_type(vocabulary(definition, end_id))
    end = np.array([end_id], held_as).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent.value, held_as)
        for batch in batches:
            ids = [tokenizer.encode(t) + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "tie": pa.array((xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in ids), pa.int64()), "ids": pa.array(ids, pa.binary())})

    return rows.mapInArrow(run, "doc_id long, tie long, ids binary")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id below ``size`` over all rows; a task sends at most ``size`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), id_type(size)), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(counts[used])})

    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


# -- files ------------------------------------------------------------------------------------


def write_files(tokens: DataFrame, size: int, path: str) -> None:
    """Write ``tokens`` (doc_id, tie, ids) to ``path``: its ``codebook`` and ``segments`` in ascending doc_id.

    Null ids come first; equal ids are ordered by the digest of their tokens,
    so that a rerun gives the same files. Rows are dealt to shards by ranges
    of (doc_id, tie, place of the row): one id may hold many rows, and so may
    one document of that id, whose rows are all alike.
    """
    spark = tokens.sparkSession
    counts = count_ids(tokens, size)
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast(lengths)
    shards = max(1, -(-int(counts.sum()) // SHARD_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        shard, number = TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int64()), "number": pa.array([number], pa.int64()), "n_ids": pa.array([held], pa.int64()), "image": pa.array([write_image(coder, doc_ids, ids)], pa.binary())}
            )

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                x = np.frombuffer(x, id_type(size))
                doc_ids.append(i)
                ids.append(x)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield image()
                    doc_ids, ids, held, number = [], [], 0, number + 1
        if ids:
            yield image()

    first = F.col("doc_id").asc_nulls_first()
    ordered = tokens.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(shards, first, "tie", "place").sortWithinPartitions(first, "tie", "place")
    ordered.select("doc_id", "ids").mapInArrow(run, "shard long, number long, n_ids long, image binary").write.option("compression", "none").parquet(f"{path}/segments")


def read_files(spark: SparkSession, path: str, *, keep_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all documents in ``path``, decoded from its images, with ``ids`` if they are kept.

    ``start`` counts the ids of all documents before: within the image, plus
    the sizes of all earlier images, of which there are few enough to be
    summed by shard and then over the shards.
    """
    segments = spark.read.parquet(f"{path}/segments")
    sent = spark.sparkContext.broadcast(np.frombuffer(spark.read.parquet(f"{path}/codebook").head().lengths, np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for batch in batches:
            for shard, number, image in zip(*(batch.column(c).to_pylist() for c in ("shard", "number", "image")), strict=True):
                doc_ids, ids = read_image(coder, image)
                n = np.array([len(x) for x in ids], np.int64)
                blobs = [x.astype("<u4").tobytes() for x in ids]
                kept = {"ids": pa.array(blobs, pa.binary())} if keep_ids else {}
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard] * len(ids), pa.int64()),
                        "number": pa.array([number] * len(ids), pa.int64()),
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "within": pa.array(np.cumsum(n) - n),
                        "n_tokens": pa.array(n),
                        "ids_crc32": pa.array(map(zlib.crc32, blobs), pa.int64()),
                    }
                    | kept
                )

    docs = segments.select("shard", "number", "image").mapInArrow(run, "shard long, number long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    sizes = segments.select("shard", "number", "n_ids")
    earlier = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("of_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("of_shard").over(before), F.lit(0)).alias("shard_start"))
    starts = sizes.select("shard", "number", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("in_shard")).join(shards, "shard")
    joined = docs.join(starts, ["shard", "number"])
    return joined.select("doc_id", (F.col("shard_start") + F.col("in_shard") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def token_file_digests(docs: DataFrame, definition: str, *, end_id: int, path: str | None = None, **columns) -> DataFrame:
    """Write the token files of ``docs`` and give what reading them back shows: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text holds the end id alone; repeated rows are files'
    documents each; an empty table gives an empty code and no rows. Tokens
    are made once and kept in the shared folder for the two passes that
    counting and coding take.
    """
    tokens = write_table(tokenise(docs, definition, end_id=end_id, **columns), "tokens")
    path = path or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_files(tokens, vocabulary(definition, end_id), path)
    return read_files(docs.sparkSession, path, keep_ids=False)
