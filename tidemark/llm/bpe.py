"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is not trained: it is serialised from a public rank file. Every
byte is mapped to one character, each token becomes a piece of mapped
characters with score ``-rank``, and the normaliser is the identity, so that
the best-scored merge of the library is the lowest-ranked merge of the rank
file. Pre-tokens are found by the vocabulary's pattern and encoded one by
one; decoding maps ids to pieces and pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from tidemark.llm.shared import whole_text

#: First character of the byte alphabet: byte b is written as chr(FIRST + b).
FIRST = 0x100
_TO_CHAR = {b: FIRST + b for b in range(256)}
_TO_BYTE = {FIRST + b: b for b in range(256)}

#: Most pre-tokens that a Python worker keeps, and the longest one kept.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 128


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHAR)


def to_bytes(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the id after the last is unknown."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    model = pb.ModelProto()
    for rank, token in enumerate(order):
        model.pieces.add(piece=to_piece(token), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one worker, made from the serialised model."""

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size() - 1)]
        self.token_bytes = [to_bytes(p) for p in pieces]
        # A pre-token that is itself a token is that token, even if merges alone would not build it.
        self.whole = {
            p: np.array([i], "<u4").tobytes()
            for i, (p, got) in enumerate(zip(pieces, self.sp.encode(pieces), strict=True))
            if got != [i]
        }
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        found, cache = self.find(text), self.cache
        if new := [p for p in set(found) if p not in cache]:
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = list(set(found))
            mapped = [to_piece(p.encode()) for p in new]
            got = {
                p: self.whole.get(m) or np.array(ids, "<u4").tobytes()
                for p, m, ids in zip(new, mapped, self.sp.encode(mapped, num_threads=1), strict=True)
            }
            ids = b"".join([got[p] if p in got else cache[p] for p in found])
            cache.update((p, v) for p, v in got.items() if len(p) <= CACHE_CHARS)
            return ids
        return b"".join([cache[p] for p in found])

    def decode(self, ids: bytes) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[bytes, Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    """One codec per worker process: loading the model takes longer than a small batch."""
    key = hashlib.sha256(model + pattern.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, pattern)
    return _codecs[key]


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_tokens``, both digests and, with ``keep_ids``, ``ids``.

    ``ids`` holds little-endian unsigned 32-bit integers. ``ids_sha256`` is
    the digest of those bytes and ``decoded_sha256`` that of the bytes which
    decoding the ids gives back. A null or empty text has no tokens and the
    digests of the empty string; repeated rows give repeated results; other
    columns of ``docs`` are not read, so that their names cannot clash.

    No shuffle: each text is encoded where it is read, whole. The model is a
    fixed vocabulary (about 1 MB), sent to the executors once.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(serialise_model(ranks))
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    rows = docs.select(docs[id_col].alias("id"), whole_text(text_col).alias("text"))
    schema = f"{rows.schema['id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            columns = {
                id_col: batch.column("id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"`{id_col}` {schema}, {fields}")


def decode_documents(coded: DataFrame, ranks: dict[bytes, int], pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """Rows of ``coded`` (``doc_id``, ids as above) with ``text`` decoded; invalid UTF-8 is replaced, null ids give null."""
    model = coded.sparkSession.sparkContext.broadcast(serialise_model(ranks))
    rows = coded.select("doc_id", coded[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
