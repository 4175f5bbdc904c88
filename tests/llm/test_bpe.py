from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from common import documents, empty_documents, odd_documents

from tidemark.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def _encode(docs, **options):
    return bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, **options)


def test_ids_are_those_of_the_library():
    codec = bpe.Codec(bpe.serialise_model(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(1)
    alphabet = "abcdeABC 019 \n\t'sll.,!?éüß漢字😀́\x1c\x85​\xa0"
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_byte_alphabet_returns():
    assert bpe.to_bytes(bpe.to_piece(bytes(range(256)))) == bytes(range(256))


def test_model_needs_all_bytes_and_ranks_without_gaps():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0})
    with pytest.raises(ValueError):
        bpe.serialise_model({bytes([b]): b + 1 for b in range(256)})


def test_odd_rows(spark):
    rows = _encode(odd_documents(spark)).collect()
    assert len(rows) == 8
    nothing = hashlib.sha256(b"").hexdigest()
    for r in rows:
        if r["doc_id"] in (1, 2):
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, nothing, nothing)
    assert len({r["ids_sha256"] for r in rows if r["doc_id"] == 5}) == 1
    assert _encode(empty_documents(spark)).count() == 0


def test_decoding_gives_the_texts(spark):
    texts = ["a b  c", "", "naïve 😀", None]
    back = bpe.decode_documents(_encode(documents(spark, texts)), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {0: "a b  c", 1: "", 2: "naïve 😀", 3: ""}
