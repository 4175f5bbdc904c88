"""The registered queries themselves, on whole tables, against plain computation."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import TESTDATA
from test_near_dup import _brute
from test_pii import _plain as plain_pii
from test_quality import _plain as plain_metrics
from test_secret_scan import _plain as plain_secrets
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries, toxicity

SF = str(TESTDATA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _rows(frame, columns, texts):
    assert frame.columns[: len(columns.split())] == columns.split()
    rows = {r["doc_id"]: r for r in frame.collect()}
    assert rows.keys() == texts.keys() and len(rows) == frame.count()
    return rows


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, texts):
    rows = _rows(queries.op1_byte_bpe(spark, SF), "doc_id n_tokens ids_sha256 decoded_sha256", texts)
    ranks = bpe.read_ranks(public_tokenizers.path(queries.BPE_RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert tuple(rows[i])[1:4] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), _sha(text))


def test_op2(spark, texts):
    rows = _rows(queries.op2_secret_ownership(spark, SF), "doc_id n_assign n_access n_hex base_sha256 spans", texts)
    for i, text in texts.items():
        base = plain_secrets(text)
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert tuple(rows[i])[1:5] == (*(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")), _sha(",".join(listed)))
        assert set(listed) <= set(rows[i]["spans"].split(",")) | {""}


def test_op3(spark, texts):
    rows = _rows(queries.op3_bagminhash_near_dup(spark, SF), "doc_id class_id", texts)
    ids = sorted(texts)
    brute = _brute([texts[i] for i in ids])
    assert {i: rows[i]["class_id"] for i in ids} == {ids[k]: ids[c] for k, c in brute.items()}


def test_op5(spark, texts, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rows = _rows(queries.op5_gru_toxicity(spark, SF), "doc_id held_out score predicted", texts)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()}
    assert np.mean([rows[i]["predicted"] == y for i, y in labels.items() if i in rows]) > 0.8


def test_op6(spark, texts):
    rows = _rows(queries.op6_huffman_token_files(spark, SF), "doc_id start n_tokens ids_crc32", texts)
    library, start = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER)), 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, queries.END_ID]
        assert tuple(rows[i])[1:4] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark, texts):
    rows = _rows(queries.op8_disclosure_pii(spark, SF), "doc_id n_email n_ip n_card n_phone base_sha256 spans", texts)
    for i, text in texts.items():
        base = plain_pii(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert tuple(rows[i])[1:6] == (*(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")), _sha(listed))
        assert rows[i]["spans"].startswith(listed)


def test_op9(spark, texts):
    rows = _rows(queries.op9_rank_order_langid(spark, SF), "doc_id held_out lang_pred score", texts)
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learned = {x for i, x in docs.items() if x is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in (learned if any(map(str.isalpha, texts[i])) else {"und"})
    assert np.mean([r["lang_pred"] == docs[i] for i, r in rows.items() if r["held_out"] and docs[i] in learned]) > 0.9


def test_op10(spark, texts):
    rows = _rows(queries.op10_perplexity_rules(spark, SF), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", texts)
    for i, text in texts.items():
        n, chars, symbols, dup, repeated = plain_metrics(text)
        failed = n < 10 or 100 * repeated > 20 * n
        assert tuple(rows[i])[1:7] == (n, chars, symbols, dup, repeated, failed) and not (failed and rows[i]["kept"])
