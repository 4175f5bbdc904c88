from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from common import documents, empty_documents, odd_documents
from tokenizers import Tokenizer

from tidemark.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, encoding="utf-8") as f:
    DEFINITION = f.read()
LIBRARY = Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library():
    mine, rng = token_files.WordTokenizer(DEFINITION, "<u2"), random.Random(6)
    pieces = ["word", "Word", "WORD,", "it's", "'s", "é", "É", "é", "ß", "İ", "ΣΑΣ", "12", "x1", "**", "end.", "!?", " ", "\n", "\t", "\xa0", "\x1c", "漢字", "😀", "_", "²"]
    for _ in range(600):
        text = "".join(rng.choices(pieces, k=rng.randrange(12)))
        for _ in range(2):  # from the cache as well
            assert np.frombuffer(mine.encode(text), "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)


def _huffman_cost(counts):
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_code_lengths_are_optimal_and_bounded():
    rng = np.random.default_rng(3)
    for n in (2, 3, 17, 300):
        counts = rng.integers(1, 1000, n)
        lengths = token_files.code_lengths(counts).astype(int)
        assert (counts * lengths).sum() == _huffman_cost(counts.tolist())
        assert sum(2.0**-x for x in lengths) == 1
    steep = np.array([2**k for k in range(40)])
    lengths = token_files.code_lengths(steep, 8).astype(int)
    assert lengths.max() == 8 and sum(2.0**-x for x in lengths) <= 1
    assert token_files.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    assert token_files.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]


def test_images_return():
    rng = np.random.default_rng(4)
    for total in (0, 1, 255, 256, 257, 5000):
        ids = np.minimum(rng.zipf(1.3, total), 40_000).astype(np.uint32)
        counts = np.bincount(ids, minlength=40_001)
        coder = token_files.Coder(token_files.code_lengths(counts))
        cuts = np.sort(rng.integers(0, total + 1, 3))
        parts = np.split(ids, cuts)
        names, back = token_files.read_image(coder, token_files.write_image(coder, [3, None, 5, -1], parts))
        assert names == [3, None, 5, -1]
        assert [x.tolist() for x in back] == [x.tolist() for x in parts]


def test_files_are_ordered_and_return(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "SHARD_IDS", 200)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "x9", "delta,"], k=rng.randrange(40))) for _ in range(60)]
    ids = rng.sample(range(1000), 60)
    rows = {r["doc_id"]: r for r in token_files.token_file_digests(documents(spark, texts, ids=ids), DEFINITION, end_id=2, path=f"file://{tmp_path}/t").collect()}
    start = 0
    for i, text in sorted(zip(ids, texts, strict=True)):
        want = np.array([*LIBRARY.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    segments = spark.read.parquet(f"{tmp_path}/t/segments")
    assert segments.select("shard").distinct().count() > 1
    assert token_files.read_files(spark, f"file://{tmp_path}/t").count() == 60


def test_odd_rows(spark):
    rows = token_files.token_file_digests(odd_documents(spark), DEFINITION, end_id=2).collect()
    assert len(rows) == 8
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert next(r["start"] for r in rows if r["doc_id"] is None) == 0
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert token_files.token_file_digests(empty_documents(spark), DEFINITION, end_id=2).count() == 0
