from __future__ import annotations

import random

import numpy as np
from common import documents, empty_documents, odd_documents

from tidemark.llm import near_dup


def _words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _classes(docs):
    return {r["id"]: r["class_id"] for r in near_dup.duplicate_classes(docs).collect()}


def _brute(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if texts[a] == texts[b] or near_dup.bag_similarity(texts[a], texts[b]) >= near_dup.SIMILARITY:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: root(k) for k in range(len(texts))}


def test_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(1)
    agree, true = [], []
    for _ in range(40):
        h = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
        a = rng.choice([1, 1, 2, 3, 9], 200).astype(np.int64)
        b = np.maximum(a - rng.integers(0, 4, 200) * (rng.random(200) < 0.3), 0)
        s = near_dup.signatures([(h, a), (h[b > 0], b[b > 0])])
        agree.append((s[0] == s[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(true)) < 0.02


def test_classes_are_those_of_all_pairs(spark):
    """Stars whose copies are alike only through their original, chains, repeated phrases, copies, strangers."""
    rng = random.Random(5)
    texts = []
    for _ in range(4):
        base = _words(rng, 120)
        for _ in range(6):
            copy = list(base)
            for k in rng.sample(range(0, 120, 10), 2):
                copy[k] = "changed" + str(rng.random())
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    chain = _words(rng, 150)
    for _ in range(5):
        chain = chain[8:] + _words(rng, 8)
        texts.append(" ".join(chain))
    texts += ["same words again and again"] * 3 + ["short one", "short  one", "short two", "a a a a a a a a a a", "a a a a a a a a a a a"]
    texts += [" ".join(_words(rng, 80)) for _ in range(10)]
    assert _classes(documents(spark, texts)) == _brute(texts)


def test_open_buckets_lose_no_link(spark, monkeypatch):
    """The least id is like the original only, and all others are like it too: links through it must not be lost."""
    rng = random.Random(11)
    base = _words(rng, 100)
    texts = []
    for k in range(12):
        copy = list(base)
        at = 5 + 7 * k
        copy[at : at + 5] = _words(rng, 5)
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    brute = _brute(texts)
    assert set(brute.values()) == {0}
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    assert _classes(documents(spark, texts)) == brute


def test_one_of_each_class_is_kept(spark):
    texts = ["one two three four five six seven"] * 4 + ["other words that are not alike at all", "", "", None]
    docs = documents(spark, texts, ids=[4, 3, 3, None, 8, 9, 10, 11])
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, texts[0]), (8, texts[4]), (9, "")]


def test_texts_are_linked_whatever_their_ids(spark):
    """Null ids: near copies of each other and of an identified row; a repeated id whose texts are of two classes."""
    rng = random.Random(21)
    a, b, c = (_words(rng, 100) for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "changed"])
    texts = [" ".join(a), near(a), near(a), " ".join(b), near(b), near(b), " ".join(c), " ".join(b + b[::-1])]
    ids = [7, None, None, None, None, None, 9, 9]
    docs = documents(spark, texts, ids=ids)
    found = {(r["id"], bytes(r["digest"])): r["class_id"] for r in near_dup.duplicate_classes(docs).collect()}
    assert sorted(map(str, found.values())) == ["7", "7", "9", "9", "None", "None"]
    kept = [(r["doc_id"], r["text"]) for r in near_dup.keep_one(docs).collect()]
    assert len(kept) == 4 and {(7, texts[0]), (9, texts[6]), (9, texts[7])} <= set(kept)
    assert [t in texts[3:5] for i, t in kept if i is None] == [True]
    docs = documents(spark, [texts[0], texts[0], texts[6]], ids=[3, 5, 5])
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.keep_one(docs).collect()) == [(3, texts[0]), (5, texts[6])]


def test_odd_rows(spark):
    odd = odd_documents(spark)
    rows = near_dup.duplicate_classes(odd).collect()
    assert len(rows) == 8
    assert near_dup.keep_one(odd).columns == odd.columns
    # null and empty are one text; the blank one is alone; the repeated row is kept once
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(odd).collect()) == sorted(["1", "3", "None", "5", "7", "8"])
    assert near_dup.duplicate_classes(empty_documents(spark)).count() == 0
    assert near_dup.keep_one(empty_documents(spark)).count() == 0
