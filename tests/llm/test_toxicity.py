from __future__ import annotations

import random

import numpy as np
import pytest
from common import documents, empty_documents, odd_documents

from tidemark.llm import toxicity


def _texts(n, seed=2):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(400)]
    texts, labels = [], []
    for k in range(n):
        words = rng.choices(clean, k=rng.randrange(5, 160))
        if k % 4 == 0:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["zorgon", "krax"]) + rng.choice(["", "ek", "im", "ou"])
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        starts = toxicity._starts(n)
        covered = {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(["a", "b"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((9, 6 * toxicity.STATES)) * 0.5
    at, lengths, y = rng.integers(0, 9, (4, 6)), np.array([6, 4, 1, 6]), np.array([1.0, 0, 1, 0])

    def loss():
        logits, _ = net.forward(x, at, lengths)
        return float((np.logaddexp(0, logits) - y * logits).sum())

    logits, cache = net.forward(x, at, lengths, keep=True)
    g, dx = net.backward(x, at, cache, 1 / (1 + np.exp(-logits)) - y)
    for array, gradient in [(x, dx), *((net.p[k], g[k]) for k in ("u", "attend", "out", "bias"))]:
        for _ in range(6):
            k = tuple(rng.integers(0, s) for s in array.shape)
            held, step = array[k], 1e-3
            array[k] = held + step
            up = loss()
            array[k] = held - step
            down = loss()
            array[k] = held
            assert gradient[k] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def _plain_score(net, text):
    """The highest window's probability, one word and one unit after the other."""
    s, p = toxicity.STATES, {k: v.astype(np.float64) for k, v in net.p.items()}
    words = text.lower().split()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(projected, direction):
        h, out = np.zeros(s), []
        for x in projected:
            a = h @ p["u"][direction]
            z, r = sigmoid(x[:s] + a[:s]), sigmoid(x[s : 2 * s] + a[s : 2 * s])
            new = np.tanh(x[2 * s :] + r * a[2 * s :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    best = 0.0
    for start in toxicity._starts(len(words)) if words else []:
        rows = []
        for w in words[start : start + toxicity.WINDOW]:
            grams, _ = toxicity.gram_buckets([w])
            rows.append(np.concatenate([p["words"][net.known.get(w, 0)], p["chars"][grams].mean(axis=0)]) @ p["w"] + p["b"])
        both = [np.concatenate(x) for x in zip(states([r[: 3 * s] for r in rows], 0), states([r[3 * s :] for r in rows[::-1]], 1)[::-1], strict=True)]
        weight = np.exp([x @ p["attend"] for x in both])
        pooled = sum(w * x for w, x in zip(weight / weight.sum(), both, strict=True))
        best = max(best, float(sigmoid(pooled @ p["out"] + p["bias"][0])))
    return best


def test_scores_are_those_of_a_plain_network():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgé", k=rng.randrange(1, 9))) for _ in range(50)] + ["12", "--", "É1x"]
    net = toxicity.Network(words[:20], seed=3)
    net.p = {k: (v * 2).astype(np.float32) for k, v in net.p.items()}
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 63, 64, 65, 200, 0, 113, 30)]
    got = toxicity.Scorer(net).scores(texts)
    assert max(abs(a - _plain_score(net, t)) for a, t in zip(got, texts, strict=True)) < 1e-4 and got[6] == 0


def test_all_windows_of_one_row_an_id_are_learned_from(spark):
    long = " ".join(f"w{k}" for k in range(1000))
    docs = documents(spark, [long, "short text", "short text", "another text"], ids=[1, 2, 2, 2])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.training_windows(docs, labels, id_col="doc_id", text_col="text", label_col="toxic")[0].collect()
    mine = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["number"])
    assert [r["words"] for r in mine] == [long.split()[s : s + toxicity.WINDOW] for s in toxicity._starts(1000)]
    assert [r["words"] for r in rows if r["id"] == 2] == [["another", "text"]]


def test_held_out_documents_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 120)
    texts, labels = _texts(400)
    docs = documents(spark, texts)
    known = spark.createDataFrame([(k, y) for k, y in enumerate(labels) if k % 3], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, known).collect()}
    held = [k for k in rows if k % 3 == 0]
    right = sum(rows[k]["predicted"] == labels[k] for k in held)
    assert right / len(held) > 0.95


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 12)
    texts, labels = _texts(40)
    odd = odd_documents(spark)
    train = documents(spark, texts, ids=[100 + k for k in range(40)])
    known = spark.createDataFrame([(100 + k, y) for k, y in enumerate(labels)] + [(None, 1), (5, None), (100, 7)], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd.select(*train.columns).unionByName(train), known).collect()
    assert len(rows) == 48 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert {r["score"] for r in toxicity.score_documents(odd, known.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_documents(empty_documents(spark), known.limit(0)).count() == 0
