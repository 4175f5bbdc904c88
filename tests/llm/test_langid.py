from __future__ import annotations

import random

from common import documents, empty_documents, odd_documents

from tidemark.llm import langid

ALPHABETS = {"aa": "abcdefgh", "bb": "ghijklmé", "cc": "nopqrstü"}


def _texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = sorted(ALPHABETS)[k % 3]
        out.append((lang, " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randrange(2, 7))) for _ in range(rng.randrange(5, 60)))))
    return out


def _plain_distance(text, profile):
    """Out-of-place distance by plain counting, over the same letters."""
    grams = langid.ranked(text).tolist()
    return sum(abs(profile[g] - k) if g in profile else langid.RANKS for k, g in enumerate(grams))


def test_profiles_and_distances_are_those_of_plain_counts(spark):
    from collections import Counter

    rows = _texts(60)
    docs = documents(spark, [t for _, t in rows], langs=[x for x, _ in rows])
    got: dict[str, dict[int, int]] = {}
    for r in langid.language_profiles(docs).collect():
        got.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    for lang in ALPHABETS:
        counts = Counter(g for x, t in rows if x == lang for g in langid.gram_codes(t).tolist())
        order = sorted(counts, key=lambda g: (-counts[g], g))[: langid.RANKS]
        assert got[lang] == {g: k for k, g in enumerate(order)}
    found = {r["doc_id"]: r for r in langid.identify(docs, docs).collect()}
    for k, (_, text) in enumerate(rows):
        far = {lang: _plain_distance(text, got[lang]) for lang in got}
        assert found[k]["lang_pred"] == min(sorted(far), key=far.get)
        assert abs(found[k]["score"] - (1 - min(far.values()) / (langid.RANKS * len(langid.ranked(text))))) < 1e-12


def test_held_out_accuracy(spark):
    rows = _texts(300)
    docs = documents(spark, [t for _, t in rows], langs=[x for x, _ in rows])
    found = langid.identify(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0")).collect()
    assert sum(r["lang_pred"] == rows[r["doc_id"]][0] for r in found) / len(found) > 0.97


def test_grams_are_bounded_by_words():
    assert len(langid.gram_codes("ab")) == 2 + 3 + 2  # a b, _a ab b_, _ab ab_
    assert not len(langid.gram_codes("12 !? _"))
    assert langid.gram_codes("A b").tolist() == langid.gram_codes("a--b").tolist()


def test_every_letter_counts_as_itself(spark):
    """Alphabets beyond Latin-1 and beyond U+FFFF whose letters lie 36 apart are told apart."""
    letters = {"gg": 0x3B1, "hh": 0x4E00, "ii": 0x4E00 + 36, "jj": 0x20000, "kk": 0x20000 + 36}
    rng = random.Random(3)
    rows = [(lang, " ".join("".join(chr(low + rng.randrange(15)) for _ in range(4)) for _ in range(30))) for lang, low in letters.items() for _ in range(6)]
    docs = documents(spark, [t for _, t in rows], langs=[x for x, _ in rows])
    found = langid.identify(docs, docs).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][0] and r["score"] > 0 for r in found)
    assert len(langid.gram_codes(chr(0x20000) + chr(0x1D400))) == 7


def test_odd_rows(spark):
    odd = odd_documents(spark)
    rows = langid.identify(odd, odd).collect()
    assert len(rows) == 8
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] in ("en", "fr", "de") for r in rows if r["doc_id"] not in (1, 2, 3))
    assert all(r["lang_pred"] == "und" for r in langid.identify(odd, odd.where("lang is null")).collect())
    assert langid.identify(empty_documents(spark), empty_documents(spark)).count() == 0
