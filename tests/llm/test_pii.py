from __future__ import annotations

import math
import random
import re

from common import documents, empty_documents, odd_documents

from tidemark.llm import pii


def _plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    pieces = ["a", "B.", "_", "@", "x.y", ".", "-", " ", "1", "12", "255", "256", "+1", "(", ")", "4111 1111-1111 1111", "é", "😀", "1.2.3.4", "00001"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert pii.base_spans(text) == _plain(text), repr(text)


def test_long_words_take_linear_time():
    pii.base_spans("a" * 400_000 + " " + "1" * 400_000 + " " + "a@" * 100_000 + "+1" * 50_000)


def test_terms_that_disclose_are_added_where_the_entity_is(spark):
    rng = random.Random(3)
    filler = ["plain", "common", "words", "here", "again", "other", "things"]
    texts = []
    for _ in range(6):
        texts.append(f"{' '.join(rng.choices(filler, k=9))} zanzibar mail jo@corp.example.com {' '.join(rng.choices(filler, k=9))}")
    texts += [" ".join(rng.choices(filler, k=30)) for _ in range(60)]
    texts.append("zanzibar without the entity, plain words")
    rows = {r["id"]: r for r in pii.sanitise_spans(documents(spark, texts)).collect()}
    for k in range(6):
        at = texts[k].index("zanzibar")
        kinds = {s.split(":")[0] for s in rows[k]["spans"].split(",") if s.endswith(f":{at}:{at + 8}")}
        assert kinds and kinds <= {"remove", "generalise"}
        assert rows[k]["spans"].startswith(rows[k]["base"])
        assert not any(texts[k][int(a) : int(b)] in filler for _, a, b in (s.split(":") for s in rows[k]["spans"].split(",")))
    assert all(rows[k]["spans"] == "" for k in range(6, len(texts)))


def test_copies_of_one_passage_prove_nothing(spark):
    texts = ["quixotic zanzibar jo@corp.example.com lives here"] * 20 + ["other words entirely"] * 20
    assert {r["added"] for r in pii.sanitise_spans(documents(spark, texts)).collect()} == {0}


def test_terms_count_over_whole_documents(spark):
    """Short names and numbers, far from the entity, at each of their places."""
    rng = random.Random(4)
    filler = ["plain", "common", "words", "here", "again", "other", "things"]
    texts = []
    for _ in range(6):
        texts.append(f"Kim {' '.join(rng.choices(filler, k=90))} jo@corp.example.com {' '.join(rng.choices(filler, k=90))} kim 7a41 {rng.choice(filler)}")
    texts += [" ".join(rng.choices(filler, k=60)) for _ in range(60)]
    rows = {r["id"]: r for r in pii.sanitise_spans(documents(spark, texts)).collect()}
    for k in range(6):
        marked = [texts[k][int(a) : int(b)] for kind, a, b in (s.split(":") for s in rows[k]["spans"].split(",")) if kind in ("remove", "generalise")]
        assert marked == ["Kim", "kim", "7a41"] and rows[k]["added"] == 3
    assert all(rows[k]["spans"] == "" for k in range(6, len(texts)))


def test_shares_are_those_of_plain_counts(spark):
    """Several entities and places in a document, repeated rows, null and equal ids; no share is above one."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    mails = [f"p{k}@corp.example.com" for k in range(4)]
    texts = [" ".join(rng.choices(words[:12], k=14) + ["Kim", mails[0], "7a41"] * rng.randrange(1, 4) + rng.choices(mails[1:], k=rng.randrange(3))) for _ in range(12)]
    texts += [" ".join(rng.choices(words, k=25) + rng.choices(mails[1:], k=rng.randrange(2))) for _ in range(60)] + ["Kim alone", "", None]
    texts += texts[:5]
    docs = documents(spark, texts, ids=[None if k % 7 == 0 else k // 2 for k in range(len(texts))])
    found = pii.detect(docs).where("digest is not null")
    got = {(r["entity"], r["term"]): r["share"] for r in pii.disclosures(found, docs).collect()}
    held = [(set(pii.entities(t, s)), {x for x, _, _ in pii.terms(t, s)}, set(re.findall(r"[^\W_]+", t.lower())), t) for t in (x or "" for x in texts) for s in [pii.base_spans(t)]]
    n, want = len(texts), {}
    for e in set().union(*(x[0] for x in held)):
        rows = [x for x in held if e in x[0]]
        for term in set().union(*(x[1] for x in rows)):
            both = [x for x in rows if term in x[1]]
            if len({x[3] for x in both}) >= pii.LEAST_TEXTS:
                n_term = sum(term in x[2] for x in held)
                share = math.log2(len(both) * n / (n_term * len(rows))) / math.log2(n / len(rows))
                assert share <= 1 + 1e-9
                if share >= pii.GENERALISE_FROM:
                    want[e, term] = share
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sanitised_texts(spark):
    rng = random.Random(3)
    filler = ["plain", "common", "words", "here", "again", "other", "things"]
    texts = [f"{' '.join(rng.choices(filler, k=9))} Zanzibar mail jo@corp.example.com {' '.join(rng.choices(filler, k=9))}" for _ in range(6)]
    texts += [" ".join(rng.choices(filler, k=30)) for _ in range(60)] + [None, "call +49 30 1234567 now 😀"]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in pii.sanitise_documents(docs).collect()}
    assert pii.sanitise_documents(docs).columns == docs.columns and len(rows) == len(texts)
    for k in range(6):
        assert "jo@" not in rows[k]["text"] and "Zanzibar" not in rows[k]["text"] and "[email]" in rows[k]["text"] and "[removed]" in rows[k]["text"]
        assert rows[k]["n_chars"] == len(rows[k]["text"])
    assert all(rows[k]["text"] == texts[k] for k in range(6, 67)) and rows[67]["text"] == "call [phone] now 😀"
    assert pii.sanitised("Ana 7b x", "generalise:0:3,generalise:4:6,generalise:7:8") == "[name] [number] [word]"


def test_odd_rows(spark):
    rows = pii.sanitise_spans(odd_documents(spark)).collect()
    assert len(rows) == 8 and {r["spans"] for r in rows} == {""}
    assert pii.sanitise_spans(empty_documents(spark)).count() == 0
    assert pii.sanitise_documents(odd_documents(spark)).columns == odd_documents(spark).columns
    assert pii.sanitise_documents(empty_documents(spark)).count() == 0
