"""Language identification by rank-order profiles.

The n-grams (one to three letters, words bounded by a blank) of all documents
of a language are counted and ranked; a document's own ranking is compared to
each profile by the out-of-place distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import whole_text

#: Ranks of a profile, bits of a letter's code and the code of the blank beside a word.
RANKS, BITS, BLANK = 400, 21, 1
MERGE_ROWS = 1 << 20
NO_LETTER = "und"

_table: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Codes of all code points: a letter has that of its lower case plus two, 0 is no letter."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0]) + 2
    return table


def gram_codes(text: str) -> np.ndarray:
    """Sorted codes of all n-grams of a text, with repetitions; empty without letters."""
    if not _table:
        _table.append(_letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letters = np.concatenate([[0], _table[0][points], [0]]).astype(np.int64)
    letters = letters[np.concatenate([[True], (letters[1:] != 0) | (letters[:-1] != 0)])]
    if len(letters) < 3:
        return np.zeros(0, np.int64)
    one = letters[letters != 0]
    coded = np.maximum(letters, BLANK)  # no code is 0, so n-grams of different lengths differ
    two = (coded[:-1] << BITS) | coded[1:]
    three = ((coded[:-2] << BITS | coded[1:-1]) << BITS | coded[2:])[letters[1:-1] != 0]
    return np.sort(np.concatenate([one, two, three]))


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(text: str) -> np.ndarray:
    """The document's profile: its most frequent n-grams, ties by code."""
    codes = gram_codes(text)
    if not len(codes):
        return codes
    grams, n = _runs(codes)
    return grams[np.argsort(-n, kind="stable")[:RANKS]]


def language_profiles(labelled: DataFrame) -> DataFrame:
    """Profiles of ``labelled`` (text, lang): rows (lang, gram, rank), at most ``RANKS`` a language.

    Counts cover all rows and whole texts and are added up within each task
    before the shuffle; rows without language teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        done: dict[str, tuple] = {}
        sizes: dict[str, int] = {}

        def merge(lang: str) -> None:
            grams, n = _runs(np.sort(np.concatenate(held.pop(lang))))
            if lang in done:
                both = np.concatenate([done[lang][0], grams])
                grams, where = np.unique(both, return_inverse=True)
                n = np.bincount(where, np.concatenate([done[lang][1], n])).astype(np.int64)
            done[lang], sizes[lang] = (grams, n), 0

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes = gram_codes(text)
                if len(codes):
                    held.setdefault(lang, []).append(codes)
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                    if sizes[lang] >= MERGE_ROWS:
                        merge(lang)
        for lang in list(held):
            merge(lang)
        for lang, (grams, n) in done.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams, pa.int64()), "n": pa.array(n, pa.int64())})

    texts = labelled.where("lang is not null").select("lang", whole_text().alias("text"))
    counts = texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).where(F.col("rank") < RANKS).select("lang", "gram", "rank")


class Profiles:
    """All profiles side by side: sorted n-grams and their ranks by language, ``RANKS`` where one lacks them."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.array(sorted({gram for _, gram, _ in rows}), np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), RANKS, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language and one minus its relative distance; ties go to the first by name."""
        mine = ranked(text)
        if not len(mine) or not self.langs:
            return NO_LETTER, 0.0
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        known = self.grams[at] == mine
        gap = np.abs(self.ranks[at[known]] - np.arange(len(mine))[known][:, None])
        lacks = self.ranks[at[known]] == RANKS
        far = np.where(lacks, RANKS, gap).sum(axis=0) + RANKS * int((~known).sum())
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (RANKS * len(mine)))


def identify(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Rows (id, held_out, lang_pred, score), one for each row of ``docs``.

    ``training`` has ``text`` and ``lang``. ``lang_pred`` is ``und`` with
    score 0 if the text is null or has no letter, or if nothing was learned;
    a text with letters always gets a learned language. Repeated rows are
    predicted alike. The profiles sent to the executors are at most ``RANKS``
    rows a language.
    """
    profiles = Profiles([tuple(r) for r in language_profiles(training).collect()])
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(docs[id_col].alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
