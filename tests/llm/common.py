"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator might use itself.
CLASHING = ("id", "size", "row", "rate", "copies", "digest", "base", "key", "label", "score", "n", "target", "surprise", "carried", "rows")

LONG = ("word " * 3000 + "x" * 20_000 + " ") * 3


def documents(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = [
        ((ids or range(n))[k], texts[k], (langs or ["en"] * n)[k], (sources or ["s"] * n)[k], None if texts[k] is None else len(texts[k])) for k in range(n)
    ]
    return spark.createDataFrame(rows, DOCS)


def odd_documents(spark):
    """Null and empty texts, blanks, a long one, repeated rows, nulls in every column, clashing columns."""
    texts = [None, "", " \n\t", LONG, "the same row here", "the same row here", "naïve café — ünï 😀 \x00 x", "one"]
    frame = documents(
        spark, texts, langs=["en", None, "en", "en", "fr", "fr", None, "de"], sources=[None, "a", "a", "b", "b", "b", None, "c"], ids=[1, 2, 3, None, 5, 5, 7, 8]
    )
    for c in CLASHING:
        frame = frame.selectExpr("*", f"'other' as `{c}`")
    return frame


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
