"""Mixing sources to target weights by repeating documents.

Words are summed per source, every source gets a target, and the ratio of
both is its repetition rate. A document is emitted floor(rate) times, plus
once more with a probability equal to the fraction, by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, whole_text, write_table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No target is more than this times its source's size.
MOST_REPEATS = 3
#: Sources up to which the rates are broadcast: some 100 bytes each, 10 MB.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): one row per source with ``target`` and ``rate``.

    All targets together are the total size. A target is
    ``min(most * size, level * weight)``: sharing by weight, stopping those
    above their bound and sharing the excess anew ends at just that level.
    In ascending order of bound / weight, a source is stopped if the level
    without all earlier ones is above its own ratio. Sizes are compared as
    exact decimals. A source of size 0 has target and rate 0. The table has
    one row per source, so that ordering it in one task is bounded by the
    number of sources.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    bound = (F.col("source_size") * most).cast("decimal(38,0)")
    total = F.sum(F.col("source_size").cast("decimal(38,0)")).over(whole).cast("decimal(38,0)")
    shared = sizes.withColumn("place", F.row_number().over(by_name) - 1).select("source", "source_size", weight.alias("w"), bound.alias("bound"), total.alias("total"))
    order = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0))
    stopped = (left.cast("double") * F.col("w").cast("double")) > (F.col("bound").cast("double") * F.sum("w").over(onward).cast("double"))
    marked = shared.withColumn("stopped", stopped)
    rest = F.max("total").over(whole) - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("bound"))).over(whole), F.lit(0))
    free = F.sum(F.when(~F.col("stopped"), F.col("w"))).over(whole)
    target = F.when(F.col("stopped"), F.col("bound").cast("double")).otherwise(rest.cast("double") * F.col("w").cast("double") / free.cast("double"))
    # A source at its bound by rounding alone is not above it.
    target = F.least(target, F.col("bound").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return marked.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def with_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """Rows ``(row, size, source_size, target, copies)``; ``row`` is a struct of all columns of ``docs``.

    ``size`` counts words (null or empty text: 0). Null is a source like any
    other, last in order. ``copies`` is floor(rate), plus one where the hash
    of seed and id is below the fraction; a null id is replaced by the text's
    digest. Equal ids decide alike, so that a rerun gives the same mix. An
    empty table gives no rows.

    One aggregation of a few bytes per row and task; the rates, one row per
    source, are broadcast after counting them (beyond ``BROADCAST_SOURCES``
    Spark joins by shuffle and splits hot sources). Texts are not shuffled.
    """
    counted = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"))
    sizes = counted.groupBy(F.col("row")[source_col].alias("source")).agg(F.sum("size").alias("source_size"))
    rates = write_table(source_targets(sizes, weights, most), "rates")
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = counted.join(F.broadcast(rates) if small else rates, F.col("row")[source_col].eqNullSafe(rates["source"]), "left")
    key = F.coalesce(F.col("row")[id_col].cast("string"), F.md5(F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
    whole = F.floor("rate")
    copies = (whole + (draw < F.col("rate") - whole).cast("long")).cast("int")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``with_copies`` says, with the columns of ``docs``."""
    mixed = with_copies(docs, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
