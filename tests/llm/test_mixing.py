from __future__ import annotations

import pytest
from common import documents, empty_documents, odd_documents

from tidemark.llm import mixing


def _water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing, stopping and sharing the excess, over sizes in the order of sources."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    target, total = [0.0] * len(sizes), float(sum(sizes))
    free, left = set(range(len(sizes))), total
    while free:
        share = {k: left * w[k] / sum(w[j] for j in free) for k in free}
        over = {k for k in free if share[k] > most * sizes[k]}
        if not over:
            for k in free:
                target[k] = share[k]
            break
        for k in over:
            target[k] = float(most * sizes[k])
            left -= target[k]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 7, 100_000], [0, 10, 0, 3], [1, 1, 1, 1000], [0, 0]])
def test_targets_are_those_of_sharing_the_excess(spark, sizes):
    table = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(_water(sizes))


def test_null_source_is_last(spark):
    table = spark.createDataFrame([(None, 10), ("z", 10), ("é", 10)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert got["z"] > got["é"] > got[None]


def test_sums_come_near_and_reruns_agree(spark):
    texts = ["word " * (1 + k % 50) for k in range(3000)]
    docs = documents(spark, texts, sources=["abcd"[k % 3 if k % 5 else 3] for k in range(3000)])
    rows = mixing.with_copies(docs).collect()
    again = {r["row"]["doc_id"]: r["copies"] for r in mixing.with_copies(docs.repartition(7)).collect()}
    assert again == {r["row"]["doc_id"]: r["copies"] for r in rows}
    for source in "abcd":
        mine = [r for r in rows if r["row"]["source"] == source]
        assert sum(r["size"] * r["copies"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.1)
        assert max(r["copies"] for r in mine) <= 3
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(again.values())


def test_odd_rows(spark):
    odd = odd_documents(spark)
    rows = mixing.with_copies(odd).collect()
    assert len(rows) == 8 and {r["size"] for r in rows if r["row"]["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_documents(empty_documents(spark)).count() == 0
