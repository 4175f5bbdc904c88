from __future__ import annotations

import pytest

from tidemark.engine import VectorTable
from tidemark.errors import AccountNotFound, Conflict, InvalidArgument, OutOfRange, PricePlanNotFound, VectorNotFound
from tidemark.ledger import Ledger
from tidemark.operators import billing

EVENT = "event_id string, tenant string, account_id string, ts_nanos long, units long, unit_price long, plan_id string, metadata string"


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    ledger = Ledger(spark, f"file://{tmp_path_factory.mktemp('ledger')}/t")
    ledger.create_account("t", "a")
    ledger.credit_account("t", "a", 1000)
    ledger.put_price_plan("basic", 7, "token")
    return ledger


def test_usage_is_booked_once_and_chained_over_batches(spark, books):
    first = spark.createDataFrame([("e1", "t", "a", 10, 5, 10, None, '{"k":1}'), ("e1", "t", "a", 10, 5, 10, None, '{"k":1}'), ("e2", "t", "a", 20, 3, 0, "basic", None)], EVENT)
    assert books.record_usage(first) == {"imported": 2, "skipped": 1, "rejected": 0}
    assert books.balance("t", "a") == 1000 - 50 - 21
    # a later batch holds an earlier time, an id that is booked, and one that costs too much
    second = spark.createDataFrame([("e0", "t", "a", 5, 1, 9, None, None), ("e2", "t", "a", 20, 3, 1, None, None), ("e9", "t", "a", 30, 10, 1000, None, None), ("ex", "t", "x", 1, 1, 1, None, None)], EVENT)
    assert books.record_usage(second) == {"imported": 1, "skipped": 1, "rejected": 2}
    assert {r["event_id"]: r["reason"] for r in books.rejects(second).collect()} == {"e9": "insufficient_credits", "ex": "account_not_found"}
    assert books.balance("t", "a") == 920
    assert all(r["linked"] and r["sealed"] for r in books.verify().collect()) and books.verify().count() == 3
    assert [r["event_id"] for r in books.list_usage("t", "a", limit=2)] == ["e0", "e1"]
    assert [r["event_id"] for r in books.list_usage("t", "a", limit=2, after=(10, "e1"))] == ["e2"]
    assert books.export("t").count() == 3 and books.export("other").count() == 0


def test_amounts_stay_within_a_long(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/t")
    ledger.create_account("t", "a")
    ledger.credit_account("t", "a", 2**62 + 5)
    with pytest.raises(OutOfRange):
        ledger.credit_account("t", "a", 2**62 + 5)
    assert ledger.balance("t", "a") == 2**62 + 5


def test_attempts_times_and_the_first_error(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/t")
    ledger.create_account("t", "a")
    ledger.credit_account("t", "a", 100)
    rows = [("e1", "t", "x", 1, 1, 5, None, None), ("e1", "t", "a", 2, 1, 5, None, "kept"), ("e2", "t", "a", 3, 1, 900, None, None), ("e2", "t", "a", 4, 1, 9, None, "own"), ("e2", "t", "a", 5, 1, 8, None, None)]
    events = spark.createDataFrame(rows, EVENT)
    assert ledger.record_usage(events.where("ts_nanos > 1"), stop_at_error=True) == {"imported": 1, "skipped": 0, "rejected": 3}
    assert ledger.record_usage(events) == {"imported": 1, "skipped": 3, "rejected": 1}
    assert {r["event_id"]: (r["metadata"], r["cost"]) for r in ledger.usage().collect()} == {"e1": ("kept", 5), "e2": ("own", 9)}
    late = spark.createDataFrame([("e3", "t", "a", None, 1, 10_000, None, None)], EVENT)
    assert ledger.record_usage(late) == {"imported": 0, "skipped": 0, "rejected": 1}
    assert [tuple(r) for r in ledger.rejects(late).collect()] == [("e3", "insufficient_credits")]


def test_errors(books):
    with pytest.raises(Conflict):
        books.create_account("t", "a")
    with pytest.raises(AccountNotFound):
        books.credit_account("t", "nobody", 1)
    with pytest.raises(AccountNotFound):
        books.balance("t", "nobody")
    with pytest.raises(InvalidArgument):
        books.credit_account("t", "a", 0)
    with pytest.raises(PricePlanNotFound):
        books.get_price_plan("none")
    assert books.get_price_plan("basic")["plan_price"] == 7
    assert books.get_account("t", "a")["account_id"] == "a"


def test_vectors(spark, tmp_path):
    table = VectorTable(spark, f"file://{tmp_path}/v")
    one = table.add([0.1, 0.2], '{"label":"test"}')
    assert table.get(one)["values"] == [0.1, 0.2]
    table.load(spark.createDataFrame([([1.0], None), ([2.0, 3.0], None)], "values array<double>, metadata string"))
    assert table.live().count() == 3
    table.delete(one)
    with pytest.raises(VectorNotFound):
        table.get(one)


def test_a_batch_is_booked_once_and_then_counted_from_what_was_written(spark, tmp_path, monkeypatch):
    passed, booked_ledger = spark.sparkContext.accumulator(0), billing.booked_ledger

    def counted(*args, **options):
        rows = booked_ledger(*args, **options)

        def count(batches):
            for batch in batches:
                passed.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(billing, "booked_ledger", counted)
    ledger = Ledger(spark, f"file://{tmp_path}/t")
    ledger.load_accounts(spark.createDataFrame([("t", "a", 100), ("t", "b", 0), ("t", "b", 0)], "tenant string, account_id string, credit long"))
    assert sorted(map(tuple, ledger.balances().collect())) == [("t", "a", 100, ""), ("t", "b", 0, "")]
    rows = [("e1", "t", "a", 1, 1, 5, None, None), ("e2", "t", "a", 2, 1, 900, None, None), ("e2", "t", "a", 3, 1, 9, None, None), ("e2", "t", "a", 4, 1, 8, None, None), ("e3", "t", "b", 5, 1, 1, None, None), (None, "t", "a", 6, 1, 1, None, None)]
    assert ledger.record_usage(spark.createDataFrame(rows, EVENT)) == {"imported": 2, "skipped": 1, "rejected": 3}
    assert passed.value == 4  # e1, both attempts of e2 up to the booked one, e3
    assert ledger.record_usage(spark.createDataFrame(rows[:4], EVENT)) == {"imported": 0, "skipped": 4, "rejected": 0}
    assert ledger.record_usage(spark.createDataFrame(rows[4:], EVENT)) == {"imported": 0, "skipped": 0, "rejected": 2}
