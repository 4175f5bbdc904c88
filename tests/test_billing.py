from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import billing as ops
from tidemark.sources import ndjson

EVENTS = "event_id string, tenant string, account_id string, ts_nanos long, units long, unit_price long, plan_id string, metadata string"
PLANS = "plan_id string, plan_price long, unit string"
ACCOUNTS = "tenant string, account_id string, credit long"


def _frames(spark, events, credit=100):
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame([("t", "a", credit), ("t", "b", credit)], ACCOUNTS), spark.createDataFrame([("basic", 7, "token")], PLANS)


def test_prices_and_rejects(spark):
    big = 2**62
    events, accounts, plans = _frames(
        spark,
        [("1", "t", "a", 1, 3, 0, "basic", None), ("2", "t", "a", 2, 3, 5, "none", None), ("3", "t", "a", 3, 1, 0, "none", None), ("4", "t", "x", 4, 1, 1, None, None), ("5", "t", "a", 5, 0, 1, None, None), ("6", "t", "a", 6, big, 4, None, None), ("7", None, "a", 6, 1, 4, None, None)],
    )
    cost = {r["event_id"]: r["cost"] for r in ops.priced(events, plans).collect()}
    assert cost["1"] == 21 and cost["2"] == 15 and cost["3"] is None and cost["6"] is None
    reasons = {r["event_id"]: r["reason"] for r in ops.reject_reasons(events, accounts, plans).collect()}
    assert reasons == {"3": "price_plan_not_found", "4": "account_not_found", "5": "invalid", "6": "overflow", "7": "invalid"}


def test_an_event_is_booked_once_over_all_tenants(spark):
    events, accounts, plans = _frames(spark, [("1", "t", "a", 1, 1, 5, None, None), ("1", "t", "a", 1, 1, 5, None, None), ("1", "t", "b", 2, 1, 5, None, None)])
    rows = ops.booked_ledger(ops.bookable(events, accounts, plans)).collect()
    assert [(r["event_id"], r["account_id"], r["balance_after"]) for r in rows] == [("1", "a", 95)]
    held = spark.createDataFrame([("1",)], "event_id string")
    assert ops.bookable(events, accounts, plans, held).count() == 0
    assert ops.import_stats(events, held).head().asDict() == {"imported": 0, "skipped": 3}


def test_the_gate_and_the_chain_are_a_fold(spark):
    rng = random.Random(3)
    events = [(str(i), "t", rng.choice("ab"), rng.randrange(50) + ops.DAY * rng.randrange(3), rng.randrange(1, 9), rng.randrange(1, 9), None, None) for i in range(60)]
    frame, accounts, plans = _frames(spark, events)
    got = {r["event_id"]: (r["booked"], r["balance_after"], r["hash"]) for r in ops.booked_ledger(ops.bookable(frame, accounts, plans)).collect()}
    want = {}
    for account in "ab":
        balance, last = 100, ""
        for e in sorted((e for e in events if e[2] == account), key=lambda e: (e[3], e[0])):
            cost = e[4] * e[5]
            if cost <= balance:
                balance -= cost
                last = hashlib.sha256(f"{e[0]}|t|{account}|{e[3]}|{e[4]}|{e[5]}|{cost}|{last}".encode()).hexdigest()
                want[e[0]] = (True, balance, last)
            else:
                want[e[0]] = (False, balance, None)
    assert got == want
    checked = ops.verify_chain(ops.booked_ledger(ops.bookable(frame, accounts, plans))).collect()
    assert all(r["linked"] and r["sealed"] for r in checked)
    free = ops.booked_ledger(ops.bookable(frame, accounts, plans), allow_overdraft=True)
    running = {r["event_id"]: r["balance_after"] for r in ops.running_balance(ops.bookable(frame, accounts, plans)).collect()}
    assert {r["event_id"]: r["balance_after"] for r in free.collect()} == running


def test_attempts_follow_each_other(spark):
    """A failed attempt leaves no trace; the first that the balance covers books the id, at its own price and plan."""
    rows = [
        ("1", "t", "x", 1, 1, 5, None, "unknown"), ("1", "t", "a", 2, 1, 5, None, "known"), ("1", "t", "a", 3, 1, 6, None, "late"),
        ("2", "t", "a", 4, 1, 500, None, "dear"), ("2", "t", "a", 5, 1, 400, None, "less dear"), ("2", "t", "a", 6, 3, 0, "basic", "fits"), ("2", "t", "b", 7, 1, 1, None, "elsewhere"),
        ("3", "t", "b", 8, 1, 60, None, "one"), ("4", "t", "b", 9, 1, 60, None, "two"), ("4", "t", "b", 10, 1, 60, None, "same again"),
    ]
    events, accounts, plans = _frames(spark, rows)
    found = ops.booked_ledger(ops.bookable(events, accounts, plans), carry=("metadata", "unit")).collect()
    assert sorted((r["event_id"], r["metadata"], r["unit"], r["booked"], r["balance_after"], r["reason"]) for r in found) == [
        ("1", "known", None, True, 95, None), ("2", "dear", None, False, 95, "insufficient_credits"), ("2", "fits", "token", True, 74, None),
        ("2", "less dear", None, False, 95, "insufficient_credits"), ("3", "one", None, True, 40, None), ("4", "two", None, False, 40, "insufficient_credits"),
    ]


def test_overdraft_ends_where_a_long_does(spark):
    big = 2**62
    events, accounts, plans = _frames(spark, [(str(k), "t", "a", k, big, 1, None, None) for k in range(4)] + [("b", "t", "b", 1, 1, 1, None, None)], credit=0)
    rows = {r["event_id"]: (r["booked"], r["balance_after"], r["reason"]) for r in ops.booked_ledger(ops.bookable(events, accounts, plans), allow_overdraft=True).collect()}
    assert rows == {"0": (True, -big, None), "1": (True, -2 * big, None), "2": (False, -2 * big, "overflow"), "3": (False, -2 * big, "overflow"), "b": (True, -1, None)}


def test_a_changed_event_breaks_the_chain(spark):
    events, accounts, plans = _frames(spark, [(str(k), "t", "a", k, 1, 1, None, None) for k in range(5)])
    ledger = ops.booked_ledger(ops.bookable(events, accounts, plans))
    for column, value, linked, sealed in (("units", 9, {0, 1, 2, 3, 4}, {0, 1, 3, 4}), ("hash", "0", {0, 1, 2, 4}, {0, 1, 3, 4}), ("prev_hash", "0", {0, 1, 3, 4}, {0, 1, 3, 4})):
        changed = ledger.withColumn(column, F.when(F.col("event_id") == "2", F.lit(value)).otherwise(F.col(column)))
        checked = ops.verify_chain(changed).collect()
        assert {int(r["event_id"]) for r in checked if r["linked"]} == linked and {int(r["event_id"]) for r in checked if r["sealed"]} == sealed
    assert {int(r["event_id"]): r["linked"] for r in ops.verify_chain(ledger.where("event_id <> '2'")).collect()}[3] is False


def test_empty_ledger(spark):
    events, accounts, plans = _frames(spark, [])
    assert ops.booked_ledger(ops.bookable(events, accounts, plans)).count() == 0
    assert {r["balance"] for r in ops.balances(ops.bookable(events, accounts, plans), accounts).collect()} == {100}


def test_pages_follow_a_position(spark):
    events, _, _ = _frames(spark, [(str(i), "t", "a", i // 2, 1, 1, None, None) for i in range(6)])
    first = ops.account_events(events, "t", "a", limit=3).collect()
    after = ops.account_events(events, "t", "a", limit=9, after=(first[-1]["ts_nanos"], first[-1]["event_id"])).collect()
    assert [r["event_id"] for r in first + after] == [str(i) for i in range(6)]


def test_export_returns_as_it_was(spark, tmp_path):
    events, _, _ = _frames(spark, [("1", "t", "a", 1_700_000_000_123_456_789, 3, 0, "basic", '{"k":1}'), ("2", "t", "b", 5, 1, 2, None, None), ("3", "t", "b", 1_699_999_999_999_999_999, 1, 2, None, None), ("4", "t", "b", 951_782_399_999_999_999, 1, 2, None, None)])
    ndjson.write_events(events, f"{tmp_path}/out")
    (tmp_path / "out" / "cursor.txt").write_text('\n{"type":"cursor","next":"x"}\n')
    lines = {r["line"] for r in ndjson.event_lines(events).select("line").collect()}
    assert any('"timestamp":"2023-11-14T22:13:19.999999999Z"' in x for x in lines) and any('"timestamp":"2000-02-28T23:59:59.999999999Z"' in x for x in lines)
    back = ndjson.read_events(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, back.select(*events.columns).collect())) == sorted(map(tuple, events.collect()))


def test_malformed_lines_fail_or_are_invalid(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id":"1","tenant":"t","account_id":"a","timestamp":"1970-01-01T00:00:00.000000007Z","units":1}\n{"id": 2, broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        ndjson.read_events(spark, f"{tmp_path}/in.json").collect()
    rows = ndjson.read_events(spark, f"{tmp_path}/in.json", strict=False)
    assert sorted(str(r["event_id"]) for r in rows.collect()) == ["1", "None"]
    assert rows.where(ops.valid(rows)).count() == 1
