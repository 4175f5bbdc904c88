from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.engine import Engine
from tidemark.errors import Conflict, InvalidArgument, KeyNotFound, LimitExceeded, ValueTooLarge
from tidemark.functions.codec import prefix_end
from tidemark.operators import maintenance, state, transactions

LOG = "seq long, key binary, op string, value binary"
keys = st.binary(min_size=0, max_size=3)


def _log(spark, ops):
    rows = [(i, bytearray(k), "put" if v is not None else "delete", None if v is None else bytearray(v)) for i, (k, v) in enumerate(ops)]
    return spark.createDataFrame(rows, LOG)


def _model(ops):
    held = {}
    for k, v in ops:
        held.pop(k, None)
        if v is not None:
            held[k] = v
    return held


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(keys, st.one_of(st.none(), st.binary(max_size=4))), max_size=25), keys, st.integers(1, 4))
def test_pages_are_those_of_a_dict(spark, ops, prefix, limit):
    log, held = _log(spark, ops), _model(ops)
    want = sorted((k, v) for k, v in held.items() if k.startswith(prefix))
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in state.live(log).collect()) == sorted(held.items())
    got, cursor, pages = [], b"", 0
    while True:
        rows, after = state.scan(log, state.ScanRequest(limit, prefix, bytearray(cursor)))
        got += [(bytes(r["key"]), bytes(r["value"])) for r in rows]
        pages += 1
        if after is None:
            break
        cursor = bytes(after)
    # the empty key sorts before every cursor, and only the first page can hold it
    assert got == want
    assert pages <= max(1, -(-len(want) // limit))


def test_prefix_end():
    assert prefix_end(b"ab") == b"ac"
    assert prefix_end(b"a\xff") == b"b"
    assert prefix_end(b"\xff\xff") is None
    assert prefix_end(b"") is None


def test_request_checks():
    with pytest.raises(InvalidArgument):
        state.ScanRequest(0).validate()
    with pytest.raises(InvalidArgument):
        state.ScanRequest(1, max_value_bytes=0).validate()


def test_engine_puts_reads_and_deletes(spark, tmp_path):
    db = Engine(spark, f"file://{tmp_path}/kv")
    db.put(b"alpha", b"one")
    with db.transaction() as t:
        t.put(b"beta", b"two")
        t.put(b"beta", b"three")
        t.put(b"gone", b"x")
        t.delete(b"gone")
    assert db.get(b"beta") == b"three"
    with pytest.raises(KeyNotFound):
        db.get(b"gone")
    before = db.table.version()
    with pytest.raises(KeyNotFound), db.transaction() as t:
        t.put(b"delta", b"4")
        t.delete(b"missing")
    assert db.table.version() == before
    rows, cursor = db.scan(b"", limit=1)
    assert [bytes(r["key"]) for r in rows] == [b"alpha"] and bytes(cursor) == b"alpha"
    with pytest.raises(ValueTooLarge):
        db.scan(b"beta", max_value_bytes=3)


def test_compaction_keeps_the_order_of_writes(spark, tmp_path):
    """Rows keep their seq, so that a rewritten old value never hides a newer one; readers keep their version."""
    db = Engine(spark, f"file://{tmp_path}/kv")
    db.put(b"a", b"1")
    db.put(b"b", b"1")
    db.put(b"a", b"2")
    db.delete(b"b")
    pinned = db.table.version()
    with pytest.raises(LimitExceeded):
        db.compact(max_entries=2)
    assert db.compact() == {"total": 4, "written": 1, "bytes_before": 7, "bytes_after": 2}
    db.put(b"a", b"3")
    assert db.get(b"a") == b"3"
    assert [bytes(r["value"]) for r in db.state(pinned).collect()] == [b"2"]
    with pytest.raises(Conflict):
        db.table.commit(pinned, [])
    db.snapshot(f"file://{tmp_path}/copy")
    assert Engine(spark, f"file://{tmp_path}/copy").get(b"a") == b"3"
    assert db.table.sweep(db.table.version())
    assert db.get(b"a") == b"3"


def test_flush_batches_of_nothing(spark):
    log = spark.createDataFrame([], "seq long, key string, op string, value string")
    assert maintenance.flush_batches(log).count() == 0


def test_oldest_parts_are_merged_and_backed_up(spark, tmp_path):
    db = Engine(spark, f"file://{tmp_path}/kv")
    db.load(spark.createDataFrame([(bytearray(bytes([k])), bytearray(b"0")) for k in range(6)], "key binary, value binary"))
    db.delete(b"\x00")
    db.put(b"\x01", b"1")
    db.put(b"\x02", b"2")
    with pytest.raises(LimitExceeded):
        db.merge_oldest(3, max_entries=7)
    assert db.merge_oldest(3, rows_per_file=2)["total"] == 8
    assert len(db.table.manifest()["parts"]) == 2
    held = {bytes(r["key"]): bytes(r["value"]) for r in db.state().collect()}
    assert held == {bytes([k]): {1: b"1", 2: b"2"}.get(k, b"0") for k in range(1, 6)}
    record = db.backup(f"file://{tmp_path}/saved")
    assert (record["entries"], record["log_rows"]) == (5, 6)
    for part in ("snapshot", "log"):
        copy = Engine(spark, f"file://{tmp_path}/saved/{part}")
        assert {bytes(r["key"]): bytes(r["value"]) for r in copy.state().collect()} == held
    assert spark.read.json(f"file://{tmp_path}/saved/backup").head()["version"] == record["version"]


def test_long_scans_go_page_by_page(spark):
    log = _log(spark, [(bytes([k]), b"v") for k in range(20)] + [(bytes([3]), None)])
    rows = list(state.stream_pages(log, state.ScanRequest(15), page_rows=4))
    assert [bytes(r["key"])[0] for r in rows] == [k for k in range(20) if k != 3][:15]


def test_a_log_is_validated_against_all_that_came_before(spark):
    """Whatever the blocks that a key is split into."""
    rng = random.Random(6)
    ops = [(seq, seq // 3, rng.choice("aab"), rng.choice(["put", "delete"])) for seq in range(60)]
    frame = spark.createDataFrame(ops, "seq long, txn_id long, key string, op string")
    want, last = {}, {}
    for _, t, key, op in ops:
        bad = op == "delete" and last.get(key, "delete") == "delete"
        want[t] = want.get(t, 0) + bad
        last[key] = op
    for block in (1, 7, 1 << 20):
        got = {r["txn_id"]: (r["bad_deletes"], r["status"]) for r in transactions.validate_log(frame, block=block).collect()}
        assert got == {t: (n, "aborted" if n else "committed") for t, n in want.items()}
