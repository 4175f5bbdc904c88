from __future__ import annotations

import pytest
from oracle import connect, same_rows

import __spark_entry__ as entry_point
from conftest import TESTDATA
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect(str(TESTDATA))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_its_sql(spark, con, name):
    same_rows(catalog.QUERIES[name](spark, str(TESTDATA)), catalog.ORACLES[name], con)


def test_every_name_of_the_oracles_is_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_stream_books_what_the_batch_books(spark):
    """One batch of files: the stream's bookings are those of the batch ledger."""
    columns = ["event_id", "booked", "balance_after"]
    batch = catalog.QUERIES["bill_gated_ledger"](spark, str(TESTDATA)).select(*columns)
    stream = catalog.QUERIES["stream_gated_ledger"](spark, str(TESTDATA)).select(*columns)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_reject_reasons_of_events_that_use_nothing(spark, tmp_path):
    """The query looks up accounts and prices only, in that order, whatever an event uses."""
    customer = connect(str(TESTDATA)).execute("select min(c_custkey) from customer").fetchone()[0]
    kinds = [(user, kind, value) for user in (customer, 10**9, None) for kind in ("click", "error", None) for value in (0.0, 0.004, -3.0, None, 2.0)]
    rows = ", ".join(f"({k + 1}::BIGINT, TIMESTAMP '2024-01-01', {user or 'NULL'}::BIGINT, {repr(kind) if kind else 'NULL'}::VARCHAR, {'NULL' if v is None else v}::DOUBLE, '{{}}')" for k, (user, kind, v) in enumerate(kinds))
    odd = connect(str(TESTDATA))
    odd.execute(f"copy (select * from (values {rows}) v(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    odd.execute(f"copy customer to '{tmp_path}/customer.parquet'")
    same_rows(catalog.QUERIES["bill_reject_reasons"](spark, str(tmp_path)), catalog.ORACLES["bill_reject_reasons"], connect(str(tmp_path)))
