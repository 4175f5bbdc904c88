"""The ledger as a stream: idempotent, gated bookings with a state per account."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.billing import ACCOUNT, chain_input, priced, valid

BOOKED = "event_id string, tenant string, account_id string, ts_nanos long, cost long, booked boolean, balance_after long, prev_hash string, hash string"
STATE = "balance long, last string"


def _book(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tenant, account = key
    balance, last = state.get if state.exists else (None, "")
    # Within a batch an account's events are booked in the order of their time.
    rows = pd.concat(list(frames)).sort_values(["ts_nanos", "event_id"])
    out = []
    for r in rows.itertuples(index=False):
        balance = int(r.credit) if balance is None else balance
        if r.cost <= balance:
            balance -= int(r.cost)
            h = hashlib.sha256(chain_input(r.event_id, tenant, account, r.ts_nanos, r.units, r.price, r.cost, last).encode()).hexdigest()
            out.append((r.event_id, tenant, account, r.ts_nanos, r.cost, True, balance, last, h))
            last = h
        else:
            out.append((r.event_id, tenant, account, r.ts_nanos, r.cost, False, balance, None, None))
    state.update((balance, last))
    yield pd.DataFrame(out, columns=[f.split()[0] for f in BOOKED.split(", ")])


def stream_ledger(events: DataFrame, accounts: DataFrame, plans: DataFrame) -> DataFrame:
    """Bookings of a stream of usage events, as they arrive.

    Rows without account or price leave no trace; of the others, an event
    id has one attempt, whatever its tenant, before rows are keyed by
    account. One that the balance does not cover is not tried again: unlike
    the batch ledger, which compares all attempts of an id. The ids are kept
    for good, as a ledger must know them; the state of an account is its
    balance and last hash.
    """
    known = events.where(valid(events)).join(accounts.select(*ACCOUNT, "credit"), list(ACCOUNT))
    rows = priced(known, plans).where("cost is not null").select("event_id", *ACCOUNT, "ts_nanos", "units", "price", "cost", "credit").dropDuplicates(["event_id"])
    return rows.groupBy(*ACCOUNT).applyInPandasWithState(_book, BOOKED, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_usage(events: DataFrame, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Units and events by tenant and tumbling window of event time; rows later than ``late`` are dropped."""
    timed = events.withColumn("event_time", F.timestamp_micros(F.expr("ts_nanos div 1000")))
    return timed.withWatermark("event_time", late).groupBy("tenant", F.window("event_time", window).alias("w")).agg(F.sum("units").alias("units"), F.count("*").alias("n"))
