"""The usage ledger: prices, idempotency, overdraft gate, balances and hash chains.

Amounts are whole numbers. An event that cannot be booked goes to the
rejects with a reason and leaves no trace in the ledger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import nanos_key, path_key

ACCOUNT = ("tenant", "account_id")
#: The order in which an account's events are booked.
ORDER = ("ts_nanos", "event_id")
#: Nanoseconds of a day.
DAY = 86_400_000_000_000


def valid(events: DataFrame) -> Column:
    """Events that name themselves, their tenant and account, and use something."""
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return named("event_id") & named("tenant") & named("account_id") & F.coalesce(F.col("units") > 0, F.lit(False)) & F.coalesce(F.col("ts_nanos") >= 0, F.lit(False))


def first_events(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Each event id once, the earliest, and none that ``ledger`` holds. Ids are unique over all tenants.

    An aggregation with partial minima: copies of one event make no hot task.
    """
    rest = [c for c in events.columns if c != "event_id"]
    first = F.min_by(F.struct(*rest), F.struct("ts_nanos", "tenant", "account_id", "units"))
    rows = events.groupBy("event_id").agg(first.alias("e")).select("event_id", "e.*").select(*events.columns)
    return rows if ledger is None else rows.join(ledger.select("event_id"), "event_id", "left_anti")


def known_accounts(events: DataFrame, accounts: DataFrame) -> DataFrame:
    return events.join(accounts.select(*ACCOUNT), list(ACCOUNT), "left_semi")


def unknown_accounts(events: DataFrame, accounts: DataFrame) -> DataFrame:
    return events.join(accounts.select(*ACCOUNT), list(ACCOUNT), "left_anti")


def priced(events: DataFrame, plans: DataFrame) -> DataFrame:
    """``events`` with ``price``, ``cost`` and ``unit``: the event's own price if above 0, else its plan's.

    ``price`` is null without either; ``cost`` is null then and where the
    product would not fit a long.
    """
    joined = events.join(plans, "plan_id", "left")
    price = F.when(F.col("unit_price") > 0, F.col("unit_price")).otherwise(F.col("plan_price"))
    return joined.withColumn("price", price).withColumn("cost", F.try_multiply(F.col("units"), F.col("price")))


#: The checks of an event before its account's balance counts, in their order.
CHECKS = ("invalid", "account_not_found", "price_plan_not_found", "overflow")


def reject_reasons(events: DataFrame, accounts: DataFrame, plans: DataFrame, *carry: str, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """Rows (event_id, ``carry``, reason) of all events that fail one of ``checks``: the first that they fail, in the order of ``CHECKS``."""
    marked = priced(events, plans).join(accounts.select(*ACCOUNT, F.lit(True).alias("known")), list(ACCOUNT), "left")
    failed = dict(zip(CHECKS, (~valid(events), F.col("known").isNull(), F.col("price").isNull(), F.col("cost").isNull()), strict=True))
    reason = F.coalesce(*(F.when(failed[c], c) for c in CHECKS if c in checks))
    return marked.select("event_id", *carry, reason.alias("reason")).where("reason is not null")


def attempts(events: DataFrame) -> DataFrame:
    """The rows of priced ``events`` that may change the ledger, with ``again``: does their id have another such row?

    An id is booked once, by the first of its attempts that the balance
    covers; one that fails leaves no trace, so that a later one may succeed.
    As a balance only falls within a batch, an attempt counts only if it
    costs less than all earlier ones of its id. An id belongs to the account
    of its earliest attempt; rows of the same id at other accounts are
    repeats. Repeated rows are reduced by partial minima first, so that
    copies of one event make no hot task.
    """
    key = ("event_id", *ACCOUNT, "cost")
    rest = [c for c in events.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct("ts_nanos", *(c for c in rest if c != "ts_nanos")))
    rows = events.groupBy(*key).agg(first.alias("e")).select(*key, "e.*")
    turn = Window.partitionBy("event_id").orderBy("ts_nanos", *ACCOUNT, "cost")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    home = F.first(F.struct(*ACCOUNT)).over(turn)
    rows = rows.withColumn("mine", home == F.struct(*ACCOUNT)).withColumn("least", F.min("cost").over(before))
    rows = rows.where(F.col("mine") & (F.col("least").isNull() | (F.col("cost") < F.col("least")))).drop("mine", "least")
    return rows.withColumn("again", F.count("*").over(Window.partitionBy("event_id")) > 1).select(*events.columns, "again")


def bookable(events: DataFrame, accounts: DataFrame, plans: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Priced ``attempts`` that may be booked, with the ``credit`` of their account if ``accounts`` tells it; none whose id ``ledger`` holds.

    Rows without account, price or a cost that a long can hold fail before
    ids are compared, as they leave no trace.
    """
    rows = events.where(valid(events))
    if ledger is not None:
        rows = rows.join(ledger.select("event_id"), "event_id", "left_anti")
    known = accounts.select(*ACCOUNT, *(c for c in ("credit",) if c in accounts.columns))
    return attempts(priced(rows.join(known, list(ACCOUNT)), plans).where("cost is not null"))


def balances(bookings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows (tenant, account_id, balance): credit less booked cost, for every account."""
    spent = bookings.groupBy(*ACCOUNT).agg(F.sum(F.col("cost").cast("decimal(38,0)")).alias("spent"))
    joined = accounts.join(spent, list(ACCOUNT), "left")
    return joined.select(*ACCOUNT, (F.col("credit") - F.coalesce("spent", F.lit(0))).cast("long").alias("balance"))


def _block(order: tuple[str, ...]) -> Column:
    """A number that does not fall along ``order`` and parts a long account: the day, or the first column if that is no time."""
    return F.expr(f"ts_nanos div {DAY}") if order[0] == "ts_nanos" else F.col(order[0])


def running_balance(bookings: DataFrame) -> DataFrame:
    """``balance_after`` where overdraft is allowed: a running sum by account.

    Sums run within the days of an account, and a day starts from the sum of
    the account's earlier days: a hot account is split by its days.
    """
    rows = bookings.select("event_id", *ACCOUNT, "ts_nanos", "cost", "credit", _block(ORDER).alias("day"))
    days = rows.groupBy(*ACCOUNT, "day").agg(F.sum("cost").alias("spent"))
    earlier = Window.partitionBy(*ACCOUNT).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*ACCOUNT, "day", F.coalesce(F.sum("spent").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*ACCOUNT, "day").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("spent", F.sum("cost").over(within)).join(days, [*ACCOUNT, "day"])
    return summed.select("event_id", *ACCOUNT, "ts_nanos", "cost", (F.col("credit") - F.col("before") - F.col("spent")).alias("balance_after"))


def chain_input(event_id, tenant, account, nanos, units, price, cost, before) -> str:
    """What an event's hash is of; fields and order are fixed values."""
    return f"{event_id}|{tenant}|{account}|{nanos}|{units}|{price}|{cost}|{before}"


_BOOKED = "event_id string, tenant string, account_id string, ts_nanos long, units long, price long, cost long, booked boolean, balance_after long, prev_hash string, hash string, reason string"
#: The least long: a balance cannot fall below it.
LEAST = -(1 << 63)


def booked_ledger(bookings: DataFrame, *, allow_overdraft: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with its gate and hash chain: ``booked`` is false where the balance did not cover the cost, and ``reason`` tells why.

    Whether an event is booked depends on which were before, so that an
    account is a fold in order. Rows stream through a task in sorted order,
    with the state of one account at a time: memory does not grow with an
    account but for the ids of which it holds several ``attempts``; a hot one
    costs time in one task but nothing else. Attempts of an id that is booked
    by then give no row. Events that are not booked keep the balance and
    stand outside the chain. With a column ``last_hash``, the chain goes on
    from there. Columns in ``carry`` are those of the attempt itself.
    """
    columns = ("event_id", *ACCOUNT, "ts_nanos", "units", "price", "cost", "credit", "last_hash", "again")
    for name, default in (("last_hash", F.lit("")), ("again", F.lit(False))):
        if name not in bookings.columns:
            bookings = bookings.withColumn(name, default)
    rows = bookings.select(*columns, *carry).repartition(*ACCOUNT).sortWithinPartitions(*ACCOUNT, *ORDER, F.desc("cost"))
    names = [f.split()[0] for f in _BOOKED.split(", ")]
    types = [pa.string()] * 3 + [pa.int64()] * 4 + [pa.bool_(), pa.int64()] + [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, balance, last, done = None, 0, "", set()
        for batch in batches:
            out, kept = [], []
            for k, (e, t, a, ns, units, price, cost, credit, before, again) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
                if (t, a) != account:
                    account, balance, last, done = (t, a), credit, before, set()
                if again and e in done:
                    continue
                reason = "overflow" if balance - cost < LEAST else "insufficient_credits" if cost > balance and not allow_overdraft else None
                booked = reason is None
                prev = h = None
                if booked:
                    balance -= cost
                    prev, h = last, hashlib.sha256(chain_input(e, t, a, ns, units, price, cost, last).encode()).hexdigest()
                    last = h
                    if again:
                        done.add(e)
                kept.append(k)
                out.append((e, t, a, ns, units, price, cost, booked, balance, prev, h, reason))
            found = [pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], k) for k in types]
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(found + [batch.column(c).take(at) for c in carry], names=names + list(carry))

    extra = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, _BOOKED + extra)


def verify_chain(ledger: DataFrame, *, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows (event_id, linked, sealed) of booked events: does the link hold, does the hash match its fields?

    Links are compared within the blocks of an account, and its first one of
    a block to the last hash of the blocks before: a hot account is split.
    """
    booked = ledger.where("booked").withColumn("block", _block(order))
    ends = booked.groupBy(*ACCOUNT, "block").agg(F.max_by("hash", F.struct(*order)).alias("end"))
    ends = ends.select(*ACCOUNT, "block", F.lag("end").over(Window.partitionBy(*ACCOUNT).orderBy("block")).alias("carried"))
    before = F.lag("hash").over(Window.partitionBy(*ACCOUNT, "block").orderBy(*order))
    seal = F.sha2(F.concat_ws("|", "event_id", "tenant", "account_id", "ts_nanos", "units", "price", "cost", "prev_hash"), 256)
    marked = booked.withColumn("before", before).join(ends, [*ACCOUNT, "block"])
    return marked.select("event_id", (F.col("prev_hash") == F.coalesce("before", "carried", F.lit(""))).alias("linked"), (seal == F.col("hash")).alias("sealed"))


def price_snapshots(bookings: DataFrame) -> DataFrame:
    """Rows (event_id, plan_id, price, unit, captured_at): the price that each event was booked at."""
    own = F.col("unit_price") > 0
    return bookings.select("event_id", F.when(~own, F.col("plan_id")).alias("plan_id"), "price", F.when(~own, F.col("unit")).alias("unit"), F.col("ts_nanos").alias("captured_at"))


def account_events(events: DataFrame, tenant: str, account: str, *, limit: int, after: tuple[int, str] | None = None) -> DataFrame:
    """A page of an account's events in order of (ts_nanos, event_id), after a position."""
    rows = events.where((F.col("tenant") == tenant) & (F.col("account_id") == account))
    return _after(rows, ("ts_nanos", "event_id"), after).orderBy("ts_nanos", "event_id").limit(limit)


def export_events(events: DataFrame, tenant: str = "", *, limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """Events of a tenant, or of all, in order of (tenant, ts_nanos, event_id), after a position."""
    rows = events.where(F.col("tenant") == tenant) if tenant else events
    rows = _after(rows, ("tenant", "ts_nanos", "event_id"), after).orderBy("tenant", "ts_nanos", "event_id")
    return rows if limit is None else rows.limit(limit)


def _after(rows: DataFrame, columns: tuple[str, ...], position: tuple | None) -> DataFrame:
    if position is None:
        return rows
    return rows.where(F.struct(*columns) > F.struct(*(F.lit(x).alias(c) for c, x in zip(columns, position, strict=True))))


def import_stats(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row (imported, skipped): events that are new, and those that the ledger or an earlier row holds."""
    new = incoming.select("event_id").distinct().join(ledger.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("imported"))
    return incoming.agg(F.count("*").alias("n")).crossJoin(new).select("imported", (F.col("n") - F.col("imported")).alias("skipped"))


def event_keys(events: DataFrame) -> DataFrame:
    """Rows (event_id, event_key, account_event_key, entry_key): where a store of ordered keys holds an event."""
    stamp = nanos_key(F.col("ts_nanos"))
    return events.select(
        "event_id",
        path_key("event", F.col("tenant"), stamp, F.col("event_id")).alias("event_key"),
        path_key("acct_event", F.col("tenant"), F.col("account_id"), stamp, F.col("event_id")).alias("account_event_key"),
        path_key("entry", F.col("event_id")).alias("entry_key"),
    )


def fan_out(ledger: DataFrame) -> DataFrame:
    """Rows (event_id, op_idx, key, value): the puts that booking an event makes, in their order."""
    stamp = nanos_key(F.col("ts_nanos"))
    body = F.to_json(F.struct("event_id", "units", "price", "cost"))
    puts = [
        (path_key("event", F.col("tenant"), stamp, F.col("event_id")), body),
        (path_key("acct_event", F.col("tenant"), F.col("account_id"), stamp, F.col("event_id")), body),
        (path_key("entry", F.col("event_id")), F.to_json(F.struct("event_id", "cost", "balance_after"))),
        (path_key("bal", F.col("tenant"), F.col("account_id")), F.col("balance_after").cast("string")),
        (path_key("acct_hash", F.col("tenant"), F.col("account_id")), F.col("hash")),
        (path_key("price_snapshot", F.col("event_id")), F.col("price").cast("string")),
    ]
    ops = F.array(*(F.struct(F.lit(i).alias("op_idx"), k.alias("key"), v.alias("value")) for i, (k, v) in enumerate(puts)))
    return ledger.where("booked").select("event_id", F.explode(ops).alias("p")).select("event_id", "p.*")
