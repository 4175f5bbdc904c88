"""Ledger: accounts, credits, price plans and usage over one versioned table.

All rows, of every kind, are in one table, so that one manifest is the only
commit point: a batch is booked as a whole or not at all.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import AccountNotFound, Conflict, InvalidArgument, OutOfRange, PricePlanNotFound
from tidemark.operators import billing
from tidemark.sources.table_store import TableStore

ENTRIES = (
    "kind string, id string, tenant string, account_id string, ts_nanos long, units long, unit_price long, plan_id string, price long, cost long, "
    "amount long, balance_after long, prev_hash string, hash string, unit string, metadata string, version long"
)
EVENT = ("event_id", "tenant", "account_id", "ts_nanos", "units", "unit_price", "plan_id", "metadata")


def now_nanos() -> int:
    return time.time_ns()


class Ledger:
    """Usage billing in whole numbers, with ids that are booked once and a hash chain for each account."""

    def __init__(self, spark: SparkSession, path: str, *, allow_overdraft: bool = False):
        self.spark, self.allow_overdraft = spark, allow_overdraft
        self.table = TableStore(spark, path, ENTRIES)

    def _rows(self, kind: str, version: int | None = None) -> DataFrame:
        return self.table.read(version).where(F.col("kind") == kind)

    def _full(self, rows: DataFrame, base: int) -> DataFrame:
        """Rows with all columns of the table, null where they have none."""
        have = set(rows.columns)
        fields = [f.split() for f in ENTRIES.split(", ")]
        return rows.withColumn("version", F.lit(base + 1).cast("long")).select(*(F.col(n) if n in have or n == "version" else F.lit(None).cast(t).alias(n) for n, t in fields))

    def _append(self, base: int, *frames: DataFrame) -> int:
        parts = [self.table.stage(self._full(f, base)) for f in frames]
        return self.table.commit(base, [*self.table.manifest(base)["parts"], *parts])

    def _one(self, **values) -> DataFrame:
        types = dict(f.split() for f in ENTRIES.split(", "))
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[k]}" for k in values)).coalesce(1)

    # -- accounts ------------------------------------------------------------------------------

    def create_account(self, tenant: str, account_id: str, metadata: str | None = None) -> int:
        if not tenant or not account_id:
            raise InvalidArgument("tenant and account need a name")
        base = self.table.version()
        if self._account(tenant, account_id, base):
            raise Conflict(f"account {tenant}/{account_id} exists")
        return self._append(base, self._one(kind="account", id=account_id, tenant=tenant, account_id=account_id, ts_nanos=now_nanos(), metadata=metadata))

    def load_accounts(self, accounts: DataFrame) -> int:
        """Open the accounts of a DataFrame (tenant, account_id, credit) that do not exist, with their credit, in one version."""
        base = self.table.version()
        new = accounts.dropDuplicates(list(billing.ACCOUNT)).join(self._rows("account", base).select(*billing.ACCOUNT), list(billing.ACCOUNT), "left_anti")
        kinds = F.when(F.col("credit") > 0, F.array(F.lit("account"), F.lit("credit"))).otherwise(F.array(F.lit("account")))
        opened = new.select(F.explode(kinds).alias("kind"), F.col("account_id").alias("id"), *billing.ACCOUNT, "credit")
        return self._append(base, opened.withColumn("amount", F.when(F.col("kind") == "credit", F.col("credit"))).drop("credit"))

    def _account(self, tenant: str, account_id: str, version: int):
        return self._rows("account", version).where((F.col("tenant") == tenant) & (F.col("account_id") == account_id)).head()

    def get_account(self, tenant: str, account_id: str):
        row = self._account(tenant, account_id, self.table.version())
        if row is None:
            raise AccountNotFound(f"{tenant}/{account_id}")
        return row

    def credit_account(self, tenant: str, account_id: str, amount: int) -> int:
        """Add credit, unless the balance would leave a long; credits are rows of the ledger, so that balances can be rebuilt."""
        if amount <= 0:
            raise InvalidArgument("amount must be above 0")
        base = self.table.version()
        if self.balance(tenant, account_id, base) + amount >= 1 << 63:
            raise OutOfRange(f"credit of {amount}")
        return self._append(base, self._one(kind="credit", id=account_id, tenant=tenant, account_id=account_id, ts_nanos=now_nanos(), amount=amount))

    def balances(self, version: int | None = None) -> DataFrame:
        """Rows (tenant, account_id, balance, last_hash) of all accounts: one aggregation over the table."""
        rows = self.table.read(version).where(F.col("kind").isin("account", "credit", "usage"))
        change = F.when(F.col("kind") == "credit", F.col("amount")).when(F.col("kind") == "usage", -F.col("cost")).otherwise(F.lit(0))
        # The chain follows the order of booking: by version, then by time within a batch.
        last = F.max_by(F.col("hash"), F.when(F.col("kind") == "usage", F.struct("version", "ts_nanos", "id")))
        found = rows.groupBy(*billing.ACCOUNT).agg(F.sum(change.cast("decimal(38,0)")).cast("long").alias("balance"), F.coalesce(last, F.lit("")).alias("last_hash"), F.count_if(F.col("kind") == "account").alias("n"))
        return found.where("n > 0").drop("n")

    def balance(self, tenant: str, account_id: str, version: int | None = None) -> int:
        row = self.balances(version).where((F.col("tenant") == tenant) & (F.col("account_id") == account_id)).head()
        if row is None:
            raise AccountNotFound(f"{tenant}/{account_id}")
        return row["balance"]

    # -- price plans ---------------------------------------------------------------------------

    def put_price_plan(self, plan_id: str, unit_price: int, unit: str = "") -> int:
        if not plan_id or unit_price <= 0:
            raise InvalidArgument("a plan needs an id and a price above 0")
        return self._append(self.table.version(), self._one(kind="plan", id=plan_id, price=unit_price, unit=unit, ts_nanos=now_nanos()))

    def price_plans(self, version: int | None = None) -> DataFrame:
        last = self._rows("plan", version).groupBy("id").agg(F.max_by(F.struct("price", "unit"), "version").alias("p"))
        return last.select(F.col("id").alias("plan_id"), F.col("p.price").alias("plan_price"), F.col("p.unit").alias("unit"))

    def get_price_plan(self, plan_id: str):
        row = self.price_plans().where(F.col("plan_id") == plan_id).head()
        if row is None:
            raise PricePlanNotFound(plan_id)
        return row

    # -- usage ---------------------------------------------------------------------------------

    def record_usage(self, events: DataFrame, *, stop_at_error: bool = False) -> dict:
        """Book a batch of events (the columns ``EVENT``); returns how many were imported, skipped and rejected.

        An id that is booked already, or that comes again after it was
        booked, is skipped. A missing time is that of the call. Events are
        booked in the order of (ts_nanos, event_id) of the batch, one attempt
        after the other, see ``billing.attempts``; ``rejects`` tells why
        others are not. With ``stop_at_error`` only what comes before the
        first failing event of that order is booked.
        """
        base, at = self.table.version(), now_nanos()
        incoming = self._timed(events, at).select(*EVENT)
        usage = self._rows("usage", base).select(F.col("id").alias("event_id"))
        accounts = self.balances(base).withColumnRenamed("balance", "credit")
        plans = self.price_plans(base)
        ready = billing.bookable(incoming, self._rows("account", base).select(*billing.ACCOUNT), plans, usage)
        ready = ready.join(accounts.select(*billing.ACCOUNT, "credit", "last_hash"), list(billing.ACCOUNT))
        tried = billing.booked_ledger(ready, allow_overdraft=self.allow_overdraft, carry=("unit_price", "plan_id", "unit", "metadata"))
        rows = tried.where("booked")
        if stop_at_error:
            failed = billing.reject_reasons(incoming.join(usage, "event_id", "left_anti"), accounts, plans, "ts_nanos").select("ts_nanos", "event_id")
            first = failed.unionByName(tried.where("not booked").select("ts_nanos", "event_id")).agg(F.min(F.struct("ts_nanos", "event_id")).alias("p")).head()["p"]
            if first is not None:
                rows = rows.where(F.struct("ts_nanos", "event_id") < F.struct(F.lit(first["ts_nanos"]).alias("ts_nanos"), F.lit(first["event_id"]).alias("event_id")))
        part = self.table.stage(self._full(rows.withColumnsRenamed({"event_id": "id"}).withColumn("kind", F.lit("usage")), base))
        self.table.commit(base, [*self.table.manifest(base)["parts"], part])
        # From here on only what was written is read: the ledger is not booked again to be counted.
        booked = self._rows("usage", base + 1).select(F.col("id").alias("event_id"), F.when(F.col("version") == base + 1, F.struct("ts_nanos", *billing.ACCOUNT)).alias("booked_at"), F.lit(True).alias("held"))
        found = incoming.select("event_id", F.struct("ts_nanos", *billing.ACCOUNT).alias("tried_at")).join(booked, "event_id", "left")
        # Attempts of an id before the one that was booked failed; later ones were skipped.
        counts = found.agg(F.count("*").alias("total"), F.count("held").alias("held"), F.count_if(F.col("tried_at") < F.col("booked_at")).alias("earlier")).head()
        imported = self.table.read_parts([part]).count()
        skipped = counts["held"] - imported - counts["earlier"]
        return {"imported": imported, "skipped": skipped, "rejected": counts["total"] - imported - skipped}

    @staticmethod
    def _timed(events: DataFrame, at: int) -> DataFrame:
        return events.withColumn("ts_nanos", F.coalesce("ts_nanos", F.lit(at)))

    def rejects(self, events: DataFrame) -> DataFrame:
        """Rows (event_id, reason) of events that are not booked: a failed check, or ``insufficient_credits``."""
        plans, accounts = self.price_plans(), self.balances()
        reasons = billing.reject_reasons(self._timed(events, now_nanos()), accounts, plans)
        missing = events.select("event_id").distinct().join(self._rows("usage").select(F.col("id").alias("event_id")), "event_id", "left_anti")
        short = missing.join(reasons, "event_id", "left_anti").withColumn("reason", F.lit("insufficient_credits"))
        return reasons.join(missing, "event_id", "left_semi").distinct().unionByName(short)

    def usage(self, version: int | None = None) -> DataFrame:
        """Booked events with cost, balance after and hashes."""
        columns = ("tenant", "account_id", "ts_nanos", "units", "unit_price", "plan_id", "price", "cost", "balance_after", "prev_hash", "hash", "metadata")
        return self._rows("usage", version).select(F.col("id").alias("event_id"), *columns)

    def list_usage(self, tenant: str, account_id: str, *, limit: int, after: tuple[int, str] | None = None) -> list:
        return billing.account_events(self.usage(), tenant, account_id, limit=limit, after=after).collect()

    def export(self, tenant: str = "", *, limit: int | None = None, after: tuple | None = None) -> DataFrame:
        return billing.export_events(self.usage(), tenant, limit=limit, after=after)

    def verify(self) -> DataFrame:
        """Rows (event_id, linked, sealed), in the order of booking."""
        rows = self._rows("usage").select(F.col("id").alias("event_id"), "tenant", "account_id", "ts_nanos", "units", "price", "cost", "prev_hash", "hash", "version", F.lit(True).alias("booked"))
        return billing.verify_chain(rows, order=("version", *billing.ORDER))
