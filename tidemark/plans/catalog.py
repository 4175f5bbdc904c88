"""All ledger and key-value queries and their DuckDB oracles."""

from tidemark.plans import billing, codecs, interfaces, kv, streams, transactions, vectors  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bill_balance"
