"""Training-data pipeline operators.

Nothing else in the package imports this subpackage; ``queries.py`` holds the
thin ``opN_<name>`` queries and ``oracles.py`` their SQL.
"""
