"""Sources: from stores, files and exports to the tables of the ledger.

A source takes DataFrames of raw rows (from JDBC, Parquet, JSON, text or binary files) and gives
a dict of ledger tables. `read` of each module loads the raw rows with Spark's own readers.
"""
