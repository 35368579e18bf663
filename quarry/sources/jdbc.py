"""Tables of a database, read in ranges of a key.

A table is read by as many tasks as its rows ask for, each with one connection
and one range of the key between the smallest and the largest, which the
database itself is asked for. The outer ranges are open and the first takes
keys that are null, so rows that arrive meanwhile, or lack a key, are not lost.
Filters and column choices of later steps reach the database through Spark.

Ranges are equal in width, not in rows: choose a key whose values are spread, such
as the primary key. Ranges are read at different moments; a table that changes
meanwhile is read as it was at several of them.

Defined cases: an empty table, a table with one key or with null keys alone and
a table read without a key take one task; a key that is no column is an error.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from math import floor

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

#: Rows a task should read, connections open at a time, and rows a fetch brings.
ROWS, CONNECTIONS, FETCH = 1_000_000, 64, 10_000


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, options: Mapping[str, str] | None = None, rows: int = ROWS, connections: int = CONNECTIONS, quote: str = '"') -> DataFrame:
    """A table, in ranges of ``key`` (a number, date or timestamp) of about ``rows`` rows if that is given.

    ``options`` are those of Spark's JDBC source (user, password, driver, ...). The key is found
    whatever its case; ``quote`` is the mark the database puts around names.
    """

    def reader() -> DataFrameReader:
        return spark.read.format("jdbc").options(**{"url": url, "fetchsize": str(FETCH), **(options or {})})

    whole = reader().option("dbtable", table)
    if key is None:
        return whole.load()
    names = whole.load().columns
    name = next((c for c in (key, *names) if c in names and c.lower() == key.lower()), None)
    if name is None:
        raise ValueError(f"{table} has no column {key}")
    column = quote + name.replace(quote, quote * 2) + quote
    low, high, n = reader().option("query", f"SELECT MIN({column}) AS low_key, MAX({column}) AS high_key, COUNT(*) AS n_rows FROM {table}").load().first()
    parts = min(connections, -(-int(n) // rows))
    if parts < 2 or low is None or low == high:
        return whole.load()
    bound = lambda x: str(x) if isinstance(x, date) else str(floor(x))
    return whole.option("partitionColumn", column).option("lowerBound", bound(low)).option("upperBound", bound(high)).option("numPartitions", str(parts)).load()


def read_transactions(spark: SparkSession, url: str, table: str, **how) -> DataFrame:
    """(tid, item, quantity, probability) of a table with these columns, in any case and order, as the search takes them."""
    kinds = {"tid": "long", "item": "int", "quantity": "int", "probability": "double"}
    return read_table(spark, url, table, "tid", **how).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
