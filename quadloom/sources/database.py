"""Tables of a database over JDBC, read in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that a round trip fetches.
FETCH = 10_000


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, options: dict[str, str] | None = None) -> DataFrame:
    """A table, or a query in brackets with a name, as a DataFrame whose filters and columns reach the database.

    With an integer or date column `key` it is read by `parts` tasks, in equal ranges between the least and the greatest
    value, which the database is asked for; rows whose key is null are in the first part. Without one a single task reads all.
    """
    given = {"url": url, "fetchsize": str(FETCH), **(options or {})}
    if key and parts > 1:
        low, high = spark.read.format("jdbc").options(**given, query=f"SELECT MIN({key}) AS LEAST_KEY, MAX({key}) AS MOST_KEY FROM {table}").load().first()
        if low is not None:
            given |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**given, dbtable=table).load()
