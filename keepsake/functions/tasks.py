"""Tasks of bounded size where the session's number of shuffle partitions does not follow the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts by key: some 150 MB of its memory where they are a few numbers.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df, dealt out by keys to as many tasks as its rows need, if the session's shuffles have fewer; rows: how many there are, if known, else they are counted."""
    n = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
