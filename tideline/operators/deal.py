"""How many tasks a table is dealt out to: as many as its rows ask for, so that what one task holds doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task, about; a row in a sort or a hash table takes some 400 bytes.
ROWS_PER_TASK = 500_000


def tasks(rows: DataFrame) -> int:
    """One for each ROWS_PER_TASK of rows, and at least as many as there are cores."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, 1 + rows.count() // ROWS_PER_TASK)
