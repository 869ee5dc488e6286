"""How tables that may be as large as the graph are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the code base: it is shuffled, never broadcast.

    Spark guesses a table's size from its compressed files and counts no rows that an explode adds, so it took nodes and edges of a large graph for small ones and sent them through the driver.
    """
    return side.hint("merge")
