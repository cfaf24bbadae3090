"""Connected components of links, by joins whose keys are pre-aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import connected


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) for each end of the links (a, b); component is the smallest id reachable.

    Rounds grow with the logarithm of the number of ids, whatever their order, and go on until no label changes. No list
    of neighbours is gathered. An empty table gives no rows.
    """
    return connected(links, rounds)
