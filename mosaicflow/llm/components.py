"""Connected components of links between numbered nodes, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regions import contracted


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another: root is the smallest node of its component.

    links: two columns of integers, one row a link, in any direction and as often as may be; links to null are none. The links of a node of many, the hub
    of a star, are dealt over parts. An empty table of links gives an empty one.
    """
    a, b = links.columns
    return contracted(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
