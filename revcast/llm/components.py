"""Connected components of links between ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every id in ``links`` (``a``, ``b``); a component is named by its smallest id.

    Each round lowers an id's label to the smallest of its neighbours' labels and
    of the label of its own label, so labels run along chains in growing steps.
    A round is one job that writes the labels; only whether any changed reaches
    the driver.  An id with any number of links is a group that is reduced before
    the shuffle.
    """
    both = written(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct().toDF("node", "other"), "links"
    )
    first = both.groupBy("node").agg(F.min("other").alias("low"))
    labels = written(first.select("node", F.least("node", "low").alias("component"), F.lit(True).alias("changed")), "labels")
    while not labels.filter("changed").isEmpty():
        own = labels.select("node", F.col("component").alias("old"), F.col("component").alias("low"))
        of = labels.select(F.col("node").alias("of"), F.col("component").alias("low"))
        none = F.lit(None).cast("long").alias("old")
        near = both.join(of, F.col("other") == F.col("of")).select("node", none, "low")
        further = own.drop("low").join(of, F.col("old") == F.col("of")).select("node", none, "low")
        lowered = own.unionByName(near).unionByName(further).groupBy("node").agg(F.max("old").alias("old"), F.min("low").alias("component"))
        before, labels = labels, written(lowered.select("node", "component", (F.col("component") < F.col("old")).alias("changed")), "labels")
        forget(before)
    forget(both)
    return labels.select("node", "component")
