"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that can be reached.

    In each round every node hangs on its smallest neighbour, chains are halved until all hang on a root, and the links
    are redrawn between roots: loops and repeats go, so a round has fewer links than the one before. Rounds are written
    tables, and only whether anything is left comes to the driver.
    """
    ends = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    edges = written(links.select(*ends).distinct(), "edges")
    ids = edges.select(F.col("lo").alias("id")).union(edges.select("hi")).distinct()
    labels = written(ids.withColumn("component", F.col("id")), "labels")
    edges = edges.where("lo < hi")
    while not edges.isEmpty():
        roots = _roots(written(edges.groupBy("hi").agg(F.min("lo").alias("up")), "hooks"))
        now = written(labels.join(roots.withColumnRenamed("hi", "component"), "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
        # A node's link to the neighbour that it hangs on has done its work.
        rest = edges.join(roots, "hi").where("lo <> up").select("lo", F.col("root").alias("other"))
        rest = rest.join(roots.select(F.col("hi").alias("lo"), F.col("root").alias("low")), "lo", "left").select(F.coalesce("low", "lo").alias("a"), F.col("other").alias("b")).where("a <> b")
        more = written(rest.select(*ends).distinct(), "edges")
        dropped(edges, roots, labels)
        edges, labels = more, now
    return labels


def _roots(hooks: DataFrame) -> DataFrame:
    """hi, up and root of each node of a forest (hi, up), in which a parent is smaller than its child."""
    found = written(hooks.withColumn("root", F.col("up")), "roots")
    while True:
        steps = found.select(F.col("hi").alias("mid"), F.col("root").alias("far"))
        deeper = written(found.select(F.col("root").alias("mid")).distinct().join(steps, "mid"), "deeper")
        if deeper.isEmpty():
            dropped(hooks, deeper)
            return found
        now = written(found.join(deeper, F.col("root") == F.col("mid"), "left").select("hi", "up", F.coalesce("far", "root").alias("root")), "roots")
        dropped(found, deeper)
        found = now


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after more links (a, b) between their ids; only the links between components are followed."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"component_{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("component_a <> component_b")
    joined = components(between.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
    joined = joined.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("smaller"))
    return written(labels.join(joined, "component", "left").select("id", F.coalesce("smaller", "component").alias("component")), "labels")
