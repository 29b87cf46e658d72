"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import tasks_for, written


def components(links: DataFrame) -> DataFrame:
    """For every node of ``links`` (a, b): node, component, the smallest node reachable from it.

    In each round a node goes under the neighbour of least rank, if that is less than its own, and that one's own choice is
    followed once more; what is left are links between the nodes so chosen.  Ranks are hashes, drawn anew each round, so
    no order of ids is long: at least some third of the nodes with links disappear in a round, on average.  Then the
    rounds are undone from the last, each for the nodes that it still had.  Self-links and repeated links are allowed.
    No links give an empty table.
    """
    rest = written(links.select("a", "b").distinct(), "links")
    tasks = tasks_for(rest.count())
    nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    rest, steps = rest.where("a <> b"), []
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        ranked = lambda c, turn=len(steps): F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("node"))
        up = both.groupBy("a").agg(F.min(ranked("b")).alias("least")).select("a", F.least(ranked("a"), "least")["node"].alias("up"))
        second = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        step = written(up.join(second, "up").select("a", "top"), "links-step", tasks)
        steps.append(step)
        to_a, to_b = step.toDF("a", "ra"), step.toDF("b", "rb")
        left = rest.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        rest = written(left.where("a <> b").distinct(), "links-left", tasks)
    root = None
    for step in reversed(steps):
        if root is not None:
            step = step.join(root, "top", "left").select("a", F.coalesce("root", "top").alias("top"))
            step = written(step, "links-root", tasks)
        root = step.toDF("top", "root")
    if root is None:
        return written(nodes.select("node", F.col("node").alias("component")), "links-found", tasks)
    found = nodes.join(root.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return written(found.join(least, "root").select("node", "component"), "links-found", tasks)
