"""Connected components of links between ids, by alternating star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import written


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to ``node, component``: the smallest id that is reachable. Linked ids only.

    Each round hangs every neighbour on the smallest one it knows (a join on the node and a minimum,
    which is combined before the shuffle) and is written out. Stars settle in one round, chains in
    logarithmically many. No table: no rows; links of an id with itself and repeated links add nothing.
    """
    edges = written(links.filter("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "links")
    mark = None
    while True:
        both = edges.select("u", "v").unionAll(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).selectExpr("u", "least(u, low) AS low")
        large = both.filter("v > u").join(low, "u").selectExpr("v AS u", "low AS v")
        down = large.filter("u != v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(low, "u").filter("v != low").selectExpr("v AS u", "low AS v").unionAll(low.selectExpr("u", "low AS v"))
        edges = written(small.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
