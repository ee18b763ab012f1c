"""Connected components of a graph in rounds of joins, each written to the shared folder."""

from pyspark.sql import DataFrame, functions as F

from tidewatch.plans.durable import written


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of `edges(a, b)`: equal roots for connected nodes.

    Each round hooks every node to its smallest smaller neighbour, follows these hooks to their ends
    (twice as far each time), and replaces the nodes of all edges by the ends. Edges inside one tree
    vanish, so a few rounds are enough however long the chains are. Both sides of every join are
    scans of written tables, so that Spark can split the keys of hubs.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a < b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = written(nodes.select("node", F.col("node").alias("root")), "roots")
    while not edges.isEmpty():
        ends = _followed(written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("end")),
                                 "hooks"))
        roots = written(_replaced(roots, "root", ends), "roots")
        moved = _replaced(_replaced(edges, "a", ends), "b", ends).filter("a <> b")
        edges = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "edges")
    return roots


def _replaced(df: DataFrame, column: str, ends: DataFrame) -> DataFrame:
    moved = ends.select(F.col("node").alias("_node"), F.col("end").alias("_end"))
    return (df.join(moved, df[column] == moved["_node"], "left")
            .withColumn(column, F.coalesce("_end", column)).drop("_node", "_end"))


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks that lead to nodes without one. Hooks lead to smaller nodes, so there are no cycles."""
    while True:
        further = hooks.select(F.col("node").alias("end"), F.col("end").alias("next"))
        moved = written(hooks.join(further, "end", "left")
                        .select("node", F.coalesce("next", "end").alias("end"),
                                F.col("next").isNotNull().alias("moved")), "hooks")
        hooks = moved.select("node", "end")
        if moved.filter("moved").isEmpty():
            return hooks
