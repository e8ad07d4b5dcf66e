"""Connected components of an edge table, as joins and aggregates.

Every round each vertex hooks to its smallest neighbour, the hooks are followed to their
ends by pointer jumping, and the edges are drawn together on those ends; the vertices
that still have edges at least halve.  Each step is written to the shared scratch folder,
which cuts lineage.  No edge or component leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotstats.plans.session import remove_scratch, scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared scratch folder and read again; ``dropped`` removes it."""
    df.write.parquet(at := scratch_path(df.sparkSession, name))
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._scratch = at
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove what ``saved`` wrote, once nothing unwritten reads it any more."""
    for df in frames:
        remove_scratch(df.sparkSession, df._scratch)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b); root is the component's least vertex."""
    edges = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = table = saved(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "cc-hooks")
        while True:
            on = hooks.select(F.col("v").alias("p"), F.col("p").alias("up"))
            step = saved(hooks.join(on, "p").select("v", "up", (F.col("up") < F.col("p")).alias("moved")), "cc-jump")
            dropped(table)
            hooks, table = step.select("v", F.col("up").alias("p")), step
            if step.filter("moved").isEmpty():
                break
        before, drawn = found, edges
        if found is None:
            found = saved(hooks.withColumnRenamed("p", "root"), "cc-found")
        else:
            onward = hooks.select(F.col("v").alias("root"), F.col("p").alias("end"))
            found = saved(found.join(onward, "root", "left").select("v", F.coalesce("end", "root").alias("root")), "cc-found")
            dropped(before)
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("v").alias(end), "p"), end).drop(end).withColumnRenamed("p", end)
        edges = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        dropped(drawn, table)
    dropped(edges)
    if found is None:
        return spark.createDataFrame([], "v long, root long")
    return found
