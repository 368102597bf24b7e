"""Connected components by hash-to-min with pointer jumping; lineage is cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each component. Null ends are ignored, self-loops make single nodes. Each round halves the distance to the root, so long chains end too."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = cut(e.union(e.select("y", "x")).distinct(), "edges")
    roots = cut(e.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).withColumnRenamed("x", "node"), "roots")
    for _ in range(max_rounds):
        near = e.join(roots.toDF("y", "ry"), "y").groupBy("x").agg(F.min("ry").alias("m")).withColumnRenamed("x", "node")
        step = roots.join(near, "node").select("node", F.least("root", "m").alias("root"))
        jumped = step.alias("s").join(step.toDF("root", "up"), "root").select("node", F.least("root", "up").alias("root"))
        nxt = cut(jumped, "roots")
        changed = nxt.join(roots.toDF("node", "old"), "node").where("root <> old").limit(1).count()
        roots = nxt
        if not changed:
            return roots
    raise RuntimeError("components did not settle")
