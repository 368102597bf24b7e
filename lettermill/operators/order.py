"""Global numbering without a window over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.session import cut


def numbered(df: DataFrame, *order: str, name: str = "k") -> DataFrame:
    """``df`` with ``name``, the place of each row from one in the order of the columns ``order``, which must tell rows apart.

    Rows are cut into ranges of the order, of equal size whatever the values, and written; places inside a range are added to the counts of the ranges before it.
    Nulls come first; an empty table stays empty.
    """
    d = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_before")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return d.join(F.broadcast(sizes), "_p").withColumn(name, (F.col("_before") + place).cast("long")).drop("_p", "_before")
