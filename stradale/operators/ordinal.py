"""Numbers of rows in a total order, without sorting all of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stradale.plans.staging import materialize


def numbered(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the order given, which should leave no ties.

    Rows are dealt by ranges of the order and written once. Each range is numbered by itself and moved by the rows of the ranges
    before it; only the sizes of the ranges, one for each shuffle partition, are summed in one task. No rows give none.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")
