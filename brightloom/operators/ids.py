"""Dense ids in a global order, without one task holding all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.sources.scratch import keep

#: Rows that a task sorts or groups at most, about, whatever the number of shuffle partitions.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows dealt by hash to tasks of about ``TASK_ROWS``, so that a task's memory doesn't grow with the table."""
    return df.repartition(rows // TASK_ROWS + 1, *keys)


def dense_ids(df: DataFrame, *order: str, name: str = "id", stored: bool = False) -> DataFrame:
    """Number the rows 0..n-1 by ``order``, nulls first; rows alike in ``order`` have numbers next to each other, in no stated order.

    The rows are kept, range-partitioned and kept again with their place in their partition, so
    that ``df`` is computed once; ``stored`` says that it is a table as read from files, which is
    not kept first. The partitions' counts, one row each, give where each starts. No row is
    joined by its values, so nulls and repeated values lose or add none.
    """
    place = f"place_{uuid.uuid4().hex}"  # no column of the caller's has this name
    rows = (df if stored else keep(df, "id-rows")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.withColumn(place, F.monotonically_increasing_id()), "id-order")
    part, own = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    starts = starts.select(F.col("part").alias(f"{place}_part"), F.col("start").alias(f"{place}_start"))
    found = rows.join(F.broadcast(starts), part == F.col(f"{place}_part"))  # a row for each partition
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(f"{place}_start") + own).cast("long").alias(name))
