"""The first rows of each group, safe for groups that hold most of the data."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A group is first cut in this many parts, so no task of the first step sees
# more than 1/SPREAD of the tasks' leaders, and none of the second more than
# SPREAD * n rows.
SPREAD = 256


def first_rows(df: DataFrame, keys, order, n: int, position: str = "position") -> DataFrame:
    """Keep the first ``n`` rows per ``keys`` in ``order``; number them from 1.

    Each task keeps its own leaders before the shuffle (WindowGroupLimit).  On
    many thousand tasks even those leaders are too many for one reducer when a
    group spans them all, so they are merged in two steps.  Which part a row
    falls in does not change the result: ``order`` must be total.
    """
    part = "__part"
    spread = df.withColumn(part, F.spark_partition_id() % SPREAD)
    leaders = _limit(spread, [*keys, part], order, n, position).drop(part, position)
    return _limit(leaders, keys, order, n, position)


def _limit(df, keys, order, n, position):
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(position, rank).filter(F.col(position) <= n)
