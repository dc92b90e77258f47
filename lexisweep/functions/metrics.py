"""Column functions on run times and sizes, in exact decimal arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bandwidth(input_size, time_us) -> Column:
    """``"1.23 GB/s"``: decimal gigabytes per second; null for no time at all."""
    per_second = _exact(time_us) * F.lit(1000).cast("decimal(4,0)")
    ratio = F.try_divide(_exact(input_size), per_second)
    return F.concat(F.round(ratio, 2).cast("string"), F.lit(" GB/s"))


def time_taken_ms(time_us) -> Column:
    """Whole milliseconds."""
    return F.call_function("div", F.col(time_us), F.lit(1000))


def time_ratio(slow_us, fast_us) -> Column:
    """How many times faster, as text with two decimals; null for no time at all."""
    return F.round(F.try_divide(_exact(slow_us), _exact(fast_us)), 2).cast("string")


def _exact(name) -> Column:
    return F.col(name).cast("decimal(18,0)")
