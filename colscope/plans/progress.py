"""Row counts observed while a batch job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def count_rows(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Count the rows that pass this point of a plan, without a job of its own.

    Read ``observation.get["rows"]`` after an action on the returned DataFrame.
    """
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
