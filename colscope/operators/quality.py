"""Data-quality rules over column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule thresholds.
HIGH_MISSING_RATIO = 0.2
IDENTIFIER_MIN_VALUES = 20
IDENTIFIER_UNIQUE_RATIO = 0.98


def percent_label(ratio: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.concat(F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%"))


def quality_warnings(profiles: DataFrame) -> DataFrame:
    """Warnings ``(column_index, name, position, code, message)`` in rule order per column."""
    name = F.col("name")

    def rule(code: str, condition: Column, *message: Column) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(code).alias("code"), F.concat(name, *message).alias("message")),
        )

    empty = F.col("non_null") == 0
    rules = [
        rule(
            "mixedType", F.col("type") == "mixed",
            F.lit(" contains mixed value types across the full dataset."),
        ),
        rule("allEmpty", empty, F.lit(" is entirely empty.")),
        rule(
            "constant", ~empty & (F.col("distinct") == 1), F.lit(" contains one non-null value.")
        ),
        rule(
            "highMissing", F.col("missing_ratio") >= HIGH_MISSING_RATIO,
            F.lit(" is "), percent_label(F.col("missing_ratio")), F.lit(" missing."),
        ),
        rule(
            "possibleIdentifier",
            (F.col("non_null") >= IDENTIFIER_MIN_VALUES)
            & (F.col("unique_ratio") >= IDENTIFIER_UNIQUE_RATIO),
            F.lit(" may be an identifier ("), percent_label(F.col("unique_ratio")), F.lit(" unique)."),
        ),
    ]
    found = profiles.select(
        "column_index", "name", F.posexplode(F.array_compact(F.array(*rules))).alias("position", "rule")
    )
    return found.select(
        "column_index", "name", "position",
        F.col("rule.code").alias("code"), F.col("rule.message").alias("message"),
    )
