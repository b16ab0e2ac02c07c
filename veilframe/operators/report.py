"""What is shown of findings: masked text, severity counts, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SPACE


def mask(s: Column) -> Column:
    """White space runs as one blank, trimmed; up to six characters as bullets (one at least), else the first three and the last two."""
    flat = F.regexp_replace(F.regexp_replace(s, f"[{SPACE}]+", " "), "^ | $", "")
    bullets = F.repeat(F.lit("•"), F.greatest(F.length(flat), F.lit(1)))
    return F.when(F.length(flat) <= 6, bullets).otherwise(F.concat(F.substring(flat, 1, 3), F.lit("…"), F.right(flat, F.lit(2))))


def findings(spans: DataFrame) -> DataFrame:
    """The findings list: no text but the masked one."""
    return spans.withColumn("masked", mask(F.col("text"))).drop("text")


def severity_rollup(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Critical, high and other counts; medium counts as other."""
    return spans.groupBy(*(by or [])).agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(~F.col("severity").isin("critical", "high")).alias("other"),
        F.count("*").alias("total"),
    )


def dashboard(regions: Column, manual: Column) -> Column:
    """Protected (hidden regions and hand-drawn boxes), exposed (visible regions), total, and the summary line of an image."""
    hidden = F.size(F.filter(regions, lambda r: r["hidden"]))
    drawn = F.coalesce(F.size(manual), F.lit(0))
    total = F.size(regions) + drawn
    return F.struct((hidden + drawn).alias("protected"), (F.size(regions) - hidden).alias("exposed"), total.alias("total"), F.concat_ws(" ", (hidden + drawn).cast("string"), F.lit("of"), total.cast("string"), F.lit("hidden")).alias("summary"))


def text_dashboard(spans: Column) -> Column:
    """Of a text nothing is protected and every hit exposed."""
    return F.struct(F.lit(0).alias("protected"), F.size(spans).alias("exposed"), F.size(spans).alias("total"), F.concat_ws(" ", F.size(spans).cast("string"), F.lit("found")).alias("summary"))
