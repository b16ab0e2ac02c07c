"""The scan over streams.  It keeps no state, so batch and stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ScanConfig, scan


def scan_stream(stream: DataFrame, text_col: str = "text", config: ScanConfig | None = None) -> DataFrame:
    return scan(stream, text_col, config=config)


def latest_stream(stream: DataFrame, keys: list[str], time_col: str, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """The newest row of each key and window; later than the watermark doesn't count."""
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max(F.struct(F.col(time_col).alias("__t"), *[F.col(c).alias(f"v_{c}") for c in rest])).alias("m")
    out = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), *keys).agg(newest)
    return out.select(*keys, *[F.col(f"m.v_{c}").alias(c) for c in rest])


def severity_stream(spans: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Severity counts of event-time windows."""
    return spans.withWatermark(time_col, late).groupBy(F.window(time_col, window), "severity").count()
