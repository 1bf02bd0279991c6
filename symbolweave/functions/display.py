"""Numbers as a report shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(value: Column, places: int) -> Column:
    """Cut, not rounded, after some decimal places."""
    scale = float(10**places)
    return F.floor(value * scale) / scale


def cost(value: Column) -> Column:
    return F.format_string("$%.2f", value.cast("double"))


def amount(value: Column) -> Column:
    """1.2M, 3.4k or the plain whole number."""
    whole = F.bround(value, 0).cast("bigint")
    in_millions = F.format_string("%.1fM", truncated(whole / 1_000_000, 1))
    in_thousands = F.format_string("%.1fk", truncated(whole / 1_000, 1))
    return (
        F.when(whole >= 1_000_000, in_millions)
        .when(whole >= 1_000, in_thousands)
        .otherwise(whole.cast("string"))
    )


def duration(seconds: Column) -> Column:
    whole = F.bround(seconds, 0).cast("bigint")
    return F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60)


def savings(with_tool: Column, without: Column) -> Column:
    """Percent saved, from a ratio cut to one decimal; N/A without a base."""
    percent = F.format_string("%.1f%% ↓", (F.lit(1.0) - truncated(with_tool / without, 1)) * 100)
    return F.when(without == 0, F.lit("N/A")).otherwise(percent)


def saved_share(with_tool: Column, without: Column) -> Column:
    """Percent saved as a number; null without a base."""
    return F.when(without != 0, (F.lit(1.0) - with_tool / without) * 100)
