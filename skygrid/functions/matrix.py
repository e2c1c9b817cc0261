"""Which columns may be features: a whitelist that shares none with what defines the label or tells the place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whitelisted(rows: DataFrame, keep: list[str], features: list[str], leaking: list[str], geographic: list[str]) -> DataFrame:
    """rows with ``keep`` and exactly the features, in their order.

    Raises if a feature defines the label, tells the place, is named twice, or is not there.
    """
    faults = [f"{f} defines the label" for f in features if f in leaking] + [f"{f} tells the place" for f in features if f in geographic]
    faults += [f"{f} is named twice" for f in sorted({f for f in features if features.count(f) > 1})] + [f"no column {f}" for f in features if f not in rows.columns]
    if faults:
        raise ValueError("; ".join(faults))
    return rows.select(*keep, *features)


def observed(features: list[str]) -> Column:
    """Whether every feature has a value; a row that lacks one is not assessed, and nothing is filled in for it."""
    return reduce(Column.__and__, (F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features))


def lift_text(share: Column, background: Column) -> tuple[Column, Column]:
    """(background, lift) as texts: n/a without a background, unbounded over one of 0."""
    percent = F.format_string("%.2f%%", background * 100)
    return F.when(background.isNull(), "n/a").otherwise(percent), F.when(background.isNull(), "n/a").when(background == 0, "unbounded").otherwise(F.format_string("%.2fx", F.try_divide(share, background)))
