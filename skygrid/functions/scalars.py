"""Scalar builders: instants, confidence, statuses, parsing, bands, labels. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def acquisition_instant(date: Column, hhmm: Column) -> Column:
    """UTC instant of a date and an HHMM number that may lack padding; null if the time is out of range."""
    t = hhmm.cast("int")
    good = t.between(0, 2359) & (t % 100 < 60)
    return F.when(good, F.timestamp_seconds(F.unix_date(date.cast("date")).cast("long") * 86400 + F.floor(t / 100) * 3600 + (t % 100) * 60))


def local_clock(instant: Column, minutes: int = 330) -> Column:
    """Wall clock at a fixed offset from UTC (by default +05:30), as a timestamp without zone."""
    return (instant.cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTE")).cast("timestamp_ntz")


def confidence_band(raw: Column) -> Column:
    """low / nominal / high of a 0-100 number (cut at 30 and 80) or a letter; null if it is neither."""
    n, letter = raw.try_cast("int"), F.lower(F.trim(raw))
    number = F.when(n.between(0, 29), "low").when(n.between(30, 79), "nominal").when(n.between(80, 100), "high")
    return F.coalesce(number, F.when(letter.isin("l", "low"), "low").when(letter.isin("n", "nominal"), "nominal").when(letter.isin("h", "high"), "high"))


def status(raw: Column) -> Column:
    """Asset status in lower case without an ' - inferred ..' ending; blank becomes 'blank'."""
    s = F.trim(F.regexp_replace(F.lower(F.trim(raw)), " - inferred.*$", ""))
    return F.when(s == "", "blank").otherwise(s)


def year(raw: Column) -> Column:
    """A year from 1800 to 2100, else null."""
    y = raw.try_cast("double").cast("int")
    return F.when(y.between(1800, 2100), y)


def coordinate_pair(raw: Column) -> Column:
    """Array (lat, lon) of 'lat, lon' (the first pair of a ';' list), null if malformed."""
    parts = F.split(F.split(raw, ";")[0], ",")
    pair = F.array(F.trim(parts[0]).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double"))
    return F.when((F.size(parts) == 2) & pair[0].between(-90, 90) & pair[1].between(-180, 180), pair)


def dataset_band(metres: Column) -> Column:
    return F.when(metres < 1000, "under 1 km").when(metres < 5000, "1 to 5 km").when(metres.isNull(), "none in reach").otherwise("5 km or more")


def console_band(metres: Column) -> Column:
    """1, 5 and 20 km edges of the distance in whole metres (half to even); null stays null."""
    m = F.bround(metres, 0)
    return F.when(m < 1000, "<1 km").when(m < 5000, "1-5 km").when(m < 20000, "5-20 km").when(m.isNotNull(), ">=20 km")


def weak_label(flare_m: Column, industrial_m: Column, asset_m: Column, cover: Column, flare_at: float = 500, industrial_at: float = 1000) -> Column:
    """flare, industrial, agricultural or unlabelled, the first rule that holds; a missing distance never holds."""
    return F.when(flare_m <= flare_at, "flare").when((industrial_m <= industrial_at) | (asset_m <= industrial_at), "industrial").when(cover == "cropland", "agricultural").otherwise("unlabelled")


def operating(year_: Column, start: Column, retired: Column) -> Column:
    """Whether an asset runs in a year; an unknown start or end excludes nothing."""
    return (start.isNull() | (year_ >= start)) & (retired.isNull() | (year_ <= retired))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def strict(value: Column, raw: Column, what: str) -> Column:
    """value, with an error at run time where it is null although raw is not: for input that must be readable."""
    return F.when(value.isNull() & raw.isNotNull(), F.raise_error(F.concat(F.lit(f"not a {what}: "), raw.cast("string")))).otherwise(value)


#: Asset statuses that are in use, and those that are not.
IN_USE = frozenset(["operating", "operating pre-retirement", "mothballed pre-retirement"])
NOT_IN_USE = frozenset("announced cancelled construction mothballed permitted pre-construction retired shelved unknown blank".split())


def in_use(status_: Column) -> Column:
    """Whether a status is one of an asset in use; a status of neither list raises."""
    known = F.when(status_.isin(*sorted(IN_USE)), F.lit(True)).when(status_.isin(*sorted(NOT_IN_USE)), F.lit(False))
    return strict(known, status_, "known status")


def folded(name: Column) -> Column:
    """Dashes, quotes and spaces of other alphabets' typesetting as plain ones."""
    dashes, single, double, spaces = "\u2010\u2011\u2012\u2013\u2014\u2212", "\u2018\u2019\u201b\u2032", "\u201c\u201d\u2033", "\u00a0\u2009\u202f"
    plain = "-" * len(dashes) + "'" * (len(single) + len(double) + 1) + " " * len(spaces)
    return F.translate(name, dashes + single + double + '"' + spaces, plain)


def looked_up(count: Column, table: list[float], fill: int) -> Column:
    """The table's value for a count, the index clipped to the table; counts from ``fill`` on are missing."""
    at = F.greatest(F.lit(0), F.least(count, F.lit(len(table) - 1)))
    return F.when(count < fill, F.element_at(F.lit(table), (at + 1).cast("int")))


def shown_metres(m: Column) -> Column:
    return F.when(m.isNull(), "not measured").when(m < 1000, F.concat(m.cast("long").cast("string"), F.lit(" m"))).otherwise(F.format_string("%.1f km", m / 1000.0))


def shown_percent(share: Column) -> Column:
    """A share in per cent with one decimal."""
    return F.when(share.isNull(), "not measured").otherwise(F.format_string("%.1f%%", share))


def grouped_indian(n: Column) -> Column:
    """A whole number with its last three digits and then pairs set apart."""
    x = n.cast("string")
    head = F.regexp_replace(F.substr(x, F.lit(1), F.length(x) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.when(F.length(x) <= 3, x).otherwise(F.concat(head, F.lit(","), F.right(x, F.lit(3))))
