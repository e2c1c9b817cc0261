"""Reading and writing: detection CSV of two families, keyed inserts, planning of windows, exports."""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, NumericType, StringType, StructType

from skygrid.functions.scalars import acquisition_instant, confidence_band, local_clock

#: The columns of the two detection families.
COMMON = ("latitude", "longitude", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "frp", "daynight")
FAMILIES = {"viirs": ("bright_ti4", "bright_ti5"), "modis": ("brightness", "bright_t31", "country_id")}
NUMBERS = frozenset("latitude longitude scan track frp bright_ti4 bright_ti5 brightness bright_t31".split())
OPTIONAL = frozenset(["country_id"])


def read_detections(spark: SparkSession, path: str, family: str, marker: str | None = None) -> DataFrame:
    """A detection CSV with header, by name: blank text is null, rows without a latitude go, a missing column raises.

    Rows whose version is ``marker`` (of fixtures) raise at run time.
    """
    raw = spark.read.csv(path, header=True)
    wanted = (*COMMON, *FAMILIES[family])
    if missing := [c for c in wanted if c not in raw.columns and c not in OPTIONAL]:
        raise ValueError(f"columns missing from {path}: {missing}")
    text = {c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string") for c in wanted}
    out = raw.select(*(text[c].try_cast("double").alias(c) if c in NUMBERS else text[c].alias(c) for c in wanted)).where("latitude is not null")
    if marker:
        out = out.withColumn("version", F.when(F.col("version") == marker, F.raise_error(F.lit("fixture rows"))).otherwise(F.col("version")))
    return out.withColumns({"family": F.lit(family), "acq_ts_utc": acquisition_instant(F.col("acq_date"), F.col("acq_time")), "confidence_band": confidence_band(F.col("confidence"))}).withColumn("acq_ts_local", local_clock(F.col("acq_ts_utc")))


def both_families(viirs: DataFrame, modis: DataFrame) -> DataFrame:
    return viirs.unionByName(modis, allowMissingColumns=True)


def within(lon: Column, lat: Column, box: tuple[float, float, float, float], closed: bool = True) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north) if closed else (lon > west) & (lon < east) & (lat > south) & (lat < north)


@F.pandas_udf(StringType())
def detection_id(instrument: pd.Series, satellite: pd.Series, lon: pd.Series, lat: pd.Series, instant: pd.Series) -> pd.Series:
    """BLAKE2b-128 of instrument, satellite, coordinates to five places and the UTC instant."""
    rows = zip(instrument, satellite, lat, lon, instant, strict=True)
    return pd.Series([hashlib.blake2b(f"{i}|{s}|{a:.5f}|{o:.5f}|{t}".encode(), digest_size=16).hexdigest() for i, s, a, o, t in rows])


def keyed_insert(target: DataFrame, batch: DataFrame, key: str, arrival: str) -> DataFrame:
    """Rows of batch to append: the first arrival of each key that target lacks. Run again, it is empty."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(arrival))
    return batch.withColumn("_r", first).where("_r = 1").drop("_r").join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """target with the rows of batch in place of those of the same key."""
    return target.join(batch.select(key), key, "left_anti").unionByName(batch)


def date_chunks(windows: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Inclusive windows cut into chunks of at most ``days`` days: (chunk_start, chunk_end)."""
    cut = windows.withColumn("chunk_start", F.explode(F.sequence(start, end, F.expr(f"INTERVAL {days} DAY"))))
    return cut.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(end)))


def plan_windows(windows: DataFrame, available: DataFrame) -> DataFrame:
    """Windows (win, start, end) clipped to each source's (source, first, last); the days of each piece."""
    hit = windows.join(available, (F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first")))
    out = hit.select("win", "source", F.greatest("start", "first").alias("start"), F.least("end", "last").alias("end"))
    return out.withColumn("days", F.datediff("end", "start") + 1)


def overlaps(segments: DataFrame, sensor: str, start: str, end: str, ident: str) -> DataFrame:
    """Segments that start before one before them, of the same sensor in the order (start, end, ident), has ended."""
    before = F.max(end).over(Window.partitionBy(sensor).orderBy(start, end, ident).rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("_e", before).where(F.col("_e") >= F.col(start)).drop("_e")


def granule_instant(name: Column) -> Column:
    """UTC instant in a name such as 3SIMG_02NOV2024_0741_L1B.h5, null if there is none; a date or month that does not exist raises."""
    m = lambda g: F.regexp_extract(name, r"_(\d{2})([A-Z]{3})(\d{4})_(\d{4})_", g)
    date = F.to_date(F.try_to_timestamp(F.concat_ws("-", m(1), F.initcap(m(2)), m(3)), F.lit("dd-MMM-yyyy")))
    known = F.when(date.isNull(), F.raise_error(F.concat(F.lit("no such date: "), name))).otherwise(date)
    return F.when(m(2) != "", acquisition_instant(known, m(4).try_cast("int")))


def coordinates(text: Column) -> Column:
    """Array of 'lon,lat' texts found in <coordinates> elements."""
    return F.regexp_extract_all(text, F.lit(r"<coordinates>\s*(-?[0-9.]+,-?[0-9.]+)"), 1)


def footprint(wkt: Column) -> Column:
    """A footprint without its service prefix and closing quote."""
    return F.rtrim(F.substring_index(wkt, ";", -1), F.lit("'"))


def json_paths(text: Column, keys: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.get_json_object(text, f"$.{k}") for k in keys)))


def _not_finite(c: Column, kind: DataType) -> Column | None:
    """Whether a value of that type holds a float that is not a finite number; None if it cannot."""
    if isinstance(kind, FloatType | DoubleType):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, ArrayType) and _not_finite(F.lit(0.0), kind.elementType) is not None:
        return F.coalesce(F.exists(c, lambda x: _not_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, MapType):
        return _not_finite(F.map_values(c), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        inner = [b for f in kind.fields if (b := _not_finite(c.getField(f.name), f.dataType)) is not None]
        return reduce(Column.__or__, inner) if inner else None
    return None


def finite(df: DataFrame) -> DataFrame:
    """df, with an error at run time where a float or double, also inside an array, a map or a struct, is not a finite number."""
    for f in df.schema.fields:
        bad = _not_finite(F.col(f"`{f.name}`"), f.dataType)
        if bad is not None:
            df = df.where(F.when(bad, F.raise_error(F.lit(f"not a finite number in {f.name}"))).otherwise(F.lit(True)))
    return df


def write_release(df: DataFrame, path: str, kind: str, order: list[str] | None = None) -> None:
    """Parquet with ZSTD, gzipped CSV with header, or JSON that refuses what is not finite; files and their rows in ``order``."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if kind == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    elif kind == "json":
        finite(df).write.mode("overwrite").json(path)
    else:
        raise ValueError(kind)


def console_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """All columns as text in a fixed order: arrays joined by spaces, null 'not measured' or 'not assessable'."""
    kinds = dict(df.dtypes)

    def shown(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.concat_ws(" ", F.col(c).cast("array<string>")).alias(c)
        return F.coalesce(F.col(c).cast("string"), F.lit("not assessable" if kinds[c] == "boolean" else "not measured")).alias(c)

    return df.select(*map(shown, order))


def availability(lines: DataFrame, line: str) -> DataFrame:
    """(source, first, last) of text lines 'source,date,date'; other lines are skipped."""
    part = F.split(F.col(line), ",")
    day = lambda i: F.try_to_timestamp(F.trim(F.get(part, F.lit(i))), F.lit("yyyy-MM-dd")).cast("date")
    out = lines.where(F.size(part) == 3).select(F.trim(part[0]).alias("source"), day(1).alias("first"), day(2).alias("last"))
    return out.where("source <> '' and first is not null and last is not null")


def json_integer(text: Column, path: str) -> Column:
    """The whole number at a JSON path; null if there is something else, a boolean or a number in quotes, say."""
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    return F.when(F.schema_of_variant(found) == "BIGINT", F.try_variant_get(found, "$", "bigint"))


def _no_number(text: str) -> float:
    raise ValueError(f"{text} is no JSON")


def numbers_in(text: str | None) -> list[tuple[str, float]]:
    """(dotted path, value) of every number in a JSON text, however deep; nothing for null and for what is no JSON."""
    try:
        todo = [("", json.loads(text, parse_constant=_no_number))] if text else []
    except (ValueError, RecursionError):
        return []
    found = []
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict | list):
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in (x.items() if isinstance(x, dict) else enumerate(x))]
        elif isinstance(x, int | float) and not isinstance(x, bool):
            with contextlib.suppress(OverflowError):  # beyond the doubles
                found.append((path, float(x)))
    return found


def json_numbers(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, path, value) of every number in JSON texts, with dotted paths; booleans are none, nor does a text that is no JSON have any."""
    kind = dict(rows.dtypes)[ident]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for path, value in numbers_in(t):
                    at.append(i)
                    paths.append(path)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.float64())], [ident, "path", "value"])

    return rows.select(ident, text).mapInArrow(walk, f"`{ident}` {kind}, path string, value double")


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Administrative areas (osm_id, admin_level, name, name_en, wkt) of a CSV with header; of an area's rows the first counts.

    Fields may be as long as a line may: a state's WKT has megabytes.
    """
    schema = "osm_id long, admin_level string, name string, name_en string, wkt string"
    rows = spark.read.csv(path, schema=schema, header=True, maxCharsPerColumn=-1, escape='"')
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    first = rows.withColumn("_at", place).groupBy("osm_id", "admin_level").agg(F.min_by(F.struct("name", "name_en", "wkt"), "_at").alias("r"))
    return first.select("osm_id", "admin_level", "r.*")


def first_row_status(assets: DataFrame, key: str, sheet: DataFrame, sheet_key: str, status: str, line: str) -> DataFrame:
    """assets with ``status``: that of the key's first row in the sheet (by ``line``, nulls last, ties by status), '' where the sheet lacks the key or the row its status.

    Two numbers are one key if they are equal, whatever their types; other keys are compared as trimmed texts.
    """
    numbers = all(isinstance(d.schema[c].dataType, NumericType) for d, c in ((assets, key), (sheet, sheet_key)))
    own = lambda c: F.col(c) if numbers else F.trim(F.col(c).cast("string"))
    first = sheet.groupBy(own(sheet_key).alias("_k")).agg(F.min(F.struct(F.col(line).isNull().alias("n"), F.col(line).alias("l"), F.col(status).alias("s"))).alias("_r"))
    return assets.join(first, own(key) == F.col("_k"), "left").withColumn("status", F.coalesce("_r.s", F.lit(""))).drop("_k", "_r")


def window_warnings(windows: DataFrame, tiers: dict[str, list[str]], available: DataFrame) -> DataFrame:
    """(win, sensor, warning) of windows (win, start, end): sources that nobody offers, and sensors that cover none or part of a window.

    ``tiers`` names each sensor's sources; available: (source, first, last). Days of a sensor are added over its sources.
    """
    pairs = F.array(*(F.struct(F.lit(sensor).alias("sensor"), F.lit(source).alias("source")) for sensor, sources in tiers.items() for source in sources))
    met = windows.withColumn("_t", F.explode(pairs)).select("win", "start", "end", "_t.*").join(available, "source", "left")
    first, last = F.greatest("start", "first"), F.least("end", "last")
    days = F.when(F.col("first").isNotNull(), F.greatest(F.datediff(last, first) + 1, F.lit(0))).otherwise(0)
    absent = met.where("first is null").select("win", "sensor", F.concat("source", F.lit(" absent from the availability response")).alias("warning"))
    covered = met.groupBy("win", "sensor", "start", "end").agg(F.sum(days).alias("d")).withColumn("all", F.datediff("end", "start") + 1)
    told = F.when(F.col("d") == 0, F.concat_ws(" ", "sensor", F.lit("covers none of"), "start", F.lit("to"), "end")).when(F.col("d") < F.col("all"), F.concat_ws(" ", "sensor", F.lit("covers"), "d", F.lit("of"), "all", F.lit("days in"), "start", F.lit("to"), "end"))
    return absent.unionByName(covered.select("win", "sensor", told.alias("warning")).where("warning is not null"))
