"""Typed JSON at a boundary: documents are held against a shape, and every fault names its path.

A shape is a kind (``string``, ``integer``, ``number``, ``boolean``), a set of allowed strings, a list of one shape
(an array of it), a pair (shape, None) that may be null, or a dict of shapes by key, where a key ending in ``?``
may be absent. Keys that the dict lacks are faults. The check is an expression on the parsed variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a variant's type name begins with, by kind.
KINDS = {"string": r"^STRING", "integer": r"^BIGINT", "number": r"^(BIGINT|DECIMAL|DOUBLE)", "boolean": r"^BOOLEAN", "object": r"^OBJECT", "array": r"^ARRAY", "null": r"^VOID"}
_NONE = "array<string>"


def _kind(v: Column) -> Column:
    name, out = F.schema_of_variant(v), F.lit("other")
    for kind in ("number", "integer", "string", "boolean", "object", "array", "null"):
        out = F.when(name.rlike(KINDS[kind]), kind).otherwise(out)
    return out


def faults(v: Column, shape, path: Column) -> Column:
    """Faults of a variant value that is there, the first ones first."""
    none = F.array().cast(_NONE)
    told = lambda what: F.array(F.concat(path, F.lit(": expected "), F.lit(what), F.lit(", found "), _kind(v)))
    if isinstance(shape, tuple):
        return F.when(F.is_variant_null(v), none).otherwise(faults(v, shape[0], path))
    name = F.schema_of_variant(v)
    if isinstance(shape, str):
        return F.when(name.rlike(KINDS[shape]), none).otherwise(told(shape))
    if isinstance(shape, (set, frozenset)):
        names = sorted(shape)
        return F.when(~name.rlike(KINDS["string"]), told("string")).when(v.try_cast("string").isin(names), none).otherwise(F.array(F.concat(path, F.lit(": expected one of " + ", ".join(names)))))
    if isinstance(shape, list):
        each = F.transform(v.try_cast("array<variant>"), lambda x, i: faults(x, shape[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(name.rlike(KINDS["array"]), F.flatten(each)).otherwise(told("array"))
    fields = v.try_cast("map<string,variant>")
    known = [k.removesuffix("?") for k in shape]
    at = lambda k: F.concat(path, F.lit("."), k)
    strange = F.transform(F.filter(F.array_sort(F.map_keys(fields)), lambda k: ~k.isin(known)), lambda k: F.concat(at(k), F.lit(": unknown key")))
    parts = [strange]
    for key, inner in shape.items():
        plain = key.removesuffix("?")
        there, absent = F.array_contains(F.map_keys(fields), plain), none if key.endswith("?") else F.array(F.concat(at(F.lit(plain)), F.lit(": missing")))
        parts.append(F.when(there, faults(F.try_element_at(fields, F.lit(plain)), inner, at(F.lit(plain)))).otherwise(absent))
    return F.when(name.rlike(KINDS["object"]), F.concat(*parts)).otherwise(told("object"))


def parsed(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, or null.

    The parser stops where a value ends; what may follow it inside of both a list and an object is nothing.
    """
    listed, keyed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    return F.when(listed.isNotNull(), F.try_variant_get(keyed, "$.a", "variant"))


def checked(rows: DataFrame, text: str, shape) -> DataFrame:
    """rows with ``faults``: empty for a document of the shape, which passes as it is; null text and text that is no JSON have one."""
    none = F.array(F.lit("$: not JSON"))
    return rows.withColumn("_v", parsed(F.col(text))).withColumn("faults", F.when(F.col("_v").isNull(), none).otherwise(faults(F.col("_v"), shape, F.lit("$")))).drop("_v")


def strict(rows: DataFrame, text: str, shape) -> DataFrame:
    """rows as they are; a document with faults raises, naming them."""
    bad = F.size("faults") > 0
    told = F.raise_error(F.concat(F.lit("not of the shape: "), F.array_join("faults", "; ")))
    return checked(rows, text, shape).withColumn(text, F.when(bad, told).otherwise(F.col(text))).drop("faults")
