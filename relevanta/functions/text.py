"""Strings: request strings, tags, values inside raw text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a field's value may look like in raw text.
FIELD_PATTERNS = {
    "numeric": r"[0-9]+",
    "float": r"[-+]?[0-9]*\.?[0-9]+",
    "alpha": r"[A-Za-z]+",
    "alphanumeric": r"[A-Za-z0-9]+",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
}


def params_key(params: Column) -> Column:
    """Canonical text of ``MAP<name, ARRAY<value>>``: sorted names, ``name=value`` joined by ``&``, values sorted."""
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.transform(F.array_sort(e["value"]), lambda v: F.concat(e["key"], F.lit("="), v)))), "&")


def single_tag(name: str, value: Column) -> Column:
    """``(name=value)``; null where the value is."""
    return F.concat(F.lit(f"({name}="), value.cast("string"), F.lit(")"))


def multi_tag(tags: Column) -> Column:
    """Several tags as one: sorted, joined by ``-``."""
    return F.array_join(F.array_sort(tags), "-")


def aggregation_tag(id_: Column, variable: Column, fixed: Column) -> Column:
    return F.concat(F.lit("aggTag-"), id_, F.lit("-"), params_key(variable), F.lit("-"), params_key(fixed))


def number_text(value: Column) -> Column:
    """Numbers with two decimals, as in request strings."""
    return F.format_string("%.2f", value)


def query_string(params: Column) -> Column:
    """``name=value`` of ``MAP<name, ARRAY<value>>``, url-encoded, names in order, values as given, joined by ``&``."""
    entries = F.array_sort(F.map_entries(params), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), F.url_encode(v))))), "&")


def url(context_path: Column, params: Column) -> Column:
    """Path with one leading slash, then ``?`` and the request string where there is one."""
    path = F.when(context_path.startswith("/"), context_path).otherwise(F.concat(F.lit("/"), context_path))
    asked = query_string(params)
    return F.when(asked == "", path).otherwise(F.concat(path, F.lit("?"), asked))


def field_values(text: Column, field: str, kind: str = "numeric") -> Column:
    """All values of ``"field":value`` in raw text, in order."""
    return F.regexp_extract_all(text, F.lit(rf'"{field}"\s*:\s*"?({FIELD_PATTERNS[kind]})"?'), 1)


def first_field_value(text: Column, field: str, kind: str = "numeric") -> Column:
    """The first such value, null without one."""
    return F.nullif(F.regexp_extract(text, rf'"{field}"\s*:\s*"?({FIELD_PATTERNS[kind]})"?', 1), F.lit(""))


def param_in_tag(tag: Column, param: str, default: str | None = None) -> Column:
    """Value of a parameter inside a tag or file name, up to the last bracket or comma."""
    found = F.nullif(F.regexp_extract(tag, rf"{param}=(.*)[),]", 1), F.lit(""))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def number_aware_order(value: Column) -> list[Column]:
    """Sort keys: numbers by value first, other text after them."""
    number = value.try_cast("double")
    return [number.asc_nulls_last(), value.asc()]


def scale_map(values: Column, by: Column) -> Column:
    return F.transform_values(values, lambda _, v: v * by)


def combine_maps(a: Column, b: Column, merge) -> Column:
    """Key by key; ``merge`` sees both values where both maps have the key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merge(x, y)))
