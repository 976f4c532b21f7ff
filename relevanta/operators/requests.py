"""Request rows from grid points: ``url, request_params MAP<STRING, ARRAY<STRING>>, request_headers MAP<STRING,
ARRAY<STRING>>, request_body``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevanta.functions.text import url
from relevanta.operators.grid import table_grid


def merge_params(a: Column, b: Column, replace: bool) -> Column:
    """Two parameter maps; where both have a name the right one wins or its values are appended."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x) if replace else F.concat(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))))


def merge_headers(a: Column, b: Column, replace: bool) -> Column:
    """Two header maps: the right one alone, or both, where a name keeps each different value once."""
    none = F.array().cast("array<string>")
    return b if replace else F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, none), F.coalesce(y, none)))


def replace_all(text: Column, replacements: Column) -> Column:
    """Applies ``MAP<old, new>`` to a text, in the order of the old strings."""
    return F.aggregate(F.array_sort(F.map_entries(replacements)), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def replace_in_values(values: Column, replacements: Column) -> Column:
    """The same in every value of ``MAP<name, ARRAY<value>>``."""
    return F.transform_values(values, lambda _, v: F.transform(v, lambda x: replace_all(x, replacements)))


def build_requests(
    rows: DataFrame,
    context_path: Column,
    params: Column,
    fixed: Column | None = None,
    headers: Column | None = None,
    body: Column | None = None,
    body_replacements: Column | None = None,
    url_replacements: Column | None = None,
    replace: bool = False,
    fixed_headers: Column | None = None,
    header_replacements: Column | None = None,
    replace_headers: bool = False,
) -> DataFrame:
    """Adds request columns to grid points. Parameters and headers of a point join the fixed ones, or take their place with
    ``replace`` (name by name) and ``replace_headers`` (all of them). Replacements are applied last: to the body, and to
    the values of parameters and headers, never to their names."""
    none = F.create_map().cast("map<string,array<string>>")
    whole = params if fixed is None else merge_params(fixed, params, replace)
    sent = none if headers is None else headers
    sent = sent if fixed_headers is None else fixed_headers if headers is None else merge_headers(fixed_headers, sent, replace_headers)
    text = F.coalesce(body if body is not None else F.lit(None).cast("string"), F.lit(""))
    text = text if body_replacements is None else replace_all(text, body_replacements)
    whole = whole if url_replacements is None else replace_in_values(whole, url_replacements)
    sent = sent if header_replacements is None else replace_in_values(sent, header_replacements)
    return rows.withColumns({"_params": whole, "_headers": sent, "_body": text}).withColumn("url", url(context_path, F.col("_params"))).withColumnsRenamed({"_params": "request_params", "_headers": "request_headers", "_body": "request_body"})


#: The dimensions of a permutation in the order of the grid, the first varying fastest.
DIMENSIONS = ("params", "headers", "body_replacements", "url_replacements", "header_replacements", "bodies")


def request_permutation(spark: SparkSession, context_path: str, dims: dict[str, dict[str, DataFrame]], start: int = 0, end: int | None = None, **fixed) -> DataFrame:
    """``idx`` and request columns of every combination of the named value tables ``(pos, value)`` of six dimensions:
    parameters, headers, replacements in the body and in values of parameters and headers (old text to new texts), and
    bodies (under any one name). Tables without values are left out, as if they weren't named; with none there is one
    request. ``fixed`` goes to ``build_requests``."""
    if unknown := set(dims) - set(DIMENSIONS):
        raise ValueError(f"no dimensions: {sorted(unknown)}")
    axes = [(d, name, table) for d in DIMENSIONS for name, table in dims.get(d, {}).items() if not table.isEmpty()]
    tables = {f"_axis{i}": table for i, (_, _, table) in enumerate(axes)}
    rows = table_grid(tables, start, end) if tables else spark.range(start, 1 if end is None else min(end, 1)).withColumnRenamed("id", "idx")

    def named(dim: str, many: bool) -> Column:
        own = [x for i, (d, name, _) in enumerate(axes) if d == dim for x in (F.lit(name), F.array(F.col(f"_axis{i}").cast("string")) if many else F.col(f"_axis{i}").cast("string"))]
        return F.create_map(*own).cast("map<string,array<string>>" if many else "map<string,string>")

    bodies = [F.col(f"_axis{i}").cast("string") for i, (d, _, _) in enumerate(axes) if d == "bodies"]
    if len(bodies) > 1:
        raise ValueError("a request has one body")
    body = {"body": bodies[0]} if bodies else {}
    replacements = {f"{d}": named(f"{d}", False) for d in ("body_replacements", "url_replacements", "header_replacements")}
    out = build_requests(rows, F.lit(context_path), named("params", True), headers=named("headers", True), **{**fixed, **body, **replacements})
    return out.drop(*tables)


def param_list_to_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, name, value, pos)`` to ``params``: all values of a name in order."""
    names = rows.groupBy(*keys, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_v"))
    return names.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "_v")))).alias("params"))
