"""Fields out of JSON responses.

A selector is a path such as ``\\ response \\ docs \\\\ product_id``: a single backslash goes to a key, a double one finds
the key at any depth, in document order. Paths without a double backslash are plain column expressions, and so are those
that end in the only one where the caller knows the hits to be fields of the records at the path before it; other searches
walk each document once in Python, batch by batch, for all of them together; ``deep.extract_deep`` gives arrays for all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SQL types by name of a selector's type.
TYPES = {"INT": "int", "STRING": "string", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "boolean"}


def parse_selector(path: str) -> list[tuple[str, str]]:
    """``[("plain" | "deep", key)…]`` of a selector."""
    steps = [("deep" if m[1] == "\\\\" else "plain", m[2]) for m in re.finditer(r"(\\{1,2})\s*([^\\\s]+)\s*", path)]
    if not steps or "".join(path.split()) != "".join(("\\\\" if kind == "deep" else "\\") + key for kind, key in steps):
        raise ValueError(f"not a selector: {path!r}")
    return steps


def _at(response: Column, keys: list[str]) -> Column:
    """JSON text at a path of keys, whatever characters they have."""
    if not any(c in k for k in keys for c in "'?"):
        return F.get_json_object(response, "$" + "".join(f"['{k}']" for k in keys))
    for k in keys:
        response = F.try_element_at(F.from_json(response, "map<string,string>"), F.lit(k))
    return response


def extract_plain(response: Column, keys: list[str], kind: str = "STRING") -> Column:
    """The value at a path of keys; null where it is absent or no such type."""
    return _at(response, keys).try_cast(TYPES[kind])


def extract_records(response: Column, keys: list[str], field: str, kind: str = "STRING") -> Column:
    """A field of every record of the array at a path, absent ones left out: an array whatever the number of records."""
    quoted = field.replace("`", "``")
    records = F.from_json(_at(response, keys) if keys else response, f"array<struct<`{quoted}`:string>>")
    return F.filter(F.transform(F.coalesce(records, F.array().cast(f"array<struct<`{quoted}`:string>>")), lambda r: r[field].try_cast(TYPES[kind])), lambda v: v.isNotNull())


def _deep(value, key: str) -> list:
    """All values of a key at any depth, in document order."""
    out, left = [], [(False, value)]
    while left:
        hit, value = left.pop()
        if hit:
            out.append(value)
        if isinstance(value, dict):
            left += [(k == key, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            left += [(False, v) for v in reversed(value)]
    return out


def _select(document, steps: list[tuple[str, str]]) -> list:
    found = [document]
    for kind, key in steps:
        found = [x for v in found for x in (_deep(v, key) if kind == "deep" else [v[key]] if isinstance(v, dict) and key in v else [])]
    return found


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def walked(response: Column, walks: list[list[tuple[str, str]]]) -> Column:
    """An array of hits, as text, for each path; a document is parsed once."""

    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                try:
                    document = json.loads(text)
                    out.append([[_text(x) for x in _select(document, steps)] for steps in walks])
                except (TypeError, ValueError):
                    out.append([[] for _ in walks])
            yield pd.Series(out)

    return run(response)


def all_as(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: v.try_cast(TYPES[kind]))


def extract_any(response: Column, path: str, kind: str = "STRING") -> Column:
    """Hits of any selector as an array; records and arrays stay JSON text, what is no such type becomes null."""
    return all_as(walked(response, [parse_selector(path)])[0], kind)


def extract_fields(rows: DataFrame, response_col: str, selectors: dict[str, tuple[str, str]], direct: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with a column for each ``name: (selector, type)``: a value for a plain path, else an array. Names in
    ``direct`` have paths of the form ``\\ a \\ b \\\\ field`` whose hits are fields of the records at ``a``, ``b`` and stand
    nowhere deeper: no document leaves the JVM for them."""
    columns, walks = {}, {}
    for name, (path, kind) in selectors.items():
        steps = parse_selector(path)
        kinds = [k for k, _ in steps]
        if "deep" not in kinds:
            columns[name] = extract_plain(F.col(response_col), [k for _, k in steps], kind)
        elif name in direct:
            if kinds.index("deep") != len(steps) - 1:
                raise ValueError(f"not a field of records: {path!r}")
            columns[name] = extract_records(F.col(response_col), [k for _, k in steps[:-1]], steps[-1][1], kind)
        else:
            walks[name] = (steps, kind)
    if not walks:
        return rows.withColumns(columns)
    found = rows.withColumn("_walks", walked(F.col(response_col), [steps for steps, _ in walks.values()]))
    columns |= {name: all_as(F.col("_walks")[i], kind) for i, (name, (_, kind)) in enumerate(walks.items())}
    return found.withColumns(columns).drop("_walks")


def typed_cast(value: Column, kind: str) -> Column:
    """A value, or an array for ``SEQ[...]``, as the named type; null where it isn't one."""
    inner = re.fullmatch(r"SEQ\[(\w+)\]", kind)
    return F.transform(value, lambda v: v.try_cast(TYPES[inner[1]])) if inner else value.try_cast(TYPES[kind])
