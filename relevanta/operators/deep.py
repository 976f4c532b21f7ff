"""Searches at any depth of JSON, for all selectors of a document in one walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevanta.operators.extract import all_as, parse_selector, walked


def extract_deep(rows: DataFrame, keys: list[str], response_col: str, selectors: dict[str, tuple[str, str]]) -> DataFrame:
    """``keys`` and an array column for each ``name: (selector, type)``: all hits in document order, records and arrays as
    JSON text, null where a value is no such type. A text that is no JSON has no hits. A document is parsed once, in the
    task that holds its row: nothing is shuffled or written between."""
    found = rows.select(*keys, walked(F.col(response_col), [parse_selector(path) for path, _ in selectors.values()]).alias("_hits"))
    return found.select(*keys, *(all_as(F.col("_hits")[i], kind).alias(name) for i, (name, (_, kind)) in enumerate(selectors.items())))
