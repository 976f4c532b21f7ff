"""Tags: the grouping keys of metric rows. A row may have several and then counts in each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevanta.functions import text


def tag_by_param(params: Column, name: str, fallback: Column | None = None) -> Column:
    """``(name=v1&v2)`` of a parameter in ``MAP<name, ARRAY<value>>``, or of a replacement of that name; null without."""
    values = F.try_element_at(params, F.lit(name))
    joined = F.array_join(F.array_sort(values), "&")
    return text.single_tag(name, joined if fallback is None else F.coalesce(joined, F.try_element_at(fallback, F.lit(name))))


def tag_by_length(values: Column, name: str) -> Column:
    """``(name-size=n)`` of a sequence."""
    return F.when(values.isNotNull(), F.concat(F.lit(f"({name}-size="), F.size(values).cast("string"), F.lit(")")))


def tag_extend(tags: Column, tag: Column, extend: bool) -> Column:
    """``extend``: the new tag joins each tag there is (or stands alone); else it is one more tag of the row. A null tag
    changes nothing."""
    if extend:
        wider = F.when(F.size(tags) > 0, F.transform(tags, lambda t: text.multi_tag(F.array(t, tag)))).otherwise(F.array(tag))
    else:
        wider = F.array_union(tags, F.array(tag))
    return F.when(tag.isNull(), tags).otherwise(wider)


def explode_tags(rows: DataFrame, tags_col: str = "tags", tag_col: str = "tag") -> DataFrame:
    """One row a tag."""
    return rows.withColumn(tag_col, F.explode(tags_col)).drop(tags_col)


def tag_remap(rows: DataFrame, mapped: Column, tag_col: str = "tag") -> DataFrame:
    return rows.withColumn(tag_col, mapped)


def tag_filter_map(rows: DataFrame, accepted: Column, mapped: Column | None = None, tag_col: str = "tag") -> DataFrame:
    """Accepted rows, their tag mapped."""
    kept = rows.filter(accepted)
    return kept if mapped is None else kept.withColumn(tag_col, mapped)


def exclude_params(params: Column, names: list[str]) -> Column:
    return F.map_filter(params, lambda k, _: ~k.isin(names))


def carry_context(*columns: str) -> Column:
    """Fields as JSON; absent ones are left out."""
    return F.to_json(F.struct(*columns))
