"""Metrics of result lists as long rows: one row a list and metric, a value or the reasons why there is none."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevanta.functions import ranking

#: Depths of the preset.
NDCG_AT, JUDGED_AT = (2, 4, 8, 12, 24), (2, 4, 8, 12, 24)


def ranking_metrics(threshold: float = 0.2) -> dict[str, Column]:
    """NDCG, precision and recall of ``judged_lists``."""
    current, best = F.col("current"), F.col("ideal")
    out = {f"NDCG@{k}": ranking.ndcg_at_k(current, best, k) for k in NDCG_AT}
    out |= {f"PRECISION@k={k},t={threshold}": ranking.precision_at_k(current, k, threshold) for k in (2, 4)}
    out |= {f"RECALL@k={k},t={threshold}": ranking.recall_at_k(current, best, k, threshold) for k in (2, 4)}
    return out


def judged_metrics() -> dict[str, Column]:
    """The number of judged results; a list that can't be judged has one, too."""
    return {f"J@{k}": ranking.judged_at_k(F.col("grades"), k) for k in JUDGED_AT}


def list_metrics(threshold: float = 0.2) -> dict[str, Column]:
    """The preset over ``judged_lists``: the number of judged results, NDCG, precision and recall."""
    return judged_metrics() | ranking_metrics(threshold)


def coverage_metrics() -> dict[str, Column]:
    grades = F.col("grades")
    return judged_metrics() | {"MISSING@8": ranking.missing_at_k(grades, 8), "MISSING": ranking.missing_at_k(grades), "RESULTS": ranking.ok(F.size(grades))}


def _records(lists: DataFrame, metrics: dict[str, Column], failed_col: str | None, wanted: list[str] | None, needs: dict[str, list[str]] | None, always: Collection[str]) -> Column:
    chosen = {n: m for n, m in metrics.items() if wanted is None or n in wanted}
    for name, columns in (needs or {}).items():
        if name in chosen:
            lacks = ranking.missing_keys({c: F.col(c) if c in lists.columns else F.lit(None) for c in columns})
            here = all(c in lists.columns for c in columns)
            chosen[name] = F.when(F.size(lacks) > 0, ranking.failed_with(lacks)).otherwise(chosen[name]) if here else ranking.failed_with(lacks)
    if failed_col:
        reasons = F.col(failed_col)
        chosen = {n: m if n in always else F.when(F.size(reasons) > 0, ranking.failed_with(reasons)).otherwise(m) for n, m in chosen.items()}
    return F.array(*(F.struct(F.lit(n).alias("metric"), m.alias("m")) for n, m in chosen.items()))


def calculate_metrics(lists: DataFrame, metrics: dict[str, Column], keys: list[str], failed_col: str | None = "failed", wanted: list[str] | None = None, needs: dict[str, list[str]] | None = None, always: Collection[str] = ()) -> DataFrame:
    """``keys, metric, value, reasons``. Where ``failed_col`` has reasons every metric of the row fails with them but those
    named in ``always``; names in ``wanted`` that no metric has are left out. ``needs`` names the columns of a metric's data:
    where one is null or isn't there at all, that metric alone fails with ``MISSING_DATA_KEY-<column>``. One pass: the metrics
    are columns first, rows after."""
    rows = F.explode(_records(lists, metrics, failed_col, wanted, needs, always))
    return lists.select(*keys, rows.alias("_r")).select(*keys, "_r.metric", "_r.m.value", "_r.m.reasons")


def metric_records(lists: DataFrame, metrics: dict[str, Column], keys: list[str], failed_col: str | None = "failed", wanted: list[str] | None = None, needs: dict[str, list[str]] | None = None, always: Collection[str] = ()) -> DataFrame:
    """``keys, records``: the same metrics of a list in one row, to be written or sent."""
    return lists.select(*keys, _records(lists, metrics, failed_col, wanted, needs, always).alias("records"))


def by_metric(records: DataFrame) -> DataFrame:
    """The rows of ``metric_records`` that were read back: ``metric, value, reasons`` beside the other columns. (Over records
    that are still to be computed Spark would compute them twice, to leave out empty ones.)"""
    keys = [c for c in records.columns if c != "records"]
    return records.select(*keys, F.explode("records").alias("_r")).select(*keys, "_r.metric", "_r.m.value", "_r.m.reasons")


def compare_sources(results: DataFrame, keys: list[str], source_col: str, left: str, right: str) -> DataFrame:
    """``keys, left, right``: the two sources' product lists of each request in rank order, null where one has none."""
    lists = results.filter(F.col(source_col).isin(left, right)).groupBy(*keys).pivot(source_col, [left, right]).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product"))), lambda x: x["product"]))
    empty = lambda c: F.when(F.size(c) > 0, c)
    return lists.select(*keys, empty(F.col(f"`{left}`")).alias("left"), empty(F.col(f"`{right}`")).alias("right"))


def one_source_each(results: DataFrame, keys: list[str], source_col: str) -> DataFrame:
    """Rows of one source a request, picked by hash: the same at every run."""
    pick = results.groupBy(*keys).agg(F.min_by(source_col, F.md5(F.concat_ws("|", *keys, source_col))).alias(source_col))
    return results.join(pick, [*keys, source_col], "left_semi")
