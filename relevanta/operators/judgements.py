"""Result lists meet judgements.

``results(list keys…, query, product, rank)`` is long; ``judgements(query, product, grade)`` has one grade a pair. The
join is a plain equi-join on (query, product): Spark broadcasts the judgements where they are small and otherwise
shuffles both sides by the pair, so that no query is a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevanta.functions import ranking

#: Grades of a query that its ideal order can use.
TOP = 100


def last_grades(judged: DataFrame, order_col: str) -> DataFrame:
    """One grade a (query, product): the last by ``order_col``."""
    return judged.groupBy("query", "product").agg(F.max_by("grade", order_col).alias("grade"))


def join_judgements(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """``results`` with ``grade``, null where the pair has none; order and rows stay."""
    return results.join(judgements.select("query", "product", "grade"), ["query", "product"], "left")


def ideal_grades(judgements: DataFrame, top: int = TOP) -> DataFrame:
    """``(query, known)``: the highest ``top`` grades of each query, descending. Ranks are limited before grades are
    gathered, so that a query with very many judgements stays small; both steps share one shuffle by query."""
    best = Window.partitionBy("query").orderBy(F.desc("grade"))
    kept = judgements.filter("grade is not null").select("query", "grade", F.row_number().over(best).alias("_n")).filter(F.col("_n") <= top)
    return kept.groupBy("query").agg(F.sort_array(F.collect_list("grade"), asc=False).alias("known"))


def judged_lists(results: DataFrame, judgements: DataFrame, keys: list[str], constant: float | None = 0.0, most_missing: float | None = None, top: int = TOP) -> DataFrame:
    """One row a result list: ``keys, query, grades, known, current, ideal, failed``.

    ``grades`` are in rank order with nulls, ``current`` imputed, ``failed`` the reasons for which the list can't be judged.
    """
    by = list(dict.fromkeys([*keys, "query"]))
    joined = join_judgements(results, judgements)
    lists = joined.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "grade"))), lambda x: x["grade"]).alias("grades"))
    lists = lists.join(ideal_grades(judgements, top), "query", "left")
    lists = lists.withColumn("known", F.coalesce("known", F.array().cast("array<double>"))).withColumn("current", ranking.impute(F.col("grades"), constant))
    return lists.withColumns({"ideal": ranking.ideal(F.col("known"), F.col("grades"), F.col("current")), "failed": ranking.failed_checks(F.col("grades"), most_missing)})
