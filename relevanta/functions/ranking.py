"""Ranking metrics over one result list, as columns.

A list is an array of grades in rank order. Every metric is a struct ``(value DOUBLE, reasons ARRAY<STRING>)``: the value
is null exactly where there are reasons. All of it stays inside the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_RESULTS, NO_JUDGEMENTS, TOO_FEW_JUDGEMENTS, ZERO_DENOMINATOR = "NO_RESULTS", "NO_JUDGEMENTS", "TOO_FEW_JUDGEMENTS", "ZERO_DENOMINATOR"
NO_REASONS = "array<string>"


def ok(value: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), F.array().cast(NO_REASONS).alias("reasons"))


def failed(*reasons: str) -> Column:
    return F.struct(F.lit(None).cast("double").alias("value"), F.array(*map(F.lit, reasons)).cast(NO_REASONS).alias("reasons"))


def failed_with(reasons: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("value"), reasons.cast(NO_REASONS).alias("reasons"))


def missing_keys(needs: dict[str, Column]) -> Column:
    """The reasons ``MISSING_DATA_KEY-<key>`` of the data that a row lacks."""
    return F.filter(F.array(*(F.when(c.isNull(), F.lit(f"MISSING_DATA_KEY-{k}")) for k, c in needs.items())).cast(NO_REASONS), lambda r: r.isNotNull())


def python_metric(compute, *columns: Column) -> Column:
    """A metric of a caller's own Python function of plain values, in Arrow batches. A row for which it raises fails with the
    name of the exception's class; the others go on. What it returns is the value; None fails as NO_RESULTS."""

    def each(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for values in zip(*columns, strict=True):
            try:
                value = compute(*(None if v is pd.NA or (isinstance(v, float) and v != v) else v for v in values))
                out.append((None, [NO_RESULTS]) if value is None else (float(value), []))
            except Exception as error:  # any error is the metric's own
                out.append((None, [type(error).__name__]))
        return pd.DataFrame(out, columns=["value", "reasons"]).astype({"value": "Float64"})

    return F.pandas_udf(each, "value double, reasons array<string>")(*columns)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def impute(grades: Column, constant: float | None = 0.0) -> Column:
    """Missing grades become a constant, or the mean of the others (0 without any) where ``constant`` is None."""
    if constant is not None:
        return F.transform(grades, lambda g: F.coalesce(g, F.lit(constant)))
    known = F.filter(grades, lambda g: g.isNotNull())
    mean = F.when(F.size(known) > 0, total(known) / F.size(known)).otherwise(F.lit(0.0))
    return F.transform(grades, lambda g: F.coalesce(g, mean))


def failed_checks(grades: Column, most_missing: float | None = None) -> Column:
    """Reasons for which a list of raw grades can't be judged: no results, none judged and, with ``most_missing``, a
    larger share than that not judged."""
    n, missing = F.size(grades), F.size(F.filter(grades, lambda g: g.isNull()))
    checks = [F.when(n == 0, F.lit(NO_RESULTS)), F.when(n == missing, F.lit(NO_JUDGEMENTS))]
    if most_missing is not None:
        checks.append(F.when((n > 0) & (missing > n * F.lit(most_missing)), F.lit(TOO_FEW_JUDGEMENTS)))
    return F.filter(F.array(*checks), lambda r: r.isNotNull())


def ideal(known: Column, grades: Column, current: Column) -> Column:
    """Best order that a query's ``known`` grades (descending) allow for as many results as there are. What was imputed
    for missing grades takes part, so that no list is better than its ideal."""
    n = F.size(grades)
    imputed = F.transform(F.filter(F.arrays_zip(grades.alias("g"), current.alias("c")), lambda x: x["g"].isNull()), lambda x: x["c"])
    return F.slice(F.sort_array(F.concat(F.slice(known, F.lit(1), n), imputed), asc=False), F.lit(1), n)


def _discounted(grades: Column, k: int) -> Column:
    return total(F.transform(F.slice(grades, 1, k), lambda g, i: F.when(i == 0, g).otherwise(g / F.log(i + 2))))


def dcg_at_k(grades: Column, k: int) -> Column:
    """First grade plus grade / ln(rank + 1) of the others up to rank ``k``; a single result counts whatever ``k`` is."""
    n = F.size(grades)
    return F.when(n == 0, failed(NO_RESULTS)).when(n == 1, ok(grades[0])).otherwise(ok(_discounted(grades, k)))


def ndcg_at_k(grades: Column, best: Column, k: int) -> Column:
    n, top = F.size(grades), _discounted(best, k)
    one = F.when(grades[0] > 0, ok(F.lit(1.0))).otherwise(failed(ZERO_DENOMINATOR))
    return F.when(n == 0, failed(NO_RESULTS)).when(n == 1, one).when(top == 0, failed(ZERO_DENOMINATOR)).otherwise(ok(_discounted(grades, k) / top))


def _relevant(grades: Column, k: int, threshold: float) -> Column:
    return F.size(F.filter(F.slice(grades, 1, k), lambda g: g >= threshold))


def precision_at_k(grades: Column, k: int, threshold: float) -> Column:
    """Share of the first ``k`` results, as far as there are, with at least the threshold grade."""
    return F.when(F.size(grades) == 0, failed(NO_JUDGEMENTS)).otherwise(ok(_relevant(grades, k, threshold) / F.size(F.slice(grades, 1, k))))


def recall_at_k(grades: Column, best: Column, k: int, threshold: float) -> Column:
    """Relevant among the first ``k`` over relevant among the best ``k``."""
    most = _relevant(best, k, threshold)
    return F.when(most == 0, failed(ZERO_DENOMINATOR)).otherwise(ok(_relevant(grades, k, threshold) / most))


def err_at_k(grades: Column, k: int, max_grade: float = 3.0) -> Column:
    """Expected reciprocal rank: the chance to stop at a rank over the rank, summed."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("left"), F.lit(1).alias("rank"))

    def step(s: Column, g: Column) -> Column:
        stop = (F.pow(F.lit(2.0), g * max_grade) - 1) / F.lit(2.0**max_grade)
        return F.struct((s["sum"] + s["left"] * stop / s["rank"]).alias("sum"), (s["left"] * (1 - stop)).alias("left"), (s["rank"] + 1).alias("rank"))

    return F.when(F.size(grades) == 0, failed(NO_RESULTS)).otherwise(ok(F.aggregate(F.slice(grades, 1, k), start, step)["sum"]))


def judged_at_k(grades: Column, k: int) -> Column:
    """Number of judged results among the first ``k``."""
    return ok(F.size(F.filter(F.slice(grades, 1, k), lambda g: g.isNotNull())))


def missing_at_k(grades: Column, k: int | None = None) -> Column:
    """Number of results without a grade, among the first ``k`` or all."""
    return ok(F.size(F.filter(grades if k is None else F.slice(grades, 1, k), lambda g: g.isNull())))


def identity(value: Column) -> Column:
    return F.when(value.isNull(), failed(NO_RESULTS)).otherwise(ok(value))


def first_match(flags: Column, wanted: bool = True) -> Column:
    """Index from 0 of the first ``wanted`` flag."""
    at = F.array_position(flags, F.lit(wanted))
    return F.when(at > 0, ok(at - 1)).otherwise(failed(NO_RESULTS))


def match_count(flags: Column, wanted: bool = True) -> Column:
    return ok(F.size(F.filter(flags, lambda x: x == wanted)))


def binary_precision(flags: Column, k: int, wanted: bool = True) -> Column:
    return precision_at_k(F.transform(flags, lambda x: F.when(x == wanted, F.lit(1.0)).otherwise(F.lit(0.0))), k, 0.9)


def position_histogram(values: Column, k: int) -> Column:
    """``MAP<value, MAP<position, 1.0>>`` of the first ``k`` values; positions count from 0, as text."""
    first = F.slice(values, 1, k)
    places = F.transform(first, lambda v, i: F.struct(v.alias("v"), i.cast("string").alias("p")))
    entry = lambda v: F.struct(v, F.map_from_entries(F.transform(F.filter(places, lambda x: x["v"] == v), lambda x: F.struct(x["p"], F.lit(1.0)))))
    return F.map_from_entries(F.transform(F.array_distinct(first), entry))


def value_counts(values: Column, k: int, within_k: bool = False) -> Column:
    """``MAP<value, count>`` of the distinct first ``k`` values, counted over the whole list unless ``within_k``."""
    over = F.slice(values, 1, k) if within_k else values
    return F.map_from_entries(F.transform(F.array_distinct(F.slice(values, 1, k)), lambda v: F.struct(v, F.size(F.filter(over, lambda x: x == v)).cast("double"))))


def unique_values(values: Column, k: int) -> Column:
    return F.array_distinct(F.slice(values, 1, k))


def unique_value_count(values: Column, k: int) -> Column:
    return ok(F.size(unique_values(values, k)))


def occurrences_of(values: Column, wanted: str, k: int, within_k: bool = False) -> Column:
    """How often ``wanted`` occurs, over the whole list unless ``within_k``."""
    return ok(F.size(F.filter(F.slice(values, 1, k) if within_k else values, lambda v: v == wanted)))


def jaccard(a: Column, b: Column, names: tuple[str, str] = ("left", "right")) -> Column:
    """Intersection over union of two lists; a missing list is a reason of its own."""
    missing = F.filter(F.array(*(F.when(x.isNull(), F.lit(f"MISSING_DATA_KEY-{n}")) for x, n in zip((a, b), names, strict=True))), lambda r: r.isNotNull())
    union = F.size(F.array_union(a, b))
    return F.when(F.size(missing) > 0, failed_with(missing)).when(union == 0, failed(NO_RESULTS)).otherwise(ok(F.size(F.array_intersect(a, b)) / union))
