"""Data quality checks: record rules, gates on batches, tables compared within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_type(column: str, kind: str) -> tuple[str, Column]:
    return f"{column}: not {kind}", F.col(column).isNull() | F.col(column).try_cast(kind).isNotNull()


def rule_required(column: str) -> tuple[str, Column]:
    return f"{column}: missing", F.col(column).isNotNull()


def rule_regex(column: str, pattern: str) -> tuple[str, Column]:
    return f"{column}: no match", F.col(column).isNull() | F.col(column).rlike(f"^(?:{pattern})$")


def rule_choice(column: str, choices: list) -> tuple[str, Column]:
    return f"{column}: not a choice", F.col(column).isNull() | F.col(column).isin(choices)


def rule_between(column: str, low: float | None = None, high: float | None = None) -> tuple[str, Column]:
    value, fits = F.col(column), F.lit(True)
    fits = fits & (value >= low) if low is not None else fits
    return f"{column}: out of range", value.isNull() | (fits & (value <= high) if high is not None else fits)


def rule_each(column: str, test) -> tuple[str, Column]:
    """Every element of an array passes ``test(element)``."""
    return f"{column}: bad element", F.col(column).isNull() | F.forall(column, test)


def rule_map(column: str, key_test, value_test) -> tuple[str, Column]:
    """Every key and value of a map passes."""
    return f"{column}: bad entry", F.col(column).isNull() | (F.forall(F.map_keys(column), key_test) & F.forall(F.map_values(column), value_test))


def rule_either(name: str, *rules: tuple[str, Column]) -> tuple[str, Column]:
    """At least one of several rules holds."""
    out = F.lit(False)
    for _, fits in rules:
        out = out | F.coalesce(fits, F.lit(False))
    return f"{name}: none of {len(rules)}", out


def rule_conditional(column: str, rules: dict[str, list[tuple[str, Column]]]) -> list[tuple[str, Column]]:
    """Rules chosen by another field's value; an unknown value is invalid."""
    out = [(f"{column}: unknown condition", F.coalesce(F.col(column).isin(list(rules)), F.lit(False)))]
    return out + [(f"{column}={v}, {name}", ~F.coalesce(F.col(column) == v, F.lit(False)) | fits) for v, own in rules.items() for name, fits in own]


def validate_records(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with ``invalid``: the names of the rules that a row breaks."""
    broken = F.array(*(F.when(~F.coalesce(fits, F.lit(False)), F.lit(name)) for name, fits in rules))
    return rows.withColumn("invalid", F.filter(broken, lambda x: x.isNotNull()))


def fail_fraction_gate(rows: DataFrame, failed: Column, most: float, least_rows: int = 0, key: str = "batch_nr") -> DataFrame:
    """``key, n, fails, passed``: a batch of more than ``least_rows`` rows fails above the fraction ``most``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(failed).alias("fails"))
    return counts.withColumn("passed", ~((F.col("n") > least_rows) & (F.col("fails") / F.col("n") > most)))


def class_count_gate(rows: DataFrame, class_col: str, expected: DataFrame) -> DataFrame:
    """``class, expected, n, passed`` for each class of ``expected(class, expected)``."""
    counts = rows.groupBy(F.col(class_col).alias("class")).agg(F.count("*").alias("n"))
    return expected.join(counts, "class", "left").select("class", "expected", F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("passed", F.col("n") >= F.col("expected"))


def table_differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows that differ: ``keys`` and the columns at fault. Numbers may differ by less than ``tolerance``."""
    columns = [c for c in a.columns if c not in keys]
    numeric = {f.name for f in a.schema if f.dataType.typeName() in ("double", "float", "decimal")}
    left, right = a.withColumnsRenamed({c: f"a_{c}" for c in columns}).withColumn("a_", F.lit(1)), b.withColumnsRenamed({c: f"b_{c}" for c in columns}).withColumn("b_", F.lit(1))

    def same(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) < tolerance, F.lit(False)) if c in numeric else x.eqNullSafe(y)

    joined = left.join(right, keys, "full")
    lone = F.when(F.col("a_").isNull(), F.lit("only right")).when(F.col("b_").isNull(), F.lit("only left"))
    faults = F.when(lone.isNotNull(), F.array(lone)).otherwise(F.filter(F.array(*(F.when(~same(c), F.lit(c)) for c in columns)).cast("array<string>"), lambda x: x.isNotNull()))
    return joined.select(*keys, faults.alias("faults")).filter(F.size("faults") > 0)
