"""Value and mapping files. Paths go to Spark as they are, so local, HDFS, ``s3a:`` and ``gs:`` stores read alike; a store's
own settings (mount tables, end points, credentials) can be given as ``options`` of a read.

Order within a file is the order of Spark's line ids, which grow along a file; keys given twice are settled by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """``(line_id, line, file)``: trimmed lines that aren't empty and no comment."""
    rows = spark.read.options(**(options or {})).text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line_id"))
    return rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_lines(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    return _lines(spark, path, options).select("line_id", F.col("line").alias("value"))


def read_split_values(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(line_id, pos, value)``: all values of all lines, trimmed."""
    rows = _lines(spark, path).select("line_id", F.posexplode(F.split("line", _literal(delimiter))).alias("pos", "value"))
    return rows.select("line_id", "pos", F.trim("value").alias("value")).filter("value <> ''")


def read_unique_column(spark: SparkSession, path: str, delimiter: str, column: int) -> DataFrame:
    """Distinct values of the n-th column (from 0)."""
    rows = _lines(spark, path).select(F.trim(F.get(F.split("line", _literal(delimiter)), F.lit(column))).alias("value"))
    return rows.filter("value <> ''").distinct()


def _literal(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def _cells(spark: SparkSession, path: str, delimiter: str, key: int, value: int) -> DataFrame:
    parts = _lines(spark, path).select("line_id", F.split("line", _literal(delimiter), -1).alias("c")).filter(F.size("c") > max(key, value))
    return parts.select("line_id", F.trim(F.col("c")[key]).alias("key"), F.trim(F.col("c")[value]).alias("value"))


def read_mapping_csv(spark: SparkSession, path: str, delimiter: str = ",", key: int = 0, value: int = 1, mode: str = "last", split: str | None = None) -> DataFrame:
    """``(key, value)`` of two columns: the ``last`` value of each key, the ``set`` of its values, or its last value
    ``split`` into a list."""
    rows = _cells(spark, path, delimiter, key, value)
    if mode == "set":
        return rows.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("value"))
    last = rows.groupBy("key").agg(F.max_by("value", "line_id").alias("value"))
    return last if split is None else last.select("key", F.transform(F.split("value", _literal(split)), F.trim).alias("value"))


def read_mapping_csv_header(spark: SparkSession, path: str, key: str, value: str, delimiter: str = ",") -> DataFrame:
    """``(key, values)`` of two named columns, values in file order."""
    rows = spark.read.option("header", True).option("sep", delimiter).csv(path).select(F.trim(F.col(f"`{key}`")).alias("key"), F.trim(F.col(f"`{value}`")).alias("value"), F.monotonically_increasing_id().alias("n"))
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))


def read_mapping_csv_meta(spark: SparkSession, path: str, default: str = ",") -> DataFrame:
    """``(key, value)`` of a file that names its delimiter in a ``#delimiter=`` line."""
    meta = spark.read.text(path).filter(F.col("value").startswith("#delimiter=")).select(F.substring_index("value", "=", -1).alias("d")).head()
    return read_mapping_csv(spark, path, meta["d"] if meta and meta["d"] else default)


def read_mapping_json(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """``(key, value)`` of one JSON object a file; nested values stay JSON text, or are arrays of text with ``arrays``."""
    kind = "map<string,array<string>>" if arrays else "map<string,string>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def read_key_by_filename(spark: SparkSession, path: str, suffix: str = ".txt", split: str | None = None) -> DataFrame:
    """``(key, values)``: a file's name without suffix, and its lines in order (each split, if asked for)."""
    rows = _lines(spark, path).select(_stem(F.col("file"), suffix).alias("key"), "line_id", "line")
    values = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "line"))), lambda x: x["line"]).alias("values"))
    return values if split is None else values.select("key", F.flatten(F.transform("values", lambda v: F.transform(F.split(v, _literal(split)), F.trim))).alias("values"))


def _stem(file: Column, suffix: str) -> Column:
    return F.when(file.endswith(suffix), F.left(file, F.length(file) - len(suffix))).otherwise(file)


def read_filename_keys(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Names of a folder's files without suffix; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(_stem(F.element_at(F.split("path", "/"), -1), suffix).alias("value")).distinct()


def read_param_dirs(spark: SparkSession, paths: dict[str, str], suffix: str = ".txt") -> DataFrame:
    """``(key, param, values)`` of one folder a parameter."""
    parts = [read_key_by_filename(spark, p, suffix).select("key", F.lit(name).alias("param"), "values") for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def list_results(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """``(path, length)`` of files below a folder whose name matches."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return rows.filter(F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{pattern})$"))


def results_overview(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(date, jobs, summarised)`` from tables partitioned by ``date, job``."""
    jobs = results.groupBy("date").agg(F.array_sort(F.collect_set("job")).alias("jobs"))
    done = results.select("date", "job").distinct().join(summaries.select("date", "job"), ["date", "job"], "left_semi")
    return jobs.join(done.groupBy("date").agg(F.array_sort(F.collect_set("job")).alias("summarised")), "date", "left")


def sample_values(values: Column, n: int) -> Column:
    """First n of an array."""
    return F.slice(values, 1, n)


def sample_mapping(rows: DataFrame, n: int) -> DataFrame:
    """First n pairs of a mapping by key."""
    return rows.orderBy("key").limit(n)


def read_judgements_csv(spark: SparkSession, path: str, delimiter: str = "\u0000", query: int = 0, product: int = 1, grade: int = 2, least_columns: int = 3) -> DataFrame:
    """``(query, product, grade, line_id)``: every judgement of a delimited file; short lines are skipped, and what is no
    number has no grade. ``last_grades`` settles pairs given twice."""
    parts = _lines(spark, path).select("line_id", F.split("line", _literal(delimiter), -1).alias("c")).filter(F.size("c") >= max(least_columns, query + 1, product + 1, grade + 1))
    return parts.select(F.col("c")[query].alias("query"), F.col("c")[product].alias("product"), F.col("c")[grade].try_cast("double").alias("grade"), "line_id").filter("grade is not null")


def read_judgements_jsonl(spark: SparkSession, path: str, query: str = "query", products: str = "products", product: str = "productId", grade: str = "score") -> DataFrame:
    """``(query, product, grade)`` of JSON lines, one query a line; the last line of a query wins."""
    rows = spark.read.schema(f"`{query}` string, `{products}` array<struct<`{product}`:string,`{grade}`:string>>").json(path)
    rows = rows.select(F.col(f"`{query}`").alias("query"), F.col(f"`{products}`").alias("p"), F.monotonically_increasing_id().alias("n")).filter("query is not null")
    last = rows.groupBy("query").agg(F.max_by("p", "n").alias("p"))
    return last.select("query", F.explode("p").alias("x")).select("query", F.col(f"x.`{product}`").alias("product"), F.col(f"x.`{grade}`").try_cast("double").alias("grade"))
