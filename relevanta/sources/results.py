"""Result documents: wide tab-separated files and columnar JSON, one document a tag, to and from long rows.

Long rows are ``tag, params MAP<STRING, ARRAY<STRING>>, params_key, metric, agg_type, value, map_value, nested_value,
seq_value, success_count, weighted_success_count, fail_count, weighted_fail_count, fail_reasons MAP<STRING, BIGINT>,
context_info``. The type of a metric says which of the four values it has; writers take rows that lack columns. A tag with
more than ``settings_per_part`` settings is several documents, each complete in itself, so no task holds more. Parquet
partitioned by tag is the store that loses nothing; both documents are exports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevanta.functions.text import params_key

#: Column families of a metric in a wide file, in order, and the mark of a line that names a metric's type.
FAMILIES = ("fail-count-", "weighted-fail-count-", "failReasons-", "success-count-", "weighted-success-count-", "value-")
TYPE_LINE = "# K_METRIC_AGGREGATOR_MAPPING "
DEFAULT_TYPE = "DOUBLE_AVG"
#: By type: the column of the value, its SQL type, and the JSON of no value.
VALUES = {
    "DOUBLE_AVG": ("value", "double", "0.0"),
    "MAP_UNWEIGHTED_SUM_VALUE": ("map_value", "map<string,double>", "{}"),
    "MAP_WEIGHTED_SUM_VALUE": ("map_value", "map<string,double>", "{}"),
    "MAP_AVG_VALUE": ("map_value", "map<string,double>", "{}"),
    "NESTED_MAP_UNWEIGHTED_SUM_VALUE": ("nested_value", "map<string,map<string,double>>", "{}"),
    "NESTED_MAP_WEIGHTED_SUM_VALUE": ("nested_value", "map<string,map<string,double>>", "{}"),
    "SEQUENCE_KEEP_FIRST": ("seq_value", "array<string>", "[]"),
}
_TYPED = dict.fromkeys((column, type_) for column, type_, _ in VALUES.values())
SETTINGS_PER_PART = 100_000
#: A document with this line has the characters of ``ESCAPES`` percent-encoded in names, values and reasons; others are read
#: as they are. It is written only where something had to be encoded.
ESCAPED_LINE = "# PERCENT_ENCODED"
ESCAPES = {"%": "%25", "\t": "%09", "\n": "%0A", "\r": "%0D", "&": "%26", ",": "%2C", ":": "%3A", " ": "%20"}
#: What has to be encoded in a cell, in a fail reason, and in a metric's name on its type line.
IN_CELL, IN_REASON, IN_TYPE = "%\t\n\r&", "%\t\n\r&,:", "%\t\n\r& "


def encoded(text: Column, characters: str = IN_CELL) -> Column:
    """Encoded text; a leading ``#`` would begin a comment and is encoded too."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(ESCAPES[c]))
    return F.when(text.startswith("#"), F.concat(F.lit("%23"), F.substr(text, F.lit(2)))).otherwise(text)


def encoded_name(name: str, characters: str = IN_CELL) -> str:
    """A parameter's or metric's name; a parameter that looks like a column of a metric has its first letter encoded."""
    out = "".join(ESCAPES.get(c, c) if c in characters else c for c in name)
    special = out.startswith("#") or out == "contextInfo" or any(out.startswith(f) for f in FAMILIES)
    return f"%{ord(out[0]):02X}{out[1:]}" if special and out else out


def decoded(text: Column) -> Column:
    first = {"%23": "#"} | {f"%{ord(c):02X}": c for c in {f[0] for f in FAMILIES} | {"c"}}
    for code, c in (*first.items(), *((code, c) for c, code in ESCAPES.items() if c != "%"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(c))
    return text


def complete(rows: DataFrame) -> DataFrame:
    """``rows`` with every column of long rows; what they lack is null, or nothing for counts and reasons."""
    zeros = {"success_count": F.lit(0).cast("long"), "fail_count": F.lit(0).cast("long"), "fail_reasons": F.create_map().cast("map<string,bigint>"), "agg_type": F.lit(DEFAULT_TYPE)}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (*_TYPED, ("context_info", "string")) if c not in rows.columns})
    rows = rows.withColumns({c: z for c, z in zeros.items() if c not in rows.columns})
    return rows.withColumns({c: F.col(n).cast("double") for c, n in (("weighted_success_count", "success_count"), ("weighted_fail_count", "fail_count")) if c not in rows.columns})


def value_json(decimals: int | None = None) -> Column:
    """The value of a long row as JSON text, numbers of their own with ``decimals`` if asked for."""
    number = F.col("value").cast("string") if decimals is None else F.format_string(f"%.{decimals}f", "value")
    return F.coalesce(F.when(F.col("agg_type") == DEFAULT_TYPE, number), F.to_json("map_value"), F.to_json("nested_value"), F.to_json("seq_value"))


def typed_values(kind: Column, json: Column) -> list[Column]:
    """``value, map_value, nested_value, seq_value`` out of JSON text: the one of the metric's type, the others null."""
    out = []
    for column, type_ in _TYPED:
        own = json.try_cast("double") if type_ == "double" else F.from_json(json, type_)
        out.append(F.when(kind.isin([k for k, v in VALUES.items() if v[0] == column]), own).alias(column))
    return out


def _sizes(rows: DataFrame, settings_per_part: int) -> DataFrame:
    return rows.select("tag", "params_key").distinct().groupBy("tag").agg(F.ceil(F.count("*") / settings_per_part).cast("int").alias("_parts"))


def _parts(rows: DataFrame, settings_per_part: int) -> DataFrame:
    """``rows`` with the ``part`` of their tag's document."""
    return rows.join(_sizes(rows, settings_per_part), "tag").withColumn("part", F.pmod(F.xxhash64("params_key"), F.col("_parts")).cast("int")).drop("_parts")


def _typed(line: Column, escaped: Column) -> Column:
    """``metric, agg_type`` of a type line."""
    parts = F.split(F.substr(line, F.lit(len(TYPE_LINE) + 1)), " ")
    return F.struct(F.when(escaped, decoded(parts[0])).otherwise(parts[0]).alias("metric"), F.coalesce(F.get(parts, F.lit(1)), F.lit(DEFAULT_TYPE)).alias("agg_type"))


def read_metric_types(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, agg_type)`` named in wide files below a folder."""
    marks = spark.read.text(path).filter(F.col("value").startswith(TYPE_LINE) | (F.col("value") == ESCAPED_LINE)).select("value", F.col("_metadata.file_path").alias("path"))
    marks = marks.groupBy("path").agg(F.bool_or(F.col("value") == ESCAPED_LINE).alias("_escaped"), F.collect_set("value").alias("lines"))
    named = marks.select("_escaped", F.explode("lines").alias("line")).filter(F.col("line") != ESCAPED_LINE)
    return named.select(_typed(F.col("line"), F.col("_escaped")).alias("t")).select("t.*").distinct()


def read_results_csv(spark: SparkSession, path: str, tag: Column | None = None) -> DataFrame:
    """Long rows of wide files. Each file has a header of its own; ``contextInfo`` may be absent; the tag is the file's
    name unless given as a column of ``file`` or of the folders' partition columns.

    Files are read in splits: what each file's header and type lines say is found first, one row a file, and meets the lines
    of all its splits by the file's path. A line equal to its file's header is that header."""
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"), *folders).filter("value <> ''")
    comment = F.col("value").startswith("#")
    of_file = lines.groupBy("path").agg(
        F.min_by(F.when(~comment, F.col("value")), F.when(~comment, F.col("place"))).alias("header"),
        F.collect_set(F.when(F.col("value").startswith(TYPE_LINE), F.col("value"))).alias("type_lines"),
        F.coalesce(F.bool_or(F.col("value") == ESCAPED_LINE), F.lit(False)).alias("escaped"),
    )
    kinds = F.map_from_entries(F.array_distinct(F.transform("type_lines", lambda x: _typed(x, F.col("escaped")))))
    of_file = of_file.filter("header is not null").select("path", "header", "escaped", F.split("header", "\t").alias("head"), kinds.alias("types"))
    rows = lines.filter(~comment).join(of_file, "path").filter(F.col("value") != F.col("header"))
    rows = rows.withColumn("file", F.regexp_replace("file", r"\.[^.]*$", "")).select((tag if tag is not None else F.col("file")).alias("tag"), "types", "head", "escaped", F.split("value", "\t").alias("cells"))
    plain = lambda x: F.when(F.col("escaped"), decoded(x)).otherwise(x)
    cell = F.map_from_entries(F.transform(F.col("head"), lambda h, i: F.struct(h, F.get(F.col("cells"), i))))
    rows = rows.select("tag", "types", cell.alias("cell"), "head", "escaped")
    is_metric = lambda h: h.rlike("^(" + "|".join(FAMILIES) + ")") | (h == "contextInfo")
    values = lambda h: F.transform(F.split(F.element_at("cell", h), "&"), plain)
    params = F.map_from_entries(F.transform(F.filter("head", lambda h: ~is_metric(h)), lambda h: F.struct(plain(h), values(h))))
    metrics = F.transform(F.filter("head", lambda h: h.startswith("value-")), lambda h: F.substr(h, F.lit(len("value-") + 1)))
    rows = rows.select("tag", params.alias("params"), "types", "cell", "escaped", F.explode(metrics).alias("column")).withColumn("metric", plain(F.col("column")))
    family = lambda f: F.try_element_at("cell", F.concat(F.lit(f), F.col("column")))
    counted = F.transform(F.split(F.nullif(family("failReasons-"), F.lit("")), ","), lambda x: F.split(x, ":"))
    reasons = F.map_from_entries(F.transform(counted, lambda p: F.struct(plain(p[0]), F.get(p, F.lit(1)).try_cast("long"))))
    kind = F.coalesce(F.try_element_at("types", F.col("metric")), F.lit(DEFAULT_TYPE))
    number = lambda f: F.coalesce(family(f).try_cast("double"), F.lit(0.0))
    return rows.select(
        "tag", "params", params_key(F.col("params")).alias("params_key"), "metric", kind.alias("agg_type"), *typed_values(kind, plain(family("value-"))),
        number("success-count-").cast("long").alias("success_count"), number("weighted-success-count-").alias("weighted_success_count"), number("fail-count-").cast("long").alias("fail_count"), number("weighted-fail-count-").alias("weighted_fail_count"),
        F.coalesce(reasons, F.create_map().cast("map<string,bigint>")).alias("fail_reasons"), F.nullif(plain(F.try_element_at("cell", F.lit("contextInfo"))), F.lit("")).alias("context_info"),
    )


def reasons_text(reasons: Column, encode: bool = False) -> Column:
    name = (lambda k: encoded(k, IN_REASON)) if encode else (lambda k: k)
    return F.array_join(F.transform(F.array_sort(F.map_entries(reasons)), lambda e: F.concat(name(e["key"]), F.lit(":"), e["value"].cast("string"))), ",")


def results_csv_lines(rows: DataFrame, params: list[str], metrics: dict[str, str], decimals: int = 4, settings_per_part: int = SETTINGS_PER_PART) -> DataFrame:
    """``(tag, part, n, params_key, line)``: the lines of each tag's wide documents; parameters and metrics are sorted,
    numbers have four decimals by default, maps and sequences are JSON. ``metrics`` maps names to types. What a cell can't
    hold is percent-encoded, in documents that say so in a line of their own. A parameter without a value is an empty cell."""
    params, names = sorted(params), sorted(metrics)
    four = lambda c: F.format_string(f"%.{decimals}f", c)
    pick = lambda c, m: F.first(F.when(F.col("metric") == m, c), ignorenulls=True)
    nothing = f"{0:.{decimals}f}"
    rows = _parts(complete(rows), settings_per_part).withColumn("_value", value_json(decimals))
    cells = []
    for m in names:
        empty = nothing if metrics[m] == DEFAULT_TYPE else VALUES[metrics[m]][2]
        cells += [F.coalesce(pick(c, m), F.lit(z)) for c, z in ((F.col("fail_count").cast("string"), "0"), (four("weighted_fail_count"), nothing), (reasons_text(F.col("fail_reasons"), True), ""), (F.col("success_count").cast("string"), "0"), (four("weighted_success_count"), nothing), (encoded(F.col("_value")), empty))]
    setting = [F.coalesce(F.array_join(F.transform(F.try_element_at(F.first("params"), F.lit(p)), lambda v: encoded(v)), "&"), F.lit("")) for p in params]
    context = F.coalesce(encoded(F.first("context_info", ignorenulls=True)), F.lit("{}"))
    body = rows.groupBy("tag", "part", "params_key").agg(F.concat_ws("\t", *setting, *cells, context).alias("line"))
    head = [f"{TYPE_LINE}{encoded_name(m, IN_TYPE)} {metrics[m]}" for m in names]
    head.append("\t".join([*map(encoded_name, params), *(f + encoded_name(m) for m in names for f in FAMILIES), "contextInfo"]))
    # a percent sign stands in a document only where something is encoded
    marked = F.lit(any("%" in h for h in head)) | F.bool_or(F.contains("line", F.lit("%")))
    head_lines = F.concat(F.when(F.col("_marked"), F.array(F.lit(ESCAPED_LINE))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, head)))
    top = body.groupBy("tag", "part").agg(marked.alias("_marked")).select("tag", "part", F.posexplode(head_lines).alias("n", "line"))
    return top.select("tag", "part", "n", F.lit("").alias("params_key"), "line").unionByName(body.select("tag", "part", F.lit(len(head) + 1).alias("n"), "params_key", "line"))


def write_results_csv(rows: DataFrame, path: str, params: list[str], metrics: dict[str, str], decimals: int = 4, settings_per_part: int = SETTINGS_PER_PART) -> None:
    """Folders ``tag=/part=`` with the tag's documents, each in order and written by one task, however many parts there are."""
    by = ["tag", "part"]
    lines = results_csv_lines(rows, params, metrics, decimals, settings_per_part)
    lines.repartition(*by).sortWithinPartitions(*by, "n", "params_key").select(*by, "line").write.partitionBy(*by).text(path)


def results_json(rows: DataFrame, settings_per_part: int = SETTINGS_PER_PART) -> DataFrame:
    """``(tag, part, document)``: one columnar JSON document: labels are parameter settings, an entry a type has, a
    dataset a metric, arrays in their order, and so has ``contextInfos``. A setting that lacks a metric holds the type's
    empty value and no samples."""
    by = ["tag", "part"]
    rows = _parts(complete(rows), settings_per_part)
    by_key = lambda a, b: F.when(a["params_key"] < b["params_key"], -1).when(a["params_key"] > b["params_key"], 1).otherwise(0)
    by_name = lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1)
    context = F.parse_json(F.coalesce(F.first("context_info", ignorenulls=True), F.lit("{}")))
    settings = rows.groupBy(*by, "params_key").agg(F.first("params").alias("params"), context.alias("context"), F.max("success_count").alias("ok"), F.max("fail_count").alias("failed"))
    settings = settings.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("params_key", "params", "context", "ok", "failed")), by_key).alias("_settings"))
    counts = ["success_count", "weighted_success_count", "fail_count", "weighted_fail_count", "fail_reasons"]
    own = F.map_from_entries(F.collect_list(F.struct("params_key", F.struct(value_json().alias("json"), *counts))))
    sets = rows.groupBy(*by, "agg_type", "metric").agg(own.alias("_own")).join(settings, by)
    at = lambda c, zero: F.transform("_settings", lambda s: F.coalesce(F.try_element_at("_own", s["params_key"])[c], zero))
    empty = F.element_at(F.create_map(*(F.lit(x) for k, v in VALUES.items() for x in (k, v[2]))), F.col("agg_type"))
    dataset = F.struct(
        F.col("metric").alias("name"), F.transform(at("json", empty), F.parse_json).alias("data"), at("success_count", F.lit(0).cast("long")).alias("successSamples"), at("weighted_success_count", F.lit(0.0)).alias("weightedSuccessSamples"),
        at("fail_count", F.lit(0).cast("long")).alias("failSamples"), at("weighted_fail_count", F.lit(0.0)).alias("weightedFailSamples"), at("fail_reasons", F.create_map().cast("map<string,bigint>")).alias("failReasons"),
    )
    most = lambda c: F.array_max(F.transform("_settings", lambda s: s[c]))
    entries = sets.groupBy(*by, "agg_type").agg(F.array_sort(F.collect_list(dataset), by_name).alias("datasets"), F.first("_settings").alias("_settings"))
    entry = F.struct(F.col("agg_type").alias("name"), F.col("agg_type").alias("entryType"), F.transform("_settings", lambda s: s["params"]).alias("labels"), "datasets", most("ok").alias("successCount"), most("failed").alias("failCount"))
    whole = entries.groupBy(*by).agg(F.array_sort(F.collect_list(entry), by_name).alias("data"), F.transform(F.first("_settings"), lambda s: s["context"]).alias("contextInfos"))
    data = F.transform("data", lambda e: e.dropFields("name"))
    return whole.select(*by, F.to_json(F.struct(F.col("tag").alias("name"), data.alias("data"), "contextInfos")).alias("document"))


def write_results_json(rows: DataFrame, path: str, settings_per_part: int = SETTINGS_PER_PART) -> None:
    """A folder a tag with its documents, one a line."""
    results_json(rows, settings_per_part).select("tag", "document").write.partitionBy("tag").text(path)


_DATASET = "struct<name:string,data:array<string>,successSamples:array<bigint>,weightedSuccessSamples:array<double>,failSamples:array<bigint>,weightedFailSamples:array<double>,failReasons:array<map<string,bigint>>>"


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of such documents."""
    entries = f"array<struct<entryType:string,labels:array<map<string,array<string>>>,datasets:array<{_DATASET}>>>"
    whole = spark.read.text(path).select(F.from_json("value", f"name string, data {entries}, contextInfos array<string>").alias("d"))
    sets = whole.select(F.col("d.name").alias("tag"), F.col("d.contextInfos").alias("c"), F.explode("d.data").alias("e")).select("tag", "c", F.col("e.entryType").alias("agg_type"), F.col("e.labels").alias("labels"), F.explode("e.datasets").alias("s"))
    arrays = ["data", "successSamples", "weightedSuccessSamples", "failSamples", "weightedFailSamples", "failReasons"]
    rows = sets.select("tag", "agg_type", F.col("s.name").alias("metric"), F.explode(F.arrays_zip(F.col("labels"), F.col("c"), *(F.col(f"s.{a}") for a in arrays))).alias("x"))
    counts = {"successSamples": "success_count", "weightedSuccessSamples": "weighted_success_count", "failSamples": "fail_count", "weightedFailSamples": "weighted_fail_count", "failReasons": "fail_reasons"}
    return rows.select("tag", F.col("x.labels").alias("params"), params_key(F.col("x.labels")).alias("params_key"), "metric", "agg_type", *typed_values(F.col("agg_type"), F.col("x.data")), *(F.col(f"x.{a}").alias(c) for a, c in counts.items()), F.col("x.c").alias("context_info"))


def write_results_by_tag(rows: DataFrame, path: str) -> None:
    """The store: Parquet partitioned by tag; tags are dealt out so that one task writes few of them."""
    rows.repartition("tag").write.mode("overwrite").partitionBy("tag").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """``summary`` of a job below its folder."""
    summary.write.mode("overwrite").json(f"{path.rstrip('/')}/summary")
