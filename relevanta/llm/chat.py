"""Chat logs to training text: event-sourced reconstruction, then a template with a loss mask.

An event log has ``conv_id, seq, kind, msg, role, text``. Folded in order of ``seq``:

* ``message`` opens message ``msg`` with a role and a first text,
* ``delta`` appends its text to message ``msg``,
* ``edit`` replaces the text of ``msg`` (later deltas append to the new text),
* ``regenerate`` replaces the text of ``msg`` and drops all messages after it that were opened before.

The fold needs no conversation in one place: a message's text is what came since its last replacement, so messages are
folded apart, and a running maximum over a conversation's messages tells which were dropped. Windows stream their
partition, so a conversation may be far larger than memory; only one message must fit.

The template writes each message as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings inside roles and texts
are escaped reversibly: the backslashes before one (or at the text's end) are doubled, and one more put before it.

Defined results: null texts and roles are empty; events of a message that was never opened are ignored; equal ``seq``
are ordered by kind, role and text; repeated rows are folded twice; a null ``conv_id`` is a conversation of its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that no text may bring into the formatted output unescaped.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY = "|".join(re.escape(c).replace("/", r"\/") for c in CONTROLS)
_JAVA_ANY = "|".join(re.sub(r"([\[\]|])", r"\\\1", c) for c in CONTROLS)


def escape(text: Column) -> Column:
    """No control string stands in the result after an even number of backslashes."""
    inner = F.regexp_replace(text, r"(\\*)(" + _JAVA_ANY + ")", r"$1$1\\$2")
    return F.regexp_replace(inner, r"(\\+)\z", r"$1$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, msg, role, text)``; ``turn`` counts from 0."""
    log = events.select("conv_id", "seq", "kind", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.struct("seq", F.when(F.col("kind") == "message", 0).otherwise(1).alias("k"), "kind", "role", "text")
    by_message = Window.partitionBy("conv_id", "msg")
    log = log.withColumn("_at", place)
    replaces = F.col("kind").isin("message", "edit", "regenerate")
    log = log.withColumns({"_open": F.min(F.when(F.col("kind") == "message", F.col("_at"))).over(by_message), "_last": F.max(F.when(replaces, F.col("_at"))).over(by_message)})
    opened = log.filter(F.col("_open").isNotNull() & (F.col("_at") >= F.col("_open")))
    messages = opened.groupBy("conv_id", "msg").agg(
        F.max("_open").alias("_open"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("_at"))).alias("_again"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_at") >= F.col("_last")) & F.col("kind").isin("message", "edit", "regenerate", "delta"), F.col("_at")))), lambda x: x["text"]), "").alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("_cut", F.max("_again").over(earlier))
    kept = messages.filter(F.col("_cut").isNull() | (F.col("_cut") < F.col("_open")))
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("msg")) - 1
    return kept.select("conv_id", turn.cast("long").alias("turn"), "msg", F.col("_open")["role"].alias("role"), "text")


def render(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment a message, in order: ``conv_id, turn, segment, loss_start, loss_end``.

    A conversation's formatted text is its segments one after another. The loss mask is the characters [loss_start,
    loss_end) of the segment, null where nothing is learned.
    """
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    learned = F.col("role").isin(list(learn_roles))
    rows = messages.select("conv_id", "turn", head.alias("_head"), body.alias("_body"), learned.alias("_learned"))
    first = F.length("_head").cast("long")
    return rows.select("conv_id", "turn", F.concat("_head", "_body", F.lit(END)).alias("segment"), F.when(F.col("_learned"), first).alias("loss_start"), F.when(F.col("_learned"), first + F.length("_body")).alias("loss_end"))


_CONTROL = re.compile(r"(\\*)(" + _ANY + ")")


def unescape(text: str) -> str:
    text = re.sub(r"(\\+)\Z", lambda m: "\\" * (len(m[1]) // 2), text)
    return _CONTROL.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of one rendered message; fails if it isn't one."""
    marks = [(m.start(2), m.end(2), m[2]) for m in _CONTROL.finditer(segment) if len(m[1]) % 2 == 0]
    if [m[2] for m in marks] != [START, SEP, END] or marks[0][0] or marks[2][1] != len(segment):
        raise ValueError("not a rendered message")
    return unescape(segment[marks[0][1] : marks[1][0]]), unescape(segment[marks[1][1] : marks[2][0]])


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation as parsed from its segments and loss mask. Streams; holds one segment at a time."""
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close() -> tuple:
            return (key, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars)

        key, turns = None, 0
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for rows in batches:
            done = []
            for conv, segment, a, b in zip(rows["conv_id"].astype(object).where(rows["conv_id"].notna(), None), rows["segment"], rows["loss_start"], rows["loss_end"], strict=True):
                if not turns or conv != key:
                    if turns:
                        done.append(close())
                    key, turns, loss_chars, chars, whole, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse(segment)
                whole.update(f"{role}\n{text}\n".encode())
                turns, chars = turns + 1, chars + len(segment)
                if a == a and a is not None:
                    learned = unescape(segment[int(a) : int(b)])
                    loss.update(learned.encode())
                    loss_chars += len(learned)
            yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"} if kind == "bigint" else {})
        if turns:
            yield pd.DataFrame([close()], columns=columns).astype({"conv_id": "Int64"} if kind == "bigint" else {})

    return ordered.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_events(turns: DataFrame, delta_chars: int = 2000) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as a log: a message event a turn, whose text streams in as deltas.

    Turns are numbered by (turn, role, text), so repeated turn numbers keep all their rows.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("msg"))
    parts = F.sequence(F.lit(0), F.ceil(F.length("text") / F.lit(delta_chars)).cast("int"))
    rows = rows.select("*", F.explode(parts).alias("_p"))
    text = F.when(F.col("_p") > 0, F.substring(F.col("text"), (F.col("_p") - 1) * delta_chars + 1, F.lit(delta_chars))).otherwise(F.lit(""))
    return rows.select("conv_id", F.struct("msg", "_p").alias("seq"), F.when(F.col("_p") == 0, "message").otherwise("delta").alias("kind"), "msg", "role", text.alias("text"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """The contract's rows: all conversations and conversation -7, whose texts look like template markers."""
    spark = conversations.sparkSession
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    return read_back(render(fold_events(turn_events(turns))))
