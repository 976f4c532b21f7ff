"""Many patterns against many tags in one pass a tag.

A pattern is a regular expression that a tag has to begin with (``re.match``); round brackets are plain characters, as they
belong to tags. Of each of its alternatives the longest text that any match must hold goes into one Aho-Corasick automaton.
One walk over a tag finds the texts in it, and only patterns whose text is there are tried. Alternatives that need no text,
such as ``.*`` or ``[0-9]+``, are tried on every tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevanta.sources.work import staged

#: Patterns of one pass, in characters: what a pass broadcasts. More patterns are matched in several passes.
PATTERN_CHARS = 16 << 20
_UNIT = re.compile(r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.)([*+?]\??|\{[0-9]+(?:,[0-9]*)?\}\??)?", re.S)


def plain_brackets(pattern: str) -> str:
    """The pattern with ``(`` and ``)`` as plain characters."""
    return "".join(("\\" + unit if unit in ("(", ")") else unit) + (often or "") for unit, often in _UNIT.findall(pattern))


def required_texts(pattern: str) -> list[str]:
    """For each alternative the longest text that every match of it holds, empty if there is none."""
    out, best, run = [], "", ""
    for unit, often in [*_UNIT.findall(pattern), ("|", "")]:
        least = 1 if not often or often[0] == "+" else int(re.match(r"\{([0-9]+)", often)[1]) if often[0] == "{" else 0
        if unit == "|":
            out.append(max(best, run, key=len))
            best = run = ""
            continue
        literal = unit if len(unit) == 1 and unit not in ".^$" else unit[1] if unit[0] == "\\" and not unit[1].isalnum() else ""
        if literal and least:
            run += literal
        if not literal or often:
            best, run = max(best, run, key=len), ""
    return out


class PatternSet:
    def __init__(self, patterns: list[str]):
        self.tests = [re.compile(plain_brackets(p), re.S).match for p in patterns]
        self.always, found = [], {}
        for i, p in enumerate(patterns):
            texts = required_texts(p)
            if not all(texts):
                self.always.append(i)
            else:
                for text in texts:
                    found.setdefault(text, []).append(i)
        self.automaton = ahocorasick.Automaton() if found else None
        for text, own in found.items():
            self.automaton.add_word(text, own)
        if found:
            self.automaton.make_automaton()

    def match(self, tag: str) -> list[int]:
        """The numbers of the patterns that the tag begins with."""
        tried = set(self.always)
        if self.automaton is not None:
            for _, own in self.automaton.iter(tag):
                tried.update(own)
        return sorted(i for i in tried if self.tests[i](tag))


def matching(tags: DataFrame, tag_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """``tag, pattern`` of every different tag and pattern that match; nulls match nothing. Patterns reach the tasks in
    passes of at most ``PATTERN_CHARS``."""
    spark = tags.sparkSession
    different = staged(tags.filter(F.col(tag_col).isNotNull()).select(F.col(tag_col).alias("tag")).distinct(), "tags")
    wanted = patterns.filter(F.col(pattern_col).isNotNull()).select(F.col(pattern_col).alias("pattern")).distinct()
    wanted = staged(wanted, "patterns")
    passes = -(-(wanted.agg(F.sum(F.length("pattern") + 16)).first()[0] or 1) // PATTERN_CHARS)
    out = None
    for n in range(passes):
        own = sorted(r["pattern"] for r in wanted.filter(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == n).collect())
        known = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            names, rules = known.value, PatternSet(known.value)
            for batch in batches:
                found = [(tag, names[i]) for tag in batch.column(0).to_pylist() for i in rules.match(tag)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["tag", "pattern"])

        part = different.mapInArrow(run, "tag string, pattern string")
        out = part if out is None else out.unionByName(part)
    return out
