"""Formats of nested JSON records: trees of rules compiled to one expression over a parsed VARIANT.

A format tells what is wrong with a value, as an array of texts that begin with the value's path; an empty one means valid.
Elements of arrays and entries of maps share a path (``lines[]``, ``tags{}``), and what is wrong with several of them is
told once. Records look at the fields they name and ignore others; JSON null is a value that fits no format but ``anything``.

All that a tree can tell is known when it is compiled. So its texts are numbered, and what is wrong with a value is a long
of bits, which elements add up without arrays of texts of their own. A tree of more than 63 texts takes a long for each 63.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

#: JSON types by name, as ``schema_of_variant`` names them.
KINDS = {"int": "BIGINT", "string": "STRING", "boolean": "BOOLEAN", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT"}

#: Doubles as JSON that are no strings.
QUOTED = ['"NaN"', '"Infinity"', '"-Infinity"']

#: Texts whose bits fit into a long that is not negative.
BITS = 63


class Texts:
    """What a tree can tell, by number; ``bit`` gives the bits of those from ``first``, and none for others."""

    def __init__(self, numbers: dict[str, int], first: int = 0) -> None:
        self.numbers, self.first = numbers, first

    def bit(self, text: str) -> int:
        at = self.numbers.setdefault(text, len(self.numbers)) - self.first
        return 1 << at if 0 <= at < BITS else 0


def _long(bits: int) -> Column:
    return F.lit(bits).cast("long")


def _any(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), masks) if masks else _long(0)


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


class Format:
    #: What a VARIANT is read as before it is looked at; null if it is none.
    read: DataType = VariantType()

    def mask(self, value: Column, path: str, texts: Texts) -> Column:
        """Bits of what is wrong with a value that is read as ``read``."""
        raise NotImplementedError

    def mask_of(self, variant: Column, path: str, texts: Texts) -> Column:
        if isinstance(self.read, VariantType):
            return self.mask(variant, path, texts)
        return _bound(variant.try_cast(self.read), lambda v: self.mask(v, path, texts))

    def masks(self, variant: Column, path: str) -> list[tuple[list[str], Column]]:
        """Texts in order, at most ``BITS`` at once, with a mask of them."""
        known = Texts({})
        self.mask_of(variant, path, known)
        told = sorted(known.numbers)
        numbers = {text: i for i, text in enumerate(told)}
        return [(told[i : i + BITS], self.mask_of(variant, path, Texts(numbers, i))) for i in range(0, len(told), BITS)]

    def valid(self, variant: Column) -> Column:
        return reduce(lambda a, b: a & b, [mask == 0 for _, mask in self.masks(variant, "")], F.lit(True))


@dataclass
class Leaf(Format):
    """A value of a kind for which ``test`` holds, given as its own SQL type."""

    kind: str
    name: str
    test: Callable[[Column], Column] | None = None

    def valid(self, variant: Column) -> Column:
        schema = F.schema_of_variant(variant)
        fits = schema.rlike(f"^({KINDS[self.kind]})$") if self.kind == "number" else schema == KINDS[self.kind]
        if self.test is None:
            return F.coalesce(fits, F.lit(False))
        # a leaf's JSON is read faster than its VARIANT is cast; doubles that aren't finite stand in quotes there
        get = lambda sql: F.try_variant_get(variant, "$", sql)
        if self.kind == "int":
            return F.coalesce(fits & _bound(F.to_json(variant).try_cast("bigint"), self.test), F.lit(False))
        if self.kind == "number":
            value = F.coalesce(F.to_json(variant).try_cast("double"), F.when(fits, get("double")))
            return F.coalesce(_bound(value, lambda x: x.isNotNull() & self.test(x)), F.lit(False))
        if self.kind == "string":
            as_is = lambda j: j.startswith('"') & ~j.contains("\\") & ~j.isin(QUOTED)
            inside = lambda j: F.substr(j, F.lit(2), F.length(j) - 2)
            return F.coalesce(_bound(F.to_json(variant), lambda j: F.when(as_is(j), self.test(inside(j))).otherwise(fits & self.test(get("string")))), F.lit(False))
        return F.coalesce(fits & self.test(get(self.kind)), F.lit(False))

    def mask(self, value: Column, path: str, texts: Texts) -> Column:
        bit = texts.bit(f"{path}: {self.name}")
        return F.when(self.valid(value), _long(0)).otherwise(_long(bit)) if bit else _long(0)


class Anything(Format):
    def mask(self, value: Column, path: str, texts: Texts) -> Column:
        return _long(0)


@dataclass
class Each(Format):
    """An array whose every element has a format."""

    element: Format

    @property
    def read(self) -> DataType:
        return ArrayType(self.element.read)

    def mask(self, value: Column, path: str, texts: Texts) -> Column:
        inner = F.aggregate(value, _long(0), lambda all_, x: all_.bitwiseOR(self.element.mask(x, f"{path}[]", texts)))
        return F.coalesce(inner, _long(texts.bit(f"{path}: not an array")))


@dataclass
class Entries(Format):
    """A map: every key passes ``key``, a test of texts, and every value has a format."""

    key: Callable[[Column], Column]
    value: Format

    @property
    def read(self) -> DataType:
        return MapType(StringType(), self.value.read)

    def mask(self, value: Column, path: str, texts: Texts) -> Column:
        names = F.when(F.forall(F.map_keys(value), self.key), _long(0)).otherwise(_long(texts.bit(f"{path}{{}}: key")))
        inner = F.aggregate(F.map_values(value), names, lambda all_, x: all_.bitwiseOR(self.value.mask(x, f"{path}{{}}", texts)))
        return F.coalesce(inner, _long(texts.bit(f"{path}: not a record")))


@dataclass
class Either(Format):
    """At least one of several formats."""

    formats: list[Format]

    def mask(self, value: Column, path: str, texts: Texts) -> Column:
        bit = texts.bit(f"{path}: none of {len(self.formats)}")
        fits = reduce(lambda a, b: a | b, [f.valid(value) for f in self.formats], F.lit(False)) if bit else F.lit(True)
        return F.when(fits, _long(0)).otherwise(_long(bit))


@dataclass
class Field:
    """A field of a record. Its name is a text, or a pattern that the first fitting name of the record has to match."""

    name: str
    format: Format
    required: bool = True
    pattern: bool = False

    def mask(self, record: Record, value: Column, path: str, texts: Texts) -> Column:
        at = f"{path}.{self.name}" if path else self.name
        missing = _long(texts.bit(f"{at}: missing") if self.required else 0)
        look = lambda v: F.when(v.isNull(), missing).otherwise(self.format.mask_of(v, at, texts))
        if self.pattern:
            fitting = F.filter(F.map_keys(value), lambda k: k.rlike(f"^(?:{self.name})$"))
            return _bound(F.try_element_at(value, F.get(fitting, F.lit(0))), look)
        return look(record.at(value, self.name)) if record.plain else _bound(record.at(value, self.name), look)


@dataclass
class Record(Format):
    """A record with fields, and with more fields for each value of another field; a value that none are named for, or the
    lack of one, is wrong."""

    fields: list[Field]
    conditional: dict[str, dict[str, list[Field]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        named = [*self.fields, *(f for cases in self.conditional.values() for fields in cases.values() for f in fields)]
        self.names = list(dict.fromkeys([f.name for f in named if not f.pattern] + list(self.conditional)))
        #: Whether names are all known and differ by more than case: such a record is read as a struct, others as a map.
        self.plain = bool(self.names) and all(self.names) and not any(f.pattern for f in named) and len({n.lower() for n in self.names}) == len(self.names)

    @property
    def read(self) -> DataType:
        if not self.plain:
            return MapType(StringType(), VariantType())
        return reduce(lambda struct, name: struct.add(name, VariantType()), self.names, StructType())

    def at(self, value: Column, name: str) -> Column:
        return value.getField(name) if self.plain else F.try_element_at(value, F.lit(name))

    def mask(self, value: Column, path: str, texts: Texts) -> Column:
        parts = [f.mask(self, value, path, texts) for f in self.fields]
        for name, cases in self.conditional.items():
            own = F.try_variant_get(self.at(value, name), "$", "string")
            chosen = _long(texts.bit(f"{path}.{name}: unknown condition" if path else f"{name}: unknown condition"))
            for case, fields in cases.items():
                chosen = F.when(own == case, _any([f.mask(self, value, path, texts) for f in fields])).otherwise(chosen)
            parts.append(chosen)
        return F.when(value.isNull(), _long(texts.bit(f"{path or 'record'}: not a record"))).otherwise(_any(parts))


def typed(kind: str) -> Format:
    return Leaf(kind, f"not {kind}")


def regex(pattern: str) -> Format:
    return Leaf("string", "no match", lambda x: x.rlike(f"^(?:{pattern})$"))


def choice(values: list) -> Format:
    kind = "string" if isinstance(values[0], str) else "boolean" if isinstance(values[0], bool) else "int" if isinstance(values[0], int) else "number"
    return Leaf(kind, "not a choice", lambda x: x.isin(values))


def between(low: float | None = None, high: float | None = None, kind: str = "number") -> Format:
    def test(x: Column) -> Column:
        fits = x.isNotNull()
        fits = fits & (x >= low) if low is not None else fits
        return fits & (x <= high) if high is not None else fits

    return Leaf(kind, "out of range", test)


def _told(texts: list[str], mask: Column) -> Column:
    return _bound(mask, lambda m: F.filter(F.array(*map(F.lit, texts)), lambda _, i: F.getbit(m, i) == 1))


def invalid_parts(json: Column, format_: Format) -> Column:
    """What is wrong with a JSON text, sorted; a text that is no JSON is one thing wrong."""

    def told(variant: Column) -> Column:
        parts = [_told(texts, mask) for texts, mask in format_.masks(variant, "")]
        return parts[0] if len(parts) == 1 else F.concat(F.array().cast("array<string>"), *parts)

    return _bound(F.try_parse_json(json), lambda v: F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(told(v)))
