"""SQL type names and the types they stand for."""

from __future__ import annotations

import re
from typing import Any

from pydantic import BaseModel, ConfigDict, model_serializer, model_validator
from pyspark.sql import types as T
from pyspark.sql.types import DataType, DecimalType, NumericType

#: Names of other databases and Spark's names for them.
ALIASES = {
    "INT8": "BIGINT",
    "INT4": "INT",
    "INT2": "SMALLINT",
    "FLOAT8": "DOUBLE",
    "FLOAT4": "FLOAT",
    "DOUBLE PRECISION": "DOUBLE",
    "TEXT": "STRING",
    "CHARACTER VARYING": "VARCHAR",
    "BOOL": "BOOLEAN",
    "HUGEINT": "DECIMAL(38,0)",
    "BYTEA": "BINARY",
    "TIMESTAMPTZ": "TIMESTAMP",
    "DATETIME": "TIMESTAMP",
    "JSONB": "STRING",
    "JSON": "STRING",
    "UUID": "STRING",
}


#: Spark's names of types without parameters.
PLAIN: dict[str, type[DataType]] = {
    **dict.fromkeys(("TINYINT", "BYTE"), T.ByteType),
    **dict.fromkeys(("SMALLINT", "SHORT"), T.ShortType),
    **dict.fromkeys(("INT", "INTEGER"), T.IntegerType),
    **dict.fromkeys(("BIGINT", "LONG"), T.LongType),
    **dict.fromkeys(("FLOAT", "REAL"), T.FloatType),
    "DOUBLE": T.DoubleType,
    "STRING": T.StringType,
    "BOOLEAN": T.BooleanType,
    "BINARY": T.BinaryType,
    "DATE": T.DateType,
    **dict.fromkeys(("TIMESTAMP", "TIMESTAMP_LTZ"), T.TimestampType),
    "TIMESTAMP_NTZ": T.TimestampNTZType,
    "VARIANT": T.VariantType,
}


def spark_ddl(raw: str) -> str:
    """A type name in Spark's spelling."""
    text = re.sub(r"\s+", " ", raw.strip()).upper()
    depth = 0
    while text.endswith("[]"):
        text, depth = text[:-2].strip(), depth + 1
    for name in sorted(ALIASES, key=len, reverse=True):
        text = re.sub(rf"\b{name}\b", ALIASES[name], text)
    text = re.sub(r"\bVARCHAR\b(?!\()", "STRING", text)
    return "ARRAY<" * depth + text + ">" * depth


def _simple(name: str, args: list[int]) -> DataType | None:
    if name in ("DECIMAL", "NUMERIC", "DEC"):
        precision, scale = (*args, 0)[:2] if args else (10, 0)
        return T.DecimalType(precision, scale) if 0 < precision <= 38 and 0 <= scale <= precision else None
    if name in ("VARCHAR", "CHAR") and len(args) == 1:
        return T.StringType()
    return PLAIN[name]() if name in PLAIN and not args else None


def _split(text: str) -> list[str]:
    """The parts of a list, cut at commas outside brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*parts, text[start:]]]


def _parsed(text: str) -> DataType | None:
    m = re.fullmatch(r"(ARRAY|MAP|STRUCT)\s*<(.*)>", text, re.S)
    if m is None:
        m = re.fullmatch(r"([A-Z_]+)\s*(?:\(\s*(\d+(?:\s*,\s*\d+)?)\s*\))?", text)
        return m and _simple(m[1], [int(x) for x in m[2].split(",")] if m[2] else [])
    inner = _split(m[2])
    if m[1] == "STRUCT":
        named = [re.fullmatch(r"`?(\w+)`?\s*(?::\s*|\s+)(.+)", x, re.S) for x in inner]
        kinds = [n and _parsed(n[2].strip()) for n in named]
        return T.StructType([T.StructField(n[1].lower(), k) for n, k in zip(named, kinds, strict=True)]) if all(kinds) else None
    kinds = [_parsed(x) for x in inner]
    if not all(kinds) or len(kinds) != (2 if m[1] == "MAP" else 1):
        return None
    return T.MapType(*kinds) if m[1] == "MAP" else T.ArrayType(kinds[0])


def parse(raw: str) -> DataType | None:
    """The Spark type of a name, None where it isn't one; needs no session."""
    return _parsed(spark_ddl(raw))


def canonical(kind: DataType) -> str:
    """One spelling for each type; the length limit of a string is no part of it, as in a query's result."""
    return re.sub(r"(?:var)?char\(\d+\)", "string", kind.simpleString())


class SqlType(BaseModel):
    """A type as written and, where it can be parsed, in one spelling; equal by the latter if both have it."""

    model_config = ConfigDict(extra="forbid", frozen=True)

    raw: str
    canonical: str | None = None

    @model_validator(mode="before")
    @classmethod
    def _from_text(cls, value: Any) -> Any:
        value = {"raw": value} if isinstance(value, str) else dict(value) if isinstance(value, dict) else value
        if isinstance(value, dict) and not str(value.get("raw", "")).strip():
            raise ValueError("a type needs a name")
        if isinstance(value, dict) and value.get("canonical") is None and (kind := parse(value["raw"])) is not None:
            value["canonical"] = canonical(kind)
        return value

    @model_serializer
    def _text(self) -> str:
        return self.raw

    @classmethod
    def of(cls, kind: DataType) -> SqlType:
        return cls(raw=canonical(kind), canonical=canonical(kind))

    @property
    def data_type(self) -> DataType | None:
        return parse(self.raw)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, SqlType):
            return NotImplemented
        if self.canonical and other.canonical:
            return self.canonical == other.canonical
        return self.raw == other.raw

    def __hash__(self) -> int:
        return hash(self.canonical or self.raw)


def numeric(kind: DataType | None) -> bool:
    return isinstance(kind, NumericType)


#: What exact comparisons of numbers are made in.
EXACT = DecimalType(38, 18)
