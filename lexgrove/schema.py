"""Schemas of document tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidInput
from .functions.text import Analyzer, Registry
from .plans.scan import Fields

_KINDS: dict[str, T.DataType] = {"text": T.StringType(), "number": T.DoubleType(), "date": T.TimestampType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    indexed: bool = True
    stored: bool = True
    analyzer: str | None = None


@dataclass(frozen=True)
class SearchSchema:
    """Typed fields beside ``doc_id``."""

    fields: tuple[Field, ...] = ()
    default_analyzer: str = "standard"
    registry: Registry = field(default_factory=Registry, compare=False)

    def with_text(self, name: str, analyzer: str | None = None, indexed: bool = True, stored: bool = True) -> SearchSchema:
        return SearchSchema((*self.fields, Field(name, "text", indexed, stored, analyzer)), self.default_analyzer, self.registry)

    def with_field(self, name: str, kind: str) -> SearchSchema:
        if kind not in _KINDS:
            raise InvalidInput(f"no kind of field is {kind!r}")
        return SearchSchema((*self.fields, Field(name, kind)), self.default_analyzer, self.registry)

    @staticmethod
    def infer(df: DataFrame, **options) -> SearchSchema:
        """From a DataFrame's columns; numbers become doubles."""
        out = []
        for f in df.schema.fields:
            if f.name == "doc_id":
                continue
            t = f.dataType
            kind = "text" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else "date" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None
            if kind is None:
                raise InvalidInput(f"column {f.name} has a type that no field can have: {t.simpleString()}")
            out.append(Field(f.name, kind))
        return SearchSchema(tuple(out), **options)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f.name, _KINDS[f.kind]) for f in self.fields)])

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` with exactly the schema's columns; absent fields are null."""
        have = set(df.columns)
        if "doc_id" not in have:
            raise InvalidInput("documents need a doc_id")
        unknown = have - {f.name for f in self.fields} - {"doc_id"}
        if unknown:
            raise InvalidInput(f"the schema has no field {sorted(unknown)}")
        return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.struct().fields])

    def analyzers(self) -> dict[str, Analyzer]:
        return {f.name: self.registry.get(f.analyzer or self.default_analyzer) for f in self.fields if f.kind == "text"}

    def query_fields(self) -> Fields:
        indexed = {f.name for f in self.fields if f.indexed} | {"doc_id"}
        return Fields({f.name: f.dataType for f in self.struct().fields if f.name in indexed}, self.analyzers(), self.registry.get(self.default_analyzer))

    def stored(self) -> list[str]:
        return ["doc_id", *(f.name for f in self.fields if f.stored)]


def from_map(df: DataFrame, schema: SearchSchema, column: str = "fields") -> DataFrame:
    """Rows of (doc_id, map of name to struct<text,number,date,boolean>) as a wide table."""
    return df.select("doc_id", *[F.col(column)[f.name][f.kind].cast(_KINDS[f.kind]).alias(f.name) for f in schema.fields])
