"""Fixed-layout records: a layout text becomes typed column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B

_FIXED = {"u8": 1, "u16": 2, "u32": 4, "i8": 1, "i16": 2, "i32": 4, "ptr": 4, "u32ptr": 4}
_SIZED = re.compile(r"(char|bytes|pad)\[([0-9]+)\]")
MAXIMUM_ROWS = 65536


class LayoutError(ValueError):
    """A layout that names no column or cannot be read."""


@dataclass(frozen=True)
class Field:
    kind: str
    offset: int
    size: int

    def column(self, record: Column) -> Column:
        raw = F.substring(record, F.lit(self.offset + 1), F.lit(self.size))
        if self.kind == "char":
            return B.until_nul(B.latin1(raw))
        if self.kind == "bytes":
            return raw
        value = B.unsigned(record, self.offset, self.size)
        return B.signed(value, 8 * self.size) if self.kind[0] == "i" else value

    @property
    def numeric(self) -> bool:
        return self.kind not in ("char", "bytes")


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field, ...]
    size: int

    @classmethod
    def parse(cls, text: str) -> Layout:
        """``u8 u16 u32 i8 i16 i32 ptr char[N] bytes[N] pad[N]``, by commas;
        blanks and empty parts are skipped; pads move offsets only."""
        fields, at = [], 0
        for token in (t.strip() for t in text.split(",")):
            if not token:
                continue
            if token in _FIXED:
                kind, size = ("ptr" if token == "u32ptr" else token), _FIXED[token]
            elif m := _SIZED.fullmatch(token):
                kind, size = m[1], int(m[2])
            else:
                raise LayoutError(f"unknown field {token!r}")
            if kind != "pad":
                fields.append(Field(kind, at, size))
            at += size
        if not fields or not at:
            raise LayoutError("a layout needs a column and a size")
        return cls(tuple(fields), at)


def decode(sources: DataFrame, layout: Layout, rows: int, offset: int = 0, maximum_rows: int = MAXIMUM_ROWS) -> DataFrame:
    """Records of each source: (source_id, row, offset, row_total, f0, f1, ...).

    ``row_total`` counts the whole records from ``offset`` on, however many are
    asked for; a part of a record at the end is left out. An offset past the
    end is an error; at the end there are no rows.
    """
    size = F.octet_length("content").cast("long")
    available = F.expr(f"(octet_length(content) - {offset}) div {layout.size}")
    total = F.when(size >= offset, available).otherwise(
        F.raise_error(F.concat(F.lit(f"offset {offset} is past the end of source "), F.col("source_id").cast("string"))).cast("long")
    )
    counted = sources.withColumn("row_total", total)
    take = F.least(F.col("row_total"), F.lit(min(rows, maximum_rows)))
    grid = counted.select("source_id", "content", "row_total", F.explode(
        F.when(take > 0, F.sequence(F.lit(0).cast("long"), take - 1)).otherwise(F.array().cast("array<bigint>"))
    ).alias("row"))
    placed = grid.withColumn("offset", F.col("row") * layout.size + offset)
    record = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.lit(layout.size))
    cut = placed.select("source_id", "row", "offset", "row_total", record.alias("_record"))
    return cut.select("source_id", "row", "offset", "row_total", *[f.column(F.col("_record")).alias(f"f{i}") for i, f in enumerate(layout.fields)])
