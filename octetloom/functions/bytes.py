"""Byte access as Catalyst expressions. All take and return Columns.

Scans work inside a row: a source's bytes are never exploded into rows, so no
scan shuffles, and one large source costs one task no more than its own bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRINTABLE = r"[\x20-\x7e]"
NO_SPANS = "cast(array() AS array<struct<start: bigint, stop: bigint, text: string>>)"


def latin1(content: Column) -> Column:
    """One character a byte, U+0000 to U+00FF."""
    return F.decode(content, "ISO-8859-1")


def byte_array(content: Column) -> Column:
    """The bytes as an array of ints, empty for empty input."""
    return F.when(F.octet_length(content) > 0, F.transform(F.split(latin1(content), ""), lambda c: F.ascii(c))).otherwise(
        F.array().cast("array<int>")
    )


def unsigned(content: Column, offset: Column | int, width: int) -> Column:
    """Big-endian unsigned integer of 1, 2 or 4 bytes at a 0-based offset, as a
    long; null where the bytes end too soon."""
    at = (F.lit(offset) if isinstance(offset, int) else offset).cast("int")
    raw = F.substring(content, at + 1, F.lit(width))
    return F.when((at >= 0) & (at + width <= F.octet_length(content)), F.conv(F.hex(raw), 16, 10).cast("long"))


def signed(value: Column, bits: int) -> Column:
    """Two's complement reading of an unsigned long."""
    return value - F.when(value >= (1 << (bits - 1)), F.lit(1 << bits)).otherwise(F.lit(0))


def bounded_u32(value: Column) -> Column:
    """The value if it is an unsigned 32-bit number, else null."""
    return F.when(value.between(0, 0xFFFFFFFF), value)


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\x00", 1)


def rgb4_to_rgb8(word: Column) -> Column:
    """$0RGB to a struct of 8-bit channels: each nibble times 17."""
    word = word.cast("long")
    return F.struct(
        (F.shiftright(word, 8).bitwiseAND(15) * 17).alias("r"),
        (F.shiftright(word, 4).bitwiseAND(15) * 17).alias("g"),
        (word.bitwiseAND(15) * 17).alias("b"),
    )


def parse_number(text: Column) -> Column:
    """Decimal, 0x or $ hexadecimal; null for anything else."""
    t = F.lower(F.trim(text))
    digits = F.regexp_extract(t, r"^(?:0x|\$)([0-9a-f]+)$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long")).when(t.rlike(r"^[0-9]{1,18}$"), t.try_cast("long"))


def pattern_spans(content: Column, pattern: str) -> Column:
    """All leftmost matches of ``pattern`` in the bytes (as Latin-1): an array
    of (start, stop, text), by running sums over the text between matches."""
    text = latin1(content)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("text"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(NO_SPANS).alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["spans"])).otherwise(F.expr(NO_SPANS))


def entropy(values: Column) -> Column:
    """Shannon entropy in bits of an array of bytes; 0 for an empty one."""
    ordered = F.array_sort(values)
    n = F.size(values).cast("double")

    def weight(run: Column) -> Column:
        return F.when(run > 1, run * F.log2(run)).otherwise(F.lit(0.0))

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        return F.struct(
            x.alias("last"),
            F.when(same, acc["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + weight(acc["run"])).alias("sum"),
        )

    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    total = F.aggregate(ordered, zero, step, lambda acc: acc["sum"] + weight(acc["run"]))
    return F.when(F.size(values) > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))
