"""Snapshots of memory through declared types."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 16


class StateError(ValueError):
    """Types or variables that do not describe memory."""


@dataclass(frozen=True)
class Leaf:
    path: str
    address: int
    size: int
    signed: bool
    little: bool
    kind: str
    members: tuple[tuple[int, str], ...] = ()


def size_of(types: dict[str, dict[str, Any]], name: str, depth: int = 0) -> int:
    if depth > DEEPEST:
        raise StateError(f"types nest more than {DEEPEST} deep at {name}")
    if name not in types:
        raise StateError(f"no type {name}")
    t = types[name]
    kind = t["kind"]
    if kind == "integer":
        if t["size"] not in (1, 2, 4, 8):
            raise StateError(f"{name} is not of 1, 2, 4 or 8 bytes")
        return t["size"]
    if kind == "pointer":
        return t.get("size", 4)
    if kind == "array":
        return t["count"] * size_of(types, t["of"], depth + 1)
    if kind in ("enum", "alias"):
        return size_of(types, t["of"], depth + 1)
    if kind == "struct":
        return t["size"]
    raise StateError(f"{name} ({kind}) takes no memory")


def leaves(types: dict[str, dict[str, Any]], name: str, address: int, path: str, depth: int = 0) -> list[Leaf]:
    """What a variable of type ``name`` is made of, in order of address. Kinds:
    integer (size, signed, little), pointer, enum (of, members), alias (of),
    array (of, count) and struct (size, fields: name -> (offset, type))."""
    size = size_of(types, name, depth)
    t = types[name]
    kind = t["kind"]
    if kind in ("integer", "pointer"):
        return [Leaf(path, address, size, t.get("signed", False), t.get("little", False), kind)]
    if kind == "alias":
        return leaves(types, t["of"], address, path, depth + 1)
    if kind == "enum":
        (base,) = leaves(types, t["of"], address, path, depth + 1)
        return [Leaf(path, address, size, base.signed, base.little, "enum", tuple(sorted((v, n) for n, v in t["members"].items())))]
    if kind == "array":
        step = size_of(types, t["of"], depth + 1)
        return [x for i in range(t["count"]) for x in leaves(types, t["of"], address + i * step, f"{path}[{i}]", depth + 1)]
    out = []
    for field, (offset, of) in sorted(t["fields"].items(), key=lambda f: f[1][0]):
        if offset + size_of(types, of, depth + 1) > size:
            raise StateError(f"{path}.{field} leaves its struct")
        out += leaves(types, of, address + offset, f"{path}.{field}", depth + 1)
    return out


def snapshot(regions: DataFrame, types: dict[str, dict[str, Any]], variables: dict[str, tuple[int, str]]) -> DataFrame:
    """Fields of the variables (name -> (address, type)) in each snapshot's
    memory: (snapshot, path, kind, value DECIMAL(20), member).

    ``regions`` are (snapshot, origin, content). Variables that overlap, and
    ones that a snapshot's regions do not hold whole, are refused, not left out.
    """
    placed = sorted((a, a + size_of(types, t), n) for n, (a, t) in variables.items())
    for (_, end, n), (start, _, m) in zip(placed, placed[1:]):
        if start < end:
            raise StateError(f"{n} and {m} overlap")
    flat = [x for n, (a, t) in variables.items() for x in leaves(types, t, a, n)]
    names = ["path", "address", "size", "signed", "little", "kind", "members"]
    rows = json.dumps([dict(zip(names, (x.path, x.address, x.size, x.signed, x.little, x.kind, {str(v): n for v, n in x.members}))) for x in flat])
    schema = "array<struct<path: string, address: bigint, size: int, signed: boolean, little: boolean, kind: string, members: map<string,string>>>"
    declared = F.from_json(F.lit(rows), schema)
    wanted = regions.select("snapshot").distinct().select("snapshot", F.explode(declared).alias("leaf")).select("snapshot", "leaf.*")
    wanted = wanted.withColumn("members", F.to_json("members"))
    held = wanted.join(regions, "snapshot", "left").withColumn(
        "_raw", F.when((F.col("address") >= F.col("origin")) & (F.col("address") + F.col("size") <= F.col("origin") + F.octet_length("content")),
            F.substring(F.col("content"), (F.col("address") - F.col("origin") + 1).cast("int"), F.col("size")))
    ).groupBy("snapshot", "path", "kind", "address", "size", "signed", "little", "members").agg(F.max("_raw").alias("_raw"))
    raw = F.when(F.col("_raw").isNull(), F.raise_error(F.concat(F.lit("memory does not hold "), "path")).cast("binary")).otherwise(F.col("_raw"))
    digits = F.hex(raw)
    ordered = F.when(F.col("little"), F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")).otherwise(digits)
    big = lambda h: F.conv(h, 16, 10).cast("decimal(20,0)")
    unsigned = big(ordered)
    limit = F.pow(F.lit(2.0), 8 * F.col("size") - 1).cast("decimal(20,0)")
    value = F.when(F.col("signed") & (unsigned >= limit), unsigned - limit - limit).otherwise(unsigned)
    named = held.select("snapshot", "path", "kind", value.cast("decimal(20,0)").alias("value"), F.from_json("members", "map<string,string>").alias("members"))
    return named.select("snapshot", "path", "kind", "value", F.try_element_at("members", F.col("value").cast("string")).alias("member"))
