"""Registers, display lists and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes as B

REGISTER_BASE = 0xDFF000
#: Subsystems and the ranges of offsets (ends included) that they hold, in the
#: order in which they are looked up: fixed values.
SUBSYSTEMS = (
    ("dma", ((0x002, 0x002), (0x096, 0x096))),
    ("interrupt", ((0x018, 0x018), (0x01C, 0x01C), (0x01E, 0x01E), (0x09A, 0x09A), (0x09C, 0x09C))),
    ("disk", ((0x01A, 0x01A), (0x020, 0x024), (0x07E, 0x07E))),
    ("serial", ((0x030, 0x030), (0x032, 0x032))),
    ("blitter", ((0x040, 0x074),)),
    ("copper", ((0x080, 0x08C),)),
    ("display", ((0x08E, 0x094), (0x098, 0x098), (0x100, 0x10E))),
    ("audio", ((0x09E, 0x09E), (0x0A0, 0x0DF))),
    ("bitplane", ((0x0E0, 0x0FE), (0x110, 0x11E))),
    ("sprite", ((0x120, 0x17E),)),
    ("color", ((0x180, 0x1BE),)),
)
#: Offsets and names of single registers: fixed values.
NAMED = {
    0x002: "DMACONR", 0x004: "VPOSR", 0x006: "VHPOSR", 0x00A: "JOY0DAT", 0x00C: "JOY1DAT", 0x00E: "CLXDAT", 0x010: "ADKCONR", 0x016: "POTGOR",
    0x01A: "DSKBYTR", 0x01C: "INTENAR", 0x01E: "INTREQR", 0x020: "DSKPTH", 0x022: "DSKPTL", 0x024: "DSKLEN", 0x02A: "VPOSW", 0x02C: "VHPOSW",
    0x02E: "COPCON", 0x030: "SERDAT", 0x032: "SERPER", 0x034: "POTGO", 0x040: "BLTCON0", 0x042: "BLTCON1", 0x044: "BLTAFWM", 0x046: "BLTALWM",
    0x048: "BLTCPTH", 0x04A: "BLTCPTL", 0x04C: "BLTBPTH", 0x04E: "BLTBPTL", 0x050: "BLTAPTH", 0x052: "BLTAPTL", 0x054: "BLTDPTH", 0x056: "BLTDPTL",
    0x058: "BLTSIZE", 0x05A: "BLTCON0L", 0x05C: "BLTSIZV", 0x05E: "BLTSIZH", 0x060: "BLTCMOD", 0x062: "BLTBMOD", 0x064: "BLTAMOD", 0x066: "BLTDMOD",
    0x070: "BLTCDAT", 0x072: "BLTBDAT", 0x074: "BLTADAT", 0x07E: "DSKSYNC", 0x080: "COP1LCH", 0x082: "COP1LCL", 0x084: "COP2LCH", 0x086: "COP2LCL",
    0x088: "COPJMP1", 0x08A: "COPJMP2", 0x08C: "COPINS", 0x08E: "DIWSTRT", 0x090: "DIWSTOP", 0x092: "DDFSTRT", 0x094: "DDFSTOP", 0x096: "DMACON",
    0x098: "CLXCON", 0x09A: "INTENA", 0x09C: "INTREQ", 0x09E: "ADKCON", 0x100: "BPLCON0", 0x102: "BPLCON1", 0x104: "BPLCON2", 0x106: "BPLCON3",
    0x108: "BPL1MOD", 0x10A: "BPL2MOD", 0x1DC: "BEAMCON0", 0x1E4: "DIWHIGH", 0x1FC: "FMODE",
}


def _numbered() -> dict[int, str]:
    """Registers that follow a rule: audio, bitplane, sprite and colour."""
    out: dict[int, str] = {}
    for n in range(4):
        for i, part in enumerate(("LCH", "LCL", "LEN", "PER", "VOL", "DAT")):
            out[0x0A0 + 16 * n + 2 * i] = f"AUD{n}{part}"
    for n in range(8):
        out[0x0E0 + 4 * n], out[0x0E2 + 4 * n], out[0x110 + 2 * n] = f"BPL{n + 1}PTH", f"BPL{n + 1}PTL", f"BPL{n + 1}DAT"
    for n in range(8):
        out[0x120 + 4 * n], out[0x122 + 4 * n] = f"SPR{n}PTH", f"SPR{n}PTL"
        for i, part in enumerate(("POS", "CTL", "DATA", "DATB")):
            out[0x140 + 8 * n + 2 * i] = f"SPR{n}{part}"
    for n in range(32):
        out[0x180 + 2 * n] = f"COLOR{n:02d}"
    return out


def subsystem(offset: int) -> str:
    return next((name for name, ranges in SUBSYSTEMS if any(a <= offset <= b for a, b in ranges)), "other")


def register_rows() -> list[tuple[int, str, str]]:
    names = NAMED | _numbered()
    return [(k, names[k], subsystem(k)) for k in sorted(names)]


def register_map(spark: SparkSession) -> DataFrame:
    """(offset, name, subsystem) of the custom-chip registers known here."""
    return spark.createDataFrame(register_rows(), "offset int, name string, subsystem string")


def register_references(accesses: DataFrame, base: int = REGISTER_BASE) -> DataFrame:
    """Accesses (site, address, ...) to the register page, with names. The map,
    some 150 rows, is broadcast; offsets it does not know keep a null name."""
    own = accesses.where(F.col("address").between(base, base + 0x1FF)).withColumn("offset", (F.col("address") - base).cast("int"))
    return own.join(F.broadcast(register_map(accesses.sparkSession)), "offset", "left")


def decode_copper(words: DataFrame, key: str = "source_id", position: str = "pos", limit: int = 4096) -> DataFrame:
    """Display-list instructions of 32-bit words (key, pos, first, second), in
    order, up to and with the end word FFFF FFFE, ``limit`` at most."""
    w = Window.partitionBy(key).orderBy(position)
    end = (F.col("first") == 0xFFFF) & (F.col("second") == 0xFFFE)
    before = F.coalesce(F.max(end.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = words.withColumn("_n", F.row_number().over(w)).withColumn("_ended", before).where((F.col("_ended") == 0) & (F.col("_n") <= limit))
    first, second = F.col("first").cast("long"), F.col("second").cast("long")
    move = first.bitwiseAND(1) == 0
    op = F.when(move, "MOVE").when(second.bitwiseAND(1) == 0, "WAIT").otherwise("SKIP")
    only = lambda c: F.when(~move, c)
    return rows.select(
        key, position, op.alias("op"), F.when(move, first.bitwiseAND(0x1FE)).alias("register"), F.when(move, second).alias("value"),
        only(F.shiftright(first, 8)).alias("vpos"), only(first.bitwiseAND(0xFE)).alias("hpos"),
        only(F.shiftright(second, 8).bitwiseAND(0x7F)).alias("vmask"), only(second.bitwiseAND(0xFE)).alias("hmask"),
        only(second.bitwiseAND(0x8000) != 0).alias("blitter_finish_disable"),
    )


def last_writes(moves: DataFrame, key: str = "source_id", position: str = "pos") -> DataFrame:
    """The last value written to each register: (key, register, value)."""
    return moves.groupBy(key, "register").agg(F.max_by("value", position).alias("value"))


def display_spec(moves: DataFrame, key: str = "source_id", position: str = "pos") -> DataFrame:
    """What a list sets up: plane count (top bits of BPLCON0) and colours in
    register order, last write wins: (key, planes, colours)."""
    last = last_writes(moves, key, position)
    colour = F.when(F.col("register").between(0x180, 0x1BE), F.struct("register", "value"))
    return last.groupBy(key).agg(
        F.max(F.when(F.col("register") == 0x100, F.shiftright("value", 12).bitwiseAND(7))).alias("planes"),
        F.transform(F.sort_array(F.collect_list(colour)), lambda c: c["value"]).alias("colours"),
    )


def resolve_address(values: DataFrame, value: Column, origin: Column, size: Column, file_offset: Column) -> DataFrame:
    """One number in three frames, null where a frame does not reach: relative
    to ``origin``, absolute, and in the file."""
    relative = F.when((value >= origin) & (value < origin + size), value - origin)
    return values.select(
        "*", B.bounded_u32(value).alias("absolute"), B.bounded_u32(relative).alias("relative"), B.bounded_u32(relative + file_offset).alias("in_file")
    )
