"""Sources as rows, and parsers as table functions over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

MAXIMUM_INPUT_BYTES = 64 << 20
#: Bytes and rows that a task gathers before it hands them on.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 4096


#: What parsers may be given to make of a source's bytes first.
Write = Callable[[bytes], bytes] | None


class FormatError(ValueError):
    """A source is not what a parser reads."""


def read_files(spark: SparkSession, path: str, recursive: bool = True, maximum_bytes: int = MAXIMUM_INPUT_BYTES) -> DataFrame:
    """Files as sources (source_id, path, content, size, sha256). A file larger
    than ``maximum_bytes`` is an error, not a shorter source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    content = F.when(F.col("length") <= maximum_bytes, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("source is too large: "), F.col("path"))).cast("binary")
    )
    return files.select(F.col("path").alias("source_id"), "path", content.alias("content"), F.col("length").alias("size")).withColumn("sha256", F.sha2("content", 256))


def from_bytes(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "source_id string, content binary")


def pieces(batches: Iterable[pa.RecordBatch], make: Callable[[bytes], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that ``make`` makes of each content, behind its
    source_id. They are handed on by size, so that a task holds one input batch,
    one source's rows and a piece, however many rows a batch has."""
    for b in batches:
        keys, contents = b.column(0), b.column(1)
        at, rows, held = [], [], 0

        def piece() -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), schema.types[1:])]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())).cast(schema.types[0]), *columns], schema=schema)

        for i in range(b.num_rows):
            for row in make(contents[i].as_py() or b""):
                at.append(i)
                rows.append(row)
                held += sum(len(v) for v in row if isinstance(v, bytes | str))
                if held >= PIECE_BYTES or len(rows) >= PIECE_ROWS:
                    yield piece()
                    at, rows, held = [], [], 0
        if rows:
            yield piece()


def _mapped(sources: DataFrame, make: Callable[[bytes], list[tuple]], fields: list[StructField]) -> DataFrame:
    kind = StructType([StructField("source_id", sources.schema["source_id"].dataType), *fields])
    schema = to_arrow_schema(kind)
    return sources.select("source_id", "content").mapInArrow(lambda batches: pieces(batches, make, schema), kind)


def rewritten(sources: DataFrame, write: Callable[[bytes], bytes]) -> DataFrame:
    """(source_id, content) with ``write`` of each source's bytes."""
    return _mapped(sources, lambda c: [(write(c),)], [sources.schema["content"]])


def parse(sources: DataFrame, parser: Callable[[bytes], Iterable[tuple]], schema: str, write: Write = None) -> DataFrame:
    """A row for each tuple that ``parser`` makes of a source's bytes, behind
    source_id; a source that it refuses is one row with ``error`` and nulls.
    ``write`` is applied to the bytes first, in the same task; what it refuses
    is no error of the source and ends the task."""
    fields = StructType.fromDDL(schema).fields
    nothing = (None,) * len(fields)

    def rows(content: bytes) -> list[tuple]:
        made = write(content) if write else content
        try:
            return [(*row, None) for row in parser(made)]
        except FormatError as e:
            return [(*nothing, str(e))]

    return _mapped(sources, rows, [*fields, StructField("error", StringType())])
