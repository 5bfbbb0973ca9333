"""Every operator as a query over whole test tables, with its SQL oracle.

Text columns stand in for byte sources: a document's UTF-8 bytes are a source.
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import windows as W
from ..functions.tables import tasks_for
from ..operators import compare, graph, hardware, project, raster, sandbox, scans, tables
from ..operators.layout import Layout, decode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _l(name: str):
    return F.col(name).cast("long").alias(name)


# -- scans ------------------------------------------------------------------

#: One ASCII character a byte: others become as many chr(1) as they have bytes.
_ASCII = r"""
    ascii AS (
        SELECT doc_id AS source_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
            '[\x{10000}-\x{10FFFF}]', repeat(chr(1), 4), 'g'), '[\x{800}-\x{FFFF}]', repeat(chr(1), 3), 'g'),
            '[\x{80}-\x{7FF}]', repeat(chr(1), 2), 'g') AS t FROM documents
    )"""


def _runs(minimum: int) -> str:
    p = r"'[\x20-\x7e]{" + str(minimum) + ",}'"
    return f"""{_ASCII}, split AS (
        SELECT source_id, regexp_extract_all(t, {p}) AS r, string_split_regex(t, {p}) AS g FROM ascii
    ), parts AS (
        SELECT source_id, unnest(r) AS text, unnest(g[1:len(r)]) AS gap, generate_subscripts(r, 1) AS i FROM split
    ), runs AS (
        SELECT source_id, i, text, (sum(len(gap) + len(text)) OVER (PARTITION BY source_id ORDER BY i) - len(text))::BIGINT AS start,
            (sum(len(gap) + len(text)) OVER (PARTITION BY source_id ORDER BY i))::BIGINT AS stop FROM parts
    )"""


@query(f"""WITH {_runs(4)}, kept AS (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start) AS n, count(*) OVER (PARTITION BY source_id) AS string_total
        FROM runs WHERE contains(text, 'the')
    ) SELECT source_id, start, stop, text, string_total, string_total > 16 AS string_truncated FROM kept WHERE n <= 16""")
def strings_scan(spark, sf_dir):
    return scans.strings_scan(_sources(spark, sf_dir), 4, "the", 16)


@query(f"""WITH {_runs(6)}, marked AS (
        SELECT *, CASE WHEN start <= lag(stop) OVER (PARTITION BY source_id ORDER BY start) + 8 THEN 0 ELSE 1 END AS fresh FROM runs
    ), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY start) AS g FROM marked)
    SELECT source_id, min(start) AS start, max(stop) AS stop, count(*) AS strings FROM numbered GROUP BY source_id, g""")
def strings_merge_gap(spark, sf_dir):
    return scans.merged_strings(_sources(spark, sf_dir))


_BYTES = """
    raw AS (SELECT doc_id AS source_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
    bytes AS (SELECT source_id, unnest(h) AS b, generate_subscripts(h, 1) - 1 AS pos FROM raw)"""


@query(f"""WITH {_BYTES}, counts AS (SELECT source_id, pos // 256 AS block, b, count(*) AS n FROM bytes GROUP BY ALL),
    sums AS (SELECT source_id, block, sum(n) AS size, sum(n * log2(n)) AS s FROM counts GROUP BY ALL),
    e AS (SELECT source_id, block::BIGINT AS block, size::BIGINT AS size, log2(size) - s / size AS e FROM sums)
    SELECT source_id, block, size, round(e, 6) + 0.0 AS entropy, CASE WHEN e >= 7.5 THEN 'packed' WHEN e <= 2.0 THEN 'sparse' ELSE 'mixed' END AS kind FROM e""")
def entropy_map(spark, sf_dir):
    return scans.entropy_map(_sources(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6) + 0.0)


_LAGS = ", ".join(f"(lag(b, {s}) OVER w = b)::INT AS e{s}" for s in range(1, 9))
_STRIDES = " UNION ALL ".join(
    f"SELECT source_id, {s} AS stride, count(e{s}) AS compared, coalesce(sum(e{s}), 0)::BIGINT AS equal FROM lags GROUP BY source_id HAVING count(e{s}) > 0" for s in range(1, 9)
)
_AUTO = f"""WITH {_BYTES}, lags AS (SELECT source_id, {_LAGS} FROM bytes WINDOW w AS (PARTITION BY source_id ORDER BY pos)), strides AS ({_STRIDES})"""


@query(f"{_AUTO} SELECT source_id, stride, compared, equal, round(equal / compared, 6) AS score FROM strides")
def stride_autocorrelation(spark, sf_dir):
    return scans.autocorrelation(_sources(spark, sf_dir), 8).withColumn("score", F.round("score", 6))


@query(f"""{_AUTO}, best AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY equal / compared DESC, stride) AS n FROM strides)
    SELECT source_id, stride, planes::INTEGER AS planes, ((stride // planes) * 8)::BIGINT AS row_pixels, round(equal / compared, 6) AS score
    FROM best, range(1, 9) AS p(planes) WHERE n = 1 AND stride % planes = 0""")
def geometry_candidates(spark, sf_dir):
    strides = scans.autocorrelation(_sources(spark, sf_dir), 8)
    return scans.geometry_candidates(strides).select("source_id", "stride", "planes", "row_pixels", F.round("score", 6).alias("score"))


#: Words of a supplier: part keys of its lines, in order of order and line.
_WORDS = """words AS (SELECT l_suppkey AS source_id, l_partkey AS word,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem)"""


def _words(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("word"), F.row_number().over(w).cast("long").alias("pos"))


@query(f"""WITH {_WORDS}, scaled AS (SELECT source_id, pos, (word * 37) % 6144 AS word FROM words),
    hits AS (SELECT *, pos - row_number() OVER (PARTITION BY source_id ORDER BY pos) AS island FROM scaled WHERE word & 61440 = 0)
    SELECT source_id, min(pos) AS first, count(*) AS colours, count(DISTINCT word) AS distinct_colours FROM hits GROUP BY source_id, island
    HAVING count(*) >= 8 AND count(DISTINCT word) >= 2""")
def palette_scan(spark, sf_dir):
    return scans.palette_runs(_words(spark, sf_dir).withColumn("word", F.col("word") * 37 % 6144))


_LIST_WORDS = """pairs AS (SELECT source_id, pos, CASE WHEN word % 23 = 0 THEN 65535 WHEN word % 7 = 0 THEN 2 WHEN word % 5 = 0 THEN (word * 31) % 65536 | 1 ELSE 256 + (word % 96) * 2 END AS first,
    CASE WHEN word % 23 = 0 THEN 65534 ELSE (word * 97) % 65536 END AS second FROM words)"""


@query(f"""WITH {_WORDS}, {_LIST_WORDS}, marked AS (SELECT source_id, pos - 1 AS pos, first, first = 65535 AND second = 65534 AS ended, first % 2 = 0 AND (first < 128 OR first > 510) AS bad FROM pairs),
    cut AS (SELECT *, sum((ended OR bad)::INT) OVER (PARTITION BY source_id ORDER BY pos) - (ended OR bad)::INT AS part FROM marked),
    runs AS (SELECT source_id, part, min(pos) AS s, max(pos) AS e, count(*) AS n, bool_or(ended) AS done, bool_or(bad) AS broken, count(*) FILTER (first % 2 = 0) AS moves,
        count(*) FILTER (first % 2 = 0 AND (first BETWEEN 128 AND 150 OR first BETWEEN 224 AND 318 OR first BETWEEN 384 AND 446)) AS shows FROM cut GROUP BY ALL)
    SELECT source_id, s * 4 AS start, e * 4 + 4 AS stop, n AS instructions, moves FROM runs WHERE done AND NOT broken AND moves >= 3 AND shows > 0""")
def copper_scan(spark, sf_dir):
    w = F.col("word")
    first = F.when(w % 23 == 0, F.lit(65535)).when(w % 7 == 0, F.lit(2)).when(w % 5 == 0, (w * 31 % 65536).bitwiseOR(F.lit(1).cast("long"))).otherwise(256 + w % 96 * 2)
    second = F.when(w % 23 == 0, F.lit(65534)).otherwise(w * 97 % 65536)
    cells = _words(spark, sf_dir).select("source_id", F.struct("pos", F.lpad(F.hex((first * 65536 + second).cast("long")), 8, "0").alias("h")).alias("c"))
    packed = cells.groupBy("source_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["h"]), "")).alias("content"))
    return scans.copper_lists(packed)


@query(f"""WITH {_WORDS}, span AS (SELECT max(word) // 5 AS low, max(word) AS high FROM words),
    hits AS (SELECT source_id, pos, word, low, pos - row_number() OVER (PARTITION BY source_id ORDER BY pos) AS island
        FROM words, span WHERE word <> 0 AND word >= low AND word < high)
    SELECT source_id, min(pos) AS first, count(*) AS entries, min(word) AS lowest, max(word) AS highest,
        count(DISTINCT CASE WHEN (word - low) % 2 = 0 THEN word END) AS seeds FROM hits GROUP BY source_id, island HAVING count(*) >= 3""")
def pointer_scan(spark, sf_dir):
    high = _t(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).first()[0] or 0
    return scans.pointer_runs(_words(spark, sf_dir), high // 5, high)


@query(f"""WITH {_BYTES}, signed AS (
        SELECT source_id, pos, (('0x' || b)::INT + 128) % 256 - 128 AS v, (pos // 512) AS block FROM bytes
    ), steps AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY source_id, block ORDER BY pos)) AS d, count(*) OVER (PARTITION BY source_id, block, v) AS same FROM signed),
    stats AS (
        SELECT source_id, block, min(pos) AS a, max(pos) + 1 AS z, count(*) AS n, sum(abs(v)) / count(*) AS amp, sum(d) / (count(*) - 1) AS diff,
            abs(sum(v) / count(*)) AS mean, max(same) / count(*) AS dominant FROM steps GROUP BY source_id, block HAVING count(*) >= 2
    ), fine AS (
        SELECT *, block - row_number() OVER (PARTITION BY source_id ORDER BY block) AS island FROM stats
        WHERE amp >= 6 AND diff / (amp + 1) <= 0.85 AND mean / (amp + 1) <= 1.0 AND dominant <= 0.5
    ), regions AS (SELECT source_id, min(a) AS a, max(z) AS z FROM fine GROUP BY source_id, island HAVING max(z) - min(a) >= 1024),
    inside AS (
        SELECT r.source_id, r.a, r.z, s.v, abs(s.v - lag(s.v) OVER (PARTITION BY r.source_id, r.a ORDER BY s.pos)) AS d
        FROM regions r JOIN signed s ON s.source_id = r.source_id AND s.pos >= r.a AND s.pos < r.z
    )
    SELECT source_id, a::BIGINT AS start, z::BIGINT AS stop, round(sum(abs(v)) / count(*), 6) AS amplitude,
        round(sum(d) / (count(*) - 1) / (sum(abs(v)) / count(*) + 1), 6) AS smoothness FROM inside GROUP BY source_id, a, z""")
def pcm_scan(spark, sf_dir):
    found = scans.pcm_regions(_sources(spark, sf_dir), 512, 1024, bias=1.0)
    return found.select("source_id", "start", "stop", F.round("amplitude", 6).alias("amplitude"), F.round("smoothness", 6).alias("smoothness"))


@query("""WITH e AS (SELECT event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
    SELECT event_type, (i // ceil(n / least(512, n))::BIGINT)::BIGINT AS bucket, min(value) AS lowest, max(value) AS highest FROM e GROUP BY ALL""")
def waveform_envelope(spark, sf_dir):
    return scans.envelope(_t(spark, sf_dir, "events"), "event_type", "event_id", "value", 512)


@query(f"""WITH {_runs(6)}, marked AS (
        SELECT *, CASE WHEN start <= lag(stop) OVER (PARTITION BY source_id ORDER BY start) + 8 THEN 0 ELSE 1 END AS fresh FROM runs
    ), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY start) AS g FROM marked),
    strings AS (SELECT source_id, min(start) AS start, max(stop) AS stop, count(*) AS detail_count FROM numbered GROUP BY source_id, g),
    {_BYTES},
    w16 AS (SELECT source_id, pos // 2 AS w, string_agg(b, '' ORDER BY pos) AS x, count(*) AS n FROM bytes GROUP BY ALL),
    pal AS (SELECT source_id, w, x, w - row_number() OVER (PARTITION BY source_id ORDER BY w) AS island FROM w16 WHERE n = 2 AND x[1] = '0'),
    colours AS (SELECT source_id, 2 * min(w) AS start, 2 * max(w) + 2 AS stop, count(*) AS detail_count FROM pal GROUP BY source_id, island HAVING count(*) >= 8 AND count(DISTINCT x) >= 2),
    found AS (SELECT *, 'strings' AS kind, 1 AS priority FROM strings UNION ALL SELECT *, 'palette', 2 FROM colours),
    swept AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY source_id ORDER BY start, priority DESC, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM found),
    located AS (SELECT source_id, greatest(start, cursor) AS start, stop, kind, detail_count FROM swept WHERE stop > cursor),
    sizes AS (SELECT doc_id AS source_id, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
    rest AS (
        SELECT source_id, coalesce(lag(stop) OVER (PARTITION BY source_id ORDER BY start), 0) AS start, start AS stop FROM located
        UNION ALL SELECT s.source_id, coalesce(max(l.stop), 0), s.size FROM sizes s LEFT JOIN located l USING (source_id) GROUP BY s.source_id, s.size
    ), gaps AS (SELECT * FROM rest WHERE start < stop),
    counts AS (SELECT g.source_id, g.start, g.stop, b, count(*) AS n FROM gaps g JOIN bytes y ON y.source_id = g.source_id AND y.pos >= g.start AND y.pos < g.stop GROUP BY ALL),
    scored AS (SELECT source_id, start, stop, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM counts GROUP BY ALL)
    SELECT source_id, start::BIGINT AS start, stop::BIGINT AS stop, kind, detail_count::BIGINT AS detail_count, NULL::DOUBLE AS entropy FROM located
    UNION ALL SELECT source_id, start::BIGINT, stop::BIGINT, CASE WHEN e >= 7.5 THEN 'packed' WHEN e <= 2.0 THEN 'sparse' ELSE 'code-or-bitmap' END, 0, round(e, 6) + 0.0 FROM scored""")
def survey(spark, sf_dir):
    return scans.survey(_sources(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6) + 0.0)


# -- records ----------------------------------------------------------------

@query("""SELECT n_nationkey::BIGINT AS f0, (n_regionkey - 2)::BIGINT AS f1, n_name AS f2, (n_nationkey * 65537 + 1)::BIGINT AS f3, n_nationkey::BIGINT AS row_number FROM nation""")
def table_decode(spark, sf_dir):
    """Nations packed to records (u16, i16, pad, char, ptr) and decoded again."""
    packed = _t(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("k"),
        F.unhex(F.concat(
            F.lpad(F.hex(F.col("n_nationkey").cast("long")), 4, "0"), F.lpad(F.hex(F.pmod(F.col("n_regionkey").cast("long") - 2, F.lit(65536))), 4, "0"), F.lit("FFFF"),
            F.rpad(F.hex(F.encode("n_name", "ISO-8859-1")), 48, "00"), F.lpad(F.hex(F.col("n_nationkey").cast("long") * 65537 + 1), 8, "0"),
        )).alias("r"),
    )
    whole = packed.groupBy(F.lit("nation").alias("source_id")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: F.hex(x["r"])), "")).alias("content"))
    return decode(whole, Layout.parse("u16, i16, pad[2], char[24], ptr"), 1 << 20).select("f0", "f1", "f2", "f3", F.col("row").alias("row_number"))


_PROFILED = ["l_returnflag", "l_linestatus", "l_quantity", "l_linenumber", "l_discount"]
_UNPIVOT = " UNION ALL ".join(
    f"SELECT {i} AS \"column\", " + (f"{c}::DOUBLE" if i > 1 else "NULL::DOUBLE") + f" AS num, {c}::VARCHAR AS value FROM lineitem" for i, c in enumerate(_PROFILED)
)


@query(f"""WITH u AS ({_UNPIVOT}), c AS (SELECT "column", num, value, count(*) AS count FROM u GROUP BY ALL), r AS (
        SELECT "column", num, value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, num, value) AS rank,
            count(*) OVER (PARTITION BY "column") AS distinct_total, min(num) OVER (PARTITION BY "column") AS lowest, max(num) OVER (PARTITION BY "column") AS highest FROM c
    ) SELECT "column"::INTEGER AS "column", rank, coalesce(num::VARCHAR, value) AS value, count, distinct_total, lowest, highest, distinct_total > 10 AS truncated FROM r WHERE rank <= 10""")
def table_summarize(spark, sf_dir):
    table = _t(spark, sf_dir, "lineitem").select(*_PROFILED[:2], *[F.col(c).cast("double").alias(c) for c in _PROFILED[2:]])
    return tables.summarize(table, _PROFILED, 10)


_HALF = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 {}"


@query(f"""WITH a AS ({_HALF.format('= 0')}), b AS ({_HALF.format('<> 0')}),
    j AS (SELECT a.row, a.o_orderstatus AS s0, b.o_orderstatus AS s1, a.o_orderpriority AS p0, b.o_orderpriority AS p1 FROM a JOIN b USING (row))
    SELECT 0 AS "column", row, s0 || '|' || s1 AS differing FROM j WHERE s0 IS DISTINCT FROM s1
    UNION ALL SELECT 1, row, p0 || '|' || p1 FROM j WHERE p0 IS DISTINCT FROM p1""")
def table_compare(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    halves = [tables.row_numbered(orders.where(c), ["o_orderkey"]) for c in ("o_orderkey % 3 = 0", "o_orderkey % 3 <> 0")]
    found = tables.compare(halves, "row", ["o_orderstatus", "o_orderpriority"])
    return found.select("column", "row", F.array_join("values", "|").alias("differing"))


# -- comparisons --------------------------------------------------------------

@query("""WITH p AS (SELECT source, doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents),
    h AS (SELECT doc_id AS pair_id, regexp_extract_all(hex(encode(text)), '..') AS x, regexp_extract_all(hex(encode(other)), '..') AS y FROM p WHERE other IS NOT NULL),
    z AS (SELECT pair_id, unnest(range(greatest(len(x), len(y)))) AS pos, unnest(list_resize(x, greatest(len(x), len(y)))) AS a, unnest(list_resize(y, greatest(len(x), len(y)))) AS b FROM h),
    d AS (SELECT pair_id, pos, pos - row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS island FROM z WHERE a IS DISTINCT FROM b)
    SELECT pair_id, min(pos) AS start, count(*) AS length FROM d GROUP BY pair_id, island""")
def hunk_diff_ranges(spark, sf_dir):
    """Each document against the next one of its source."""
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("a"))
    pairs = docs.withColumn("b", F.lead("a").over(Window.partitionBy("source").orderBy("doc_id"))).where("b IS NOT NULL")
    return compare.changed_ranges(pairs.withColumnRenamed("doc_id", "pair_id"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def hunk_diff_presence(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return compare.presence(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


@query("""SELECT l_suppkey, l_partkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem l WHERE l_linenumber <= 3
    AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_linenumber > 3 AND r.l_suppkey = l.l_suppkey AND r.l_partkey = l.l_partkey)""")
def relocation_diff(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", _l("l_linenumber"))
    return compare.only_in(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3"), ["l_suppkey", "l_partkey"])


@query("""WITH s AS (SELECT o_orderkey % 3 AS snapshot, o_custkey AS path, max_by(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY ALL)
    SELECT path, count(DISTINCT snapshot) AS present, count(DISTINCT coalesce('=' || value, '-')) AS distinct_values FROM s GROUP BY path
    HAVING count(DISTINCT snapshot) < 3 OR count(DISTINCT coalesce('=' || value, '-')) > 1""")
def state_compare(spark, sf_dir):
    """Each customer's last priority in three snapshots of orders."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    snaps = orders.groupBy((F.col("o_orderkey") % 3).alias("snapshot"), F.col("o_custkey").alias("path")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("value"))
    return compare.state_differences(snaps, 3)


@query("""WITH u AS (UNPIVOT (SELECT c_nationkey, c_mktsegment, (c_custkey % 7)::VARCHAR AS bucket, c_nationkey::VARCHAR AS same FROM customer) ON c_mktsegment, bucket, same INTO NAME field VALUE value)
    SELECT c_nationkey, field, count(DISTINCT value) AS distinct_values FROM u GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def record_compare(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.col("c_custkey") % 7).alias("bucket"), F.col("c_nationkey").alias("same"))
    return compare.record_differences(rows, ["c_mktsegment", "bucket", "same"], "c_nationkey")


_STEPS = "steps AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"


def _steps(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).cast("long").alias("step"))


@query(f"""WITH {_STEPS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) AS occurrence FROM steps),
    ids AS (SELECT min(user_id) AS a, max(user_id) AS b FROM events),
    x AS (SELECT step, event_type AS a, occurrence AS occurrence_a FROM o, ids WHERE user_id = ids.a),
    y AS (SELECT step, event_type AS b, occurrence AS occurrence_b FROM o, ids WHERE user_id = ids.b)
    SELECT step, a, occurrence_a, b, occurrence_b FROM x FULL JOIN y USING (step) WHERE a IS DISTINCT FROM b ORDER BY step LIMIT 1""")
def trace_divergence(spark, sf_dir):
    a, b = _t(spark, sf_dir, "events").agg(F.min("user_id"), F.max("user_id")).first()
    return compare.first_divergence(_steps(spark, sf_dir), "user_id", "step", "event_type", a, b)


@query(f"WITH {_STEPS} SELECT user_id, event_type, step, row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) AS occurrence FROM steps")
def occurrence_counter(spark, sf_dir):
    return compare.occurrences(_steps(spark, sf_dir), "user_id", "step", "event_type").withColumn("occurrence", F.col("occurrence").cast("long"))


# -- graphs -------------------------------------------------------------------

_CALLS = """calls AS (SELECT o_custkey AS caller, l_suppkey AS callee, l_orderkey * 8 + l_linenumber AS site FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _calls(spark, sf_dir) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if (n := tasks_for(lines, orders)) > spark.sparkContext.defaultParallelism:
        lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("caller"), F.col("l_suppkey").alias("callee"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("site")
    )


@query(f"WITH {_CALLS} SELECT caller, callee, count(*) AS calls FROM calls GROUP BY ALL")
def callgraph_edges(spark, sf_dir):
    return graph.call_edges(_calls(spark, sf_dir))


@query(f"""WITH {_CALLS}, e AS (SELECT DISTINCT caller, callee FROM calls),
    f AS (SELECT c_custkey AS function FROM customer UNION SELECT s_suppkey FROM supplier)
    SELECT function, (SELECT count(*) FROM e WHERE callee = function) AS in_degree, (SELECT count(*) FROM e WHERE caller = function) AS out_degree FROM f""")
def callgraph_nodes(spark, sf_dir):
    functions = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("function")).union(_t(spark, sf_dir, "supplier").select("s_suppkey")).distinct()
    return graph.call_nodes(functions, graph.call_edges(_calls(spark, sf_dir)))


@query(f"""WITH {_CALLS}, i AS (SELECT octet_length(encode(coalesce(text, ''))) AS size FROM documents WHERE lang = 'en'),
    a AS (SELECT count(*) AS instructions, sum(size)::BIGINT AS decoded_bytes FROM i),
    t AS (SELECT sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS total_bytes FROM documents),
    c AS (SELECT count(*) AS calls FROM (SELECT DISTINCT site, callee FROM calls)), s AS (SELECT count(DISTINCT site) AS call_sites FROM calls)
    SELECT *, round(decoded_bytes / total_bytes * 100, 6) AS percent FROM a, t, c, s""")
def coverage(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    total = docs.agg(F.sum("size")).first()[0]
    english = docs.where("lang = 'en'").select("size", F.lit(total).alias("total"))
    return graph.coverage(english, _calls(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {_CALLS} SELECT caller, callee, site FROM calls WHERE callee = 7")
def callers(spark, sf_dir):
    return graph.callers(_calls(spark, sf_dir), 7)


@query(f"WITH {_CALLS} SELECT caller, callee, site FROM calls WHERE caller = 7")
def callees(spark, sf_dir):
    return graph.callees(_calls(spark, sf_dir), 7)


_REFS = f"{_CALLS}, refs AS (SELECT callee AS target, site, 'call' AS kind FROM calls UNION ALL SELECT l_partkey, l_orderkey * 8 + l_linenumber, 'data' FROM lineitem)"


def _refs(spark, sf_dir) -> DataFrame:
    calls = _calls(spark, sf_dir).select(F.col("callee").alias("target"), "site", F.lit("call").alias("kind"))
    data = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("site"), F.lit("data").alias("kind"))
    return calls.unionByName(data)


@query(f"""WITH {_REFS}, h AS (SELECT *, row_number() OVER (ORDER BY site, kind) AS n, count(*) OVER () AS total FROM refs WHERE target = 7)
    SELECT target, site, kind, total, total > 200 AS total_truncated FROM h WHERE n <= 200""")
def refs_to(spark, sf_dir):
    return graph.references_to(_refs(spark, sf_dir), 7)


@query(f"""WITH {_REFS}, d AS (SELECT DISTINCT target, site FROM refs), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY site) AS n, count(*) OVER (PARTITION BY target) AS site_total FROM d)
    SELECT target, string_agg(site::VARCHAR, ',' ORDER BY site) AS sites, max(site_total) AS site_total FROM r WHERE n <= 32 GROUP BY target""")
def reverse_refs_capped(spark, sf_dir):
    return graph.reverse_references(_refs(spark, sf_dir)).select("target", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"), "site_total")


_FACTS = """facts AS (SELECT event_id, user_id AS owner, event_type AS kind, value, user_id % 17 AS target,
    CASE WHEN value >= 75 THEN 'certain' WHEN value >= 50 THEN 'inferred' WHEN value >= 25 THEN 'probable' ELSE 'observed' END AS confidence FROM events)"""


def _facts(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    grade = F.when(v >= 75, "certain").when(v >= 50, "inferred").when(v >= 25, "probable").otherwise("observed")
    return _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), F.col("event_type").alias("kind"), "value", (F.col("user_id") % 17).alias("target"), grade.alias("confidence"))


@query(f"""WITH {_FACTS} SELECT CASE WHEN NOT owner < 100 THEN 'selection' WHEN kind NOT IN ('click', 'purchase', 'view') THEN 'category'
    WHEN confidence NOT IN ('certain', 'inferred') THEN 'confidence' ELSE 'kept' END AS outcome, count(*) AS facts FROM facts GROUP BY 1""")
def fact_select(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return graph.exclusion_counts(graph.select_facts(facts, F.col("owner") < 100, F.col("kind").isin("click", "purchase", "view"), graph.strength(F.col("confidence")) >= 3))


@query(f"""WITH {_FACTS}, f AS (SELECT owner, CASE WHEN kind = 'purchase' THEN 'call' ELSE kind END AS kind, target, confidence <> 'observed' AS certain FROM facts)
    SELECT owner, count(*) AS facts, count(*) FILTER (kind = 'call') AS calls, count(DISTINCT CASE WHEN kind = 'call' THEN target END) AS callees,
        string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CASE WHEN count(*) FILTER (kind = 'call') > 0 THEN false WHEN bool_and(certain) THEN true END AS leaf
    FROM f GROUP BY owner""")
def function_summaries(spark, sf_dir):
    kind = F.when(F.col("kind") == "purchase", "call").otherwise(F.col("kind"))
    return graph.function_summaries(_facts(spark, sf_dir).select("owner", kind.alias("kind"), "target", (F.col("confidence") != "observed").alias("certain")))


@query(f"""WITH {_FACTS}, r AS (SELECT kind, confidence, count(*) AS n FROM facts WHERE confidence <> 'certain' GROUP BY ALL),
    d AS (SELECT kind, confidence, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, list_position(['inferred', 'probable', 'observed'], confidence)) AS rn FROM r)
    SELECT f.kind, count(*) AS arguments, count(*) FILTER (f.confidence = 'certain') AS resolved, round(count(*) FILTER (f.confidence = 'certain') / count(*) * 100, 6) AS percent,
        any_value(d.confidence) AS dominant_reason, any_value(d.n) AS dominant_count FROM facts f LEFT JOIN d ON d.kind = f.kind AND d.rn = 1 GROUP BY f.kind""")
def resolution_stats(spark, sf_dir):
    arguments = _facts(spark, sf_dir).select("kind", (F.col("confidence") == "certain").alias("resolved"), F.col("confidence").alias("reason"))
    return graph.resolution(arguments, "kind", ["inferred", "probable", "observed"]).withColumn("percent", F.round("percent", 6))


_SPANS = """spans AS (SELECT user_id AS k, event_id AS id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + (value * 600)::BIGINT AS until FROM events WHERE event_type <> 'click'),
    cut AS (SELECT k, id, start, least(until, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start, id), until)) AS stop FROM spans),
    points AS (SELECT user_id AS k, event_id, epoch_us(ts) // 1000000 AS "at" FROM events WHERE event_type = 'click')"""


@query(f"""WITH {_SPANS}, j AS (SELECT p.*, s.id, s.start, s.stop, row_number() OVER (PARTITION BY p.event_id ORDER BY s.start DESC, s.stop DESC, s.id DESC) AS n
        FROM points p LEFT JOIN cut s ON s.k = p.k AND s.start <= p."at")
    SELECT k, event_id, "at", CASE WHEN "at" < stop THEN id END AS id, CASE WHEN "at" < stop THEN start END AS start FROM j WHERE n = 1""")
def covering_instruction(spark, sf_dir):
    """The span (an event and the seconds its value gives it) that holds a click."""
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("at"), "value")
    spans = events.where("event_type <> 'click'").select("k", F.col("event_id").alias("id"), F.col("at").alias("start"), (F.col("at") + F.rint(F.col("value") * 600).cast("long")).alias("until"))
    following = F.lead("start").over(Window.partitionBy("k").orderBy("start", "id"))
    cut = spans.withColumn("stop", F.least("until", F.coalesce(following, F.col("until"))))
    return graph.covering(events.where("event_type = 'click'").select("k", "event_id", "at"), cut, "k")


@query(f"""WITH {_SPANS}, s AS (SELECT DISTINCT k, start FROM spans) SELECT k, start, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start), 4102444800) AS stop FROM s""")
def region_end(spark, sf_dir):
    starts = _t(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("user_id").alias("k"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("start")).distinct()
    return graph.region_ends(starts, "k", F.lit(4102444800))


@query("""WITH RECURSIVE uses AS (SELECT DISTINCT 'p' || l_partkey AS used_by, 's' || l_suppkey AS defined_by FROM lineitem WHERE l_linenumber = 1
        UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber = 2),
    reach(node, depth) AS (SELECT 'p1', 0 UNION SELECT u.defined_by, r.depth + 1 FROM reach r JOIN uses u ON u.used_by = r.node WHERE r.depth < 4)
    SELECT node, min(depth)::INTEGER AS depth FROM reach GROUP BY node""")
def backward_slice(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"), "l_linenumber")
    uses = lines.where("l_linenumber = 1").select(F.col("p").alias("used_by"), F.col("s").alias("defined_by")).union(lines.where("l_linenumber = 2").select("s", "p"))
    return graph.backward_slice(uses, ["p1"], 4)


# -- hardware -----------------------------------------------------------------

#: Written apart from the operator's table: families by arithmetic, single registers by name.
_REGISTERS = """(WITH o AS (SELECT unnest(range(0, 512, 2)) AS k), single AS (SELECT * FROM (VALUES
        (2, 'DMACONR'), (4, 'VPOSR'), (6, 'VHPOSR'), (10, 'JOY0DAT'), (12, 'JOY1DAT'), (14, 'CLXDAT'), (16, 'ADKCONR'), (22, 'POTGOR'), (26, 'DSKBYTR'), (28, 'INTENAR'),
        (30, 'INTREQR'), (32, 'DSKPTH'), (34, 'DSKPTL'), (36, 'DSKLEN'), (42, 'VPOSW'), (44, 'VHPOSW'), (46, 'COPCON'), (48, 'SERDAT'), (50, 'SERPER'), (52, 'POTGO'),
        (64, 'BLTCON0'), (66, 'BLTCON1'), (68, 'BLTAFWM'), (70, 'BLTALWM'), (72, 'BLTCPTH'), (74, 'BLTCPTL'), (76, 'BLTBPTH'), (78, 'BLTBPTL'), (80, 'BLTAPTH'),
        (82, 'BLTAPTL'), (84, 'BLTDPTH'), (86, 'BLTDPTL'), (88, 'BLTSIZE'), (90, 'BLTCON0L'), (92, 'BLTSIZV'), (94, 'BLTSIZH'), (96, 'BLTCMOD'), (98, 'BLTBMOD'),
        (100, 'BLTAMOD'), (102, 'BLTDMOD'), (112, 'BLTCDAT'), (114, 'BLTBDAT'), (116, 'BLTADAT'), (126, 'DSKSYNC'), (128, 'COP1LCH'), (130, 'COP1LCL'), (132, 'COP2LCH'),
        (134, 'COP2LCL'), (136, 'COPJMP1'), (138, 'COPJMP2'), (140, 'COPINS'), (142, 'DIWSTRT'), (144, 'DIWSTOP'), (146, 'DDFSTRT'), (148, 'DDFSTOP'), (150, 'DMACON'),
        (152, 'CLXCON'), (154, 'INTENA'), (156, 'INTREQ'), (158, 'ADKCON'), (256, 'BPLCON0'), (258, 'BPLCON1'), (260, 'BPLCON2'), (262, 'BPLCON3'), (264, 'BPL1MOD'),
        (266, 'BPL2MOD'), (476, 'BEAMCON0'), (484, 'DIWHIGH'), (508, 'FMODE')) AS t(k, name)),
    named AS (SELECT o.k, CASE
        WHEN o.k BETWEEN 160 AND 223 THEN 'AUD' || ((o.k - 160) // 16) || ['LCH', 'LCL', 'LEN', 'PER', 'VOL', 'DAT'][(o.k - 160) % 16 // 2 + 1]
        WHEN o.k BETWEEN 224 AND 255 THEN 'BPL' || ((o.k - 224) // 4 + 1) || ['PTH', 'PTL'][o.k % 4 // 2 + 1]
        WHEN o.k BETWEEN 272 AND 287 THEN 'BPL' || ((o.k - 272) // 2 + 1) || 'DAT'
        WHEN o.k BETWEEN 288 AND 319 THEN 'SPR' || ((o.k - 288) // 4) || ['PTH', 'PTL'][o.k % 4 // 2 + 1]
        WHEN o.k BETWEEN 320 AND 383 THEN 'SPR' || ((o.k - 320) // 8) || ['POS', 'CTL', 'DATA', 'DATB'][o.k % 8 // 2 + 1]
        WHEN o.k BETWEEN 384 AND 447 THEN 'COLOR' || lpad(((o.k - 384) // 2)::VARCHAR, 2, '0')
        ELSE single.name END AS name FROM o LEFT JOIN single ON single.k = o.k)
    SELECT k::INTEGER AS "offset", name, CASE WHEN k IN (2, 150) THEN 'dma' WHEN k IN (24, 28, 30, 154, 156) THEN 'interrupt'
        WHEN k IN (26, 126) OR k BETWEEN 32 AND 36 THEN 'disk' WHEN k IN (48, 50) THEN 'serial' WHEN k BETWEEN 64 AND 116 THEN 'blitter' WHEN k BETWEEN 128 AND 140 THEN 'copper'
        WHEN k BETWEEN 142 AND 148 OR k = 152 OR k BETWEEN 256 AND 270 THEN 'display' WHEN k BETWEEN 158 AND 223 THEN 'audio'
        WHEN k BETWEEN 224 AND 254 OR k BETWEEN 272 AND 286 THEN 'bitplane' WHEN k BETWEEN 288 AND 382 THEN 'sprite' WHEN k BETWEEN 384 AND 446 THEN 'color' ELSE 'other' END AS subsystem
    FROM named WHERE name IS NOT NULL) AS r"""


@query(f"SELECT \"offset\", name, subsystem FROM {_REGISTERS}")
def register_list(spark, sf_dir):
    return hardware.register_map(spark)


@query(f"""WITH a AS (SELECT l_orderkey * 8 + l_linenumber AS site, ({hardware.REGISTER_BASE} + (l_partkey * 2) % 1024)::BIGINT AS address FROM lineitem)
    SELECT (address - {hardware.REGISTER_BASE})::INTEGER AS "offset", site, address, name, subsystem FROM a LEFT JOIN {_REGISTERS} ON address - {hardware.REGISTER_BASE} = r."offset"
    WHERE address BETWEEN {hardware.REGISTER_BASE} AND {hardware.REGISTER_BASE + 511}""")
def register_refs(spark, sf_dir):
    accesses = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("site"), (F.lit(hardware.REGISTER_BASE).cast("long") + F.col("l_partkey") * 2 % 1024).alias("address"))
    return hardware.register_references(accesses)


_COPPER = f"""{_WORDS}, pairs AS (SELECT source_id, pos, CASE WHEN word % 23 = 0 THEN 65535 WHEN word % 5 = 0 THEN (word * 31) % 65536 | 1 ELSE 256 + (word % 96) * 2 END AS first,
    CASE WHEN word % 23 = 0 THEN 65534 ELSE (word * 97) % 65536 END AS second FROM words),
    n AS (SELECT *, row_number() OVER w AS n, coalesce(max((first = 65535 AND second = 65534)::INT) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM pairs WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
    k AS (SELECT source_id, pos, first, second, first & 1 = 0 AS move FROM n WHERE ended = 0 AND n <= 4096)"""


def _copper(spark, sf_dir) -> DataFrame:
    w = F.col("word")
    first = F.when(w % 23 == 0, F.lit(65535)).when(w % 5 == 0, (w * 31 % 65536).bitwiseOR(F.lit(1).cast("long"))).otherwise(256 + w % 96 * 2)
    second = F.when(w % 23 == 0, F.lit(65534)).otherwise(w * 97 % 65536)
    return hardware.decode_copper(_words(spark, sf_dir).select("source_id", "pos", first.alias("first"), second.alias("second")))


@query(f"""WITH {_COPPER} SELECT source_id, pos, CASE WHEN move THEN 'MOVE' WHEN second & 1 = 0 THEN 'WAIT' ELSE 'SKIP' END AS op,
    CASE WHEN move THEN first & 510 END AS register, CASE WHEN move THEN second END AS value, CASE WHEN NOT move THEN first >> 8 END AS vpos, CASE WHEN NOT move THEN first & 254 END AS hpos,
    CASE WHEN NOT move THEN (second >> 8) & 127 END AS vmask, CASE WHEN NOT move THEN second & 254 END AS hmask, CASE WHEN NOT move THEN second & 32768 <> 0 END AS blitter_finish_disable FROM k""")
def copper_decode(spark, sf_dir):
    return _copper(spark, sf_dir)


@query(f"""WITH {_COPPER}, l AS (SELECT source_id, first & 510 AS register, max_by(second, pos) AS value FROM k WHERE move GROUP BY ALL)
    SELECT source_id, max(CASE WHEN register = 256 THEN (value >> 12) & 7 END) AS planes,
        coalesce(string_agg(CASE WHEN register BETWEEN 384 AND 446 THEN value::VARCHAR END, ',' ORDER BY register), '') AS colours FROM l GROUP BY source_id""")
def display_spec(spark, sf_dir):
    spec = hardware.display_spec(_copper(spark, sf_dir).where("op = 'MOVE'"))
    return spec.select("source_id", "planes", F.array_join(F.col("colours").cast("array<string>"), ",").alias("colours"))


@query("""WITH v AS (SELECT o_orderkey, o_custkey * 65536 + o_orderkey AS value, o_custkey * 65536 AS origin, 40000 AS size, o_orderkey * 64 AS file_offset FROM orders)
    SELECT o_orderkey, CASE WHEN value BETWEEN 0 AND 4294967295 THEN value END AS absolute, CASE WHEN value >= origin AND value < origin + size THEN value - origin END AS relative,
        CASE WHEN value >= origin AND value < origin + size AND value - origin + file_offset BETWEEN 0 AND 4294967295 THEN value - origin + file_offset END AS in_file FROM v""")
def address_resolve(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    origin = F.col("o_custkey") * 65536
    found = hardware.resolve_address(orders, origin + F.col("o_orderkey"), origin, F.lit(40000), F.col("o_orderkey") * 64)
    return found.select("o_orderkey", "absolute", "relative", "in_file")


# -- rasters ------------------------------------------------------------------

_GRID = """grid AS (SELECT (l_orderkey % 512)::BIGINT AS x, ((l_orderkey // 512) * 8 + l_linenumber)::BIGINT AS y, l_partkey % 16 AS a, l_suppkey % 16 AS b FROM lineitem),
    one AS (SELECT x, y, min(a) AS a, min(b) AS b FROM grid GROUP BY x, y)"""


def _grids(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 512).alias("x"), (F.expr("l_orderkey div 512") * 8 + F.col("l_linenumber")).alias("y"), (F.col("l_partkey") % 16).alias("a"), (F.col("l_suppkey") % 16).alias("b")
    ).groupBy("x", "y").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    return rows.where("x < 500").select("x", "y", F.col("a").alias("index")), rows.where("x >= 8").select("x", "y", F.col("b").alias("index"))


_DIFF = f"{_GRID}, diff AS (SELECT x, y, p, q FROM (SELECT x, y, a AS p FROM one WHERE x < 500) FULL JOIN (SELECT x, y, b AS q FROM one WHERE x >= 8) USING (x, y) WHERE p IS DISTINCT FROM q)"


@query(f"WITH {_DIFF} SELECT coalesce(p, 0) AS from_index, coalesce(q, 0) AS to_index, count(*) AS pixels FROM diff GROUP BY 1, 2")
def bitmap_compare(spark, sf_dir):
    return raster.substitutions(raster.pixel_differences(*_grids(spark, sf_dir)))


@query(f"WITH {_DIFF} SELECT count(*) AS pixels, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom FROM diff")
def bitmap_bounds(spark, sf_dir):
    return raster.bounds(raster.pixel_differences(*_grids(spark, sf_dir)))


_BLOBS = "pts AS (SELECT DISTINCT (l_partkey % 200)::BIGINT AS x, (l_suppkey % 97)::BIGINT AS y FROM lineitem WHERE l_quantity >= 48 AND l_linenumber = 7)"


@query(f"""WITH RECURSIVE {_BLOBS}, num AS (SELECT *, y * 2147483648 + x AS id FROM pts),
    reach(id, root) AS (SELECT id, id FROM num UNION SELECT n.id, r.root FROM reach r JOIN num m ON m.id = r.id
        JOIN num n ON abs(n.x - m.x) + abs(n.y - m.y) = 1),
    lab AS (SELECT id, min(root) AS region FROM reach GROUP BY id)
    SELECT region, count(*) AS pixels, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom FROM lab JOIN num USING (id) GROUP BY region""")
def connected_regions(spark, sf_dir):
    points = _t(spark, sf_dir, "lineitem").where("l_quantity >= 48 AND l_linenumber = 7").select((F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 97).alias("y"))
    return raster.connected_regions(points).withColumn("pixels", F.col("pixels").cast("long"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, bit::BIGINT AS bit,
    (((l_partkey & 255) >> (7 - bit)) & 1) + 2 * (((l_suppkey & 255) >> (7 - bit)) & 1) + 4 * ((((l_orderkey) & 255) >> (7 - bit)) & 1) AS pixel FROM lineitem, range(8) AS r(bit)""")
def planar_decode(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", _l("l_linenumber"), "l_partkey", "l_suppkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    planes = [F.col(c).bitwiseAND(F.lit(255).cast("long")) for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    return rows.select("l_orderkey", "l_linenumber", F.col("bit").cast("long").alias("bit"), raster.planar_to_chunky(planes, F.col("bit")).alias("pixel"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey % 65536 > 4095 AS stray,
    ((l_partkey >> 8) & 15) * 17 AS r, ((l_partkey >> 4) & 15) * 17 AS g, (l_partkey & 15) * 17 AS b FROM lineitem""")
def palette_decode(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", _l("l_linenumber"), (F.col("l_partkey") % 65536).alias("w"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("w") > 4095).alias("stray"), B.rgb4_to_rgb8(F.col("w")).alias("c")).select("l_orderkey", "l_linenumber", "stray", "c.r", "c.g", "c.b")


# -- projects -----------------------------------------------------------------

@query("SELECT doc_id AS source_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def manifest(spark, sf_dir):
    return project.manifest(_sources(spark, sf_dir))


@query("""WITH e AS (SELECT source, 'doc-' || doc_id AS path, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS h FROM documents)
    SELECT source, count(*) AS files, sum(size)::BIGINT AS bytes, sha256(string_agg(path || chr(9) || size || chr(9) || h, chr(10) ORDER BY path)) AS tree_sha256 FROM e GROUP BY source""")
def inventory_hash(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("source", F.concat(F.lit("doc-"), "doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    entries = docs.select("source", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    return project.tree_hash(entries, "source")


@query("""SELECT 'dangling-customer' AS code, o_custkey::VARCHAR AS reference, count(*) AS documents FROM orders
    WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) GROUP BY o_custkey""")
def project_check_dangling(spark, sf_dir):
    kept = _t(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")
    return project.dangling(_t(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", kept, "c_custkey", "dangling-customer")


@query("SELECT 'duplicate-part-name' AS code, p_name AS reference, count(*) AS documents FROM part GROUP BY p_name HAVING count(*) > 1")
def project_check_duplicates(spark, sf_dir):
    return project.duplicates(_t(spark, sf_dir, "part").select("p_name"), "p_name", "duplicate-part-name")


@query("""SELECT lang, count(*) AS sources, count(DISTINCT source) AS directories, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY lang""")
def project_describe(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("lang", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("source").alias("directories"), F.sum("n").alias("bytes"))


# -- patterns, sweeps, folds --------------------------------------------------

@query("""WITH e AS (SELECT user_id, event_id, event_type, value, lead(event_type) OVER w AS nt, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round(nv / value, 6) AS scale FROM e WHERE event_type = 'view' AND nt = 'click' AND value > 0""")
def fixed_point_pattern(spark, sf_dir):
    """A view followed at once by a click, as a multiply is by its shift."""
    events = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type", "value")
    pairs = raster.follows(events, "user_id", "at", ["event_type", "value"]).where("event_type = 'view' AND next_event_type = 'click' AND value > 0")
    return pairs.select("user_id", "event_id", F.round(F.col("next_value") / F.col("value"), 6).alias("scale"))


@query("""WITH e AS (SELECT user_id, event_id, value, lead(value) OVER w AS n1, lead(value, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id FROM e WHERE value > n1 AND n2 > n1""")
def clamp_pattern(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    w = Window.partitionBy("user_id").orderBy("at")
    return events.withColumn("n1", F.lead("value").over(w)).withColumn("n2", F.lead("value", 2).over(w)).where("value > n1 AND n2 > n1").select("user_id", "event_id")


@query("""WITH c AS (SELECT user_id AS sweep, event_id, (value * 10)::BIGINT AS steps FROM events),
    s AS (SELECT *, coalesce(sum(steps) OVER (PARTITION BY sweep ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM c)
    SELECT sweep, event_id, steps, spent, spent + 1000 <= 20000 AS runs FROM s""")
def matrix_sweep(spark, sf_dir):
    cases = _t(spark, sf_dir, "events").select(F.col("user_id").alias("sweep"), "event_id", F.rint(F.col("value") * 10).cast("long").alias("steps"))
    return sandbox.within_budget(cases, "event_id", F.col("steps"), 1000, 20000)


@query("""WITH e AS (SELECT user_id, event_id, value, count(*) OVER w AS steps, max(value) OVER w AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, steps, peak FROM e""")
def timeline_fold(spark, sf_dir):
    """One evolving state a user: steps so far and the highest value."""

    def fold(rows):
        return rows.assign(steps=range(1, len(rows) + 1), peak=rows["value"].cummax())[["user_id", "event_id", "steps", "peak"]]

    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return sandbox.timeline(events, "user_id", ["event_id"], fold, "user_id long, event_id long, steps long, peak double")
