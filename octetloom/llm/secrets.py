"""Secret scans: patterns, and entropy of sliding windows (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
#: Only maximal runs can match, so the look-behind changes nothing but the time.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

#: Characters of candidate strings, and how many make one.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Characters of a window, and the bits a character that make it random-looking,
#: by the candidate's class of characters.
WINDOW = 20
CLASS_BITS = (
    (r"^[0-9]+$", None),  # numbers are no secrets
    (r"^[a-z+/_=-]+$|^[A-Z+/_=-]+$", None),  # letters of one case: words
    (r"^[A-Za-z+/_=-]+$", 3.75),
    (r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
    (r"^[0-9a-z_-]+$|^[0-9A-Z_-]+$", 3.5),
    (r"", 3.75),
)
#: Words as in paths and names: of one case, or humps of three letters or more
#: and some of two; in paths also numbers, and words with few digits behind.
_WORD = r"([a-z]+|[A-Z]+|[A-Z][a-z]+|[A-Za-z][a-z]{2,}([A-Z][a-z]{2,}|As|At|By|Id|In|Is|No|Of|On|Or|To)+)"
_NAME = rf"({_WORD}[0-9]{{0,3}}|[0-9]{{1,4}})"
_PART = rf"[_-]*{_NAME}([_-]+{_NAME})*[_-]*"
#: Candidates that match one of these as a whole are left alone.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    rf"^/*{_PART}(/{_PART})+/*$",  # paths
    r"^md5[-_=]([0-9a-fA-F]{32}|[A-Za-z0-9+/]{22}==)$",  # named digests, in hex or base64
    r"^sha1[-_=]([0-9a-fA-F]{40}|[A-Za-z0-9+/]{27}=)$",
    r"^sha256[-_=]([0-9a-fA-F]{64}|[A-Za-z0-9+/]{43}=)$",
    r"^sha384[-_=]([0-9a-fA-F]{96}|[A-Za-z0-9+/]{64})$",
    r"^sha512[-_=]([0-9a-fA-F]{128}|[A-Za-z0-9+/]{86}==)$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-][0-9-]+Z?)?$",  # dates
    rf"^{_WORD}([-_]{_WORD})*[-_]?[0-9]{{1,6}}$",  # numbered names
    rf"^[/_=+-]*{_WORD}([/_=+-]+{_WORD})*[/_=+-]*$",  # names of words
)

#: Matches of a text whose places are listed at a time.
BLOCK = 256
KINDS = ("assign", "access", "hex", "entropy")


def _sql(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _places(found: str, gaps: str, rank: int, keep: str = "true") -> str:
    """Spans (start, rank, end) of the strings ``found``, between which ``gaps``
    stand, as running sums of their lengths in code points."""
    span = "struct<start: bigint, rank: int, stop: bigint, ok: boolean>"
    # Built in blocks: a list that grew by one each time would be copied as often.
    return f"""
        filter(flatten(aggregate(
            sequence(0, (size({found}) - 1) div {BLOCK}),
            named_struct('at', 0L, 'spans', cast(array() AS array<array<{span}>>)),
            (o, b) -> transform(array(aggregate(
                sequence(cast(b * {BLOCK} AS int), cast(least(size({found}), b * {BLOCK} + {BLOCK}) - 1 AS int)),
                named_struct('at', o.at, 'spans', cast(array() AS array<{span}>)),
                (acc, i) -> named_struct(
                    'at', acc.at + length({gaps}[i]) + length({found}[i]),
                    'spans', concat(acc.spans, array(named_struct(
                        'start', acc.at + length({gaps}[i]), 'rank', {rank},
                        'stop', acc.at + length({gaps}[i]) + length({found}[i]), 'ok', {keep}
                    )))
                )
            )), g -> named_struct('at', g.at, 'spans', concat(o.spans, array(g.spans))))[0]
        ).spans), s -> s.ok)"""


def _weight(n: str) -> str:
    return f"IF(({n}) > 1, ({n}) * log2({n}), 0D)"


def _window_span(bits: str) -> str:
    """(first, last) windows of candidate characters ``c`` whose entropy is at
    least ``bits``. The sum of n*log2(n) over a window's characters moves on
    with the one character that leaves and the one that enters."""
    w = WINDOW
    count = "size(filter(slice({a}, {at}, {n}), x -> x = {ch}))"
    out = count.format(a="c", at="i", n=w, ch="c[i - 1]")
    come = count.format(a="c", at="i + 1", n=w - 1, ch=f"c[i + {w - 1}]")
    start = f"""aggregate(array_distinct(slice(c, 1, {w})), 0D,
        (z, ch) -> z + transform(array(size(filter(slice(c, 1, {w}), x -> x = ch))), n -> {_weight('n')})[0])"""
    log_w = f"log2({w}D)"
    step = f"""transform(array(named_struct('o', {out}, 'e', {come})),
        n -> acc.s - {_weight('n.o')} + {_weight('n.o - 1')} - {_weight('n.e')} + {_weight('n.e + 1')})[0]"""
    high = f"{log_w} - z / {w} >= {bits} - 1e-9"
    grow = f"""transform(array({{s}}), z -> named_struct(
        's', z, 'first', IF(acc.first < 0 AND {high}, {{i}}, acc.first), 'last', IF({high}, {{i}}, acc.last)))[0]"""
    zero = "named_struct('s', 0D, 'first', -1, 'last', -1)"
    first = f"transform(array({zero}), acc -> {grow.format(s=start, i='0')})[0]"
    return f"""aggregate(IF(size(c) > {w}, sequence(1, size(c) - {w}), cast(array() AS array<int>)), {first},
        (acc, i) -> {grow.format(s=step, i='i')})"""


def _outside(s: str) -> str:
    """What of a candidate (s, start) lies outside the spans ``_base``, as such."""
    cut = f"""array_sort(filter(_base, b -> b.start < {s}.start + length({s}.s) AND b.stop > {s}.start))"""
    piece = "named_struct('s', substring({s}.s, cast(acc.at - {s}.start + 1 AS int), cast({e} - acc.at AS int)), 'start', acc.at)"
    none = "cast(array() AS array<struct<s: string, start: bigint>>)"
    return f"""aggregate({cut}, named_struct('at', {s}.start, 'out', {none}),
        (acc, b) -> named_struct('at', greatest(acc.at, b.stop), 'out', IF(b.start > acc.at, concat(acc.out, array({piece.format(s=s, e='b.start')})), acc.out)),
        acc -> filter(concat(acc.out, array({piece.format(s=s, e=f'({s}.start + length({s}.s))')})), x -> length(x.s) >= {WINDOW}))"""


def find(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED, apart: bool = False) -> DataFrame:
    """Return ``docs`` with ``spans``: array of (start, rank, stop) in code
    points, sorted by start, then kind (rank indexes KINDS).

    Kinds: ``assign`` (a secret's name and a value of 6 characters or more),
    ``access`` (key ids), ``hex`` (24 digits or more), each leftmost and not
    overlapping within the kind; and ``entropy``: in a candidate string of 20
    characters or more that the ``allowed`` patterns do not match, the stretch
    from the first to the last window whose Shannon entropy reaches its
    character class's bits, unless it overlaps a span of the other kinds. With
    ``apart``, what of a candidate lies outside those spans is a candidate of
    its own instead, so nothing random-looking is lost by its neighbour.

    Null and empty texts have no spans; every row stays, repeated or not;
    an input column named ``spans`` is replaced. Nothing is shuffled.
    """
    rows, _ = boxed(docs, ["spans"])
    some = lambda a, p: f"IF(size({a}) > 0, split(_t, {_sql(p)}, -1), cast(array() AS array<string>))"
    t = rows.withColumn("_t", F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")))
    patterns = {"_a": ASSIGN, "_k": ACCESS, "_h": HEX, "_c": CANDIDATE}
    t = t.selectExpr("*", *[f"regexp_extract_all(_t, {_sql(p)}, 0) AS {c}" for c, p in patterns.items()])
    t = t.selectExpr(
        "*", *[f"{some(c, p)} AS {c}g" for c, p in patterns.items()],
        f"IF(size(_a) > 0, regexp_extract_all(_t, {_sql(ASSIGN)}, 2), cast(array() AS array<string>)) AS _v",
    )
    t = t.selectExpr("row", "_c", "_cg", *[
        f"IF(size({c}) > 0, {_places(c, c + 'g', rank, keep)}, cast(array() AS array<struct<start: bigint, rank: int, stop: bigint, ok: boolean>>)) AS {c}s"
        for rank, (c, keep) in enumerate((("_a", f"length(_v[i]) >= {ASSIGN_LEAST}"), ("_k", "true"), ("_h", "true")))
    ], f"IF(size(_c) > 0, {_places('_c', '_cg', 3)}, cast(array() AS array<struct<start: bigint, rank: int, stop: bigint, ok: boolean>>)) AS _cs")
    t = t.selectExpr("*", "concat(_as, _ks, _hs) AS _base")
    bits = "CASE " + " ".join(f"WHEN s.s RLIKE {_sql(p)} THEN {'cast(null AS double)' if b is None else f'{b}D'}" for p, b in CLASS_BITS) + " END"
    allow = " AND ".join(f"NOT s.s RLIKE {_sql(p)}" for p in allowed) or "true"
    clear = "NOT exists(_base, b -> b.start < {e} AND b.stop > {a})"
    strings = "transform(_cs, (p, i) -> named_struct('s', _c[i], 'start', p.start))"
    if apart:
        strings = f"flatten(transform({strings}, w -> {_outside('w')}))"
    candidates = f"""filter(transform(
            filter({strings}, s -> {allow}),
            s -> named_struct('s', s.s, 'start', s.start, 'bits', {bits})), s -> s.bits IS NOT NULL)"""
    t = t.selectExpr("*", f"""IF(size(_c) > 0, filter(transform({candidates}, s ->
            transform(array(split(s.s, '')), c -> transform(array({_window_span('s.bits')}), g ->
                named_struct('start', s.start + g.first, 'rank', 3, 'stop', s.start + g.last + {WINDOW}, 'ok', g.first >= 0))[0])[0]
        ), s -> s.ok AND {clear.format(a='s.start', e='s.stop')}),
        cast(array() AS array<struct<start: bigint, rank: int, stop: bigint, ok: boolean>>)) AS _e""")
    return t.selectExpr(
        "row.*",
        "transform(array_sort(concat(_base, _e)), s -> named_struct('start', s.start, 'rank', s.rank, 'stop', s.stop)) AS spans",
    )


def span_list(spans: str, base_only: bool = False) -> str:
    """SQL for kind:start:end of each span, joined by commas."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    kept = f"filter({spans}, s -> s.rank < 3)" if base_only else spans
    return f"array_join(transform({kept}, s -> concat_ws(':', {kinds}[s.rank], s.start, s.stop)), ',')"


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Return ``docs`` with every span of ``find`` (``apart``) in the text replaced
    by ``mark`` (overlapping spans by one), and ``n_chars``, if there, counted
    anew in changed rows. Rows without secrets are left as they are, nulls too."""
    rows = find(docs, text, apart=True)
    mark_sql = _sql(mark)
    new = f"""aggregate(spans, named_struct('at', 0L, 'out', ''),
        (acc, s) -> IF(s.start < acc.at,
            named_struct('at', greatest(acc.at, s.stop), 'out', acc.out),
            named_struct('at', s.stop, 'out', concat(acc.out, substring(`{text}`, cast(acc.at + 1 AS int), cast(s.start - acc.at AS int)), {mark_sql}))),
        acc -> concat(acc.out, substring(`{text}`, cast(acc.at + 1 AS int))))"""
    fresh = "new_" + "_".join(docs.columns)  # longer than any name of the input
    rows = rows.selectExpr("*", f"IF(size(spans) > 0, {new}, `{text}`) AS `{fresh}`")
    out = []
    for c in docs.columns:
        if c == text:
            out.append(f"`{fresh}` AS `{c}`")
        elif c.lower() == "n_chars":
            out.append(f"IF(size(spans) > 0, cast(length(`{fresh}`) AS {dict(docs.dtypes)[c]}), `{c}`) AS `{c}`")
        elif c.lower() != "spans":
            out.append(f"`{c}`")
    return rows.selectExpr(*out)
