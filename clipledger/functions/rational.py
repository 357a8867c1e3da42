"""Exact positive rationals as ``struct<num, den, value, status>`` columns.

The parser is one SQL expression. Intermediate results are bound by one-element
``transform`` calls, so every part appears once: chained projections would be
inlined into each other as soon as a filter on the result is pushed down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions.evaluate import evaluate_once

DEC = "decimal(38,0)"
RATE_TYPE = f"struct<num:{DEC},den:{DEC},value:double,status:string>"

# fixed values: spellings that mean "unknown", and the accepted grammar
UNKNOWN_RATES = ["", "0/0", "N/A"]
UNKNOWN = (
    f"named_struct('num', CAST(NULL AS {DEC}), 'den', CAST(NULL AS {DEC}), "
    "'value', CAST(NULL AS DOUBLE), 'status', 'unknown')"
)
_MAX_LENGTH = 64
_MAX_EXPONENT = 1000
_FRACTION = r"r'^\+?[0-9]+/[0-9]+\z'"
_DECIMAL = r"r'^\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _parts(num: str, den: str, value: str) -> str:
    return (
        f"named_struct('n', CAST({num} AS {DEC}), 'd', CAST({den} AS {DEC}), 'v', CAST({value} AS DOUBLE))"
    )


def _gcd(a: str, b: str) -> str:
    """Euclid as a bounded fold: at most five steps per digit of the smaller operand."""

    def fold(kind: str) -> str:
        return f"""aggregate(
            sequence(1, length(CAST(least({a}, {b}) AS STRING)) * 5 + 1),
            named_struct('x', CAST({a} AS {kind}), 'y', CAST({b} AS {kind})),
            (g, i) -> IF(g.y <> 0, named_struct('x', g.y, 'y', CAST(g.x % g.y AS {kind})), g),
            g -> CAST(g.x AS {DEC}))"""

    return f"""CASE WHEN {a} = 1 OR {b} = 1 THEN CAST(1 AS {DEC})
        WHEN {a} < 1000000000000000000 AND {b} < 1000000000000000000 THEN {fold('BIGINT')}
        ELSE {fold(DEC)} END"""


def _reduced(parts: str, absent: str) -> str:
    """Rate in lowest terms; what does not fit the decimals is reported, not rounded."""

    def shrink(n: str) -> str:
        return f"CASE WHEN q.g = 1 THEN {n} ELSE try_cast(try_divide({n}, q.g) AS {DEC}) END"

    rate = """named_struct(
        'num', IF(r.fits, r.n, NULL), 'den', IF(r.fits, r.d, NULL), 'value', IF(r.sound, r.v, NULL),
        'status', CASE WHEN {absent} THEN 'unknown' WHEN NOT r.sound THEN 'invalid'
                       WHEN r.fits THEN 'ok' ELSE 'unsupported_precision' END)""".format(absent=absent)
    fitted = _let(
        "r",
        "named_struct('n', t.n, 'd', t.d, 'v', t.v, 'sound', t.sound, "
        "'fits', t.n IS NOT NULL AND t.d IS NOT NULL)",
        rate,
    )
    divided = _let(
        "t",
        f"named_struct('n', {shrink('q.p.n')}, 'd', {shrink('q.p.d')}, 'v', q.p.v, 'sound', q.sound)",
        fitted,
    )
    sound = "coalesce(p.v > 0 AND p.v < double('Infinity'), false)"
    with_gcd = _let(
        "q",
        f"named_struct('p', p, 'sound', {sound}, 'g', "
        f"CASE WHEN {sound} AND p.n IS NOT NULL AND p.d IS NOT NULL THEN {_gcd('p.n', 'p.d')} END)",
        divided,
    )
    return _let("p", parts, with_gcd)


def _fraction(s: str) -> str:
    """``a/b`` of whole numbers; a leading zero before digits means base eight."""

    def whole(t: str) -> str:
        return f"""CASE WHEN NOT {t} RLIKE r'^0[0-9]' THEN try_cast({t} AS {DEC})
            WHEN {t} RLIKE r'^0[0-7]{{1,21}}\\z' THEN try_cast(conv({t}, 8, 10) AS {DEC})
            WHEN {t} RLIKE r'^0[0-7]{{22,42}}\\z' THEN try_add(
                try_multiply(try_cast(conv(left({t}, length({t}) - 21), 8, 10) AS {DEC}), CAST({8**21} AS {DEC})),
                try_cast(conv(right({t}, 21), 8, 10) AS {DEC})) END"""

    eights = _let(
        "e",
        f"named_struct('n', {whole('f.a')}, 'd', {whole('f.b')})",
        _parts("e.n", "e.d", "try_divide(CAST(e.n AS DOUBLE), CAST(e.d AS DOUBLE))"),
    )
    plain = _parts(
        f"try_cast(f.a AS {DEC})", f"try_cast(f.b AS {DEC})",
        "try_divide(try_cast(f.a AS DOUBLE), try_cast(f.b AS DOUBLE))",
    )
    return _let(
        "f",
        f"named_struct('a', split_part({s}, '/', 1), 'b', split_part({s}, '/', 2))",
        f"CASE WHEN f.a RLIKE r'^0[0-9]' OR f.b RLIKE r'^0[0-9]' THEN {eights} ELSE {plain} END",
    )


def _decimal(s: str) -> str:
    """Decimal text with optional exponent as ``digits * 10 ^ shift``."""
    mantissa = f"regexp_replace({s}, r'[eE].*\\z', '')"
    exponent = f"regexp_extract({s}, r'[eE]([+-]?[0-9]+)\\z', 1)"
    read = f"""named_struct(
        'digits', regexp_replace(replace({mantissa}, '.', ''), r'^0+', ''),
        'scale', length(regexp_extract({mantissa}, r'\\.([0-9]*)\\z', 1)),
        'e', CASE WHEN {exponent} = '' THEN 0 ELSE try_cast({exponent} AS INT) END)"""
    # Bounded before anything is padded: a short text can ask for 10^9 zeros.
    bounded = f"""named_struct(
        'short', rtrim('0', m.digits), 'real', abs(m.e) <= {_MAX_EXPONENT},
        'shift', CASE WHEN abs(m.e) <= {_MAX_EXPONENT}
                      THEN m.e - m.scale + length(m.digits) - length(rtrim('0', m.digits)) END)"""
    parts = _parts(
        f"try_cast(concat(k.short, repeat('0', greatest(k.shift, 0))) AS {DEC})",
        f"try_cast(concat('1', repeat('0', greatest(-k.shift, 0))) AS {DEC})",
        f"CASE WHEN k.real THEN try_cast({s} AS DOUBLE) END",
    )
    return _let("m", read, _let("k", bounded, parts))


def parse_rate(text: str, lenient: bool = True, trim: bool = False) -> Column:
    """The exact positive rational that the column ``text`` spells, as a rate struct.

    ``status`` is ``ok``, ``unknown`` (lenient mode only), ``invalid`` or
    ``unsupported_precision``: the exact pair needs over 38 digits, and only the
    double is given. The grammar is checked before any cast, because
    casts accept spellings such as ``0x1p3``, ``1d`` or ``Infinity``.
    """
    ends = f"^{C.WHITE_SPACE_RUN}|{C.WHITE_SPACE_RUN}\\z"
    column = f"regexp_replace(`{text}`, r'{ends}', '')" if trim else f"`{text}`"
    unknown = ", ".join(f"'{u}'" for u in UNKNOWN_RATES)
    short = f"length(s) <= {_MAX_LENGTH}"
    parts = f"""CASE WHEN {short} AND s RLIKE {_FRACTION} THEN {_fraction("ltrim('+', s)")}
        WHEN {short} AND s RLIKE {_DECIMAL} THEN {_let("b", "ltrim('+', s)", _decimal("b"))}
        ELSE {_parts("NULL", "NULL", "NULL")} END"""
    general = _let("s", f"coalesce({column}, '')", _reduced(parts, "false"))
    # Whole numbers over one, the usual case, need no general arithmetic.
    parsed = f"""CASE WHEN {column} RLIKE r'^[1-9][0-9]{{0,14}}/1\\z' THEN named_struct(
            'num', CAST(split_part({column}, '/', 1) AS {DEC}), 'den', CAST(1 AS {DEC}),
            'value', CAST(split_part({column}, '/', 1) AS DOUBLE), 'status', 'ok')
        ELSE {general} END"""
    if not lenient:
        return F.expr(parsed)
    return F.expr(f"CASE WHEN coalesce({column}, '') IN ({unknown}) THEN {UNKNOWN} ELSE {parsed} END")


def with_rate(
    df: DataFrame, text: str, out: str, lenient: bool = True, trim: bool = False
) -> DataFrame:
    """Add :func:`parse_rate` of the column ``text`` as ``out``."""
    return evaluate_once(df, {out: parse_rate(text, lenient, trim)})


def rate_text(rate: Column) -> Column:
    """Canonical ``num/den``; NULL unless the rate is usable."""
    return F.when(
        rate["status"] == "ok",
        F.concat(rate["num"].cast("string"), F.lit("/"), rate["den"].cast("string")),
    )


def quotient(a: str, b: str) -> Column:
    """``a / b`` of two rate columns, reduced; unknown unless both are usable."""
    parts = _parts(
        f"try_cast(try_multiply(a.num, b.den) AS {DEC})",
        f"try_cast(try_multiply(a.den, b.num) AS {DEC})",
        "a.value / b.value",
    )
    absent = "NOT coalesce(a.status = 'ok' AND b.status = 'ok', false)"
    return F.expr(_let("a", f"`{a}`", _let("b", f"`{b}`", _reduced(parts, absent))))


def with_quotient(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return evaluate_once(df, {out: quotient(a, b)})
