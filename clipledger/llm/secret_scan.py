"""Secret scans with a trigram inverted index (operator 6).

From each rule's regular expression a Boolean trigram query is derived: a
conjunction of clauses, each an alternative of trigram sets that any match must
contain. Postings (trigram, document) are kept for the trigrams that queries ask
for; a query is answered by counting a document's postings per alternative. Only
its candidates are verified with the expression. Rules without mandatory trigrams
are verified on all documents.

Postings and candidates are narrow. Candidates meet the texts by a broadcast while
their measured bytes stay below ``max_broadcast_bytes``, else by a shuffle.

A rule's matches are leftmost and do not overlap those of the same rule. Matches
whose measured group is too short are dropped after matching. Positions count
code points; ends are exclusive.

Defined results: a NULL text is empty and has no matches; rows that repeat are
scanned alike; letters that a rule takes in either case are ASCII letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import stored, text_or_empty, with_running_starts

MAX_BROADCAST_BYTES = 32 << 20
#: Most literal strings followed at a time while a query is derived.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group that is measured
    least: int = 0  # its least length
    base: bool = False


# Kinds, patterns and lengths.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # runs are matched whole, so the least length can be asked for at once
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/@]{3,64}@"),
)

Clause = frozenset[frozenset[str]]


def trigram_query(pattern: str) -> tuple[Clause, ...]:
    """Clauses that all hold for any text with a match; each holds if one of its sets is contained."""
    clauses: list[Clause] = []
    strings = _follow(regex_parser.parse(pattern), {""}, clauses)
    _close(strings, clauses)
    return tuple(dict.fromkeys(clauses))


def _close(strings: set[str], clauses: list[Clause]) -> set[str]:
    """What was followed so far becomes a clause; the next string starts afresh."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if all(sets):
        clauses.append(frozenset(a for a in sets if not any(b < a for b in sets)))
    return {""}


def _follow(items, strings: set[str], clauses: list[Clause]) -> set[str]:
    """All lower-cased literal strings that ``items`` can append; closes a clause where they are too many."""
    for op, arg in items:
        name = str(op)
        options = _exact(name, arg)
        if options is not None and len(options) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, options)}
        elif name == "SUBPATTERN":
            strings = _follow(arg[3], strings, clauses)
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            _close(_follow(arg[2], strings, clauses), clauses)
            strings = {""}
        elif name != "AT":
            strings = _close(strings, clauses)
    return strings


def _exact(name: str, arg) -> set[str] | None:
    """The strings an item stands for, if they are few."""
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(c).lower() for _, c in arg}
        return None
    if name == "SUBPATTERN":
        return _exact_all(arg[3])
    if name == "BRANCH":
        found = [_exact_all(b) for b in arg[1]]
        return None if None in found else set().union(*found)
    if name == "MAX_REPEAT" and tuple(arg[:2]) == (0, 1):
        found = _exact_all(arg[2])
        return None if found is None else {"", *found}
    return None


def _exact_all(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = _exact(str(op), arg)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """``trigram, id, h``: the documents that contain each trigram, letters in either case."""
    low = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"), F.lower(text_or_empty(text_col)).alias("t")
    )
    found = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select("id", "h", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """``id, h, rules``: numbers of the rules whose queries a document answers."""
    asked = [
        (r, c, a, g, len(alt), len(queries))
        for r, rule in enumerate(rules)
        for queries in [trigram_query(rule.pattern)]
        for c, clause in enumerate(queries)
        for a, alt in enumerate(sorted(clause, key=sorted))
        for g in sorted(alt)
    ]
    spark = docs.sparkSession
    rows = ", ".join(f"({r}, {c}, {a}, '{_quoted(g)}', {n}, {m})" for r, c, a, g, n, m in asked)
    wanted = spark.sql(f"SELECT * FROM VALUES {rows} AS q(rule, clause, alt, trigram, trigrams, clauses)")
    index = postings(docs, sorted({g for *_, g, _, _ in asked}), id_col, text_col).distinct()
    met = (
        index.join(F.broadcast(wanted), "trigram")  # as large as the rules
        .groupBy("id", "h", "rule", "clause", "alt", "trigrams", "clauses")
        .agg(F.count("*").alias("n"))
        .filter("n = trigrams")
    )
    return (
        met.groupBy("id", "h", "rule", "clauses")
        .agg(F.count_distinct("clause").alias("n"))
        .filter("n = clauses")
        .groupBy("id", "h")
        .agg(F.collect_list("rule").alias("rules"))
    )


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def _with_spans(rows: DataFrame, rules: tuple[Rule, ...], asked: list[Column]) -> DataFrame:
    """Adds ``spans``: matches in ``t`` as structs of start, rule number and end, where a rule is asked for."""
    for k, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        ask = asked[k] & F.regexp_like("t", pattern)
        none = F.expr("CAST(array() AS array<string>)")
        rows = rows.withColumn(f"m{k}", F.when(ask, F.regexp_extract_all("t", pattern, F.lit(0))).otherwise(none))
    for k, rule in enumerate(rules):
        some = F.size(f"m{k}") > 0
        pattern = F.lit(rule.pattern)
        # What stands between matches; the last piece follows the last match.
        gaps = F.slice(F.split("t", pattern, F.lit(-1)), 1, F.size(f"m{k}"))
        measured = F.regexp_extract_all("t", pattern, F.lit(rule.group)) if rule.group else F.col(f"m{k}")
        rows = rows.withColumn(
            f"step{k}",
            F.when(some, F.zip_with(gaps, f"m{k}", lambda g, m: (F.length(g) + F.length(m)).cast("long"))).otherwise(
                F.expr("CAST(array() AS array<bigint>)")
            ),
        ).withColumn(f"g{k}", F.when(some, measured).otherwise(F.col(f"m{k}")))
    rows = with_running_starts(rows, {f"step{k}": f"at{k}" for k in range(len(rules))})
    spans = []
    for k, rule in enumerate(rules):
        kept = F.expr(
            f"transform(filter(arrays_zip(m{k}, g{k}, step{k}, at{k}), x -> length(x.g{k}) >= {rule.least}), "
            f"x -> struct(x.at{k} + x.step{k} - length(x.m{k}) AS start, {k} AS rule, x.at{k} + x.step{k} AS stop))"
        )
        spans.append(kept)
    return rows.withColumn("spans", F.array_sort(F.concat(*spans)))


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Every row of ``docs`` as ``id, spans``: structs of start, rule number and end, in that order."""
    indexed = [k for k, r in enumerate(rules) if trigram_query(r.pattern)]
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    if indexed:
        found = stored(candidates(docs, rules, id_col, text_col), "secret-candidates")
        rows_found = found.count()
        found = found.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("rules").alias("_rules"))
        if rows_found * (32 + 4 * len(rules)) <= max_broadcast_bytes:
            found = F.broadcast(found)
        on = F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("t") == F.col("_h"))
        rows = rows.join(found, on, "left")
    asked = [F.coalesce(F.array_contains("_rules", k), F.lit(False)) if k in indexed else F.lit(True) for k in range(len(rules))]
    return _with_spans(rows, rules, asked).select("id", "spans")


def named(spans: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {kinds}[s.rule], s.start, s.stop)), ',')")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", **how) -> DataFrame:
    """``doc_id``, a count per base kind, a digest of the base spans, and all spans."""
    base = [k for k, r in enumerate(rules) if r.base]
    found = scan(docs, rules, id_col, **how).withColumn(
        "base", F.expr(f"filter(spans, s -> s.rule IN ({', '.join(map(str, base))}))")
    )
    return found.select(
        F.col("id").alias(id_col),
        *[F.expr(f"CAST(size(filter(base, s -> s.rule = {k})) AS bigint)").alias(f"n_{rules[k].kind}") for k in base],
        F.sha2(named("base", rules), 256).alias("base_sha256"),
        named("spans", rules).alias("spans"),
    )
