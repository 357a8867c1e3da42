"""URL filters by a path-template tree per host (operator 9).

Rules judge first: a rule (host, path) fits its host and all subdomains if the
URL's path starts with its own; the longest fitting rule wins. The URLs that rules
judge are the labels from which the rest is judged.

Paths are cut into segments, and numbers and long hex names become wildcards at
once. The tree of a host is then built from the root, down to the ends of its paths.
Segments that all paths of a node share are passed at once, and a node whose paths do
not differ any more is finished. At any other node

* children that are rare among many (below ``RARE`` of the node's URLs where there
  are more than ``FANOUT`` children) become the wildcard branch,
* children whose labels do not differ from their siblings' (chi-square on one degree
  of freedom below ``SIMILAR``) are merged into it too; an only child stays.

A template is a path through the generalised tree. Its purity is its share of
blocked labels, smoothed by ``WEIGHT`` labels at the host's rate, which is smoothed
by as many at the overall rate. Templates of at least ``REJECT`` are blocked.

The tree works on counts of distinct shapes, aggregated before any shuffle, a fork of
each path per round; a URL meets its shape's verdict by an equi join. There are as many
rounds as a path has forks, and a round reads only shapes that are not finished. Rules
are constants of the plan.

Defined results: a NULL URL or one without ``://`` has an empty host and path and is
judged by the template of those; without any labels the overall rate is a half,
which blocks nothing below ``REJECT``; rows that repeat are judged alike. A path that
ends at a node has an empty segment there. A template is written with ``LEVELS``
segments or more. Columns of any name come back as they were; the new ones follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import ascii_lower, stored, wrapped

#: Segments that a template is written with at least; the tree itself has no depth limit.
LEVELS = 4
FANOUT = 16
RARE = 0.02
SIMILAR = 3.84
WEIGHT = 4.0
REJECT = 0.6

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, NULL where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _segments() -> Column:
    """The path's segments, numbers and long hex names generalised."""
    return F.expr(
        r"transform(slice(split(path, '/'), 2, greatest(size(split(path, '/')) - 1, 0)), s -> CASE "
        r"WHEN s RLIKE '^[0-9]+$' THEN '{n}' WHEN s RLIKE '^[0-9]+[.][a-z]+$' THEN concat('{n}.', split(s, '[.]')[1]) "
        r"WHEN s RLIKE '^[0-9a-f-]{16,}$' THEN '{x}' ELSE s END)"
    )


def _similar(n: Column, blocked: Column, all_n: Column, all_blocked: Column) -> Column:
    """Whether a child's labels are like those of its siblings; so if either has none."""
    rest, rest_blocked = all_n - n, all_blocked - blocked
    cross = blocked * (rest - rest_blocked) - (n - blocked) * rest_blocked
    margins = n * rest * all_blocked * (all_n - all_blocked)
    return F.when(margins > 0, all_n * cross * cross / margins < SIMILAR).otherwise(F.lit(True))


def templates(shapes: DataFrame) -> DataFrame:
    """Shapes (host, segs, n, labelled, blocked) with their generalised segments ``g``."""
    counts = ("n", "labelled", "blocked")
    shape = ["host", "segs", *counts]
    node = ["host", "g"]
    going = shapes.select(*shape, F.array().cast("array<string>").alias("g"), F.col("segs").alias("rest"))
    finished = []
    while True:
        # Arrays are ordered by their elements, so what the least and the greatest share, all share.
        open_rest = F.when(F.size("rest") > 0, F.col("rest"))
        ends = going.groupBy(*node).agg(
            F.min(open_rest).alias("low"), F.max(open_rest).alias("high"), F.count(F.when(F.size("rest") == 0, 1)).alias("ended")
        )
        same = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        common = F.when(same == 0, F.size("low")).otherwise(same - 1).cast("int")
        ends = ends.withColumn("common", common).withColumn("blank", F.array_position("low", "") - 1)
        alone = F.col("ended") == 0
        ends = ends.select(
            *node, F.when(alone, F.col("common")).otherwise(0).alias("shared"),
            (F.col("low").isNull() | (alone & F.col("low").eqNullSafe(F.col("high")))).alias("end"),
            # Beside ended paths, shared segments are one fork after the other with the same counts, hence the same
            # answer, up to a segment that is as empty as the ended paths' own.
            F.when(alone, 1).otherwise(
                F.greatest(F.lit(1), F.when(F.col("blank") >= 0, F.least("common", "blank")).otherwise(F.col("common")))
            ).cast("int").alias("alike_levels"),
        )
        passed = going.join(ends, node).select(
            *shape, F.concat("g", F.slice("rest", F.lit(1), F.col("shared"))).alias("g"),
            F.slice("rest", F.col("shared") + 1, F.size("rest")).alias("rest"), "end", "alike_levels",
        )
        passed = stored(passed, "url-nodes")
        finished.append(passed.filter("end").select(*shape, "g"))
        forks = passed.filter("NOT end").drop("end")
        if forks.isEmpty():
            break
        forks = forks.withColumn("child", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        children = forks.groupBy(*node, "child").agg(*[F.sum(c).alias(c) for c in counts])
        nodes = children.groupBy(*node).agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in counts])
        rare = (F.col("children") > FANOUT) & (F.col("n") < F.col("all_n") * RARE)
        alike = _similar(*[F.col(c).cast("double") for c in ("labelled", "blocked", "all_labelled", "all_blocked")])
        named = children.join(nodes, node).select(*node, "child", ((F.col("children") > 1) & (rare | alike)).alias("merged"))
        general = F.when(F.col("merged"), "*").otherwise(F.col("child"))
        levels = F.when(F.col("merged"), F.col("alike_levels")).otherwise(1)
        # The next round reads this twice, so its lineage is cut.
        going = stored(
            forks.join(named, [*node, "child"]).select(
                *shape, F.concat("g", F.array_repeat(general, levels)).alias("g"),
                F.slice("rest", levels + 1, F.size("rest")).alias("rest"),
            ),
            "url-tree",
        )
    tree = finished[0]
    for part in finished[1:]:
        tree = tree.unionByName(part)
    blank = F.array_repeat(F.lit(""), F.greatest(F.lit(LEVELS) - F.size("g"), F.lit(0)))
    return stored(tree.withColumn("g", F.concat("g", blank)), "url-templates")


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with ``u_host, u_path, u_rule, u_template, u_purity, u_verdict``.

    A name that ``pages`` has already is followed by ``_``.
    """
    host, path = split_url(F.col(f"`{url_col}`"))
    parsed = wrapped(pages, host=host, path=path)
    rule, verdict = fitting_rule(rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"), _segments().alias("segs"))
    shape = ["host", "segs"]
    shapes = parsed.groupBy(*shape).agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
    )
    shapes = stored(shapes, "url-shapes")
    tree = templates(shapes)
    name = ["host", "g"]
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    per_template = tree.groupBy(*name).agg(*sums)
    per_host = per_template.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("blocked").alias("h_blocked"))
    seen = shapes.agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")).first()
    overall = ((seen["blocked"] or 0) + 1.0) / ((seen["labelled"] or 0) + 2.0)
    rated = per_template.join(per_host, "host")
    host_rate = (F.col("h_blocked") + WEIGHT * F.lit(overall)) / (F.col("h_labelled") + WEIGHT)
    purity = (F.col("blocked") + WEIGHT * host_rate) / (F.col("labelled") + WEIGHT)
    rated = rated.select(*name, purity.alias("purity"))
    verdicts = tree.join(rated, name).select(
        *shape, F.concat_ws("/", *name).alias("template"), "purity"
    )
    judged = parsed.join(verdicts, shape)
    own = {
        "u_host": F.col("host"), "u_path": F.col("path"), "u_rule": F.col("rule"), "u_template": F.col("template"),
        "u_purity": F.col("purity"),
        "u_verdict": F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")),
    }
    # Columns are told apart without regard to case; a given one keeps its name and ours gets a longer one.
    taken = {c.lower() for c in pages.columns}
    named = []
    for c, value in own.items():
        while c in taken:
            c = f"{c}_"
        named.append(value.alias(c))
    return judged.select("row.*", *named)
