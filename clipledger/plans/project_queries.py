"""Queries over the row-level operators."""

from pyspark.sql import functions as F

from clipledger.functions.keys import micros
from clipledger.functions.rational import with_rate
from clipledger.functions.text import clip
from clipledger.operators import project as P
from clipledger.plans.tables import Registry, table

REG = Registry()


@REG.add(
    "classify_events",
    """
    SELECT event_id,
           CASE WHEN event_type = 'view' AND CAST(json_extract(props, '$.k') AS BIGINT) = 7 THEN 'flagged'
                WHEN event_type IN ('click', 'view') THEN 'interactive'
                WHEN event_type = 'signup' THEN 'lifecycle'
                WHEN event_type = 'purchase' THEN 'commerce'
                ELSE 'other' END AS class
    FROM events
    """,
)
def classify_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.get_json_object("props", "$.k").alias("tag")
    )
    out = P.classify(
        events,
        "event_type",
        "tag",
        overrides=[("view", "7", "flagged")],
        classes={"interactive": ["click", "view"], "lifecycle": ["signup"], "commerce": ["purchase"]},
    )
    return out.select("event_id", "class")


_PART_RULES = [
    (r"^(red|blue|green)\b", "coloured"),
    (r"(ring|gear)$", "round"),
    (r"^[a-z]{3,4} ", "short"),
    (r"^(?:small|large)", "sized"),
]


_PARTS_SQL = r"""
    SELECT p_partkey,
           CASE WHEN regexp_matches(lower(trim(p_name)), '^(red|blue|green)\b') THEN 'coloured'
                WHEN regexp_matches(lower(trim(p_name)), '(ring|gear)$') THEN 'round'
                WHEN regexp_matches(lower(trim(p_name)), '^[a-z]{3,4} ') THEN 'short'
                WHEN regexp_matches(lower(trim(p_name)), '^(?:small|large)') THEN 'sized' END AS class
    FROM part
"""


@REG.add("classify_parts", _PARTS_SQL)
def classify_parts(spark, sf_dir):
    return P.classify_by_pattern(table(spark, sf_dir, "part"), "p_name", _PART_RULES).select("p_partkey", "class")


@REG.add("classify_parts_by_table", _PARTS_SQL)
def classify_parts_by_table(spark, sf_dir):
    rules = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(_PART_RULES)], "rule int, pattern string, class string")
    return P.classify_by_rules(table(spark, sf_dir, "part"), "p_name", rules).select("p_partkey", "class")


@REG.add(
    "parse_ratio",
    """
    SELECT 'ok' AS status, l_linenumber // gcd(l_linenumber, q) AS num, q // gcd(l_linenumber, q) AS den,
           round(l_linenumber / q, 9) AS value, count(*) AS n
    FROM (SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
    GROUP BY ALL
    """,
)
def parse_ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_linenumber"), F.lit("/"), F.col("l_quantity").cast("long")).alias("t")
    )
    # Rate texts repeat a lot: count equal texts first, parse each text once.
    texts = lines.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    # The status stays a column: a filter on it would be pushed below the counting.
    rated = with_rate(texts, "t", "r")
    return rated.groupBy(
        F.col("r.status").alias("status"),
        F.col("r.num").cast("long").alias("num"),
        F.col("r.den").cast("long").alias("den"),
        F.round("r.value", 9).alias("value"),
    ).agg(F.sum("n").alias("n"))


@REG.add(
    "impeach_balance",
    """
    WITH claims AS (
      SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal END AS a,
             c_acctbal / 2 AS b FROM customer)
    SELECT c_custkey,
           coalesce(CASE WHEN NOT isnan(a) AND a > 0 AND a <= 5000 THEN a END,
                    CASE WHEN NOT isnan(b) AND b > 0 AND b <= 4500 THEN b END) AS balance
    FROM (SELECT c_custkey, a, CASE WHEN b <= 4500 THEN b END AS b FROM claims)
    """,
)
def impeach_balance(spark, sf_dir):
    bal = F.col("c_acctbal")
    claims = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") == 3, F.lit(float("nan"))).otherwise(bal).alias("a"),
        F.when(bal / 2 <= 4500, bal / 2).alias("b"),
    )
    return P.impeach_range(claims, ["a", "b"], "balance", 0.0, 5000.0).select("c_custkey", "balance")


def _user_claims(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return (
        events.select("user_id", micros(events, "ts").alias("us"))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("span"))
    )


_USER_CLAIMS_SQL = """
    claims AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span
               FROM events GROUP BY user_id)
"""


@REG.add(
    "corroborate_rate",
    f"""
    WITH {_USER_CLAIMS_SQL},
    rates AS (SELECT *, n / 2592000.0 AS a, CASE WHEN span > 0 THEN n * 0.97 / span END AS b FROM claims)
    SELECT user_id, round(1e6 * coalesce(
      CASE WHEN NOT (span > 0) OR abs(n / a - span) <= greatest(0.01, 2.5 / a) THEN a END,
      CASE WHEN NOT (span > 0) OR abs(n / b - span) <= greatest(0.01, 2.5 / b) THEN b END), 6) AS rate
    FROM rates
    """,
)
def corroborate_rate(spark, sf_dir):
    claims = _user_claims(spark, sf_dir).withColumns(
        {"a": F.col("n") / 2592000.0, "b": F.when(F.col("span") > 0, F.col("n") * 0.97 / F.col("span"))}
    )
    out = P.select_corroborated(claims, ["a", "b"], "n", "span")
    return out.select("user_id", F.round(F.col("rate") * 1e6, 6).alias("rate"))


@REG.add(
    "needs_measurement",
    """
    WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey, CAST(floor(o_totalprice / 100000) AS BIGINT) AS claimed, n / 2.0 AS span,
                 o_orderstatus IN ('F', 'O') AS trusted,
                 o_orderpriority IN ('1-URGENT', '2-HIGH') AS checked
          FROM orders LEFT JOIN f ON o_orderkey = l_orderkey)
    SELECT o_orderkey,
           NOT (trusted AND claimed > 0)
           OR (checked AND (span IS NULL OR floor(2.0 * span + 0.5) <> claimed)) AS needs_measurement
    FROM c
    """,
)
def needs_measurement(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        table(spark, sf_dir, "orders")
        .join(facts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            "o_orderkey", "o_orderstatus", "o_orderpriority",
            F.floor(F.col("o_totalprice") / 100000).cast("long").alias("claimed"),
            F.lit(2.0).alias("rate"),
            (F.col("n") / 2.0).alias("span"),
        )
    )
    return P.needs_measurement(
        rows, "claimed", "rate", "span",
        trusted=F.col("o_orderstatus").isin("F", "O"),
        checked=F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
    ).select("o_orderkey", "needs_measurement")


@REG.add(
    "expected_timing",
    """
    WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1),
    s AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 1 END AS up,
                 CASE user_id % 3 WHEN 2 THEN 10000 ELSE 1 END AS down FROM u),
    t AS (SELECT *, n * up AS a, days * down AS b, (n * up) / (days * down) AS v FROM s)
    SELECT user_id, a // gcd(a, b) AS target_num, b // gcd(a, b) AS target_den,
           CASE WHEN v BETWEEN 1 AND 2000 THEN round(n / v, 6) END AS expected_span,
           CASE WHEN v > 2000 THEN 'target rate too high' WHEN v < 1 THEN 'target rate too low' END AS timing_error
    FROM t
    """,
)
def expected_timing(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days")
    )
    bucket = F.col("user_id") % 3
    rows = users.withColumns(
        {
            "rate_text": F.concat(F.col("n"), F.lit("/"), F.col("days")),
            "scale_text": F.when(bucket == 0, "0.1").when(bucket == 1, "1/2").otherwise("1e4"),
            "span": F.col("days").cast("double"),
        }
    )
    rows = with_rate(with_rate(rows, "rate_text", "rate"), "scale_text", "scale", lenient=False)
    out = P.expected_timing(rows, "rate", "n", "span", "scale")
    return out.select(
        "user_id",
        F.col("target_rate.num").cast("long").alias("target_num"),
        F.col("target_rate.den").cast("long").alias("target_den"),
        F.round("expected_span", 6).alias("expected_span"),
        "timing_error",
    )


_REF_SQL = f"""
    WITH {_USER_CLAIMS_SQL},
    c AS (SELECT user_id, n, CASE WHEN n % 3 <> 0 THEN span END AS span,
                 CASE WHEN n % 2 = 0 THEN n / 2400000.0 END AS rate,
                 CASE WHEN n % 5 < 3 THEN n / 2500000.0 END AS imp FROM claims)
"""


def _reference_claims(spark, sf_dir):
    n = F.col("n")
    return _user_claims(spark, sf_dir).withColumns(
        {
            "span": F.when(n % 3 != 0, F.col("span")),
            "rate": F.when(n % 2 == 0, n / 2400000.0),
            "imp": F.when(n % 5 < 3, n / 2500000.0),
        }
    )


@REG.add(
    "timing_reference",
    _REF_SQL
    + """
    SELECT user_id, round(least(n / rate, CASE WHEN span > 0 THEN span END, n / imp), 3) AS reference_span FROM c
    """,
)
def timing_reference(spark, sf_dir):
    out = P.timing_reference(_reference_claims(spark, sf_dir), "rate", "span", "imp", "n")
    return out.select("user_id", F.round("reference_span", 3).alias("reference_span"))


@REG.add(
    "rebuild_rate",
    _REF_SQL
    + """
    SELECT user_id, round(coalesce(
        CASE WHEN n > 1 AND span > 0 AND n / (span / 86400) BETWEEN 1 AND 2000 THEN n / (span / 86400) END,
        CASE WHEN n > 1 AND n % 4 < 2 AND imp * 86400 BETWEEN 1 AND 2000 THEN imp * 86400 END), 6) AS rebuild_rate
    FROM c
    """,
)
def rebuild_rate(spark, sf_dir):
    rows = _reference_claims(spark, sf_dir).withColumns(
        {
            "target": F.lit(None).cast("double"),
            "days": F.col("span") / 86400,
            "claim": F.col("imp") * 86400,
            "broken": F.col("n") % 4 < 2,
        }
    )
    out = P.rebuild_rate(rows, "target", "n", "days", "claim", "broken")
    return out.select("user_id", F.round("rebuild_rate", 6).alias("rebuild_rate"))


@REG.add(
    "rule_violations",
    """
    SELECT concat_ws('; ',
             CASE WHEN l_discount > 0.085 THEN 'discount too high' END,
             CASE WHEN l_quantity > 45 THEN 'bulk of ' || l_returnflag END,
             CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'returned but open' END,
             CASE WHEN l_tax < 0.005 THEN 'no tax' END) AS problems,
           count(*) AS n
    FROM lineitem GROUP BY ALL
    """,
)
def rule_violations(spark, sf_dir):
    rules = [
        (F.col("l_discount") > 0.085, "discount too high"),
        (F.col("l_quantity") > 45, F.concat(F.lit("bulk of "), F.col("l_returnflag"))),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "returned but open"),
        (F.col("l_tax") < 0.005, "no tax"),
    ]
    out = P.rule_violations(table(spark, sf_dir, "lineitem"), rules)
    return out.groupBy(F.array_join("problems", "; ").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@REG.add(
    "route_orders",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'skipped'
                WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 THEN 'run'
                WHEN o_orderstatus <> 'F' THEN 'run' ELSE 'unroutable' END AS status,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'keep original'
                WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 THEN 'express'
                WHEN o_orderstatus <> 'F' THEN 'standard' END AS backend,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'nothing to gain'
                WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 THEN NULL
                WHEN o_orderstatus <> 'F' THEN NULL
                WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN
                  'express: not urgent; standard: already final; bulk: not available'
                ELSE 'express: too small; standard: already final; bulk: not available' END AS reason
    FROM orders
    """,
)
def route_orders(spark, sf_dir):
    caps = P.Capabilities(has_prores=True, has_prores_gpu=False)
    orders = table(spark, sf_dir, "orders")
    out = P.route(
        orders,
        [((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "keep original", "nothing to gain")],
        [
            (
                "express",
                [
                    (F.lit(caps.has_prores), "not available"),
                    (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "not urgent"),
                    (F.col("o_totalprice") > 100000, "too small"),
                ],
            ),
            ("standard", [(F.col("o_orderstatus") != "F", "already final")]),
            ("bulk", [(F.lit(caps.has_prores_gpu), "not available")]),
        ],
    )
    return out.select("o_orderkey", "status", "backend", "reason")


_INJECTED_SQL = (
    "chr(27) || '[31m' || substr(text, 1, 40) || chr(27) || ']0;own' || chr(7) || substr(text, 41) "
    "|| chr(27) || '[0' || chr(0) || 'm' || chr(13) || source || chr(27)"
)


@REG.add(
    "sanitize_docs",
    rf"""
    WITH c AS (
      SELECT doc_id, regexp_replace(regexp_replace({_INJECTED_SQL},
        '(\x1b\[[^\x40-\x7e]*([\x40-\x7e]|\z))|(\x1b\][^\x07]*?(\x07|\x1b\\|\z))', '', 'g'),
        '[^\n \p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}]', '', 'g') AS clean FROM documents)
    SELECT doc_id, sha256(clean) AS digest, length(clean) AS n,
           CASE WHEN length(clean) <= 40 THEN replace(clean, chr(10), ' ')
                ELSE replace(substr(clean, 1, 37), chr(10), ' ') || '...' END AS title
    FROM c
    """,
)
def sanitize_docs(spark, sf_dir):
    text, esc = F.col("text"), F.char(F.lit(27))
    raw = F.concat(
        esc, F.lit("[31m"), F.substring(text, 1, 40), esc, F.lit("]0;own"), F.char(F.lit(7)),
        F.substring(text, F.lit(41), F.length(text)), esc, F.lit("[0"), F.char(F.lit(0)), F.lit("m"),
        F.char(F.lit(13)), F.col("source"), esc,
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    out = P.sanitize_text(docs, "raw", "clean")
    line = F.replace(F.col("clean"), F.lit("\n"), F.lit(" "))  # clean text needs no second cleaning
    return out.select(
        "doc_id", F.sha2("clean", 256).alias("digest"), F.length("clean").cast("long").alias("n"), clip(line, 40).alias("title")
    )


@REG.add(
    "exclude_generated",
    r"""
    SELECT p_partkey, name FROM (
      SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_size % 5
        WHEN 0 THEN '_prores_LT.mov' WHEN 1 THEN '_xvid_compact_' || p_size || '.AVI'
        WHEN 2 THEN '_prores_lt.avi' WHEN 3 THEN '_xvid_max_q2_x' || p_size || '.avi' ELSE '.mp4' END AS name
      FROM part)
    WHERE NOT regexp_matches(lower(name),
      '(_(xvid_compact|xvid_max_q2|xvid_efficient_q2|xvid_small|xvid_max|magicyuv_lossless|utvideo_lossless)(_[0-9]+)?\.avi|_(prores_lt|prores_422|prores_hq|prores_4444)(_[0-9]+)?\.mov)$')
    """,
)
def exclude_generated(spark, sf_dir):
    size = F.col("p_size")
    ending = (
        F.when(size % 5 == 0, F.lit("_prores_LT.mov"))
        .when(size % 5 == 1, F.concat(F.lit("_xvid_compact_"), size, F.lit(".AVI")))
        .when(size % 5 == 2, F.lit("_prores_lt.avi"))
        .when(size % 5 == 3, F.concat(F.lit("_xvid_max_q2_x"), size, F.lit(".avi")))
        .otherwise(F.lit(".mp4"))
    )
    names = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), ending).alias("name")
    )
    return P.exclude_generated(names, "name")


@REG.add(
    "exclude_generated_by_table",
    """
    WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'mov' ELSE 'avi' END AS ext FROM customer WHERE c_custkey % 3 = 0),
    n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'mov' ELSE 'avi' END AS ext,
                 CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_' || o_orderkey ELSE '_x' || o_orderkey END AS tail FROM orders)
    SELECT o_orderkey, 'Clip_customer_' || o_custkey || tail || '.' || upper(n.ext) AS name
    FROM n LEFT JOIN t ON t.c_custkey = n.o_custkey AND t.ext = n.ext
    WHERE t.c_custkey IS NULL OR o_orderkey % 3 = 2
    """,
)
def exclude_generated_by_table(spark, sf_dir):
    kind = lambda c: F.when(F.col(c) % 2 == 0, "mov").otherwise("avi")
    tokens = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(
        F.concat(F.lit("customer_"), "c_custkey").alias("token"), kind("c_custkey").alias("ext")
    )
    key = F.col("o_orderkey")
    tail = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("_"), key)).otherwise(F.concat(F.lit("_x"), key))
    names = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Clip_customer_"), "o_custkey", tail, F.lit("."), F.upper(kind("o_orderkey"))).alias("name")
    )
    return P.exclude_generated_by(names, "name", tokens)


@REG.add(
    "allowlist_segments",
    """
    SELECT c_custkey, CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN c_mktsegment END AS c_mktsegment
    FROM customer
    """,
)
def allowlist_segments(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return P.allowlist_or_null(customers, {"c_mktsegment": ["building", "machinery"]})


@REG.add(
    "long_rates",
    """
    SELECT rate_text, CAST(split_part(rate_text, '/', 1) AS DOUBLE) / CAST(coalesce(nullif(split_part(rate_text, '/', 2), ''), '1') AS DOUBLE)
             AS value, 'unsupported_precision' AS status, count(*) AS n
    FROM (SELECT CASE user_id % 3 WHEN 0 THEN '0.' || repeat('0', 40) || (user_id % 9 + 1)
                                  WHEN 1 THEN '1' || repeat('0', 45) || '.5' ELSE '7/' || repeat('9', 44) END AS rate_text
          FROM events)
    GROUP BY ALL
    """,
)
def long_rates(spark, sf_dir):
    """Rates whose exact pair has no decimal keep their double."""
    user = F.col("user_id")
    text = (
        F.when(user % 3 == 0, F.concat(F.lit("0." + "0" * 40), user % 9 + 1))
        .when(user % 3 == 1, F.lit("1" + "0" * 45 + ".5"))
        .otherwise("7/" + "9" * 44)
    )
    texts = table(spark, sf_dir, "events").groupBy(text.alias("rate_text")).agg(F.count(F.lit(1)).alias("n"))
    rates = P.with_rate(texts, "rate_text", "rate")
    return rates.select("rate_text", F.col("rate.value").alias("value"), F.col("rate.status").alias("status"), "n")


@REG.add(
    "normalize_alias",
    """
    SELECT o_orderkey,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'urgent'
                WHEN '3-MEDIUM' THEN 'normal' WHEN '5-LOW' THEN 'low' END AS canonical,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown name:  ' || chr(9) || '4-NOT SPECIFIED' || chr(10) END AS alias_error
    FROM orders
    """,
)
def normalize_alias(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("\n")).alias("raw")
    )
    aliases = {"1-urgent": "urgent", "2-high": "urgent", "3-medium": "normal", "5-low": "low"}
    return P.normalize_alias(rows, "raw", aliases).drop("raw")


@REG.add(
    "rule_table_classes",
    """
    SELECT e.event_id, coalesce(p.r_name, b.r_name, 'other') AS class
    FROM (SELECT event_id, user_id % 5 AS code, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS tag FROM events) e
    LEFT JOIN region p ON e.code = p.r_regionkey AND e.tag = p.r_regionkey AND p.r_regionkey < 3
    LEFT JOIN region b ON e.code = (b.r_regionkey + 1) AND b.r_regionkey >= 3
    """,
)
def rule_table_classes(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    key = F.col("r_regionkey")
    rules = region.select(
        F.when(key < 3, key).otherwise(key + 1).cast("string").alias("code"),
        F.when(key < 3, key).cast("string").alias("tag"),
        F.col("r_name").alias("class"),
    )
    events = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 5).cast("string").alias("code"),
        (F.get_json_object("props", "$.k").cast("long") % 7).cast("string").alias("tag"),
    )
    return P.classify_from(events, rules, "code", "tag").select("event_id", "class")


@REG.add(
    "preset_labels",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'xvid_max_q2' WHEN 1 THEN 'xvid_efficient_q2' WHEN 2 THEN 'prores_4444' END AS canonical,
           CASE o_orderkey % 4 WHEN 0 THEN 'Share / Xvid Q2' WHEN 1 THEN 'Xvid Q2 Efficient' WHEN 2 THEN 'ProRes 4444' END AS label
    FROM orders
    """,
)
def preset_labels(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    given = F.when(kind == 0, " Share").when(kind == 1, "XVID-Efficient ").when(kind == 2, "ProRes-4444").otherwise("something else")
    named = P.normalize_alias(table(spark, sf_dir, "orders").select("o_orderkey", given.alias("given")), "given")
    return P.with_label(named, "canonical").select("o_orderkey", "canonical", "label")


@REG.add(
    "prores_layouts",
    """
    SELECT p_partkey, CASE WHEN p_size > 25 AND p_partkey % 3 = 0 THEN 'yuva444p12le' WHEN p_size > 25 THEN 'yuv444p12le'
                           WHEN p_partkey % 3 = 0 THEN 'yuva444p10le' ELSE 'yuv444p10le' END AS layout, 'yuv422p10le' AS other
    FROM part
    """,
)
def prores_layouts(spark, sf_dir):
    deep, alpha = F.when(F.col("p_size") > 25, 10).otherwise(8), F.col("p_partkey") % 3 == 0
    return table(spark, sf_dir, "part").select(
        "p_partkey", P.prores_layout(deep, alpha, "prores_4444").alias("layout"), P.prores_layout(deep, alpha, "prores_hq").alias("other")
    )
