"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.llm import (
    decontam, divergence, embedding_dedup, exact_dedup, jaccard_join, lexical_search, mixing, secret_scan, sharding,
    suffix_dedup, token_output, toxicity, url_filter,
)
from clipledger.llm.common import stored, table
from clipledger.plans.tables import Registry

REG = Registry()

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), k AS (
  SELECT *, length(bin(size)) AS digits,
         CASE WHEN length(bin(size)) > 4 THEN size >> (length(bin(size)) - 4)
              ELSE size << (4 - length(bin(size))) END AS top
  FROM d
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY digits * 16 + top, substr(key, 1, 3), key, size, doc_id) AS rnk
  FROM k
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
              ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (
              ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), max(level) OVER () * weight) AS target,
         CAST(('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 4)) AS INTEGER) / 65536 AS u
  FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate * rnk + u) - floor(rate * (rnk - 1) + u)) AS BIGINT) AS taken
FROM ranked JOIN r ON ranked.source IS NOT DISTINCT FROM r.source
"""


@REG.add("op1_mix_sources", _MIX_SQL)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.with_copies(stored(docs, "mix-sizes"), size=F.col("size"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_CONTAM_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS gram FROM i
), lengths AS (
  SELECT DISTINCT n FROM g
), p AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, p.s, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND array_to_string(list_slice(p.w, p.s, p.s + p.n - 1), ' ') = g.gram
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@REG.add("op2_decontaminate", _CONTAM_SQL)
def op2(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


@REG.add("op3_exact_dedup", _EXACT_SQL)
def op3(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@REG.add("op4_toxicity_chain")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    scored = toxicity.classify(docs.select("doc_id", "text"), chain)
    return scored.select("row.doc_id", F.col("scores")[0].alias("low_quality"), F.col("scores")[1].alias("toxicity"), "toxic")


@REG.add("op5_suffix_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def _secret_sql():
    """Matches and what stands between them, by rule; positions are sums of their lengths."""
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS m, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM d"
        )
    base = [r.kind for r in secret_scan.RULES if r.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in base)
    listed = ", ".join(f"'{b}'" for b in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r WHERE len(m) > 0),
s AS (
  SELECT doc_id, k, kind, length(m[i]) AS size,
         list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x)))
         + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS start
  FROM e WHERE length(g[i]) >= least
), n AS (
  SELECT doc_id, {counts},
         string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, k) AS spans,
         string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, k) FILTER (kind IN ({listed})) AS base
  FROM (SELECT doc_id, k, kind, size, CAST(start AS BIGINT) AS start FROM s) GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in base)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (doc_id)
"""


@REG.add("op6_secret_scan", _secret_sql())
def op6(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


@REG.add("op7_kd_shards")
def op7(spark, sf_dir):
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@REG.add("op8_jaccard_join")
def op8(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def _url_sql():
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    ruled = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    n = url_filter.LEVELS
    segs = [f"coalesce(t[{k}], '') AS s{k}" for k in range(1, n)] + [f"array_to_string(list_slice(t, {n}, len(t)), '/') AS s{n}"]
    shape = ", ".join(["host", *[f"s{k}" for k in range(1, n + 1)]])
    levels, last = [], "shapes"
    for k in range(1, n + 1):
        node = ", ".join(["host", *[f"g{j}" for j in range(1, k)]])
        levels.append(f"""
c{k} AS (
  SELECT {node}, s{k}, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(labelled) AS DOUBLE) AS a, CAST(sum(blocked) AS DOUBLE) AS b
  FROM {last} GROUP BY {node}, s{k}
), w{k} AS (
  SELECT *, count(*) OVER p AS children, sum(n) OVER p AS all_n, sum(a) OVER p AS all_a, sum(b) OVER p AS all_b
  FROM c{k} WINDOW p AS (PARTITION BY {node})
), x{k} AS (
  SELECT *, b * ((all_a - a) - (all_b - b)) - (a - b) * (all_b - b) AS crossed, a * (all_a - a) * all_b * (all_a - all_b) AS margins
  FROM w{k}
), l{k} AS (
  SELECT {", ".join(f"{last}.{c}" for c in [*shape.split(", "), "n", "labelled", "blocked", *[f"g{j}" for j in range(1, k)]])},
         CASE WHEN children = 1 THEN {last}.s{k}
              WHEN (children > {url_filter.FANOUT} AND x{k}.n < all_n * {url_filter.RARE})
                OR CASE WHEN margins > 0 THEN all_a * crossed * crossed / margins < {url_filter.SIMILAR} ELSE true END THEN '*'
              ELSE {last}.s{k} END AS g{k}
  FROM {last} JOIN x{k} USING ({node}, s{k})
)""")
        last = f"l{k}"
    name = ", ".join(["host", *[f"g{k}" for k in range(1, n + 1)]])
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled,
         list_transform(list_slice(string_split(path, '/'), 2, len(string_split(path, '/'))), lambda s: CASE
           WHEN regexp_full_match(s, '[0-9]+') THEN '{{n}}'
           WHEN regexp_full_match(s, '[0-9]+[.][a-z]+') THEN '{{n}}.' || string_split(s, '.')[2]
           WHEN regexp_full_match(s, '[0-9a-f-]{{16,}}') THEN '{{x}}' ELSE s END) AS t
  FROM h
), q AS (SELECT *, {", ".join(segs)} FROM j),
shapes AS (
  SELECT {shape}, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM q GROUP BY {shape}
),{",".join(levels)},
t AS (
  SELECT {name}, CAST(sum(labelled) AS DOUBLE) AS a, CAST(sum(blocked) AS DOUBLE) AS b FROM {last} GROUP BY {name}
), hs AS (
  SELECT host, sum(a) AS ha, sum(b) AS hb FROM t GROUP BY host
), o AS (
  SELECT (sum(b) + 1.0::DOUBLE) / (sum(a) + 2.0::DOUBLE) AS overall FROM t
), p AS (
  SELECT {", ".join(f"t.{c}" for c in name.split(", "))},
         (b + 4.0::DOUBLE * ((hb + 4.0::DOUBLE * overall) / (ha + 4.0::DOUBLE))) / (a + 4.0::DOUBLE) AS purity
  FROM t JOIN hs USING (host), o
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN purity >= {url_filter.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       concat_ws('/', {name}) AS template, purity
FROM q JOIN {last} USING ({shape}) JOIN p USING ({name})
"""


@REG.add("op9_url_templates", _url_sql())
def op9(spark, sf_dir):
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(
        "page_id", F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("u_rule").alias("rule"),
        F.col("u_verdict").alias("verdict"), F.col("u_template").alias("template"), F.col("u_purity").alias("purity"),
    )


#: A public vocabulary, read from where it is installed.
VOCABULARY = "byte_bpe_50k.json"


@REG.add("op10_token_output")
def op10(spark, sf_dir):
    import public_tokenizers

    return token_output.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


_NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), s AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v
  WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
  WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""


@REG.add("op11_embedding_dedup", _NEAR_SQL)
def op11(spark, sf_dir):
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RANK_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), s AS (
  SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, n, term
), f AS (
  SELECT term, count(*) AS df FROM p GROUP BY term
), b AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), w AS (
  SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM b JOIN f USING (term), s
), r AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN p USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""


@REG.add("op12_lexical_search", _RANK_SQL)
def op12(spark, sf_dir):
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_DIVERGE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), o AS (
  SELECT r, lang, source, unnest(t) AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (CAST(coalesce(n, 0) + 5 AS HUGEINT) * 1000000000) // CAST(total + 5 * v AS HUGEINT) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (CAST(sum(n) + 5 AS HUGEINT) * 1000000000) // CAST(any_value(total) + 5 * any_value(v) AS HUGEINT) AS q
  FROM p JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
), e AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) z ON z.lang = a.lang AND z.source = a.source AND z.other = b.source
), u AS (
  SELECT lang, source, 'pair' AS part, item, value FROM e
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 50
"""


@REG.add("op13_source_divergence", _DIVERGE_SQL)
def op13(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries():
    return dict(REG.queries)


def oracle_sql():
    return dict(REG.sql)
