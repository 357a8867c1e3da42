"""The reuse workflow: which existing result, if any, stands for a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions import text
from clipledger.functions.digest import provenance_tag
from clipledger.functions.keys import as_list, join_on
from clipledger.plans.tables import Registry, table

REG = Registry()


def _rejection(prefix: str) -> Column:
    """Why a candidate is not taken; NULL if it is. Cheap evidence comes first."""
    tag = provenance_tag(prefix, F.col("s_signature"), F.col("s_job_sig"))
    off = F.abs(F.col("fps") - F.col("s_rebuild_rate"))
    allowed = F.greatest(F.lit(C.RATE_ABS_TOL), F.col("s_rebuild_rate") * C.RATE_REL_TOL)
    rebuilt = F.col("s_timestamps_broken") & F.col("s_target_rate").isNull() & (F.col("fps") > 0)
    return (
        F.when(F.col("mtime") < F.col("s_mtime"), "older than its source")
        .when(~F.coalesce(F.col("codec_matches"), F.lit(False)), "other codec")
        .when(~F.coalesce(F.lower(text.trimmed(F.col("provenance"))) == F.lower(tag), F.lit(False)), "other provenance")
        .when(F.size("problems") > 0, F.array_join("problems", "; "))
        .when(F.col("s_timestamps_broken") & F.col("timestamps_broken"), "timeline still broken")
        .when(rebuilt & (off > allowed), "rebuilt at another rate")
    )


def reuse_outputs(sources: DataFrame, candidates: DataFrame, key, slot: str = "slot", prefix: str = "clipledger") -> DataFrame:
    """``sources`` with ``reused_slot`` and ``reuse_reason``.

    ``key`` says where a source's results lie (place, stem, preset). Sources have
    ``mtime, signature, signature_now, job_sig, timestamps_broken, target_rate,
    rebuild_rate``; candidates have ``mtime, codec_matches, provenance, problems,
    timestamps_broken, fps`` and a slot that is unique per key. The lowest slot that
    nothing speaks against is taken, unless the source's signature changed while
    candidates were examined. A miss carries the reason of its lowest slot.

    Candidates are reduced to one row per source by a partial aggregate, so a source
    with very many of them needs no split.
    """
    key = as_list(key)
    facts = ["mtime", "signature", "job_sig", "timestamps_broken", "target_rate", "rebuild_rate"]
    known = sources.select(*key, *[F.col(c).alias(f"s_{c}") for c in facts])
    pairs = join_on(candidates, known, key).withColumn("__why", _rejection(prefix))
    best = pairs.groupBy(*key).agg(
        F.min(F.when(F.col("__why").isNull(), F.col(slot))).alias("__slot"), F.min_by("__why", slot).alias("__first")
    )
    changed = ~F.coalesce(F.col("signature") == F.col("signature_now"), F.lit(False))
    found = F.col("__slot").isNotNull()
    reason = (
        F.when(found & changed, "source changed meanwhile").when(found, F.lit(None))
        .otherwise(F.coalesce("__first", F.lit("no candidate")))
    )
    return (
        join_on(sources, best, key, "left")
        .withColumn("reuse_reason", reason)
        .withColumn("reused_slot", F.when(found & ~changed, F.col("__slot")))
        .select(*sources.columns, "reused_slot", "reuse_reason")
    )


@REG.add(
    "catalog_reuse",
    """
    WITH s AS (SELECT o_orderkey, o_orderpriority AS place, 'o' || o_orderkey AS stem, o_orderdate AS mtime,
                      sha256(CAST(o_custkey AS VARCHAR)) AS signature, o_custkey % 11 = 0 AS changed, o_orderstatus = 'O' AS broken,
                      CASE WHEN o_custkey % 3 > 0 THEN 25.0::DOUBLE END AS rebuild
               FROM orders),
    c AS (SELECT l_orderkey, l_linenumber AS slot, min(l_shipdate) AS mtime, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem
          GROUP BY 1, 2),
    j AS (SELECT s.*, slot, CASE
            WHEN c.mtime < s.mtime + INTERVAL 30 DAY THEN 'older than its source'
            WHEN p % 7 = 0 THEN 'other codec'
            WHEN p % 5 = 0 OR p % 5 = 1 THEN 'other provenance'
            WHEN q > 45 THEN 'too many'
            WHEN broken AND p % 2 = 0 THEN 'timeline still broken'
            WHEN broken AND abs(25 + (q % 3) / 20 - rebuild) > greatest(0.01, rebuild * 0.002) AND p % 3 > 0 THEN 'rebuilt at another rate'
          END AS why
          FROM s LEFT JOIN c ON o_orderkey = l_orderkey),
    b AS (SELECT o_orderkey, min(slot) FILTER (WHERE why IS NULL) AS best, arg_min(coalesce(why, ''), slot) AS first, any_value(changed) AS changed
          FROM j GROUP BY 1)
    SELECT o_orderkey, CASE WHEN NOT changed THEN best END AS reused_slot,
           CASE WHEN best IS NOT NULL AND changed THEN 'source changed meanwhile' WHEN best IS NULL THEN coalesce(first, 'no candidate') END
             AS reuse_reason
    FROM b
    """,
)
def catalog_reuse(spark, sf_dir):
    customer = F.col("o_custkey").cast("string")
    sources = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("place"), F.concat(F.lit("o"), "o_orderkey").alias("stem"),
        F.lit("xvid_max_q2").alias("preset"), F.expr("o_orderdate + INTERVAL 30 DAY").alias("mtime"),
        F.sha2(customer, 256).alias("signature"),
        F.when(F.col("o_custkey") % 11 > 0, F.sha2(customer, 256)).alias("signature_now"),
        F.sha2(F.lit("job"), 256).alias("job_sig"), (F.col("o_orderstatus") == "O").alias("timestamps_broken"),
        F.lit(None).cast("double").alias("target_rate"), F.when(F.col("o_custkey") % 3 > 0, F.lit(25.0)).alias("rebuild_rate"),
    )
    part, quantity = F.col("p"), F.col("q")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("slot")).agg(
        F.min("l_shipdate").alias("mtime"), F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p")
    )
    orders = sources.select("o_orderkey", "place", "stem", "preset", "signature", "job_sig")
    tag = provenance_tag("clipledger", F.col("signature"), F.col("job_sig"))
    candidates = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        "place", "stem", "preset", "slot", "mtime", (part % 7 > 0).alias("codec_matches"),
        F.when(part % 5 == 0, "made elsewhere").when(part % 5 > 1, F.concat(F.upper(tag), F.lit("\n"))).alias("provenance"),
        F.when(quantity > 45, F.array(F.lit("too many"))).otherwise(F.array().cast("array<string>")).alias("problems"),
        (part % 2 == 0).alias("timestamps_broken"),
        F.when(part % 3 > 0, 25 + (quantity % 3) / 20).alias("fps"),
    )
    out = reuse_outputs(sources, candidates, ["place", "stem", "preset"])
    return out.select("o_orderkey", "reused_slot", "reuse_reason")
