"""Journals, paired measurements and set comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeframe.catalog.common import mix_sql, rounded, tidy
from cladeframe.functions.hashing import add_mix32
from cladeframe.sources import journal, tables

REPLICATES = 100
# Upper ends of the hashes that draw a row 0, 1, 2, ... times, from the Poisson law of mean one.
DRAW_BOUNDS = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def _events(spark, folder):
    return tables.read(spark, folder, "events")


def event_journal_tail(spark, folder):
    rows = journal.tail(_events(spark, folder).select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k")), "event_id")
    return tidy(rows)


def job_queue(spark, folder):
    """Place of every event in the queue of its user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return tidy(_events(spark, folder).select("user_id", "event_id", F.row_number().over(order).alias("place")))


def plateau_window(spark, folder):
    """Plateau flags over the events of each user; the event type is the state, and a step starts where the last ended."""
    value, order = F.floor(F.col("value") / 100), Window.partitionBy("user_id").orderBy("event_id")
    rows = _events(spark, folder).select(
        F.col("user_id").alias("job"), F.col("event_id").alias("step"), F.col("event_type").alias("state"),
        F.coalesce(F.lag(value).over(order), value).alias("before"), value.alias("after"))
    return tidy(journal.plateaus(rows, 3.0))


def compact_events(spark, folder):
    """One compact event for each user and event type; a rate without a divisor is infinite and goes."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = _events(spark, folder).select("user_id", "event_type", "value", k.alias("k")).groupBy("user_id", "event_type").agg(
        F.array_sort(F.collect_list("value")).alias("gains"), F.sum("value").alias("total"), F.min("k").alias("k"))
    rate = F.when(F.col("k") == 0, float("inf")).otherwise(F.col("total") / F.nullif("k", F.lit(0.0)))
    scalars = F.create_map(F.lit("total"), F.col("total"), F.lit("rate"), rate)
    found = journal.compact(rows.select("user_id", "event_type", "gains", scalars.alias("scalars")))
    return rounded(tidy(found.select(
        "user_id", "event_type", F.array_join(F.array_sort(F.map_keys("scalars")), ",").alias("kept"), "mean_gain")), "mean_gain")


def bootstrap_means(spark, folder):
    """Mean time of each method with the 2.5 and 97.5 percent points of 100 bootstrap means.

    Resampling is Poisson: row and replicate give a 32-bit hash, and the hash
    tells how often the row is drawn, so no sample is ever gathered.
    """
    runs = _runs(spark, folder).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    hashed = add_mix32(runs, "id * 1000003 + draw * 8191 + ascii(method)", "h")
    times = sum(((F.col("h") >= bound).cast("int") for bound in DRAW_BOUNDS), F.lit(0))
    means = hashed.groupBy("method", "draw").agg((F.sum(times * F.col("seconds")) / F.nullif(F.sum(times), F.lit(0))).alias("m"))
    ends = means.groupBy("method").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rounded(tidy(_runs(spark, folder).groupBy("method").agg(F.avg("seconds").alias("mean")).join(ends, "method")), "mean", "low", "high")


def _runs(spark, folder):
    """One time per order and method; methods are return flags."""
    return tables.read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("method")).agg(
        F.min("l_quantity").alias("seconds"))


def paired_stats(spark, folder):
    """Ratio statistics of every method against method A over shared inputs."""
    runs = _runs(spark, folder)
    base = runs.where("method = 'A'").select("id", F.col("seconds").alias("base"))
    rows = runs.where("method <> 'A'").join(base, "id").withColumn("ratio", F.col("seconds") / F.col("base"))
    return rounded(tidy(rows.groupBy("method").agg(
        F.count("*").alias("n"), F.avg("ratio").alias("mean"), F.median("ratio").alias("median"),
        F.percentile("ratio", F.lit(0.95)).alias("p95"), F.min("ratio").alias("low"), F.max("ratio").alias("high"),
        F.count(F.when(F.col("ratio") < 1, 1)).alias("wins"), F.count(F.when(F.col("ratio") == 1, 1)).alias("ties"))),
        "mean", "median", "p95", "low", "high")


def rank_scores(spark, folder):
    """Mean tie-aware rank of each method over inputs that all methods finished."""
    runs = _runs(spark, folder)
    every = Window.partitionBy("id")
    complete = runs.withColumn("_k", F.count("*").over(every)).where("_k = 3")
    order = Window.partitionBy("id").orderBy("seconds")
    tied = Window.partitionBy("id", "seconds")
    ranked = complete.withColumn("score", F.rank().over(order) + (F.count("*").over(tied) - 1) / 2)
    return rounded(tidy(ranked.groupBy("method").agg(F.count("*").alias("n"), F.avg("score").alias("mean_rank"))), "mean_rank")


def completed_by_all(spark, folder):
    runs = _runs(spark, folder)
    sets = [runs.where(F.col("method") == m).select("id") for m in "ANR"]
    return tidy(sets[0].intersect(sets[1]).intersect(sets[2]))


def missing_taxa(spark, folder):
    """Customers that a backbone of customers with finished orders lacks, and the other way round."""
    have = tables.read(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("taxon")).distinct()
    want = tables.read(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("taxon"))
    return tidy(want.exceptAll(have).withColumn("lacking", F.lit("backbone")).unionByName(
        have.exceptAll(want).withColumn("lacking", F.lit("alignment"))))


QUERIES = {f.__name__: f for f in (
    event_journal_tail, job_queue, plateau_window, compact_events, paired_stats, bootstrap_means, rank_scores,
    completed_by_all, missing_taxa)}

_RUNS = """WITH runs AS (SELECT CAST(l_orderkey AS BIGINT) AS id, l_returnflag AS method, min(l_quantity) AS seconds FROM lineitem GROUP BY 1, 2)"""
ORACLES = {
    "event_journal_tail": """
SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY event_id DESC LIMIT 300""",
    "job_queue": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events",
    "plateau_window": """
WITH e AS (SELECT user_id AS job, event_id AS step, event_type AS state, floor(value / 100) AS b,
           coalesce(lag(floor(value / 100)) OVER (PARTITION BY user_id ORDER BY event_id), floor(value / 100)) AS a FROM events),
w AS (SELECT job, step, count(*) OVER r AS n, list(state) OVER r AS s, max(b) OVER r - min(a) OVER r AS span, max(b - a) OVER r AS gain FROM e
  WINDOW r AS (PARTITION BY job ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT job, step, n = 8 AND span <= 3 AND gain <= 3 AND len(list_filter(s, lambda x: len(list_filter(s, lambda y: y = x)) < 2)) = 0 AS plateau FROM w""",
    "compact_events": """
SELECT user_id, event_type, CASE WHEN min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) = 0 OR min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) IS NULL
  THEN 'total' ELSE 'rate,total' END AS kept, round(avg(value), 6) AS mean_gain FROM events GROUP BY user_id, event_type""",
    "bootstrap_means": _RUNS + ", drawn AS (SELECT id, method, seconds, unnest(range(0, " + str(REPLICATES) + ")) AS draw FROM runs), " + mix_sql(
        "drawn", "id * 1000003 + draw * 8191 + ascii(method)", "hashed", "id, method, seconds, draw") + ", counted AS (SELECT method, draw, seconds, "
        + " + ".join(f"CAST(mixed >= {bound} AS BIGINT)" for bound in DRAW_BOUNDS) + """ AS t FROM hashed),
m AS (SELECT method, draw, sum(t * seconds) / nullif(sum(t), 0) AS m FROM counted GROUP BY method, draw),
ends AS (SELECT method, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY method)
SELECT method, round(avg(seconds), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM runs JOIN ends USING (method) GROUP BY method""",
    "paired_stats": _RUNS + """, paired AS (SELECT r.method, r.seconds / b.seconds AS ratio FROM runs r JOIN runs b ON b.id = r.id AND b.method = 'A' WHERE r.method <> 'A')
SELECT method, count(*) AS n, round(avg(ratio), 6) AS mean, round(median(ratio), 6) AS median, round(quantile_cont(ratio, 0.95), 6) AS p95,
  round(min(ratio), 6) AS low, round(max(ratio), 6) AS high, count(CASE WHEN ratio < 1 THEN 1 END) AS wins, count(CASE WHEN ratio = 1 THEN 1 END) AS ties
FROM paired GROUP BY method""",
    "rank_scores": _RUNS + """, full_ids AS (SELECT id FROM runs GROUP BY id HAVING count(*) = 3),
ranked AS (SELECT method, rank() OVER (PARTITION BY id ORDER BY seconds) + (count(*) OVER (PARTITION BY id, seconds) - 1) / 2.0::DOUBLE AS score
  FROM runs WHERE id IN (SELECT id FROM full_ids))
SELECT method, count(*) AS n, round(avg(score), 6) AS mean_rank FROM ranked GROUP BY method""",
    "completed_by_all": _RUNS + " SELECT id FROM runs GROUP BY id HAVING count(DISTINCT method) = 3",
    "missing_taxa": """
WITH have AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS taxon FROM orders WHERE o_orderstatus = 'F'),
want AS (SELECT CAST(c_custkey AS BIGINT) AS taxon FROM customer WHERE c_acctbal > 0)
SELECT taxon, 'backbone' AS lacking FROM want WHERE taxon NOT IN (SELECT taxon FROM have)
UNION ALL SELECT taxon, 'alignment' FROM have WHERE taxon NOT IN (SELECT taxon FROM want)""",
}
