"""Queries that match rows in time and by name, over streams with late rows, and sinks that write only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora import sources
from arbora.operators import matching
from arbora.plans import catalog
from arbora.plans.catalog import cents, query, read
from arbora.streaming import windows
from arbora.tables import new_path

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL


@query(
    """WITH r AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT l.event_id, l.user_id, r.ts AS purchase_ts, r.purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def as_of_purchase(spark, sf_dir):
    """Each event beside its user's last purchase up to then."""
    e = read(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id"))
    others = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return windows.as_of_join(others, bought, "user_id", "ts", "purchase_ts", ["purchase_id"], tie="purchase_id").drop("ts")


@query(
    """WITH h AS (SELECT page_id, regexp_extract(url, '^https?://(?:www\\.|m\\.)?([^./]+)', 1) AS name FROM pages),
    r AS (SELECT min(doc_id) AS match_key, name FROM (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]+')) AS name FROM documents) WHERE name <> '' GROUP BY 2),
    m AS (SELECT n.name, arg_min(r.name, (levenshtein(n.name, r.name), r.name)) AS match_name, min(levenshtein(n.name, r.name)) AS distance
      FROM (SELECT DISTINCT name FROM h) n JOIN r ON abs(length(n.name) - length(r.name)) <= 2 WHERE levenshtein(n.name, r.name) <= 2 GROUP BY 1)
    SELECT h.page_id, h.name, r.match_key, m.match_name, m.distance::INT AS distance, 1 - m.distance / greatest(length(h.name), length(m.match_name), 1)::DOUBLE AS match_score,
    CASE WHEN m.match_name IS NULL THEN 'not_matched' ELSE 'matched' END AS match_status FROM h LEFT JOIN m USING (name) LEFT JOIN r ON r.name = m.match_name"""
)
def names_without_block(spark, sf_dir):
    """Hosts of pages matched with the first words of all documents, within two edits, without a block."""
    hosts = read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^./]+)", 1).alias("name"))
    first = F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))
    words = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), first.alias("name")).filter("name <> ''")
    return matching.best_name_anywhere(hosts, words, "key", "name", 2).withColumnRenamed("key", "page_id")


@query(
    """WITH y AS (SELECT l_suppkey AS target_id, year(l_shipdate)::BIGINT AS fiscal_year, CAST(sum(round(l_extendedprice * 100)::BIGINT) AS BIGINT) AS total FROM lineitem WHERE (l_suppkey + year(l_shipdate)) % 4 > 0 GROUP BY 1, 2)
    SELECT target_id, fiscal_year, total, CAST(sum(total) OVER w AS BIGINT) AS trailing, count(*) OVER w AS trailing_rows FROM y
    WINDOW w AS (PARTITION BY target_id ORDER BY fiscal_year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"""
)
def trailing_years(spark, sf_dir):
    """Sums over three fiscal years, of which some are missing: a year that is not there is not replaced."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target_id"), F.year("l_shipdate").cast("bigint").alias("fiscal_year"), cents("l_extendedprice").alias("v"))
    y = li.filter("(target_id + fiscal_year) % 4 > 0").groupBy("target_id", "fiscal_year").agg(F.sum("v").alias("total"))
    return windows.trailing(y, ["target_id"], "fiscal_year", "total", 2)


# Streams that end with what has arrived ------------------------------------------------------------------------------


def arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All events in two arrivals: those on time, and a seventh of them after the rest, most of which are late."""
    e = read(spark, sf_dir, "events")
    on_time = F.coalesce(F.col("event_id") % 7 > 0, F.lit(False))  # ids that are negative or null arrive later too
    return e.filter(on_time), e.filter(~on_time)


def in_two_runs(spark: SparkSession, sf_dir: str, over) -> DataFrame:
    """A stream's result after both arrivals; the second run goes on from the first one's state and watermark."""
    landing, out, state = new_path(spark, "landing"), new_path(spark, "out"), new_path(spark, "state")
    kinds, result = read(spark, sf_dir, "events").schema, None
    for part in arrivals(spark, sf_dir):
        part.write.mode("append").parquet(landing)
        result = over(spark.readStream.schema(kinds).parquet(landing))
        windows.run_once(result, out, state)
    return spark.read.schema(result.schema).parquet(out)


#: A window is given out when the watermark passes its end; rows of windows that had ended at the first run's watermark are late.
LATE_SQL = """m AS (SELECT date_trunc('milliseconds', max(ts) FILTER (event_id % 7 > 0)) - INTERVAL 2 DAY AS first, date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS last FROM events)"""


@query(
    f"""WITH {LATE_SQL}, w AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS start FROM events, m)
    SELECT start, event_type, count(*) AS n, sum(value) AS total FROM w WHERE (event_id % 7 > 0 OR start + INTERVAL 1 DAY > first) AND start + INTERVAL 1 DAY <= last GROUP BY 1, 2"""
)
def daily_events_with_late_rows(spark, sf_dir):
    """Streams: daily windows in append mode under a watermark of two days; late rows are dropped, open windows wait."""
    made = in_two_runs(spark, sf_dir, lambda s: windows.tumbling_stream(s, "ts", "1 day", "2 days", ["event_type"], "value"))
    return made.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    f"""WITH {LATE_SQL}, e AS (SELECT user_id, ts, first, last FROM events, m WHERE event_id % 7 > 0 OR ts + INTERVAL 3 HOUR > first),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 3 HOUR <= any_value(last)"""
)
def sessions_with_late_rows(spark, sf_dir):
    """Streams: sessions of three hours under a watermark of two days; a row in time also joins a session that had ended."""
    landing, kept, state = new_path(spark, "landing"), new_path(spark, "sessions"), new_path(spark, "state")
    kinds = read(spark, sf_dir, "events").schema
    for part in arrivals(spark, sf_dir):
        part.write.mode("append").parquet(landing)
        windows.keep_sessions(spark.readStream.schema(kinds).parquet(landing), "ts", "3 hours", "2 days", "user_id", kept, state)
    return windows.ended_sessions(spark, kept).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """SELECT user_id, CAST(ts AS DATE) AS day, first(event_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, event_id) AS event_id FROM events GROUP BY 1, 2"""
)
def preferred_event_stream(spark, sf_dir):
    """W1 on a stream: the preferred event of each user and day, replaced when a better one arrives, however late."""
    landing, out, state = new_path(spark, "landing"), new_path(spark, "preferred"), new_path(spark, "state")
    kinds = read(spark, sf_dir, "events").schema
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 3).otherwise(4)

    def update(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")

    for part in arrivals(spark, sf_dir):
        part.write.mode("append").parquet(landing)
        events = spark.readStream.schema(kinds).parquet(landing).withColumn("day", F.to_date("ts"))
        windows.preferred_stream(events, ["user_id", "day"], [rank, F.col("event_id")], ["event_id"], update, state)
    changes = spark.read.parquet(f"{out}/batch=*")
    return changes.groupBy("user_id", "day").agg(F.max_by("event_id", "batch").alias("event_id"))


# Sinks ---------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT 'first' AS run, TRUE AS written, count(*) AS n_rows FROM orders UNION ALL SELECT 'same rows', FALSE, count(*) FROM orders UNION ALL SELECT 'one status changed', TRUE, count(*) FROM orders)")
def write_only_changes(spark, sf_dir):
    """Orders written, dealt out anew without effect, and written again after a change."""
    path, o = new_path(spark, "kept"), read(spark, sf_dir, "orders")
    runs = [("first", o), ("same rows", o.repartition(3, "o_custkey")), ("one status changed", o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") > 0, F.col("o_orderstatus")).otherwise("X")))]
    told = []
    for name, rows in runs:
        wrote = sources.write_if_changed(rows, path, (f"{sf_dir}/orders.parquet",))
        told.append((name, wrote, spark.read.parquet(path).count()))
    return spark.createDataFrame(told, "run string, written boolean, n_rows bigint")
