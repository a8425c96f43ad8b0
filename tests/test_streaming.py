"""Streams give what the batch jobs give."""

import json
import tempfile

from pyspark.sql import functions as F

from undertone.operators import health as H
from undertone.operators.timeline import run_since, sessions
from undertone.plans.payloads import comment_captures, post_captures
from undertone.plans.views import probes, requests
from undertone.sources import captures as K
from undertone.sources import comments as M
from undertone.sources import posts as P
from undertone.streaming import captures as SC
from undertone.streaming import health as SH


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _in_files(df, path, order, parts):
    """Write ``df`` in order as several files, oldest first."""
    rows = df.count()
    numbered = df.orderBy(order).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    numbered = numbered.cache()
    for part in range(parts):
        low, high = rows * part // parts, rows * (part + 1) // parts
        numbered.filter((F.col("n") >= low) & (F.col("n") < high)).drop("n").coalesce(1).write.mode("append").parquet(path)


def test_health_stream_equals_batch(spark, sf):
    base = folder()
    df = probes(spark, sf)
    _in_files(df, f"{base}/in", "ts", 4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query, target = SH.start_health(stream, f"{base}/out", spark)
    query.awaitTermination(300)
    last = query.lastProgress["batchId"] if query.lastProgress else 3
    want = {r.platform: r.asDict() for r in H.current_health(df).collect()}
    got = {r.platform: r.asDict() for r in target.current(last).collect()}
    assert got == want and last >= 3


def test_late_probes_change_nothing(spark):
    base = folder()
    target = SH.HealthStream(spark, base)
    schema = "platform STRING, probe_id BIGINT, ts TIMESTAMP, success BOOLEAN, result_count INT, response_ms DOUBLE"

    def batch(*rows):
        df = spark.createDataFrame([("reddit", i, ts, ok, 1, 5.0) for i, ts, ok in rows], schema.replace("ts TIMESTAMP", "ts STRING"))
        return df.withColumn("ts", F.col("ts").cast("timestamp"))

    target(batch((1, "2024-01-01 00:00:00", True), (2, "2024-01-01 00:10:00", False)), 0)
    target(batch((3, "2024-01-01 00:05:00", True), (4, "2024-01-01 00:20:00", False)), 1)
    target(batch((3, "2024-01-01 00:05:00", True), (4, "2024-01-01 00:20:00", False)), 1)  # replay
    row = target.current(1).first()
    assert (row.status, row.consecutive_failures) == ("degraded", 2)
    target(batch((5, "2024-01-01 00:30:00", False)), 2)
    assert target.current(2).first().status == "down"


def test_run_since_equals_one_window(spark, sf):
    df = H.judged(probes(spark, sf))
    run = lambda **how: {
        r.probe_id: r.n for r in run_since(df, ["platform"], "ts", "probe_id", F.col("ok"), "n", **how).collect()
    }
    got, balanced = run(seconds=7200), run(full=20)
    want, count = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.probe_id)):
        count[r.platform] = 0 if r.ok else count.get(r.platform, 0) + 1
        want[r.probe_id] = count[r.platform]
    assert got == want and balanced == want


def test_sessions_do_not_depend_on_the_slices(spark, sf):
    df = requests(spark, sf)
    one = {tuple(r) for r in sessions(df, ["platform"], "ts", "request_id", 1800).collect()}
    two = {tuple(r) for r in sessions(df, ["platform"], "ts", "request_id", 1800, full=10).collect()}
    assert one == two


def test_capture_stream_drops_repeats_and_appends_once(spark, sf):
    base = folder()
    df = post_captures(spark, sf).unionByName(comment_captures(spark, sf))
    df.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).coalesce(3).write.json(f"{base}/in")
    platforms = ["tiktok", "reddit", "moltbook"]

    def run():
        stream = SC.dedup_stream(SC.read_stream(spark, f"{base}/in", 1))
        SC.start_ingest(stream, f"{base}/out", spark, platforms, "t").awaitTermination(300)

    run()
    run()  # nothing new: nothing appended
    posts = spark.read.parquet(f"{base}/out/silver_posts/*")
    batch = P.normalize_all_posts(K.dedup_captures(K.filter_captures(df)), platforms)
    want = sorted((r.platform, r.id) for r in batch.select("platform", "id").collect())
    assert sorted((r.platform, r.id) for r in posts.select("platform", "id").collect()) == want
    keys = SC.SILVER_KEYS["silver_comments"]
    comments = spark.read.parquet(f"{base}/out/silver_comments/*").select(*keys).collect()
    said = M.normalize_all_comments(K.dedup_captures(K.filter_captures(df))).filter(F.col("platform").isin(*platforms))
    assert sorted(map(tuple, comments)) == sorted(map(tuple, said.select(*keys).collect())) and comments


def test_request_sessions_on_a_stream(spark, sf):
    base = folder()
    df = requests(spark, sf)
    _in_files(df, f"{base}/in", "ts", 2)
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    bursts = SC.request_sessions(stream, "30 minutes", "1 minute")
    query = bursts.writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r.platform, r.requests) for r in spark.table("bursts").collect())
    # The session window closes at the gap itself; the audit keeps a gap of exactly that length open.
    want = sorted((r.platform, r.requests) for r in H.request_rates(df, 1800).collect())
    assert got == want


def test_corrupt_lines_are_kept_aside(spark):
    base = folder()
    rows = [json.dumps({"capture_id": "1", "platform": "reddit", "body": "{}"}), "{broken"]
    spark.createDataFrame([(r,) for r in rows], "value STRING").coalesce(1).write.text(f"{base}/in")
    df = K.read_captures(spark, f"{base}/in").cache()
    assert df.count() == 2 and df.filter("_corrupt IS NOT NULL").count() == 1
