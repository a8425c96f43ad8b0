"""Platform health and request rates over tables of probes and requests.

Probes: ``platform, probe_id, ts, success, result_count, response_ms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.operators.timeline import run_since, sessions
from undertone.schemas import DEFAULT_REQUESTS_PER_MINUTE, REQUESTS_PER_MINUTE, per_platform

# Limits of the monitor and its message.
TIMEOUT_MS = 15_000
FAILURES_UNTIL_DOWN = 3
FRESH_SECONDS = 300
RATE_WINDOW_SECONDS = 60
TIMEOUT_ERROR = "Health check timeout"


def judged(probes: DataFrame) -> DataFrame:
    """Probes with ``timed_out`` and ``ok``; an empty answer is not ok."""
    timed_out = F.col("response_ms") > TIMEOUT_MS
    return probes.withColumn("timed_out", timed_out).withColumn(
        "ok", F.col("success") & (F.col("result_count") > 0) & ~F.col("timed_out")
    )


def moment(ts: str = "ts", tie: str = "probe_id") -> Column:
    """Time and tie-breaking id in one number (ids are not negative).

    A fixed-width number keeps the aggregates on it in hash tables; a struct
    would make them sort their input first.
    """
    return F.unix_micros(ts).cast("decimal(38,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")


def status_of(failures: Column) -> Column:
    return (
        F.when(failures == 0, "healthy").when(failures < FAILURES_UNTIL_DOWN, "degraded").otherwise("down")
    )


def reduced(probes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per platform (or other ``keys``): last success, failures after it, last check.

    Two aggregates instead of an ordered scan: the last success per key,
    then the failures after it. Both combine before the shuffle.
    """
    keys = keys or ["platform"]
    df = judged(probes).withColumn("at", moment())
    last = df.groupBy(*keys).agg(
        F.max(F.when(F.col("ok"), F.col("at"))).alias("ok_at"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_healthy"),
        F.max("ts").alias("last_checked"),
        F.max_by("response_ms", "at").alias("response_ms"),
    )
    failed = (
        df.join(last.select(*keys, "ok_at"), keys)
        .filter(F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("failures"), F.max(F.col("timed_out").cast("int")).alias("timeouts"))
    )
    return last.join(failed, keys, "left").select(
        *keys, "last_healthy", "last_checked", "response_ms",
        F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures"),
        (F.coalesce("timeouts", F.lit(0)) > 0).alias("timeout_seen"),
    )


def states(summary: DataFrame) -> DataFrame:
    return summary.select(
        "platform",
        status_of(F.col("failures")).alias("status"),
        "last_checked",
        "last_healthy",
        F.col("failures").alias("consecutive_failures"),
        F.col("response_ms").alias("response_time_ms"),
        F.when(F.col("timeout_seen"), F.lit(TIMEOUT_ERROR)).alias("error"),
    )


def current_health(probes: DataFrame) -> DataFrame:
    """State per platform after all probes."""
    return states(reduced(probes))


def health_history(probes: DataFrame) -> DataFrame:
    """State of the platform after every single probe."""
    df = run_since(judged(probes), ["platform"], "ts", "probe_id", F.col("ok"), "consecutive_failures")
    return df.withColumn("status", status_of(F.col("consecutive_failures")))


def status_for(states: DataFrame, platform: str) -> DataFrame:
    """The state of one platform; no row when it is not monitored."""
    return states.filter(F.col("platform") == platform)


def overall(states: DataFrame) -> DataFrame:
    """One row: the worst status wins."""
    severity = F.when(F.col("status") == "down", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = F.max(severity)
    return states.agg(
        F.when(worst == 2, "down").when(worst == 1, "degraded").otherwise("healthy").alias("overall"),
        F.count(F.lit(1)).alias("platforms"),
        F.count_if(F.col("status") == "down").alias("down"),
        F.count_if(F.col("status") == "degraded").alias("degraded"),
        F.max("last_checked").alias("last_full_check"),
    )


def two_state_health(probes: DataFrame) -> DataFrame:
    """Healthy or down from the latest probe alone."""
    latest = probes.groupBy("platform").agg(
        F.max_by("success", moment()).alias("ok"), F.max("ts").alias("checked_at")
    )
    return latest.select("platform", F.when(F.col("ok"), "healthy").otherwise("down").alias("status"), "checked_at")


def freshness(probes: DataFrame, as_of: Column) -> DataFrame:
    """Whether a platform's last check is still usable at ``as_of``."""
    last = probes.groupBy("platform").agg(F.max("ts").alias("last_checked"))
    age = (F.unix_micros(as_of) - F.unix_micros("last_checked")) / 1_000_000
    return last.select(
        "platform", "last_checked", F.when(age < FRESH_SECONDS, "cached").otherwise("live").alias("source")
    )


def probe_windows(probes: DataFrame, width: str = "5 minutes") -> DataFrame:
    df = judged(probes)
    return df.groupBy("platform", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("ok")).alias("failures"),
        F.count_if(F.col("timed_out")).alias("timeouts"),
    ).select("platform", F.col("w.start").alias("window_start"), "probes", "failures", "timeouts")


def available_platforms(states: DataFrame, platforms: DataFrame) -> DataFrame:
    """Platforms that answered at least once, with their capabilities; one row."""
    known = platforms.join(states.filter(F.col("last_healthy").isNotNull()), "platform", "left_semi")
    return known.agg(
        F.array_join(F.array_sort(F.collect_list("platform")), ",").alias("available_platforms"),
        F.count(F.lit(1)).alias("total_platforms"),
    )


def request_rates(requests: DataFrame, gap_seconds: float = RATE_WINDOW_SECONDS) -> DataFrame:
    """Bursts of requests per platform against the platform's cap.

    A burst ends when nothing is sent for longer than the gap. A sender that
    keeps going has to wait after every ``cap`` requests.
    """
    return rated(sessions(requests, ["platform"], "ts", "request_id", gap_seconds))


def rated(bursts: DataFrame) -> DataFrame:
    """Bursts with the cap of their platform, whether they pass it, and how often the sender waits."""
    cap = per_platform(REQUESTS_PER_MINUTE, DEFAULT_REQUESTS_PER_MINUTE)
    return bursts.withColumn("cap", cap).select(
        "platform", "session_start", "session_end", "requests", "cap",
        (F.col("requests") > F.col("cap")).alias("over_cap"),
        F.floor((F.col("requests") - 1) / F.col("cap")).alias("waits"),
    )


def error_report(failures: DataFrame) -> DataFrame:
    """Failed operations by platform and code; disabled comments are no error."""
    disabled = E.comments_disabled(F.col("platform"), F.col("operation"), F.col("status"), F.col("reason"))
    code = E.error_code(F.col("platform"), F.col("status"), F.col("message"), F.col("reason"))
    return (
        failures.filter(~disabled)
        .withColumn("code", code)
        .groupBy("platform", "code")
        .agg(F.count(F.lit(1)).alias("errors"), F.max("ts").alias("last_seen"))
    )
