"""Slice streams: rows in any order, late rows, replays."""

import tempfile
from datetime import datetime, timedelta

from undertone.operators import health as H
from undertone.streaming import slices as S

PROBE = "platform string, probe_id long, ts timestamp, success boolean, result_count int, response_ms double"
START = datetime(2024, 1, 1)


def probe(spark, *rows):
    """(platform, id, minute, success, milliseconds); a minute of None is no time."""
    return spark.createDataFrame(
        [(p, i, None if m is None else START + timedelta(minutes=m), ok, 1, float(ms)) for p, i, m, ok, ms in rows], PROBE
    )


def health_target(spark):
    return S.SliceStream(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), S.probe_summaries, 3600)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_late_probes_correct_the_run(spark):
    target = health_target(spark)
    first = [("reddit", 1, 0, True, 5), ("reddit", 2, 70, False, 5), ("reddit", 3, 140, False, 16_000), ("tiktok", 9, 10, False, 5)]
    target(probe(spark, *first), 0)
    got = {r["platform"]: r for r in S.health_of(target.summaries()).collect()}
    assert (got["reddit"]["status"], got["reddit"]["error"], got["tiktok"]["consecutive_failures"]) == ("degraded", H.TIMEOUT_ERROR, 1)
    late = [("reddit", 4, 145, True, 7), ("reddit", 5, 80, False, 5), ("tiktok", 8, 5, True, 5), ("reddit", 6, 141, False, 5)]
    target(probe(spark, *late), 1)
    target(probe(spark, *late), 1)  # replay
    after = S.health_of(target.summaries())
    assert rows_of(after) == rows_of(H.current_health(probe(spark, *first, *late)).select(*after.columns))
    got = {r["platform"]: r for r in after.collect()}
    assert (got["reddit"]["status"], got["reddit"]["consecutive_failures"], got["tiktok"]["consecutive_failures"]) == ("healthy", 0, 1)


def test_ties_and_rows_without_time(spark):
    target = health_target(spark)
    rows = [("x", 2, 5, False, 3), ("x", 1, 5, True, 4), ("x", 3, 5, False, 6)]
    target(probe(spark, *rows, ("x", 4, None, True, 1)), 0)
    after = S.health_of(target.summaries())
    assert rows_of(after) == rows_of(H.current_health(probe(spark, *rows)).select(*after.columns))
    target(probe(spark, ("y", 4, None, True, 1)), 1)
    assert rows_of(S.health_of(target.summaries())) == rows_of(after)


def test_a_batch_reads_its_own_slices(spark):
    target = health_target(spark)
    seen = []
    target.summarise = lambda rows: seen.append(rows.inputFiles()) or S.probe_summaries(rows)
    for batch in range(4):
        target(probe(spark, ("x", batch, 60 * batch, False, 5)), batch)
    target(probe(spark, ("x", 9, 60, True, 5)), 4)
    hours = [{f.split("slice=")[1].split("/")[0] for f in files} for files in seen]
    assert [len(h) for h in hours] == [1] * 5 and hours[4] == hours[1] and [len(f) for f in seen] == [1, 1, 1, 1, 2]
    assert S.health_of(target.summaries()).first()["consecutive_failures"] == 2


def test_bursts_meet_across_slices(spark):
    gap = 1800
    target = S.SliceStream(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), S.burst_summaries(gap), 3600)

    def requests(*rows):
        return spark.createDataFrame([(p, i, START + timedelta(minutes=m)) for p, i, m in rows], "platform string, request_id long, ts timestamp")

    early = [("tiktok", 1, 50), ("tiktok", 2, 95), ("tiktok", 3, 190), ("reddit", 4, 10), ("reddit", 5, 10)]
    late = [("tiktok", 6, 75), ("tiktok", 7, 125), ("tiktok", 8, 155), ("reddit", 9, 41)]
    target(requests(*early), 0)
    assert rows_of(S.joined_bursts(target.summaries(), gap).groupBy("platform").count()) == [
        "Row(platform='reddit', count=1)", "Row(platform='tiktok', count=3)"]
    target(requests(*late), 1)
    got = H.rated(S.joined_bursts(target.summaries(), gap))
    assert rows_of(got) == rows_of(H.request_rates(requests(*early, *late), gap))
    assert sorted((r["platform"], r["requests"]) for r in got.collect()) == [("reddit", 1), ("reddit", 2), ("tiktok", 1), ("tiktok", 5)]
