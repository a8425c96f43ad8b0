"""Column expressions at their edges."""

from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.operators import threads


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")


def test_defaults(spark):
    assert value(spark, E.text_or(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    assert value(spark, E.count_or(F.lit("0"), F.lit("abc"), F.lit("12"))) == 12


def test_cosine(spark):
    assert value(spark, E.cosine(lits(1, 0, 0), lits(1, 0, 0))) == 1.0
    assert value(spark, E.cosine(lits(1, 0), lits(0, 1))) == 0.0
    assert value(spark, E.cosine(lits(1, 0), lits(-1, 0))) == -1.0
    assert value(spark, E.cosine(lits(), lits())) == 0.0
    assert value(spark, E.cosine(lits(1, 2), lits(1, 2, 3))) == 0.0
    assert value(spark, E.cosine(lits(0, 0), lits(1, 1))) == 0.0


def test_population_variance(spark):
    for numbers, want in (([5, 5, 5, 5], 0.0), ([1, 2, 3, 4, 5], 2.0), ([7], 0.0)):
        df = spark.createDataFrame([(n,) for n in numbers], "n INT")
        assert df.agg(F.var_pop("n").alias("v")).first().v == want


def test_linear_engagement(spark):
    score = lambda l, u, d, s: value(spark, E.raw_engagement(F.lit(l), F.lit(u), F.lit(d), F.lit(s)))
    assert score(0, 0, 0, 0) == 0.1 and score(50, 0, 0, 0) > 0.1 and score(0, 20, 5, 0) > 0.1
    assert score(0, 0, 0, 10) > score(0, 0, 0, 0)


def test_weights_and_selection(spark):
    rows = [("c", i, l, 0, 0, 0) for i, l in (("low", 1), ("high", 1000), ("mid", 50))]
    schema = "content_id STRING, comment_id STRING, likes BIGINT, reply_count BIGINT, shares BIGINT, views BIGINT"
    df = spark.createDataFrame(rows, schema)
    assert threads.top_comments(df, 1).first().comment_id == "high"
    assert threads.top_comments(df, 10).count() == 3
    weights = {r.comment_id: r.weight for r in threads.engagement_weights(threads.top_comments(df, 10)).collect()}
    assert weights["low"] == 0.1 and weights["high"] == 3.0 and 0.1 < weights["mid"] < 3.0
    equal = spark.createDataFrame([("c", str(i), 10, 0, 0, 0) for i in range(3)], schema)
    assert {r.weight for r in threads.engagement_weights(threads.top_comments(equal, 5)).collect()} == {1.0}


def test_sanitize(spark):
    assert value(spark, E.sanitize(F.lit("\u0001 a\u0007b \n"))) == "ab"
    assert value(spark, E.sanitize(F.lit(None).cast("string"))) == ""
    assert len(value(spark, E.sanitize(F.lit("x" * 3000)))) == 3000
    assert len(value(spark, E.sanitize(F.lit("x" * 3000), 2000))) == 2000


def test_timestamps(spark):
    at = F.lit("2020-01-01 00:00:00").cast("timestamp")
    read = lambda raw: str(value(spark, E.normalize_timestamp(F.lit(raw).cast("string"), at)))
    assert read("1700000000") == read("1700000000000") == read("2023-11-14T22:13:20Z")
    assert read(None) == read("") == read("0") == "2020-01-01 00:00:00"


def test_engagement_rate(spark):
    assert value(spark, E.engagement_rate(F.lit(3), F.lit(2), F.lit(5), F.lit(200))) == 5.0
    assert value(spark, E.engagement_rate(F.lit(3), F.lit(2), F.lit(5), F.lit(0))) == 0.0


def test_relevance(spark):
    r = lambda c, q: value(spark, E.relevance(F.lit(c), q))
    assert r("A Fast Car", "fast car") == 14 and r("car", "fast car") == 2 and r("", "x") == 0
    assert r("car", "car car") == 4  # repeated words count again
    assert r("a b", " a") == 0 + 2 + 2  # a leading blank gives an empty word, which any text contains
    for content, query in (("A Fast Car", "fast car"), ("car", "car car"), ("a b", " a")):
        assert value(spark, E.relevance_to(F.lit(content), F.lit(query))) == r(content, query)


def test_urls(spark):
    t = lambda u: value(spark, E.tiktok_video_id(F.lit(u)))
    assert t("https://www.tiktok.com/@a/video/12") == "12" and t("https://m.tiktok.com/x?aweme_id=7") == "7"
    assert t("https://m.tiktok.com/x?item_id=abc") is None and t("not a url") is None
    assert value(spark, E.is_tiktok_url(F.lit("https://faketiktok.com/x"))) is False
    assert value(spark, E.instagram_shortcode(F.lit("https://instagram.com/reels/A-b_1/"))) == "A-b_1"
    assert value(spark, E.platform_of_url(F.lit("https://netflix.com"))) == "twitter"  # contains x.com
    assert value(spark, E.platform_of_url(F.lit("https://unknown.org"))) == "twitter"


def test_error_order(spark):
    code = lambda p, s, m, r: value(spark, E.error_code(F.lit(p), F.lit(s), F.lit(m), F.lit(r)))
    assert code("youtube", 403, "", "quotaExceeded") == "RATE_LIMIT"
    assert code("youtube", 403, "", "other") == "authentication_error"
    assert code("reddit", 500, "rate limit hit", None) == "RATE_LIMIT"
    assert code("tiktok", 500, "rate limit hit", None) == "unknown_error"
    assert code("reddit", 404, None, None) == "not_found"


def test_retry(spark):
    act = lambda s: value(spark, E.retry_action(F.lit(s)))
    assert [act(s) for s in (200, 400, 409, 429, 503)] == [
        "none", "fail_fast", "recover_conflict", "retry_with_backoff", "retry_with_backoff"
    ]
