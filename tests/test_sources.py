"""Normalization rules on small hand-made payloads."""

import json

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from undertone.operators import govern, search, threads
from undertone.schemas import PLATFORMS, platform_dimension
from undertone.sources import captures as K
from undertone.sources import comments as M
from undertone.sources import posts as P
from undertone.sources import sinks
from undertone.sources.responses import page_text

AT = "2026-01-01 00:00:00"


def captures(spark, platform, kind, *bodies, content_id="c"):
    rows = [
        (f"k{i}", platform, kind, content_id, f"https://h/{i}", 200, "application/json", b if isinstance(b, str) else json.dumps(b), AT)
        for i, b in enumerate(bodies)
    ]
    schema = K.CAPTURE_SCHEMA.replace("captured_at TIMESTAMP", "captured_at STRING")
    return spark.createDataFrame(rows, schema).withColumn("captured_at", F.col("captured_at").cast("timestamp"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_zero_and_blank_fall_through(spark):
    body = {"data": {"children": [{"data": {"id": "a", "selftext": "", "title": "T", "score": 0, "ups": 7, "permalink": "/r/x"}}]}}
    row = one(P.normalize_posts(captures(spark, "reddit", "posts", body), "reddit"))
    assert (row.content, row.engagement.likes, row.media_url) == ("T", 7, "https://reddit.com/r/x")
    assert str(row.timestamp) == AT  # no time of its own: the time of retrieval


def test_object_in_place_of_a_list_hides_later_lists(spark):
    body = {"data": {"items": [{"id": "1"}]}, "item_list": [{"id": "2"}]}
    rows = P.normalize_posts(captures(spark, "tiktok", "posts", body), "tiktok").collect()
    assert [r.id for r in rows] == ["1"]


def test_first_of_the_same_id_wins_and_id_less_rows_go(spark):
    a = {"item_list": [{"id": 5, "desc": "first"}, {"desc": "no id"}]}
    b = {"item_list": [{"id": "5", "desc": "second"}, {"video": {"id": "6"}}]}
    rows = P.normalize_posts(captures(spark, "tiktok", "posts", a, b, "not json"), "tiktok").collect()
    assert {r.id: r.content for r in rows} == {"5": "first", "6": ""}


def test_statistics_object_is_chosen_whole(spark):
    body = {"item_list": [{"id": "1", "stats": {}, "statistics": {"digg_count": 4}}, {"id": "2", "statistics": {"digg_count": 4}}]}
    rows = P.normalize_posts(captures(spark, "tiktok", "posts", body), "tiktok").collect()
    assert {r.id: r.engagement.likes for r in rows} == {"1": 0, "2": 4}


def test_xiaohongshu_times_and_plain_tags(spark):
    body = {"data": {"notes": [
        {"note_id": "1", "time": 1700000000000, "tag_list": [{"name": "x"}, "y"]},
        {"note_id": "2", "create_time": 1700000000},
    ]}}
    rows = P.normalize_posts(captures(spark, "xiaohongshu", "posts", body), "xiaohongshu").collect()
    assert len({r.timestamp for r in rows}) == 1
    assert next(r for r in rows if r.id == "1").hashtags == ["x", "y"]


def test_instagram_shapes_prefer_different_ids(spark):
    body = {"data": {"user": {"edge_owner_to_timeline_media": {"edges": [{"node": {"id": "n", "pk": "p"}}]}}},
            "items": [{"id": "i", "pk": "q", "caption": {"text": "Hi #One #two"}}]}
    rows = {r.id: r for r in P.normalize_posts(captures(spark, "instagram", "posts", body), "instagram").collect()}
    assert set(rows) == {"n", "q"} and rows["q"].hashtags == ["One", "two"]
    assert rows["n"].engagement.shares is None


def test_youtube_id_may_be_text_or_object(spark):
    body = {"items": [{"id": "v1", "statistics": {"likeCount": "9"}}, {"id": {"videoId": "v2"}, "snippet": {"title": "A #Été"}}]}
    rows = {r.id: r for r in P.normalize_posts(captures(spark, "youtube", "posts", body), "youtube").collect()}
    assert rows["v1"].engagement.likes == 9 and rows["v2"].hashtags == ["#été"]


MOLTBOOK_SEARCH = {"posts": [
    {"id": "post-001", "title": "Best tools", "body": "A review.", "created_at": "2025-12-01T10:00:00Z",
     "community": {"name": "technology"}, "author": {"id": "u1", "username": "techfan", "verified": False},
     "score": 42, "comment_count": 15, "url": "https://m/1", "tags": ["ai", "research"]},
    {"id": "post-002", "title": "Comparison", "author": {"id": "u2", "username": "ml"}, "score": 78, "community": {"name": "ml"}},
]}
MOLTBOOK_COMMENTS = {"comments": [
    {"id": "c1", "body": "Great", "author": {"id": "u3", "username": "one"}, "score": 10, "upvotes": 12, "downvotes": 2,
     "replies": [{"id": "c1-r1", "body": "Agreed", "author": {"id": "u4", "username": "replier1"}, "score": 3, "replies": []}]},
    {"id": "c2", "body": "Could improve", "author": {}, "score": 5, "replies": []},
]}


def test_moltbook_search(spark):
    rows = P.normalize_posts(captures(spark, "moltbook", "posts", MOLTBOOK_SEARCH, {"posts": []}), "moltbook", "search").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.id)] == ["post-001", "post-002"]
    first, second = sorted(rows, key=lambda r: r.id)
    assert first.author.username == "techfan" and first.hashtags == ["ai", "research"]
    assert second.content == "Comparison" and second.url == "https://moltbook.com/m/ml/posts/post-002"


def test_moltbook_lists_differ_by_endpoint(spark):
    c = captures(spark, "moltbook", "posts", {"results": [{"id": "r"}], "data": [{"id": "d"}]})
    ids = {e: [r.id for r in P.normalize_posts(c, "moltbook", e).collect()] for e in P.MOLTBOOK_LISTS}
    assert ids == {"search": ["r"], "trending": ["d"], "user": ["d"]}


def test_moltbook_comments_flatten_to_three(spark):
    df = M.normalize_threads(captures(spark, "moltbook", "comments", MOLTBOOK_COMMENTS), "moltbook")
    rows = threads.preorder(df, 50).collect()
    assert [r.comment_id for r in rows] == ["c1", "c1-r1", "c2"]
    assert rows[1].parent_comment_id == "c1" and rows[1].depth == 1
    assert rows[2].author.username == "anonymous" and rows[0].upvotes == 12
    assert threads.preorder(df, 2).count() == 2


def nested(depth):
    node = {"cid": f"c{depth}", "text": "t"}
    for i in reversed(range(depth)):
        node = {"cid": f"c{i}", "text": "t", "reply_comment": [node, {"text": "no id"}]}
    return node


def test_depths_and_what_lies_deeper(spark):
    body = {"comments": [nested(12)]}
    rows = {r.comment_id: r for r in M.normalize_threads(captures(spark, "tiktok", "comments", body), "tiktok", 10).collect()}
    assert set(rows) == {f"c{i}" for i in range(11)}
    assert rows["c10"].has_deeper and not rows["c9"].has_deeper
    assert rows["c10"].path == [0] * 11 and rows["c10"].thread_root_id == "c0"
    all_rows = M.normalize_threads(captures(spark, "tiktok", "comments", body), "tiktok", 12)
    assert all_rows.count() == 13 and all_rows.filter("has_deeper").count() == 0
    assert M.normalize_threads(captures(spark, "tiktok", "comments", {"comments": [nested(30)]}), "tiktok").count() == 31


def reddit_chain(depth):
    data = {"id": f"r{depth}", "body": "t", "replies": ""}
    for i in reversed(range(depth)):
        children = [{"kind": "more", "data": {"id": "m"}}, {"kind": "t1", "data": data}]
        data = {"id": f"r{i}", "body": "t", "replies": {"data": {"children": children}}}
    return [{}, {"data": {"children": [{"kind": "t1", "data": data}]}}]


def test_every_level_of_long_chains_is_read(spark):
    forked = nested(14)
    forked["reply_comment"].insert(0, {"cid": "early", "text": "t", "reply_comment": [{"cid": "early-r", "text": "t"}]})
    df = captures(spark, "tiktok", "comments", {"comments": [forked, nested(0) | {"cid": "flat"}]}).unionByName(
        captures(spark, "reddit", "comments", reddit_chain(34)).withColumn("capture_id", F.lit("q"))
    )
    alone = M.normalize_threads(df, "tiktok", None)
    both = M.normalize_all_comments(df)
    assert both.filter("has_deeper").count() == 0 and both.columns == M.normalize_threads(df, "tiktok").columns
    rows = {r.comment_id: r for r in both.filter("platform = 'tiktok'").collect()}
    assert set(rows) == {f"c{i}" for i in range(15)} | {"early", "early-r", "flat"} and alone.count() == 18
    for i in range(15):
        row = rows[f"c{i}"]
        assert row.depth == i and row.path == [0] + [1] * min(i, 1) + [0] * (i - 1) and row.thread_root_id == "c0"
        assert row.parent_comment_id == (f"c{i - 1}" if i else None) and row.reply_count == (0 if i == 14 else 2 if i == 0 else 1)
    chain = {r.comment_id: r for r in both.filter("platform = 'reddit'").collect()}
    assert set(chain) == {f"r{i}" for i in range(35)}
    assert all(chain[f"r{i}"].parent_comment_id == f"r{i - 1}" and chain[f"r{i}"].depth == i for i in range(1, 35))


def test_reddit_replies_may_be_blank(spark):
    body = [{}, {"data": {"children": [
        {"kind": "t1", "data": {"id": "a", "body": "x", "replies": ""}},
        {"kind": "t1", "data": {"id": "b", "body": "y", "replies": {"data": {"children": [
            {"kind": "t1", "data": {"id": "b1", "body": "z", "replies": ""}}, {"kind": "more", "data": {"id": "m"}}]}}}},
        {"kind": "more", "data": {"id": "n"}},
    ]}}]
    rows = M.normalize_threads(captures(spark, "reddit", "comments", body), "reddit").collect()
    assert sorted(r.comment_id for r in rows) == ["a", "b", "b1"]


def test_instagram_comment_seen_in_both_shapes_counts_once(spark):
    tree = {"data": {"shortcode_media": {"edge_media_to_comment": {"edges": [{"node": {"id": "1", "text": "tree"}}]}}}}
    flat = {"comments": [{"pk": "1", "text": "flat"}, {"pk": "2", "text": "only flat"}]}
    rows = M.normalize_threads(captures(spark, "instagram", "comments", tree, flat), "instagram").collect()
    assert {r.comment_id: r.text for r in rows} == {"1": "tree", "2": "only flat"}


def test_patterns_in_declared_order(spark):
    df = spark.createDataFrame([("https://h/v1/search/api/comment/list/",)], "url STRING")
    row = df.select(K.matched_pattern(F.col("url"), K.URL_PATTERNS["tiktok"]).alias("p")).first()
    assert row.p == "/api/comment/list/"


def test_page_text(spark):
    html = "<html><head><title>no</title></head><body><!-- c --><h1>Head</h1><script>var a='<p>'</script><p>One &amp; <b>two</b></p><ul><li>x</li></ul></body></html>"
    df = spark.createDataFrame([(html,)], "h STRING")
    assert df.select(page_text(F.col("h")).alias("t")).first().t == "Head\nOne & two\nx"


def test_guards():
    for bad in ("", "   ", None):
        with pytest.raises(ValueError):
            search.check_text(bad, "search query")
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            search.check_limit(bad)
    assert search.check_limit(1) == 1 and search.check_limit(1000) == 1000
    assert search.per_platform_limit(30) == 5 and search.per_platform_limit(None) == 10


def test_result_table_by_platform(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/out"
    df = P.normalize_posts(captures(spark, "moltbook", "posts", MOLTBOOK_SEARCH), "moltbook", "search")
    sinks.write_result(df, path)
    back = spark.read.parquet(path)
    assert back.filter("platform = 'moltbook'").count() == 2


def test_envelope_keeps_order_and_count(spark):
    df = spark.createDataFrame([(str(i), i % 4) for i in range(12)], "id STRING, score INT")
    row = sinks.result_envelope(df, 5, "posts", [F.desc("score"), F.col("id")], platform="reddit").first()
    assert row["count"] == 5 and [p.id for p in row.posts] == ["11", "3", "7", "10", "2"]
    empty = sinks.result_envelope(df.limit(0), 5, "posts", [F.desc("score")], platform="reddit").first()
    assert empty["count"] == 0 and empty.posts == []


def test_contract(spark):
    good = P.normalize_posts(captures(spark, "moltbook", "posts", MOLTBOOK_SEARCH), "moltbook", "search")
    assert govern.post_violations(good).count() == 0
    bad = good.withColumn("engagement", F.col("engagement").withField("likes", F.lit(-1).cast("bigint")))
    assert {r.rule for r in govern.post_violations(bad).collect()} == {"engagement.likes"}
    missing = {r.platform for r in govern.missing_platforms(good, platform_dimension(spark)).collect()}
    assert missing == set(PLATFORMS) - {"moltbook"}


def test_whole_queries_see_all_platforms_and_depths(spark, sf):
    run = lambda name: entry.queries()[name](spark, sf)
    assert {r.platform for r in run("capture_envelopes_all").select("platform").distinct().collect()} == set(PLATFORMS)
    levels = {(r.platform, r.depth) for r in run("comments_normalized_all").collect()}
    seen = run("comment_votes_and_reach_all").select("platform", "depth").distinct().collect()
    assert {(r.platform, r.depth) for r in seen} == levels and len(levels) == 18
    assert run("comment_payloads_all").count() == run("comments_normalized_all").agg(F.sum("comments")).first()[0]
    broken = run("comment_contract_violations_all").select("platform").distinct().collect()
    assert {r.platform for r in broken} == set(PLATFORMS) - {"twitter", "youtube"}  # these two end above depth 2


def test_unknown_platform_is_kept_for_inspection(spark):
    assert P.unsupported(captures(spark, "friendster", "posts", {})).count() == 1


def test_failed_source_does_not_stop_the_others(spark):
    good = spark.range(3)

    def broken():
        raise OSError("gone")

    union, found, errors = search.union_available({"a": lambda: good, "b": broken})
    assert union.count() == 3 and found == {"a": True, "b": False} and errors == {"b": "gone"}
    assert search.union_available({"b": broken}, "stop")[:2] == (None, {})


def test_captures_with_a_long_common_head_all_stay(spark):
    head = '{"envelope": "' + "x" * 300 + '", "items": '
    rows = [(f"c{i}", "tiktok", f"https://t.com/api/post/item_list/?cursor={i}", f"{head}[{i % 3}]}}", i) for i in range(6)]
    df = spark.createDataFrame(rows, "capture_id STRING, platform STRING, url STRING, body STRING, t INT").withColumn(
        "captured_at", F.timestamp_seconds("t")
    )
    kept = K.dedup_captures(df)
    assert {r.capture_id for r in kept.collect()} == {"c0", "c1", "c2"}
    exchanges = [x for x in kept._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in x]
    assert exchanges


def test_the_same_capture_read_twice_stays_once(spark):
    rows = [("c0", "a", 5), ("c0", "a", 5), (None, "b", 6), (None, "b", 6), ("c3", "b", 7), ("c4", "c", None), ("c4", "c", 9), ("c5", "d", 1), ("c6", "d", 1)]
    df = spark.createDataFrame([(i, "tiktok", "https://t.com/x", b, t) for i, b, t in rows], "capture_id STRING, platform STRING, url STRING, body STRING, t INT")
    df = df.withColumn("captured_at", F.timestamp_seconds("t")).drop("t")
    kept = K.dedup_captures(df.repartition(4))
    assert kept.columns == df.columns
    found = sorted((r.body, r.capture_id or "", r.captured_at is None) for r in kept.collect())
    assert found == [("a", "c0", False), ("b", "", False), ("c", "c4", True), ("d", "c5", False)]


def test_reddit_authors_given_as_objects(spark):
    gold = {"id": "t2_1", "name": "ann", "display_name": "Ann", "is_gold": True, "icon_img": "i.png", "public_description": "hi"}
    children = [{"data": {"id": str(i), "selftext": "x", "author": a, "permalink": "/r"}} for i, a in enumerate([gold, {"name": "bob"}, "carl", {}, None])]
    posts = P.normalize_posts(captures(spark, "reddit", "posts", {"data": {"children": children}}), "reddit")
    found = {r.id: tuple(r.author) for r in posts.collect()}
    assert found["0"] == ("t2_1", "ann", "Ann", 0, True, "i.png", "hi")
    assert found["1"] == ("bob", "bob", "bob", 0, False, "", "")
    assert found["2"] == ("carl", "carl", "carl", None, None, None, None)
    assert found["3"] == ("", "", "", 0, False, "", "") and found["4"] == ("", "", "", None, None, None, None)
    listing = [{}, {"data": {"children": [{"kind": "t1", "data": {"id": "c", "body": "t", "author": gold, "replies": ""}}]}}]
    comment = one(M.normalize_threads(captures(spark, "reddit", "comments", listing), "reddit"))
    assert tuple(comment.author) == ("t2_1", "ann", "Ann", 0, True, "i.png", "hi")
