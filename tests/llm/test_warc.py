import random

from sigmill.llm import warc


def captures(spark, rows):
    return spark.createDataFrame(rows, warc.CAPTURE)


def response(i, url, ts, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, "response", etag, modified, digest, headers)


def revisit(i, url, ts, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, "revisit", etag, modified, digest, headers)


def test_statuses_and_headers(spark):
    rows = [
        response(1, "http://www.A.com/x/", 10, '"1"', "m1", "d1", [("Content-Length", "9"), ("Cache-Control", "a"), ("ETag", '"1"')]),
        response(2, "https://a.com:443/x?utm_source=f#z", 20, '"2"', "m2", "d2", [("X", "1"), ("x", "2"), ("Y", None)]),
        revisit(11, "a.com/x", 15, 'W/"1"', None, None, [("content-length", "0"), ("CACHE-control", "b"), ("Date", "t")]),
        revisit(12, "a.com/x", 20, '"1"'), revisit(13, "a.com/x", 25, '"1"'), revisit(14, "a.com/x", 100_000, None, "m2"), revisit(15, "a.com/x", 26, None, None, "d2"), revisit(16, "a.com/x", 27),
        revisit(17, "a.com/x", 10, '"1"'), revisit(18, "b.com/x", 30, '"1"'), revisit(19, None, 30), revisit(20, "a.com/x", None), revisit(13, "a.com/x", 25, '"1"'),
    ]
    found = warc.resolve(captures(spark, rows)).collect()
    assert len(found) == 11
    by = {r["revisit_id"]: r for r in found}
    assert {k: (r["response_id"], r["status"]) for k, r in by.items()} == {
        11: (1, "resolved"), 12: (1, "resolved"), 13: (2, "validator_mismatch"), 14: (2, "resolved"), 15: (2, "resolved"), 16: (2, "unvalidated"),
        17: (None, "no_earlier_response"), 18: (None, "no_earlier_response"), 19: (None, "no_earlier_response"), 20: (None, "no_earlier_response"),
    }
    assert by[11]["headers"] == 'cache-control: b\ncontent-length: 9\ndate: t\netag: "1"'
    assert by[14]["headers"] == "x: 2" and by[14]["payload_digest"] == "d2"


def test_hot_url_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(response if rng.random() < 0.3 else revisit)(i, rng.choice(["h.com/a", "h.com/a", "h.com/b"]), rng.randrange(0, 400)) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a URL spans chunks
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = {r["revisit_id"]: r["response_id"] for r in warc.resolve(captures(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, u, t, k, *_ in rows if k == "response" and u == url and t < ts]
            assert found[i] == (max(earlier)[1] if earlier else None)


def test_empty(spark):
    assert warc.resolve(captures(spark, [])).collect() == []
    pages = spark.createDataFrame([(1, None, None), (None, "a.com", "x"), (2, "http://a.com/", "")], "page_id long, url string, html string")
    assert len(warc.resolve(warc.page_captures(pages)).collect()) == 3


def test_extra_columns_long_headers_and_an_empty_table(spark):
    from pyspark.sql import functions as F

    long = [("X-Long", "v" * 1_000_000), *[(f"h{k}", str(k)) for k in range(2000)]]
    rows = [response(1, "a.com/x", 10, '"1"', None, "d", long), response(1, "a.com/x", 10, '"1"', None, "d", long), revisit(11, "a.com/x", 15, '"1"', headers=[("h7", "new")])]
    clashing = captures(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("curl", "_key", "chunk", "near", "far", "last", "hit", "status", "revisit_id")])
    found = warc.resolve(clashing).collect()
    lines = found[0]["headers"].split("\n")
    assert len(found) == 1 and found[0]["status"] == "resolved" and len(lines) == 2001 and "h7: new" in lines and f"x-long: {'v' * 1_000_000}" in lines
    assert warc.resolve(captures(spark, [])).collect() == []
