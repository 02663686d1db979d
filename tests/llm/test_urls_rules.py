"""Rules with tabs and line ends, repeated pages and very long urls."""

import pytest

from folioworks.llm import urls


@pytest.mark.parametrize("local_bytes", [urls.LOCAL_BYTES, 0])
def test_any_characters_in_rules(spark, local_bytes):
    rules = spark.createDataFrame([("a.com/x\ty/", "block"), ("b.com/\n", "block"), ("é.org/", "block\tsoft")], "rule string, verdict string")
    long = "http://www.a.com/" + "p/" * 50_000
    rows = [(1, "http://a.com/x\ty/z"), (1, "http://a.com/x\ty/z"), (2, "http://b.com/\nq"), (3, "http://w.é.org/"), (4, long), (5, "http://a.com/x")]
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, local_bytes=local_bytes).collect())
    assert got == [(1, "a.com/x\ty/", "block")] * 2 + [(2, "b.com/\n", "block"), (3, "é.org/", "block\tsoft"), (4, None, "allow"), (5, None, "allow")]
