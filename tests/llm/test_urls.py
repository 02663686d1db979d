import pytest

from folioworks.llm import urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("org/fr/", "block"), (None, "block")]
URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net/enx", "http://example.net", "http://xnet/", "x://y://net/", "http://a.b.org/fr/", "https://example.com/de/1", "https://badexample.com/de/1", "https://example.com?/de/", "http://net/#", "http://net/#"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = []
    for rule, verdict in RULES:
        if rule:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), verdict, rule))
    _, verdict, rule = max(fits, default=(0, "allow", None))
    return host, path, rule, verdict


@pytest.mark.parametrize("local_bytes", [urls.LOCAL_BYTES, 0])
def test_both_ways_equal_plain_rules(spark, local_bytes):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' as rule", "1 as key")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules, local_bytes=local_bytes).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert urls.judge_urls(pages.limit(0), rules, local_bytes=local_bytes).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0), local_bytes=local_bytes).collect()} == {"allow"}


def test_equal_digests_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda data, seed: 7)
    file = tmp_path / "x"
    file.write_bytes(urls.DigestFile.pack([("net/", "net/", "block", "/"), ("org/", "org/", "allow", "/")]))
    assert urls.DigestFile(str(file)).judge(["a.org", "a.com"], ["/", "/"]) == (["org/", None], ["allow", None])
