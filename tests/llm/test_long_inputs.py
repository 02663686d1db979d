"""Nothing that grows with the square of one text, host or file."""

import time
import tracemalloc
import zlib
from struct import pack

import pytest

from folioworks.llm import batches, media, simhash, toxicity, urls


def judged_in(labels):
    host = ".".join(["a"] * labels) + ".example.net"
    rows = [("example.net/en/", "example.net/en/", "allow", "/en/"), ("net/", "net/", "block", "/")]
    return host, rows


def test_hosts_of_20000_labels(tmp_path):
    host, rows = judged_in(20_000)
    (tmp_path / "f").write_bytes(urls.DigestFile.pack(rows))
    file = urls.DigestFile(str(tmp_path / "f"))
    start = time.process_time()
    assert file.judge([host, host, "net", "", "x" * 10**6 + ".net"], ["/en/x", "/", "/", "/", "/"]) == (["example.net/en/", "net/", "net/", None, "net/"], ["allow", "block", "block", None, "block"])
    assert time.process_time() - start < 0.5


@pytest.mark.parametrize("local_bytes", [urls.LOCAL_BYTES, 0])
def test_long_and_repeated_urls_both_ways(spark, local_bytes):
    host, _ = judged_in(3000)
    known = [(1, f"https://{host}/en/a"), (1, f"https://{host}/en/a"), (2, f"https://{host}/" + "p" * 100_000), (3, None), (4, "https://net/x"), (5, "https://EN.example.net/en/?q")]
    pages = spark.createDataFrame(known, "page_id long, url string")
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow")], "rule string, verdict string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, rules, local_bytes=local_bytes).collect())
    assert got == [(1, "example.net/en/", "allow"), (1, "example.net/en/", "allow"), (2, "net/", "block"), (3, None, "allow"), (4, "net/", "block"), (5, "example.net/en/", "allow")]


def png(width, height, stream):
    chunk = lambda kind, data: pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data))
    return media.SIGNATURE + chunk(b"IHDR", pack(">IIBBBBB", width, height, 8, media.GREY, 0, 0, 0)) + chunk(b"IDAT", stream) + chunk(b"IEND", b"")


def test_a_small_file_of_300_mb_is_refused_in_little_memory():
    squeeze = zlib.compressobj(9)
    stream = b"".join([squeeze.compress(bytes(1 << 20)) for _ in range(300)] + [squeeze.flush()])
    assert len(stream) < 400_000
    tracemalloc.start()
    with pytest.raises(ValueError, match="wrong number of samples"):
        media.opened(png(64, 64, stream))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    whole = zlib.compress(bytes(64 * 65))
    assert media.opened(png(64, 64, whole))[1] == 1
    with pytest.raises((ValueError, zlib.error)):
        media.opened(png(64, 64, whole[:-3]))


@pytest.mark.parametrize("use", [lambda d: simhash.with_fingerprints(d), lambda d: toxicity.learn_lexicons(d.selectExpr("text", "1 as toxic", "0 as fold"))])
def test_a_fresh_session_sends_texts_in_bounded_batches(spark, use):
    own = spark.newSession()
    assert own.conf.get(batches.SENT, None) is None
    use(own.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert int(own.conf.get(batches.SENT)) == batches.BYTES
