import hashlib
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from folioworks.functions import text as t

NORMAL = [
    ("الحضـــانة", "الحضانة"), ("أ    ب", "أ ب"), ("أ\n\n\n\nب", "أ\n\nب"), ("أ‏ب", "أب"), ("ﻻ", "لا"),
    ("  a \t b \r\n  c\r\rd ", "a b\nc\n\nd"), ("", ""), (" \n\t ", ""), ("x ", "x"),
]


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, [a for a, _ in NORMAL] + [None], t.normalize_text) == [b for _, b in NORMAL] + [None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aأبـ \t\n\r‏ﻻé ", max_size=30), min_size=20, max_size=40))
def test_normalize_is_idempotent(spark, texts):
    once = column(spark, texts, t.normalize_text)
    assert column(spark, once, t.normalize_text) == once


def test_digest_and_point_id(spark):
    texts = ["abc", "الحضانة", "x" * 1000]
    assert column(spark, texts, t.content_digest) == [hashlib.sha256(unicodedata.normalize("NFKC", x).encode()).hexdigest() for x in texts]
    assert column(spark, texts, t.point_id) == [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") & (1 << 63) - 1 for x in texts]


@pytest.mark.parametrize(
    ("make", "given_", "wanted"),
    [
        (t.slug, "  مادة ٣-ب / x  ", "مادة-3-ب-X"), (t.slug, "///", "OBJECT"), (t.short_key, "a / b // ج", "a_b_ج"), (t.clean_label, "أولاً — 3- ب: النص", "النص"),
        (t.plain_word, "أحكـام الشريعة", "احكام الشريعه"), (t.search_word, "«المدنية»", "مدنيه"), (t.search_word, "الحق", "الحق"), (t.fold_digits, "١٢٣", "123"), (t.first_line, "\n \n b \n", "b"),
        (t.safe_stem, "a/b:c  d", "abc d"),
    ],
)
def test_expressions(spark, make, given_, wanted):
    assert column(spark, [given_], make) == [wanted]


def test_merge_is_right_biased(spark):
    frame = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"x": "1"}), ({"y": "1"}, None)], "o map<string,string>, p map<string,string>")
    assert [dict(r.m) for r in frame.select(t.merged(F.col("o"), F.col("p")).alias("m")).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "1"}, {"y": "1"}]


def test_archive_names(spark):
    frame = spark.createDataFrame([("BATCH-20240102-030405-0123abcd-DUPLICATE_law.md",), ("BATCH-20240102-030405-0123abcd_law.md",), ("odd.md",)], "x string")
    got = [tuple(r) for r in frame.select(*(c.alias(n) for n, c in t.parse_batch_name(F.col("x")).items())).collect()]
    assert [(bool(g[0]), g[1], g[2]) for g in got] == [(True, True, "law.md"), (True, False, "law.md"), (False, False, "odd.md")]
