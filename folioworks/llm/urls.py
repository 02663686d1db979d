"""URL filters by a sorted digest array.

Rules are kept as one file: the 64-bit xxhash keys in order, where each string begins, and
the strings. Executors fetch the file and map it into memory, so that a machine holds it once
for all its workers. A url's possible rules (each domain suffix with each path prefix of a
length that occurs) are hashed and looked up in one vectorised binary search per batch; a
digest that is found counts only if the stored string is the same.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioworks.session import shared_dir

SEED = 42
#: Larger rule sets are joined on digests instead: the file is made on the driver, where a rule's row takes many times its bytes.
LOCAL_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From there up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_rules(rules: DataFrame) -> DataFrame:
    """(rule, verdict) to rule, verdict, host, path, key and its digest; one row a key: of
    several verdicts for one key, block. Null rules and verdicts drop out."""
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    parts = rules.where("rule is not null and verdict is not null").select("rule", "verdict", host.alias("host"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("path"))
    keyed = parts.withColumn("key", F.concat("host", "path")).groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
    return keyed.withColumn("digest", F.xxhash64("key"))


def _record(key: str, rule: str, verdict: str) -> bytes:
    k, r = key.encode(), rule.encode()
    return struct.pack("<II", len(k), len(r)) + k + r + verdict.encode()


class DigestFile:
    """Layout, little-endian: n and the number of path lengths; the lengths; n digests in
    order; n + 1 starts of records; records: bytes of key and rule, then key, rule, verdict."""

    @staticmethod
    def pack(rows: list[tuple[str, str, str, str]]) -> bytes:
        """rows: key, rule, verdict, path."""
        keyed = sorted((xxhash.xxh64_intdigest(k.encode(), SEED), _record(k, rule, verdict)) for k, rule, verdict, _ in rows)
        lengths = sorted({len(path) for *_, path in rows})
        labels = max((k.removesuffix(path).count(".") + 1 for k, _, _, path in rows), default=0)
        starts = np.cumsum([0, *(len(x) for _, x in keyed)])
        numbers = [len(keyed), len(lengths), labels, *lengths, *(h for h, _ in keyed), *starts.tolist()]
        return np.array(numbers, "<u8").tobytes() + b"".join(x for _, x in keyed)

    def __init__(self, path: str):
        words = np.memmap(path, np.uint8, "r")
        n, m, self.labels = (int(x) for x in words[:24].view("<u8"))
        head = words[24 : 24 + 8 * (m + n + n + 1)].view("<u8")
        self.lengths, self.digests, self.starts = head[:m].tolist(), head[m : m + n], head[m + n :]
        self.records = words[24 + 8 * (m + n + n + 1) :]

    def record(self, i: int) -> tuple[str, str, str]:
        data = bytes(self.records[int(self.starts[i]) : int(self.starts[i + 1])])
        k, r = struct.unpack_from("<II", data)
        return data[8 : 8 + k].decode(), data[8 + k : 8 + k + r].decode(), data[8 + k + r :].decode()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest rule that fits each url, and its verdict."""
        owner, keys = [], []
        for n, (host, path) in enumerate(zip(hosts, paths)):
            prefixes = [path[:k] for k in self.lengths if k <= len(path)]
            suffix = None
            for label in reversed(host.rsplit(".", self.labels)[-self.labels :] if self.labels else []):  # no rule has more labels
                suffix = label if suffix is None else f"{label}.{suffix}"
                keys += [suffix + p for p in prefixes]
                owner += [n] * len(prefixes)
        rules, verdicts, best = [None] * len(hosts), [None] * len(hosts), [(-1, -1)] * len(hosts)
        if not keys:
            return rules, verdicts
        hashed = np.fromiter((xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys), np.uint64, len(keys))
        low, high = np.searchsorted(self.digests, hashed, "left"), np.searchsorted(self.digests, hashed, "right")
        for c in np.flatnonzero(low < high):
            for i in range(low[c], high[c]):
                key, rule, verdict = self.record(i)
                rank = (len(key), len(key.split("/")[0]))
                if key == keys[c] and rank > best[owner[c]]:
                    best[owner[c]], rules[owner[c]], verdicts[owner[c]] = rank, rule, verdict
        return rules, verdicts


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestFile:
    return DigestFile(SparkFiles.get(name))


def _sent(spark: SparkSession, rows: list) -> str:
    """Writes the file in the shared folder and has executors fetch it; its name."""
    name = f"urls-{uuid.uuid4().hex}.digests"
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/{name}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(at)
    out.write(DigestFile.pack(rows))
    out.close()
    store.deleteOnExit(at)
    spark.sparkContext.addFile(path)
    return name


def _by_lookup(urls: DataFrame, rules: DataFrame) -> DataFrame:
    spark = urls.sparkSession
    name = _sent(spark, [(r.key, r.rule, r.verdict, r.path) for r in rules.select("key", "rule", "verdict", "path").collect()])

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        digests = _opened(name)
        for hosts, paths in batches:
            found = digests.judge(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": pd.Series(found[0], dtype=object), "verdict": pd.Series(found[1], dtype=object)})

    return urls.withColumn("_found", judged("host", "path")).select("*", "_found.*").drop("_found")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rule sets of any size: candidates meet rules by digest and string."""
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().collect()]  # at most a url's length
    most = rules.agg(F.max(F.regexp_count("host", F.lit(r"\."))).alias("n")).first().n or 0
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, most + 2))))  # no rule has more labels
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths or [0])), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = urls.select("host", "path").distinct()
    tried = asked.select("host", "path", F.explode(keys).alias("key")).withColumn("digest", F.xxhash64("key"))
    met = tried.join(rules.select("key", "digest", "rule", "verdict", F.length("host").alias("n")), ["digest", "key"])
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("key"), "n")).alias("_found"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "_found.rule", "_found.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", local_bytes: int = LOCAL_BYTES, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict (then ``default``:
    a url of which no rule is in the array is not filtered).

    A rule, like example.net/en/, fits its host and all subdomains where the path starts with
    the rule's; the longest wins, of equal ones that with the longer host. Null urls and those
    without :// have empty host and path. Rows are judged one by one: repeated rows agree,
    empty tables of pages or rules are allowed, and columns of the same names are replaced.
    """
    kept = pages.drop("host", "path", "rule", "verdict")
    urls = kept.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    known = normal_rules(rules)
    size = known.agg(F.sum(F.length("key") + F.length("rule") + 40).alias("n")).first().n or 0
    found = _by_lookup(urls, known) if size <= local_bytes else _by_join(urls, known)
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


ORACLE_SQL = r"""
with rules(rule, verdict) as (values ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
parts as (select rule, verdict, regexp_extract(rule, '^[^/]*') as rule_host, regexp_extract(rule, '^[^/]*(.*)$', 1) as rule_path from rules),
urls as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages
),
met as (
  select page_id, host, path, rule, verdict, row_number() over (partition by page_id, host, path order by length(rule) desc nulls last, length(rule_host) desc) as n
  from urls left join parts on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from met where n = 1
"""
