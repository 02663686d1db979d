"""Queries on files: packed and read back, streamed through the inbox, exported, indexed anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from folioworks.operators import index
from folioworks.plans.ingest import canonical_files
from folioworks.plans.registry import Tables, query
from folioworks.session import forget_last_commit, shared_dir, staged
from folioworks.sources import exports, readers, writers
from folioworks.streaming import inbox

LINES_SQL = "array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
EXTENSIONS = (".txt", ".html", ".docx", ".md", ".rtf", ".docx")
START = "timestamp '2024-01-01'"


@query(f"""
with f as (select doc_id, doc_id % 6 as k, {LINES_SQL} as body, lang, source from documents)
select doc_id, case when k < 4 and body <> '' then body end as body, case when k < 4 and body <> '' and doc_id % 2 = 0 then source end as title, case when k < 4 and body <> '' and doc_id % 2 = 0 then lang end as branch,
  case when k = 4 then 'unsupported extension .rtf' when k = 5 then 'BadZipFile: File is not a zip file' when body = '' then 'empty after normalisation' end as reason from f
""")
def file_round_trip(d: Tables) -> DataFrame:
    """S-01 to S-03, S-05 to S-08: every document as a file of one of six kinds (one without a
    reader, one broken), every second one with a sidecar, written, read back and decoded."""
    k = F.pmod("doc_id", F.lit(6)).cast("int")
    path = F.concat(F.lit("inbox/"), F.col("doc_id").cast("string"), F.get(F.array(*map(F.lit, EXTENSIONS)), k))
    side = F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("source").alias("title"), F.col("lang").alias("branch")))
    whole = writers.file_rows(d.documents.where(k < 5), path, F.col("text"), F.expr(START), side)
    broken = d.documents.where(k == 5).select(path.alias("path"), F.expr(START).alias("modificationTime"), F.col("text").cast("binary").alias("content"))
    broken = broken.select("path", "modificationTime", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("length"), "content")
    docs, rejects = canonical_files(staged(whole.unionByName(broken), "files"))
    told = docs.select("path", "body", "title", "branch", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("path", "reason"), allowMissingColumns=True)
    return told.select(F.regexp_extract("path", r"inbox/(\d+)\.", 1).cast("long").alias("doc_id"), "body", "title", "branch", "reason")


@query(f"""
with f as (select doc_id, {LINES_SQL} as body from documents),
groups as (select 'SRC-' || left(sha256(body), 16) as source_key, count(*) as copies, min(body) as body from f where body <> '' group by 1)
select source_key, 1::bigint as completed, copies - 1 as duplicates, 1::bigint as objects, length(body)::bigint as n_chars, 0::bigint as failed from groups
union all select null, 0, 0, 0, 0, count(*) from f where body = '' having count(*) > 0
""")
def stream_inbox(d: Tables) -> DataFrame:
    """R-01, R-02, R-06: all documents as files through the inbox in three micro-batches, the
    last of which runs twice; copies are duplicates, also of files in other micro-batches."""
    at = f"{shared_dir(d.spark)}/inbox-{uuid.uuid4().hex}"
    path = F.concat(F.lit("inbox/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = writers.file_rows(d.documents, path, F.col("text"), F.expr(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("doc_id", F.lit(60)).cast("decimal(18,6)")))
    n_bytes = d.documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    at_once = inbox.pack(files, f"{at}/packed", n_bytes, 3)
    last = None
    for _ in range(2):
        inbox.watch_inbox(d.spark, inbox.packed_files(d.spark, f"{at}/packed", at_once), at, f"{at}/log").awaitTermination()
        last = forget_last_commit(d.spark, f"{at}/log")
    tables = inbox.current_tables(d.spark, at, last)
    batches, objects, sources = tables["ingestion_batches"], tables["knowledge_objects"], tables["sources"]
    count = lambda status: F.sum(F.when(F.col("status") == status, 1).otherwise(0))
    told = batches.groupBy("source_key").agg(count("completed").alias("completed"), count("duplicate").alias("duplicates"), count("failed").alias("failed"))
    held = objects.groupBy("source_key").agg(F.count("*").alias("objects"), F.sum(F.length("original_text")).alias("n_chars"))
    met = told.join(held, "source_key", "left").join(sources.select("source_key", F.lit(True).alias("known")), "source_key", "left")
    sound = met.where("known or source_key is null")  # a batch of a source that the tables lack would be missing here
    return sound.select("source_key", "completed", "duplicates", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("objects", "n_chars")), "failed")


@query(f"""
with f as (select doc_id, lang, {LINES_SQL} as body, sha256(coalesce(text, '')) as raw from documents)
select case when body = '' then 'failed' when doc_id % 7 = 0 then 'duplicate' else 'archive' end as outcome, 'doc ' || doc_id as source_name, 'txt' as source_format, raw as source_sha256, 1 as normalizer_version, 0 as n_warnings, body from f
""")
def canonical_export(d: Tables) -> DataFrame:
    """S-10, S-13: canonical documents written as markdown, a folder an outcome, and read back."""
    rows = d.documents.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source_name"), F.lit(".txt").alias("ext"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    read = readers.with_blocks(rows.withColumn("raw", F.sha2("content", 256)))
    docs = readers.canonical(read, F.col("raw"))
    told = readers.outcome(docs, F.col("body") == "", F.pmod("doc_id", F.lit(7)) == 0)
    at = f"{shared_dir(d.spark)}/markdown-{uuid.uuid4().hex}"
    writers.write_markdown(told, at)
    return writers.read_markdown(d.spark, at).select("outcome", "source_name", "source_format", "source_sha256", "normalizer_version", F.size("warnings").alias("n_warnings"), "body")


@query("select role as kind, text as body, conv_id::varchar as \"appealNo\", turn::bigint as \"createdAt\" from conversations")
def json_export(d: Tables) -> DataFrame:
    """S-15: entries written as JSON lines in files of a bounded size, and read back."""
    entries = d.conversations.select(F.col("role").alias("kind"), F.col("text").alias("body"), F.col("conv_id").cast("string").alias("appealNo"), F.col("turn").cast("long").alias("createdAt"))
    at = f"{shared_dir(d.spark)}/entries-{uuid.uuid4().hex}"
    writers.write_entries(entries, at)
    return writers.read_entries(d.spark, at).select("kind", "body", "appealNo", "createdAt")


@query("""
with o as (select doc_id, case when doc_id % 31 = 0 then 'query: ' || text when doc_id % 37 = 0 then 'passage: ' || text else text end as text from documents where text is not null),
p as (select doc_id, case when doc_id % 37 = 0 and doc_id % 31 > 0 then text else 'passage: ' || text end as passage from o where doc_id % 31 > 0)
select 'point' as kind, doc_id::varchar as key, sha256(passage) as content_hash, case when doc_id % 47 = 0 then -1 else length(passage) end::double as size, case when doc_id % 47 = 0 then -1 else length(passage) - length(replace(passage, 'e', '')) end::double as n_e from p where doc_id % 41 > 0 and doc_id % 43 > 0
union all select 'rejected', doc_id::varchar, null, null, null from o where doc_id % 31 = 0
union all select 'missing', doc_id::varchar, null, null, null from o where doc_id % 41 = 0 or doc_id % 31 = 0
union all select 'changed', doc_id::varchar, null, null, null from p where doc_id % 43 = 0 and doc_id % 41 > 0
union all select 'vectorless', doc_id::varchar, null, null, null from p where doc_id % 47 = 0 and doc_id % 41 > 0
union all select 'stray', (doc_id + 10000000)::varchar, null, null, null from p where doc_id % 53 = 0 and doc_id % 41 > 0
""")
def index_rebuild(d: Tables) -> DataFrame:
    """M-11, S-22: all points anew, some of them spoilt on the way to the table (dropped, made of
    another text, without a vector, of an object that is gone): the check of what was written
    finds each one. Vectors are two counts of the passage's characters."""
    text = F.when(F.col("doc_id") % 31 == 0, F.concat(F.lit("query: "), "text")).when(F.col("doc_id") % 37 == 0, F.concat(F.lit("passage: "), "text")).otherwise(F.col("text"))
    objects = d.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("id"), text.alias("original_text"))

    def encoder():
        return lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts]

    def spoil(points: DataFrame) -> DataFrame:
        n = F.col("object_id").cast("long")
        kept = points.where(n % 41 > 0)
        bad = kept.withColumn("content_hash", F.when(n % 43 == 0, F.sha2(F.lit("another"), 256)).otherwise(F.col("content_hash"))).withColumn("vector", F.when(n % 47 > 0, F.col("vector")))
        gone = kept.where(n % 53 == 0).withColumn("object_id", (n + 10_000_000).cast("string"))
        return bad.unionByName(gone)

    points, rejected, wrong = index.rebuilt(objects, encoder, "counts", "1", spoil)
    n = F.col("object_id").cast("long")
    sound = points.where((n % 43 > 0) & (n < 10_000_000)).select(F.lit("point").alias("kind"), F.col("object_id").alias("key"), "content_hash", *(F.coalesce(F.col("vector")[i], F.lit(-1.0)).cast("double").alias(c) for i, c in enumerate(("size", "n_e"))))
    rest = rejected.select(F.lit("rejected").alias("kind"), F.col("id").alias("key")).unionByName(wrong.select(F.col("side").alias("kind"), "key"))
    return sound.unionByName(rest, allowMissingColumns=True)


@query("select text as k, (item_id % 7)::varchar as reference from benchmark union all select lang || ' ' || source, null from documents group by 1")
def reference_keys(d: Tables) -> DataFrame:
    """S-17: reference keys as files of JSON arrays, read back; a key without a reference has null."""
    keys = d.benchmark.select(F.col("text").alias("k"), (F.col("item_id") % 7).cast("string").alias("r"))
    keys = keys.unionByName(d.documents.select(F.concat_ws(" ", "lang", "source").alias("k")).distinct(), allowMissingColumns=True)
    at = f"{shared_dir(d.spark)}/keys-{uuid.uuid4().hex}"
    files = keys.groupBy(F.pmod(F.xxhash64("k"), F.lit(16)).alias("file")).agg(F.to_json(F.collect_list(F.struct("k", "r"))).alias("value"))
    files.select("value", "file").write.partitionBy("file").text(at)
    return exports.reference_keys(d.spark, f"{at}/*")
