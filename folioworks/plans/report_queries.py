"""Queries that report: counts, coverage, gaps, retention, states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from folioworks.functions.text import clean_label
from folioworks.operators import reports
from folioworks.plans.registry import Tables, query
from folioworks.session import forget_last_commit, shared_dir
from folioworks.streaming import lifecycle
from folioworks.streaming.inbox import batch_states, completed_within, completion


@query("select lang, source, count(*) as n from documents group by all")
def counts_by_lang_source(d: Tables) -> DataFrame:
    return reports.counts_by(d.documents, "lang", "source")


@query("select case when p_size % 9 > 0 then p_brand end as brand, p_type, case when p_size % 2 = 0 then p_size end as size, count(*) as n from part group by all")
def topic_tree(d: Tables) -> DataFrame:
    rows = d.part.select(F.when(F.col("p_size") % 9 > 0, F.col("p_brand")).alias("brand"), "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"))
    return reports.topic_tree(rows, ["brand", "p_type", "size"])


@query("""
with r as (select coalesce(case when p_size % 9 > 0 then p_brand end, 'unclassified') as brand, p_type, count(*) as n from part group by all)
select brand, sum(n)::bigint as n, string_agg(p_type || ':' || n, ',' order by p_type) as topics from r group by brand
""")
def topics_of_branches(d: Tables) -> DataFrame:
    rows = d.part.select(F.when(F.col("p_size") % 9 > 0, F.col("p_brand")).alias("brand"), "p_type")
    topics = F.array_join(F.transform("topics", lambda x: F.concat_ws(":", x["p_type"], x["n"].cast("string"))), ",")
    return reports.topics_of_branches(rows, "brand", "p_type").select("brand", "n", topics.alias("topics"))


@query("select p_brand as topic, p_type as subtopic, count(*) as n, min(p_partkey) as first_pos from part group by all")
def preview_tree(d: Tables) -> DataFrame:
    rows = d.part.select(F.concat((F.col("p_partkey") % 20).cast("string"), F.lit(" - "), "p_brand").alias("topic"), F.concat(F.lit("- "), "p_type").alias("subtopic"), "p_partkey")
    return reports.preview_tree(rows, ["topic", "subtopic"], "p_partkey", clean_label)


@query("""
with k as (select o_custkey, count(*) filter (where o_orderpriority = '1-URGENT') as legislation, count(*) filter (where o_orderpriority = '2-HIGH') as principles, count(*) filter (where o_orderpriority = '5-LOW') as templates from orders group by 1),
c as (select c_custkey, coalesce(legislation, 0) as legislation, coalesce(principles, 0) as principles, coalesce(templates, 0) as templates from customer left join k on o_custkey = c_custkey)
select *, array_to_string(list_filter([case when legislation = 0 then 'legislation' end, case when principles = 0 then 'principles' end, case when templates = 0 then 'templates' end], lambda x: x is not null), ',') as missing,
  case when legislation > 0 and principles > 0 and templates > 0 then 'ready_for_grounded_draft' else 'blocked_missing_authorities' end as gate
from c
""")
def coverage_gate(d: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    kinds = {"legislation": p == "1-URGENT", "principles": p == "2-HIGH", "templates": p == "5-LOW"}
    objects = d.orders.withColumnRenamed("o_custkey", "c_custkey")
    return reports.coverage_gate(d.customer.select("c_custkey"), objects, ["c_custkey"], kinds).withColumn("missing", F.array_join("missing", ","))


@query("""
with c as (select l_orderkey, count(distinct l_linenumber) as n_parts, round(avg(l_discount * 10), 9) as mean, round(max(l_discount * 10), 9) as most, max(case when l_returnflag = 'R' and l_linestatus = 'O' then 1 else 0 end) as part from lineitem group by 1)
select l_orderkey, n_parts, part = 1 or case when n_parts > 1 then mean < 0.65 else most < 0.65 end as read_again from c
""")
def reading_trigger(d: Tables) -> DataFrame:
    # Confidence in whole hundredths: sums then don't depend on their order.
    rows = d.lineitem.select("l_orderkey", F.col("l_linenumber").alias("part"), F.round(F.col("l_discount") * 1000).cast("decimal(9,0)").alias("confidence"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "partial").otherwise("clean").alias("reading"))
    return reports.reading_trigger(rows, "l_orderkey", low=65).select("l_orderkey", "n_parts", "read_again")


@query("""
with p as (select o_custkey % 50 as g, o_orderkey // 7 as n, count(*) as copies from orders group by 1, 2),
m as (select *, lead(n) over (partition by g order by n) as nx from p),
stats as (select g, min(n) as least, max(n) as greatest, count(*) as n_distinct, count(*) filter (where copies > 1) as n_repeated, coalesce(sum(greatest(nx - n - 1, 0)), 0)::bigint as n_missing from m group by g),
numbered as (select *, (row_number() over (partition by g order by n) - 1) // 1000 as chunk from m where nx - n > 1),
chunks as (select g, chunk, string_agg((n + 1) || '-' || (nx - 1), ',' order by n) as gaps from numbered group by 1, 2)
select s.*, coalesce(chunk, 0)::int as chunk, coalesce(gaps, '') as gaps from stats s left join chunks c on c.g is not distinct from s.g
""")
def sequence_gaps(d: Tables) -> DataFrame:
    rows = d.orders.select((F.col("o_custkey") % 50).alias("g"), F.floor(F.col("o_orderkey") / 7).alias("k"))
    return reports.sequence_report(rows, "g", "k")


@query("""
with w as (select unnest(['the', 'und', 'que', 'zzz', 'idiot']) as word), hits as (select word, doc_id from w join documents on contains(text, word))
select word, count(*) as n, (select string_agg(doc_id::varchar, ',' order by doc_id) from (select doc_id from hits h where h.word = hits.word order by doc_id limit 2)) as examples from hits group by word
""")
def keyword_presence(d: Tables) -> DataFrame:
    return reports.keyword_presence(d.documents, ["the", "und", "que", "zzz", "idiot"], "text", "doc_id")


RETENTION_SQL = "select doc_id, sha256(text) as name, doc_id % 4 = 1 as dup, n_chars, row_number() over (partition by sha256(text) order by doc_id % 4 = 1, doc_id desc) = 1 as keep from documents"


@query(f"select name, coalesce(sum(n_chars) filter (where not keep), 0)::bigint as freed, count(*) filter (where not keep) as files, max(doc_id) filter (where keep) as kept from ({RETENTION_SQL}) group by name")
def retention(d: Tables) -> DataFrame:
    files = d.documents.select("doc_id", F.sha2("text", 256).alias("name"), (F.col("doc_id") % 4 == 1).alias("dup"), "n_chars")
    ranked, freed = reports.retention(files, "name", "dup", "doc_id", "n_chars")
    return freed.join(ranked.where("keep").select("name", F.col("doc_id").alias("kept")), "name")


TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n, count(*) = 0 as is_empty from {t}" for t in TABLE_NAMES))
def truth_report(d: Tables) -> DataFrame:
    return reports.table_counts({t: getattr(d, t) for t in TABLE_NAMES})


@query("select source, string_agg(doc_id::varchar, ',' order by doc_id) as ids, count(*) as n from documents group by source")
def id_lists(d: Tables) -> DataFrame:
    return reports.whole_id_list(d.documents, "source", "doc_id")


@query("select distinct case when doc_id % 9 > 0 then lang end as lang from documents where doc_id % 9 > 0")
def facet_values(d: Tables) -> DataFrame:
    return reports.facet(d.documents.select(F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("lang")), "lang")


@query("select count(*) filter (where p_type like 'S%')::bigint as n from part")
def prefix_total(d: Tables) -> DataFrame:
    return reports.prefix_total(d.part, "p_type", "S")


@query("""
select count(*) as n, sum(strlen('{' || array_to_string(list_filter(['"doc_id":' || doc_id, '"text":' || to_json(text), '"lang":' || to_json(lang), '"source":' || to_json(source), '"n_chars":' || n_chars], lambda x: x is not null), ',') || '}'))::bigint as bytes from documents
""")
def size_estimate(d: Tables) -> DataFrame:
    return reports.size_estimate(d.documents)


@query("select c_custkey as batch_id, count(o_orderkey) as object_count from customer left join orders on o_custkey = c_custkey group by 1")
def write_back_counts(d: Tables) -> DataFrame:
    b = d.customer.select(F.col("c_custkey").alias("batch_id"), F.lit(0).alias("object_count"))
    return reports.write_back_counts(b, d.orders.select(F.col("o_custkey").alias("batch_id")))


@query("select o_orderstatus as folder, count(*) as n from orders where o_orderkey % 3 > 0 group by 1")
def folder_counts(d: Tables) -> DataFrame:
    return reports.folder_counts(d.orders.select(F.col("o_orderstatus").alias("folder"), F.concat(F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, ".md.json").otherwise(".md")).alias("path")))


@query("""
with r as (select source, split_part(text, chr(10), 1) as title, row_number() over (partition by source order by doc_id) as a, row_number() over (partition by source order by doc_id desc) as b from documents)
select source, 'first' as side, a::int as rn, title from r where a <= 3 union all select source, 'last', b::int, title from r where b <= 3
""")
def first_last_titles(d: Tables) -> DataFrame:
    return reports.first_and_last(d.documents.select("source", "doc_id", F.substring_index("text", "\n", 1).alias("title")), "source", "doc_id", "title")


@query("""
with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn, contains(text, 'that') as hit from conversations)
select a.conv_id, a.turn, min(abs(a.rn - b.rn))::int as distance from r a join r b on b.conv_id = a.conv_id and b.hit and abs(a.rn - b.rn) <= 3 group by 1, 2
""")
def neighbourhood(d: Tables) -> DataFrame:
    return reports.neighbourhood(d.conversations, "conv_id", "turn", F.col("text").contains("that")).select("conv_id", "turn", "distance")


@query("select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def latest_per_key(d: Tables) -> DataFrame:
    return reports.latest(d.events, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
with b as (select o_custkey % 300 as f, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders group by 1),
l as (select s_suppkey % 700 as f, min(case when s_suppkey % 2 = 0 then 'inbox' else 'failed' end) as folder from supplier group by 1)
select c_custkey as file_name, coalesce(b.s, case folder when 'inbox' then 'queued' when 'failed' then 'failed' end, 'unknown') as status from customer left join b on b.f = c_custkey left join l on l.f = c_custkey
""")
def file_status(d: Tables) -> DataFrame:
    b = d.orders.select((F.col("o_custkey") % 300).alias("file_name"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("batch_id"))
    w = d.supplier.select((F.col("s_suppkey") % 700).alias("file_name"), F.when(F.col("s_suppkey") % 2 == 0, "inbox").otherwise("failed").alias("folder"))
    return reports.file_status(d.customer.select(F.col("c_custkey").alias("file_name")), b, w)


@query("""
with r as (select l_orderkey, l_linenumber, round(l_extendedprice, 2) as s, row_number() over (partition by l_orderkey order by round(l_extendedprice, 2) desc, l_linenumber) as rn from (select l_orderkey, l_linenumber, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2))
select l_orderkey, max(l_linenumber) filter (where rn = 1) as best, max(s) filter (where rn = 1) as best_score, max(s) filter (where rn = 2) as second_score from r group by 1
""")
def best_two(d: Tables) -> DataFrame:
    rows = d.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max("l_extendedprice"), 2).alias("s"))
    return reports.best_two(rows, "l_orderkey", "s", "l_linenumber")


STATES_SQL = """
with e as (select user_id, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else event_type end as s, ts, event_id from events),
f as (select user_id, arg_min(s, (ts, s)) as s from e where s in ('completed', 'failed') group by 1), l as (select user_id, arg_max(s, (ts, s)) as s, count(*) as n from e group by 1),
states as (select l.user_id as batch_id, coalesce(f.s, l.s) as status, l.n as n_events from l left join f on f.user_id = l.user_id)
"""


def _changes(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return events.select(F.col("user_id").alias("batch_id"), kind.alias("status"), F.col("ts").alias("at"))


def _states(d: Tables) -> DataFrame:
    return batch_states(_changes(d.events))


@query(STATES_SQL + "select * from states")
def status_lifecycle(d: Tables) -> DataFrame:
    return _states(d)


def _streamed(d: Tables, tracked: DataFrame | None = None) -> str:
    """The events by time, in eight files of which a micro-batch takes two; the last one runs twice."""
    at = f"{shared_dir(d.spark)}/lifecycle-{uuid.uuid4().hex}"
    _changes(d.events).repartitionByRange(8, "at").write.parquet(f"{at}/events")
    for _ in range(2):
        events = d.spark.readStream.schema("batch_id long, status string, at timestamp").option("maxFilesPerTrigger", 2).parquet(f"{at}/events")
        lifecycle.run_life(events, at, f"{at}/log", tracked)
        forget_last_commit(d.spark, f"{at}/log")
    return at


@query(STATES_SQL + "select * from states")
def stream_lifecycle(d: Tables) -> DataFrame:
    """Keyed state over several micro-batches, one of them replayed."""
    return lifecycle.states(d.spark, _streamed(d))


COMPLETION_SQL = STATES_SQL + "select c_custkey % 20 as group_id, count(*) filter (where coalesce(status, '') not in ('completed', 'failed', 'duplicate')) as waiting, count(*) filter (where coalesce(status, '') not in ('completed', 'failed', 'duplicate')) = 0 as done from customer left join states on batch_id = c_custkey group by 1"


def _tracked(d: Tables) -> DataFrame:
    return d.customer.select(F.col("c_custkey").alias("batch_id"), (F.col("c_custkey") % 20).alias("group_id"))


@query(COMPLETION_SQL)
def completion_tracking(d: Tables) -> DataFrame:
    return completion(_states(d), _tracked(d))


@query(COMPLETION_SQL)
def stream_completion(d: Tables) -> DataFrame:
    """The same from what each micro-batch turned terminal."""
    return lifecycle.done(d.spark, _streamed(d, _tracked(d)), _tracked(d))


@query("select event_id from events where event_type = 'purchase' and user_id::varchar like '1%' and ts > timestamp '2024-01-12 00:00:00' - interval 600 minutes")
def completed_within_bound(d: Tables) -> DataFrame:
    b = d.events.select("event_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("started").alias("status"), F.col("user_id").cast("string").alias("source_key"), F.col("ts").alias("completed_at"))
    return completed_within(b, F.lit("2024-01-12").cast("timestamp"), 600, "1%").select("event_id")
