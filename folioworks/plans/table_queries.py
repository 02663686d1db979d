"""Queries on tables: statuses, audits, joins, verdicts and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioworks.functions.text import normalize_text
from folioworks.operators import audit, classify, index, matching, tables
from folioworks.operators.numbering import row_numbers
from folioworks.plans.registry import Tables, query

#: labels as objects: quality gives a status, toxic a type.
STATUS_SQL = "case when quality = 1 then 'source_verified' when doc_id % 2 = 0 then 'machine_pending_human' else 'operationally_accepted' end"
KIND_SQL = "case when toxic = 1 then 'synthesized_rule' else 'legislation' end"


def _status() -> Column:
    return F.expr(STATUS_SQL)


def _kind() -> Column:
    return F.expr(KIND_SQL)


@query(f"""
with o as (select doc_id, {KIND_SQL} as object_type, {STATUS_SQL} as status from labels)
select doc_id, object_type, status, case when object_type = 'synthesized_rule' then 'non_authoritative' when status = 'source_verified' then 'source_authority' when status = 'operationally_accepted' then 'human_verified_authority' else 'non_authoritative' end as authority,
  object_type <> 'synthesized_rule' and status in ('source_verified', 'operationally_accepted') as citable
from o
""")
def authority_matrix(d: Tables) -> DataFrame:
    o = d.labels.select("doc_id", _kind().alias("object_type"), _status().alias("status"))
    return o.withColumn("authority", classify.authority_status(F.col("object_type"), F.col("status"))).withColumn("citable", classify.citable(F.col("object_type"), F.col("status")))


@query("""
with s as (select doc_id, case doc_id % 5 when 0 then null when 1 then 'historical_only' when 2 then 'superseded' when 3 then 'approved' else 'source_verified' end as status from labels)
select coalesce(status, 'source_verified') as verification_status, coalesce(status, '') <> 'approved' as known, count(*) as n from s group by 1, 2
""")
def status_check(d: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    rows = d.labels.withColumn("verification_status", F.when(k == 1, "historical_only").when(k == 2, "superseded").when(k == 3, "approved").when(k == 4, "source_verified"))
    good, bad = classify.with_status(rows)
    return good.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False))).groupBy("verification_status", "known").agg(F.count("*").alias("n"))


@query(f"""
with o as (select doc_id, {KIND_SQL} as object_type, case when quality = 0 then 'unknown' else 'source_verified' end as verification_status, case when doc_id % 3 = 0 then 'source_authority' else 'non_authoritative' end as authority_status, case when doc_id % 4 > 0 then doc_id % 4 = 1 end as usable_as_citation from labels)
select doc_id, 'verification_status_valid' as rule from o where verification_status = 'unknown'
union all select doc_id, 'synthesized_not_authoritative' from o where object_type = 'synthesized_rule' and authority_status <> 'non_authoritative'
union all select doc_id, 'synthesized_not_citable' from o where object_type = 'synthesized_rule' and usable_as_citation
""")
def constraint_audit(d: Tables) -> DataFrame:
    k = F.col("doc_id")
    o = d.labels.select("doc_id", _kind().alias("object_type"), F.when(F.col("quality") == 0, "unknown").otherwise("source_verified").alias("verification_status"), F.when(k % 3 == 0, "source_authority").otherwise("non_authoritative").alias("authority_status"), F.when(k % 4 > 0, k % 4 == 1).alias("usable_as_citation"))
    return audit.constraint_violations(o, audit.OBJECT_RULES, "doc_id")


@query("""
select o_orderkey, case when o_orderstatus = 'F' and target is not null then 'unresolved_without_target' else 'resolved_with_target' end as rule
from (select *, case when o_orderkey % 2 = 0 then o_custkey end as target from orders) where (o_orderstatus = 'F' and target is not null) or (o_orderstatus = 'O' and target is null)
""")
def mention_audit(d: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "unresolved").when(F.col("o_orderstatus") == "O", "resolved").otherwise("other")
    rows = d.orders.select("o_orderkey", state.alias("resolution_status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("target_object_id"), F.lit(False).alias("usable_as_authority"))
    return audit.constraint_violations(rows, audit.MENTION_RULES, "o_orderkey")


@query("select sha256(text) as digest, lang, count(*) as n from documents group by 1, 2 having count(*) > 1")
def unique_audit(d: Tables) -> DataFrame:
    return audit.duplicate_keys(d.documents.select(F.sha2("text", 256).alias("digest"), "lang"), ["digest", "lang"])


@query("select l_orderkey, l_partkey, count(*) as n from lineitem where l_linenumber = 1 and l_returnflag = 'A' group by all having count(*) > 1")
def partial_unique_audit(d: Tables) -> DataFrame:
    return audit.duplicate_keys(d.lineitem, ["l_orderkey", "l_partkey"], "l_linenumber = 1 and l_returnflag = 'A'")


@query("""
select 'labels' as child, count(*) as n from labels where doc_id % 2 = 0 and doc_id not in (select doc_id from documents where doc_id % 3 > 0)
union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 > 0)
""")
def fk_audit(d: Tables) -> DataFrame:
    a = audit.missing_parents(d.labels.where("doc_id % 2 = 0"), "doc_id", d.documents.where("doc_id % 3 > 0"), "doc_id")
    b = audit.missing_parents(d.lineitem, "l_orderkey", d.orders.where("o_orderkey % 10 > 0"), "o_orderkey")
    return a.agg(F.lit("labels").alias("child"), F.count("*").alias("n")).union(b.agg(F.lit("lineitem").alias("child"), F.count("*").alias("n")))


@query("""
select doc_id::varchar as id, unnest(['missing title', 'short id', 'unknown node_type', 'unknown status']) as problem, unnest([doc_id % 13 = 0, length(doc_id::varchar) < 3, lang = 'es', source = 'src3']) as holds from documents
""".replace("select doc_id", "select id, problem from (select doc_id").rstrip() + ") where holds")
def graph_audit(d: Tables) -> DataFrame:
    nodes = d.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("node_type"), F.when(F.col("doc_id") % 13 > 0, F.left("text", F.lit(9))).alias("title"), F.col("source").alias("status"))
    value = lambda c, gone: d.documents.select(F.col(c).alias("value")).where(F.col(c) != gone).distinct()
    return audit.graph_violations(nodes, value("lang", "es"), value("source", "src3"))


@query("select lang, source, count(*) as n from documents where lang = 'en' group by all")
def optional_filter_counts(d: Tables) -> DataFrame:
    kept = d.documents.where(classify.optional("lang", "en") & classify.optional("source", ""))
    return kept.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""
with t as (select doc_id, lang, case when doc_id % 2 = 0 then source end as topic from documents)
select doc_id, n from t a join (select lang, topic, count(*) as n from t group by all) b on a.lang = b.lang and a.topic is not distinct from b.topic
""")
def null_safe_lookup(d: Tables) -> DataFrame:
    """D-09: every document against the numbers of all."""
    t = d.documents.select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("topic"))
    b = t.groupBy("lang", "topic").agg(F.count("*").alias("n")).alias("b")
    return t.alias("a").join(b, (F.col("a.lang") == F.col("b.lang")) & F.col("a.topic").eqNullSafe(F.col("b.topic"))).select("doc_id", "n")


@query("select p_partkey from part where contains(lower(p_name || ' ' || p_type), 'ring s') and p_size > 10")
def substring_search(d: Tables) -> DataFrame:
    return d.part.where(classify.contains_any_column(["p_name", "p_type"], "Ring S") & (F.col("p_size") > 10)).select("p_partkey")


@query("select c_custkey from customer where c_name ilike '%customer%' and regexp_matches(c_name, '(^|[^0-9])0*17([^0-9]|$)')")
def title_number_search(d: Tables) -> DataFrame:
    return d.customer.where(classify.title_with_number("c_name", "customer", "0*17")).select("c_custkey")


@query("select page_id from pages where url like 'https://%' and url like '%/en/%'")
def like_filters(d: Tables) -> DataFrame:
    """D-12."""
    return d.pages.where(F.col("url").like("https://%") & F.col("url").like("%/en/%")).select("page_id")


PENDING_SQL = f"(select doc_id, {STATUS_SQL} as status, case doc_id % 3 when 0 then 'true' when 1 then 'false' end as edited, case when doc_id % 7 > 0 then 'B' || (doc_id % 4) end as batch_id from labels)"


@query(f"""
select doc_id, case when status = 'machine_pending_human' and coalesce(edited, '') <> 'true' and batch_id is not null then 'pending' else 'edited' end as pick, batch_id from {PENDING_SQL}
where (status = 'machine_pending_human' and coalesce(edited, '') <> 'true' and batch_id is not null) or coalesce(edited = 'true', false)
""")
def review_selection(d: Tables) -> DataFrame:
    k = F.col("doc_id")
    meta = F.when(k % 3 == 0, F.create_map(F.lit("human_edited"), F.lit("true"))).when(k % 3 == 1, F.create_map(F.lit("human_edited"), F.lit("false")))
    rows = d.labels.select("doc_id", _status().alias("verification_status"), meta.alias("metadata"), F.when(k % 7 > 0, F.concat(F.lit("B"), (k % 4).cast("string"))).alias("batch_id"))
    pick = F.when(F.coalesce(classify.pending_review(), F.lit(False)), "pending").when(classify.human_edited(), "edited")
    return rows.select("doc_id", pick.alias("pick"), "batch_id").where("pick is not null")


@query("select p_partkey from part where try_cast(regexp_extract(p_name, '(\\d+)', 1) as int) is null and (contains(p_name, 'ring') or contains(p_name, 'rod'))")
def section_heads(d: Tables) -> DataFrame:
    number = F.regexp_extract("p_name", r"(\d+)", 1).try_cast("int")
    return d.part.where(classify.section_head(F.col("p_name"), number, ["ring", "rod"])).select("p_partkey")


@query(f"select count(*) filter (where source = 'src0') as test_rows, count(*) filter (where source <> 'src0') as real_rows, count(*) filter (where doc_id in (select doc_id from labels where ({STATUS_SQL}) in ('source_verified', 'operationally_accepted') and toxic = 0)) as citable_rows from documents")
def test_and_citable_counts(d: Tables) -> DataFrame:
    """D-16, D-17."""
    good = d.labels.where(classify.citable(_kind(), _status())).select("doc_id", F.lit(1).alias("good"))
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).alias(n)
    return d.documents.join(good, "doc_id", "left").agg(count(F.col("source") == "src0", "test_rows"), count(F.col("source") != "src0", "real_rows"), count(F.col("good") == 1, "citable_rows"))


@query("select l_returnflag, case when l_discount * 10 >= 0.8 then 'verified' when l_discount * 10 >= 0.75 then 'accepted' else 'left' end as gate, count(*) as n from lineitem group by all")
def confidence_gate(d: Tables) -> DataFrame:
    return d.lineitem.groupBy("l_returnflag", classify.confidence_gate(F.col("l_discount") * 10).alias("gate")).agg(F.count("*").alias("n"))


@query("select event_id from events where ts > timestamp '2024-01-10 00:00:00' - interval 55 minutes and ts <= timestamp '2024-01-10 00:00:00' and user_id in (select c_custkey from customer where c_acctbal > 0)")
def recent_of_ids(d: Tables) -> DataFrame:
    now = F.lit("2024-01-10").cast("timestamp")
    ids = d.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return classify.of_ids(d.events.where(classify.recent(F.col("ts"), now) & (F.col("ts") <= now)), ids, "user_id").select("event_id")


@query("select d.doc_id, lang, quality, toxic from documents d left join labels l on l.doc_id = d.doc_id and l.quality = 1")
def sidecar_join(d: Tables) -> DataFrame:
    side = d.labels.where("quality = 1").select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), "quality", "toxic")
    docs = d.documents.select("doc_id", F.col("doc_id").cast("string").alias("path"), "lang")
    return matching.with_sidecars(docs, side).drop("path")


@query("""
with s as (select min(doc_id) as first_id, lang, sha256(text) as digest from documents where doc_id in (select doc_id from labels) group by 2, 3),
c as (select s.first_id, count(t.turn) as n from s left join conversations t on t.conv_id = s.first_id group by 1)
select d.doc_id, s.first_id as known_source, c.n as object_count from documents d join s on s.lang = d.lang and s.digest = sha256(d.text) join c on c.first_id = s.first_id where d.doc_id not in (select doc_id from labels)
""")
def known_duplicates(d: Tables) -> DataFrame:
    """Labelled documents are the known sources of all others."""
    docs = d.documents.select("doc_id", F.col("lang").alias("branch"), F.lit(None).cast("string").alias("topic"), F.sha2("text", 256).alias("content_sha256"))
    labelled = d.labels.select("doc_id").distinct()
    first = docs.join(labelled, "doc_id", "left_semi").groupBy("content_sha256", "branch", "topic").agg(F.min("doc_id").alias("source_key")).withColumn("first_batch_id", F.col("source_key"))
    return matching.known_duplicates(docs.join(labelled, "doc_id", "left_anti"), first, d.conversations.select(F.col("conv_id").alias("source_key"))).select("doc_id", "known_source", "object_count")


@query("select o_orderkey as object_id, rank, round(score, 4) as score, o_orderstatus from (select vec_id as object_id, row_number() over (order by vec_id) as rank, round(embedding[1]::double, 6) as score from embeddings where label = 3) h join orders on o_orderkey = h.object_id")
def hydrate_hits(d: Tables) -> DataFrame:
    hits = d.embeddings.where("label = 3").select(F.col("vec_id").alias("object_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    hits = row_numbers(hits, [], "object_id", "rank")
    return matching.hydrate(hits, d.orders.select(F.col("o_orderkey").alias("object_id"), "o_orderstatus"))


@query("select o_orderkey as case_id, l_linenumber as position, p_name as title from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderpriority = '1-URGENT'")
def case_authorities(d: Tables) -> DataFrame:
    """J-04."""
    cases = d.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("case_id"))
    links = d.lineitem.select(F.col("l_orderkey").alias("case_id"), "l_partkey", F.col("l_linenumber").alias("position"))
    return cases.join(links, "case_id").join(d.part, F.col("l_partkey") == F.col("p_partkey")).select("case_id", "position", F.col("p_name").alias("title")).orderBy("case_id", "position")


@query("select c_custkey as case_id, string_agg(o_orderkey::varchar, ',' order by o_orderdate desc, o_orderkey desc) as drafts from customer join orders on o_custkey = c_custkey group by c_custkey")
def case_drafts(d: Tables) -> DataFrame:
    """J-05."""
    newest = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False)
    return d.orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.array_join(F.transform(newest, lambda x: x["o_orderkey"].cast("string")), ",").alias("drafts")).join(d.customer.select(F.col("c_custkey").alias("case_id")), "case_id", "left_semi")


@query("""
with b as (select d.doc_id is not null as o, l.doc_id is not null as i, coalesce(d.source, 'none') as source from documents d full join (select doc_id from labels where doc_id % 9 > 0 union all select doc_id + 10000000 from labels where doc_id % 50 = 0) l on l.doc_id = d.doc_id)
select source, count(*) filter (where o) as n_objects, count(*) filter (where i) as n_points, count(*) filter (where o and not i) as n_missing, count(*) filter (where i and not o) as n_stray, count(*) filter (where o <> i) = 0 as consistent from b group by source
""")
def reconcile_index(d: Tables) -> DataFrame:
    own = d.documents.select("doc_id", "source")
    some = d.labels.where("doc_id % 9 > 0").join(own, "doc_id").select("doc_id", "source")
    stray = d.labels.where("doc_id % 50 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("none").alias("source"))
    return index.reconcile_counts(own, some.unionByName(stray), "source", "doc_id", "doc_id")


@query("""
select doc_id::varchar as key, 'missing' as side from documents where doc_id not in (select doc_id from labels)
union all select (doc_id + 10000000)::varchar, 'stray' from labels where doc_id % 50 = 0
""")
def repair_list(d: Tables) -> DataFrame:
    points = d.labels.select("doc_id").union(d.labels.where("doc_id % 50 = 0").select(F.col("doc_id") + 10_000_000)).toDF("object_id")
    return index.reconcile(d.documents.select(F.col("doc_id").alias("id")), points)


@query("""
select doc_id::varchar as object_id, case when doc_id in (select doc_id from labels where doc_id % 9 > 0) then -1 else length(text) + 9 end::double as size from documents where not starts_with(text, 'query: ')
union all select doc_id::varchar, -1 from documents where starts_with(text, 'query: ') and doc_id in (select doc_id from labels where doc_id % 9 > 0)
""")
def index_repair(d: Tables) -> DataFrame:
    """An index of most labelled documents and of some that are gone; what is missing is encoded by its length."""
    objects = d.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("original_text"))
    stray = d.labels.where("doc_id % 50 = 0").select((F.col("doc_id") + 10_000_000).cast("string").alias("object_id"))
    held = d.labels.where("doc_id % 9 > 0").select(F.col("doc_id").cast("string").alias("object_id")).distinct().union(stray).withColumn("vector", F.array(F.lit(-1.0).cast("float")))

    def encoder():
        return lambda texts: [[float(len(x))] for x in texts]

    points, _ = index.repaired(objects, held, encoder, "length", "1")
    return points.select("object_id", F.col("vector")[0].cast("double").alias("size"))


@query("select vec_id, label from embeddings where vec_id not in (select doc_id from labels) and not (label = 4 and vec_id % 2 = 0) and vec_id % 5 > 0")
def index_deletes(d: Tables) -> DataFrame:
    points = d.embeddings.select("vec_id", F.col("vec_id").alias("object_id"), "label")
    left = index.delete_points(points, d.labels.select(F.col("doc_id").alias("object_id")), (F.col("label") == 4) & (F.col("vec_id") % 2 == 0))
    return index.delete_points(left, where=F.col("vec_id") % 5 == 0).select("vec_id", "label")


@query("select vec_id as point_id, case when vec_id % 3 = 0 then label + 100 else label end as label from embeddings union all select 10000000 + vec_id, label + 100 from embeddings where vec_id % 100 = 0")
def index_upsert(d: Tables) -> DataFrame:
    old = d.embeddings.select(F.col("vec_id").alias("point_id"), "label")
    new = d.embeddings.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label")).union(d.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id") + 10_000_000, F.col("label") + 100))
    return index.write_points(old, new.toDF("point_id", "label"))


FIRST_WORD = "regexp_extract(text, '^([A-Za-z]+)', 1)"


@query(f"""
with l as (select doc_id, nullif({FIRST_WORD}, '') as w, toxic from (select d.doc_id, text, toxic from documents d left join labels using (doc_id))),
r as (select nullif({FIRST_WORD}, '') as w, min(item_id) as item_id, count(*) as n from benchmark group by 1),
ln as (select w, count(*) as n from l group by w),
o as (select l.doc_id, case when toxic = 1 then 'protected' when r.n is null then 'unmatched' when r.n > 1 or ln.n > 1 then 'repeated' else 'matched' end as outcome, r.item_id from l left join r on r.w = l.w left join ln on ln.w = l.w)
select doc_id, outcome, case when outcome = 'matched' then item_id end as item_id from o
""")
def unique_key_match(d: Tables) -> DataFrame:
    word = F.nullif(F.regexp_extract("text", "^([A-Za-z]+)", 1), F.lit(""))
    left = d.documents.join(d.labels.select("doc_id", "toxic"), "doc_id", "left").select("doc_id", word.alias("w"), "toxic")
    right = d.benchmark.select("item_id", word.alias("w"))
    return matching.unique_key_match(left, right, "w", F.col("toxic") == 1).select("doc_id", "outcome", "item_id")


@query("select n_nationkey, n_name, min(s_suppkey) as first_s_suppkey from nation left join supplier on s_nationkey = n_nationkey group by all")
def first_match_join(d: Tables) -> DataFrame:
    return matching.first_match(d.nation.select("n_nationkey", "n_name"), d.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), "n_nationkey", "s_suppkey")


@query("""
with sig as (select distinct id, kind, array_to_string(list_sort(string_split(w, '')), '') as s from (
  select doc_id as id, 'd' as kind, unnest(list_filter(regexp_extract_all(text, '[a-zA-Z]{2,}'), lambda w: length(w) >= 3)) as w from documents
  union all select item_id, 'b', unnest(list_filter(regexp_extract_all(text, '[a-zA-Z]{2,}'), lambda w: length(w) >= 3)) from benchmark)),
size as (select id, count(*) as n from sig where kind = 'b' group by id),
cover as (select d.id, text as k, b.id as item, count(*) / max(z.n) as c from sig d join sig b on b.s = d.s and b.kind = 'b' join size z on z.id = b.id join benchmark t on t.item_id = b.id where d.kind = 'd' group by d.id, b.id, text),
ranked as (select *, row_number() over (partition by id order by c desc, k, (item % 7)::varchar) as rn from cover),
pair as (select id, max(c) filter (where rn = 1) as c1, max(c) filter (where rn = 2) as c2, max((item % 7)::varchar) filter (where rn = 1) as r1, max((item % 7)::varchar) filter (where rn = 2) as r2 from ranked where rn <= 2 group by id),
told as (select doc_id as id, case when coalesce(c1, 0) < 0.55 then 'unmatched' when r2 is not null and r1 <> r2 and c1 - c2 < 0.05 then 'ambiguous' else 'attributed' end as outcome, r1, c1 from documents left join pair on pair.id = doc_id)
select id, case when outcome = 'attributed' then r1 end as reference, round(c1, 6) as coverage, outcome from told
""")
def reference_attribution(d: Tables) -> DataFrame:
    objects = d.documents.select(F.col("doc_id").alias("id"), "text")
    refs = d.benchmark.select(F.col("text").alias("k"), (F.col("item_id") % 7).cast("string").alias("reference"))
    return matching.attribute_references(objects, refs, "a-zA-Z").withColumn("coverage", F.round("coverage", 6))


@query("""
select doc_id, 'duplicate' as problem, true as aborts from labels where doc_id % 40 = 0
union all select doc_id + 10000000, 'foreign', true from labels where doc_id % 30 = 0
union all select doc_id, 'missing', false from documents where doc_id not in (select doc_id from labels)
""")
def assignment_integrity(d: Tables) -> DataFrame:
    given = d.labels.select("doc_id").union(d.labels.where("doc_id % 40 = 0").select("doc_id")).union(d.labels.where("doc_id % 30 = 0").select(F.col("doc_id") + 10_000_000))
    return audit.assignment_integrity(given, d.documents.select("doc_id"), "doc_id")


@query("select doc_id as id, lang, case when doc_id in (select doc_id from labels) then 'L' || (doc_id % 7) end as law, case when doc_id in (select doc_id from labels) then 2 else 1 end as n_keys from documents")
def apply_attribution(d: Tables) -> DataFrame:
    law = F.concat(F.lit("L"), (F.col("doc_id") % 7).cast("string"))
    sections = d.labels.select(F.array("doc_id").alias("ids"), F.create_map(F.lit("law"), law).alias("patch"))
    objects = d.documents.select(F.col("doc_id").alias("id"), "lang", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return matching.apply_sections(objects, sections).select("id", "lang", F.col("metadata")["law"].alias("law"), F.size("metadata").alias("n_keys"))


def _verdicts(final: bool) -> str:
    fragment = "when verdict = 'non_legal_fragment' then 'fragment'" if final else ""
    return f"""
    with v as (select doc_id, case doc_id % 5 when 0 then 'not_found' when 1 then 'corrected' when 2 then 'correct' when 3 then 'non_legal_fragment' else 'correct' end as verdict, 0.6 + quality * 0.2 + toxic * 0.1 as conf from labels),
    o as (select d.doc_id as id, text, verdict, case when verdict is null then 'untouched' when verdict = 'not_found' then 'retry' {fragment} when conf < 0.75 then 'low_confidence' when verdict = 'corrected' then 'corrected' when verdict = 'correct' then 'promoted' else 'left' end as outcome from documents d left join v using (doc_id))
    select id, outcome, case when outcome = 'corrected' then 9 else length(text) end::bigint as n_text, case when outcome in ('corrected', 'promoted', 'fragment') then 'operationally_accepted' else 'machine_pending_human' end as verification_status,
      outcome in ('corrected', 'promoted') as usable_as_citation from o
    """


def _judged(d: Tables, final: bool) -> DataFrame:
    k = F.col("doc_id") % 5
    verdict = F.when(k == 0, "not_found").when(k == 1, "corrected").when(k == 3, "non_legal_fragment").otherwise("correct")
    v = d.labels.select(F.col("doc_id").alias("id"), verdict.alias("verdict"), F.lit("corrected").alias("corrected_text"), (0.6 + F.col("quality") * 0.2 + F.col("toxic") * 0.1).alias("confidence"))
    o = d.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("original_text"), F.lit("machine_pending_human").alias("verification_status"), F.lit(False).alias("usable_as_citation"))
    return matching.apply_verdicts(o, v, final=final).select("id", "outcome", F.length("original_text").cast("long").alias("n_text"), "verification_status", "usable_as_citation")


@query(_verdicts(False))
def apply_verdicts(d: Tables) -> DataFrame:
    return _judged(d, False)


@query(_verdicts(True))
def final_verdicts(d: Tables) -> DataFrame:
    return _judged(d, True)


@query(f"""
with o as (select doc_id, doc_id % 50 as batch_id, {STATUS_SQL} as verification_status, case doc_id % 3 when 0 then 'source_authority' when 1 then 'human_verified_authority' else 'non_authoritative' end as authority_status from labels),
b as (select batch_id, min(authority_status) as a from o where verification_status = 'source_verified' group by batch_id)
select doc_id, case when verification_status = 'machine_pending_human' then coalesce(b.a, (select min(authority_status) from o where verification_status = 'source_verified'), authority_status) else authority_status end as authority_status from o left join b using (batch_id)
""")
def inherit_authority(d: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    o = d.labels.select("doc_id", (F.col("doc_id") % 50).alias("batch_id"), _status().alias("verification_status"), F.when(k == 0, "source_authority").when(k == 1, "human_verified_authority").otherwise("non_authoritative").alias("authority_status"))
    return matching.inherit_authority(o).select("doc_id", "authority_status")


@query("""
with r as (select p_partkey, p_brand as topic, case when p_size % 2 = 0 then p_type end as subtopic from part),
o as (select distinct topic as orig_topic, subtopic as orig_subtopic, 'New ' || topic as topic, 'New' as subtopic from r where topic < 'Brand#3')
select p_partkey, coalesce(o.topic, r.topic) as topic, case when o.topic is not null then o.subtopic else r.subtopic end as subtopic from r left join o on r.topic = orig_topic and r.subtopic is not distinct from orig_subtopic
""")
def path_overrides(d: Tables) -> DataFrame:
    r = d.part.select("p_partkey", F.col("p_brand").alias("topic"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("subtopic"))
    o = r.where("topic < 'Brand#3'").select(F.col("topic").alias("orig_topic"), F.col("subtopic").alias("orig_subtopic")).distinct().select("*", F.concat(F.lit("New "), "orig_topic").alias("topic"), F.lit("New").alias("subtopic"))
    return matching.path_overrides(r, o, ("topic", "subtopic"))


@query("select l_orderkey, l_linenumber, coalesce(case when o_orderkey % 2 = 0 then 'o' || o_orderkey end, case when s_suppkey % 3 = 0 then 's' || s_suppkey end) as file_name from lineitem left join orders on o_orderkey = l_orderkey left join supplier on s_suppkey = l_suppkey")
def file_fallback(d: Tables) -> DataFrame:
    o = d.lineitem.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("batch_id"), F.col("l_suppkey").alias("source_key"))
    a = d.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("batch_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file_name"))
    b = d.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("source_key"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_name"))
    return matching.file_fallback(o, a, b).select("l_orderkey", "l_linenumber", "file_name")


@query("select o_custkey, detected, expected, detected is distinct from expected as alert from (select c_custkey as o_custkey, count(o_orderkey) as detected, (c_custkey % 20)::bigint as expected from customer left join orders on o_custkey = c_custkey group by c_custkey)")
def expected_counts(d: Tables) -> DataFrame:
    registry = d.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 20).alias("expected"))
    found = d.orders.join(registry, "o_custkey", "left_semi")
    return audit.expected_counts(registry, found, "o_custkey")


@query("select c_custkey as report_id from customer where c_custkey % 4 > 0 and c_custkey % 9 > 0 and c_custkey not in (select o_custkey from orders)")
def phantom_claims(d: Tables) -> DataFrame:
    reports = d.customer.select(F.col("c_custkey").alias("report_id"), (F.col("c_custkey") % 4).alias("claimed"), (F.col("c_custkey") % 9 == 0).alias("retracted"))
    return audit.phantom_claims(reports, d.orders.select(F.col("o_custkey").alias("report_id")), "report_id").select("report_id")


@query("""
with m as (select event_id, user_id::varchar as law_number, event_type as law_year, (event_id % 3)::varchar as article_number from events),
a as (select c_nationkey::varchar as law_number, case when c_custkey % 2 = 0 then 'click' else 'view' end as law_year, (c_custkey % 50)::varchar as article_number, min(c_custkey) as id from customer group by 1, 2, 3 having count(*) = 1)
select event_id, a.id as target_object_id, case when a.id is null then 'unresolved' else 'resolved' end as resolution_status, a.id is not null as usable_as_authority from m left join a using (law_number, law_year, article_number)
""")
def resolve_mentions(d: Tables) -> DataFrame:
    m = d.events.select("event_id", F.col("user_id").cast("string").alias("law_number"), F.col("event_type").alias("law_year"), (F.col("event_id") % 3).cast("string").alias("article_number"))
    a = d.customer.select(F.col("c_nationkey").cast("string").alias("law_number"), F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("view").alias("law_year"), (F.col("c_custkey") % 50).cast("string").alias("article_number"), F.col("c_custkey").alias("id"))
    return matching.resolve_mentions(m, a).select("event_id", "target_object_id", "resolution_status", "usable_as_authority")


@query("select o_orderkey as object_id, l_partkey as micro_issue_id, p_name as micro_issue_name, prim as is_primary, row_number() over (partition by o_orderkey order by prim desc, l_partkey)::int as position from orders join (select l_orderkey, l_partkey, max(l_linenumber = 2) as prim from lineitem group by 1, 2) on l_orderkey = o_orderkey join part on p_partkey = l_partkey")
def micro_issues(d: Tables) -> DataFrame:
    tasks = -(-d.lineitem.count() // matching.BRIDGE_ROWS)
    rows = d.lineitem.select(F.col("l_orderkey").alias("object_id"), F.col("l_partkey").alias("micro_issue_id"), (F.col("l_linenumber") == 2).alias("second"))
    rows = rows.repartition(tasks, "object_id") if tasks > 1 else rows
    bridge = rows.groupBy("object_id", "micro_issue_id").agg(F.max("second").alias("is_primary"))
    return matching.micro_issues_of(d.orders.select(F.col("o_orderkey").alias("id")), bridge, d.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("micro_issue_name")), tasks if tasks > 1 else None)


@query("""
with e as (select l_suppkey as f, l_returnflag as r, l_partkey as t from lineitem where l_linenumber = 1)
select s_suppkey as id, 'out' as direction, r as relation_type, count(*) as n from supplier join e on f = s_suppkey group by all
union all select s_suppkey, 'in', r, count(*) from supplier join e on t = s_suppkey group by all
""")
def edge_neighbours(d: Tables) -> DataFrame:
    edges = d.lineitem.where("l_linenumber = 1").select(F.col("l_suppkey").alias("from_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_partkey").alias("to_id"))
    return matching.neighbours(d.supplier.select(F.col("s_suppkey").alias("id")), edges).groupBy("id", "direction", "relation_type").agg(F.count("*").alias("n"))


@query("select doc_id as id, case when toxic = 1 then 'reassess' end as flag, case when toxic = 1 then lang end as reason from documents left join labels using (doc_id)")
def reassessment_flags(d: Tables) -> DataFrame:
    flagged = d.labels.where("toxic = 1").join(d.documents.select("doc_id", "lang"), "doc_id")
    flags = flagged.select(F.array("doc_id").alias("objects"), F.lit("reassess").alias("flag"), F.col("lang").alias("reason"))
    return matching.reassessment_flags(d.documents.select(F.col("doc_id").alias("id")), flags)


@query("select event_id, o_orderkey as judgment_id, o_orderpriority as judgment_title from events left join orders on o_orderkey::varchar = json_extract_string(props, '$.k')")
def judgment_links(d: Tables) -> DataFrame:
    p = d.events.select("event_id", F.create_map(F.lit("source_judgment_id"), F.get_json_object("props", "$.k")).alias("metadata"))
    return matching.principles_of_judgments(p, d.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"))).select("event_id", F.col("judgment_id").cast("long").alias("judgment_id"), "judgment_title")


@query("""
with n as (select o_orderkey * 2 as o_orderkey, o_orderstatus || '!' as o_orderstatus, o_totalprice + 1 as o_totalprice from orders)
select coalesce(c.o_orderkey, n.o_orderkey) as o_orderkey, case when c.o_orderkey is null then n.o_orderstatus else c.o_orderstatus end as o_orderstatus, round(coalesce(n.o_totalprice, c.o_totalprice), 2) as o_totalprice, c.o_custkey
from orders c full join n on c.o_orderkey = n.o_orderkey
""")
def upsert_partial(d: Tables) -> DataFrame:
    current = d.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    changes = d.orders.select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.concat("o_orderstatus", F.lit("!")).alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tables.upsert(current, changes, ["o_orderkey"], ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 3 > 0 union all select o_orderkey, 'N' from orders where o_orderkey % 3 = 0 and o_orderkey % 2 = 0")
def insert_absent(d: Tables) -> DataFrame:
    current = d.orders.where("o_orderkey % 3 > 0").select("o_orderkey", "o_orderstatus")
    return tables.insert_absent(current, d.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus")), ["o_orderkey"])


@query("select o_orderkey as batch_id, case when o_orderstatus <> 'F' and o_orderkey % 4 = 0 then 'failed' when o_orderstatus = 'F' then 'completed' else 'started' end as status, case when o_orderstatus <> 'F' and o_orderkey % 4 = 0 then 0 else o_custkey end as object_count from orders")
def guarded_status(d: Tables) -> DataFrame:
    b = d.orders.select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("started").alias("status"), F.col("o_custkey").alias("object_count"))
    return tables.guarded_status(b, b.where("batch_id % 4 = 0").select("batch_id", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("object_count")))


@query(f"select doc_id, case when ({STATUS_SQL}) = 'machine_pending_human' and doc_id % 10 < 5 then 'operationally_accepted' else {STATUS_SQL} end as status from labels")
def bulk_approve(d: Tables) -> DataFrame:
    rows = d.labels.select("doc_id", _status().alias("status"))
    return tables.set_where(rows, (F.col("status") == "machine_pending_human") & (F.col("doc_id") % 10 < 5), status=F.lit("operationally_accepted"))


@query("""
with e as (select item_id * 3 as id, trim(text) as text, case when item_id % 2 = 0 then 'T' || item_id end as title from benchmark where length(trim(text)) >= 100)
select d.doc_id as id, length(coalesce(e.text, d.text))::bigint as n_text, length(coalesce(e.text, 'n'))::bigint as n_normal, coalesce(e.title, d.lang) as title, case when e.id is null then 'source_verified' else 'operationally_accepted' end as verification_status, case when e.id is not null then 'true' end as edited
from documents d left join e on e.id = d.doc_id
""")
def human_edits(d: Tables) -> DataFrame:
    o = d.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("original_text"), F.lit("n").alias("normalized_text"), F.col("lang").alias("title"), F.lit("source_verified").alias("verification_status"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    e = d.benchmark.select((F.col("item_id") * 3).alias("id"), "text", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("T"), F.col("item_id").cast("string"))).alias("title"))
    done = tables.human_edits(o, e, normalize_text, 100)
    return done.select("id", F.length("original_text").cast("long").alias("n_text"), F.length("normalized_text").cast("long").alias("n_normal"), "title", "verification_status", F.col("metadata")["human_edited"].alias("edited"))


@query("select doc_id as id, length(text || case when quality = 1 then chr(10) || chr(10) || 'Ref: R' || (doc_id % 9) else '' end)::bigint as n_text, case when quality = 1 then '0.5' end as match from documents left join labels using (doc_id)")
def append_reference(d: Tables) -> DataFrame:
    o = d.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("original_text"), F.col("text").alias("normalized_text"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    m = d.labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.concat(F.lit("R"), (F.col("doc_id") % 9).cast("string")).alias("reference"), F.lit(0.5).alias("score"))
    return tables.append_reference(o, m, "Ref: ").select("id", F.length("original_text").cast("long").alias("n_text"), F.col("metadata")["reference_match"].alias("match"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'NEW' else c_mktsegment end as c_mktsegment, case when c_custkey % 5 = 0 then 0.0 else c_acctbal end as c_acctbal, c_nationkey from customer")
def sparse_patch(d: Tables) -> DataFrame:
    k = F.col("c_custkey")
    ch = d.customer.select("c_custkey", F.when(k % 3 == 0, "NEW").alias("c_mktsegment"), F.when(k % 5 == 0, 0.0).alias("c_acctbal"), F.lit(99).alias("c_nationkey"))
    return tables.sparse_patch(d.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"), ch, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""
select 'parents' as part, count(*) as n, sum(o_orderkey)::bigint as s from orders where o_orderstatus <> 'F'
union all select 'lineitem', count(*), sum(l_orderkey)::bigint from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')
union all select 'events', count(*), sum(case when user_id in (select o_orderkey from orders where o_orderstatus = 'F') then null else user_id end)::bigint from events
""")
def delete_cascade(d: Tables) -> DataFrame:
    gone = d.orders.where("o_orderstatus = 'F'")
    children = {"lineitem": (d.lineitem, "l_orderkey"), "events": (d.events, "user_id")}
    out = tables.delete_cascade(d.orders, children, gone, "o_orderkey", set_null=("events",))
    total = lambda name, key: out[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(key).alias("s"))
    return total("parents", "o_orderkey").union(total("lineitem", "l_orderkey")).union(total("events", "user_id"))


@query("""
with s as (select s_suppkey as source_key, 'file' || (s_suppkey % 5) || '.pdf' as file_name from supplier)
select 'sources' as part, count(*) as n from s where file_name not like 'file2%'
union all select 'batches', count(*) from orders where not (o_orderstatus = 'P' and o_custkey in (select source_key from s where file_name like 'file2%'))
""")
def unblock_sources(d: Tables) -> DataFrame:
    s = d.supplier.select(F.col("s_suppkey").alias("source_key"), F.concat(F.lit("file"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".pdf")).alias("file_name"))
    b = d.orders.select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("source_key"), F.when(F.col("o_orderstatus") == "P", "duplicate").otherwise("completed").alias("status"))
    left, kept = tables.unblock(s, b, "file2%")
    return left.agg(F.lit("sources").alias("part"), F.count("*").alias("n")).union(kept.agg(F.lit("batches").alias("part"), F.count("*").alias("n")))


@query("""
with e as (select doc_id, doc_id % 300 as article_number from labels where toxic = 1), o as (select article_number, min(id) as id from (select item_id as id, item_id % 300 as article_number from benchmark union all select event_id, event_id % 200 from events) group by 1)
select doc_id, id, id is not null as applied from e left join o using (article_number)
""")
def replay_edits(d: Tables) -> DataFrame:
    saved = d.labels.where("toxic = 1").select("doc_id", (F.col("doc_id") % 300).alias("article_number"))
    o = d.benchmark.select(F.col("item_id").alias("id"), (F.col("item_id") % 300).alias("article_number")).union(d.events.select("event_id", F.col("event_id") % 200))
    done, lost = tables.replay_edits(saved, o)
    return done.select("doc_id", "id", F.lit(True).alias("applied")).union(lost.select("doc_id", F.lit(None).cast("long").alias("id"), F.lit(False).alias("applied")))


@query("""
select o_orderkey % 100 as batch_id, case max(case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 2 when o_orderstatus = 'P' then 1 else 0 end) when 2 then 'fail' when 1 then 'pass_with_warnings' else 'pass' end as verdict from orders where o_orderkey % 7 > 0 group by 1
""")
def batch_verdicts(d: Tables) -> DataFrame:
    rows = d.orders.where("o_orderkey % 7 > 0").withColumn("batch_id", F.col("o_orderkey") % 100)
    severity = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), 2).when(F.col("o_orderstatus") == "P", 1)
    return audit.batch_verdicts(rows.select("batch_id", severity.alias("severity")).where("severity is not null"), rows)


@query("select l_orderkey as rule_id, count(distinct l_suppkey)::int as n_sources, count(distinct l_suppkey) < 2 as provisional from lineitem group by 1")
def rule_support(d: Tables) -> DataFrame:
    rules = d.lineitem.groupBy(F.col("l_orderkey").alias("rule_id")).agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("supported_by"))
    return audit.rule_support(rules).drop("supported_by")


@query("select nullif(regexp_extract(url, '/([0-9]+)', 1), '') as id, count(*) as n from pages where regexp_extract(url, '/([0-9]+)', 1) <> '' group by 1 having count(*) > 1")
def duplicate_index_ids(d: Tables) -> DataFrame:
    return audit.duplicate_ids_in_lines(d.pages.select(F.col("url").alias("value")), "/([0-9]+)")
