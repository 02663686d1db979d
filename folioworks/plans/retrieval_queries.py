"""Queries that retrieve and order results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioworks.operators import retrieval
from folioworks.plans.registry import Tables, query


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 500")
def topk_newest(d: Tables) -> DataFrame:
    return retrieval.top_newest(d.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 9999, 500)


@query("""
with b as (select o_custkey as batch_id, count(*) as object_count, max(o_orderdate) as completed_at from orders where o_orderstatus = 'F' group by 1),
n as (select * from b where object_count > 4 order by completed_at desc, batch_id limit 1)
select o_orderkey from orders where o_custkey in (select batch_id from n)
""")
def newest_batch_objects(d: Tables) -> DataFrame:
    b = d.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count("*").alias("object_count"), F.max("o_orderdate").alias("completed_at")).withColumn("status", F.lit("completed"))
    return d.orders.join(retrieval.newest_batch(b, 4), F.col("o_custkey") == F.col("batch_id"), "left_semi").select("o_orderkey")


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::double * p[2]::double))"
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


@query(f"""
with q as (select vec_id, embedding, label, unnest([false, true]) as filtered from embeddings where vec_id % 100 = 0),
s as (select q.vec_id as query_id, q.filtered, p.vec_id as object_id, {_cosine('p.embedding', 'q.embedding')} as score from embeddings p join q on not q.filtered or p.label = q.label),
r as (select *, row_number() over (partition by query_id, filtered order by score desc, object_id) as rank from s)
select query_id, filtered, object_id, round(score, 4) as score, rank::int as rank from r where rank <= 10
""")
def vector_topk(d: Tables) -> DataFrame:
    """The stated query set, every id divisible by 100: each one against all vectors, and
    against those of its own label."""
    points = d.embeddings.select(F.col("vec_id").alias("object_id"), F.col("embedding").alias("vector"), "label")
    asked = d.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    # The complement of a filtered query's id stands for it in the search: it is never divisible by 100.
    filtered = asked.where("label is not null").withColumn("query_id", F.bitwise_not("query_id"))
    found = retrieval.vector_top_k(points, asked.withColumn("label", F.lit(None).cast(asked.schema["label"].dataType)).unionByName(filtered), 10, same=("label",))
    is_filtered = F.col("query_id") % 100 != 0
    told = F.when(is_filtered, F.bitwise_not("query_id")).otherwise(F.col("query_id"))
    return found.select(told.alias("query_id"), is_filtered.alias("filtered"), "object_id", F.round("score", 4).alias("score"), "rank")


def _exact(d: Tables) -> DataFrame:
    objects = d.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("No "), (F.col("doc_id") % 40).cast("string")).alias("title"), "text")
    queries = d.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("number"), F.array_distinct(F.split("text", r"\s+")).alias("tokens"))
    return retrieval.exact_search(objects, queries, 3, fields=("text",))


EXACT_SQL = r"""
with words as (select doc_id as id, doc_id % 40 as number, unnest(list_distinct(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[().,:?]+', ''), '[().,:?]+$', '')))) as token from documents),
queries as (select item_id as query_id, item_id % 40 as number, unnest(list_distinct(string_split_regex(text, '\s+'))) as token from benchmark),
m as (select query_id, id, count(*)::int as matched from words join queries using (number, token) group by all),
t as (select *, max(matched) over (partition by query_id) as best from m),
exact as (select query_id, id, matched, row_number() over (partition by query_id order by id)::int as rank, 1.0::double as score from t where matched = best qualify rank <= 3)
"""


@query(EXACT_SQL + "select * from exact")
def exact_search(d: Tables) -> DataFrame:
    return _exact(d)


@query(EXACT_SQL + f"""
, pairs as (select b.item_id as query_id, p.vec_id as id, {_cosine('p.embedding', 'q.embedding')} as score from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings p),
semantic as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from pairs qualify rank <= 10),
joined as (select query_id, id, rank, 0 as tier from exact union all select query_id, id, rank, 1 from semantic s where not exists (select 1 from exact e where e.query_id = s.query_id and e.id = s.id))
select query_id, id, tier, row_number() over (partition by query_id order by tier, rank, id)::int as position from joined
""")
def hybrid_merge(d: Tables) -> DataFrame:
    """Semantic results are the nearest ten of all vectors."""
    items = d.benchmark.select(F.col("item_id").alias("query_id"))
    asked = d.embeddings.join(items, F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("q"))
    points = d.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    semantic = retrieval.vector_top_k(points, asked, 10, key="id")
    return retrieval.hybrid_merge(_exact(d), semantic).select("query_id", "id", "tier", "position")


@query("""
with h as (select l_suppkey % 10 as query_id, l_linenumber - 1 as axis, case l_returnflag when 'A' then 'statute' when 'R' then 'principle' else 'judgment' end as family, l_partkey as object_id, max(round(l_extendedprice, 2)) as score from lineitem group by 1, 2, 3, 4),
b as (select *, row_number() over (partition by query_id, axis, family order by score desc, object_id) as rn from h),
k as (select query_id, family, object_id, max(score) as score from b where rn <= case family when 'judgment' then case when axis = 0 then 2 else 0 end else 6 end group by 1, 2, 3),
r as (select *, row_number() over (partition by query_id, family order by score desc, object_id)::int as rank from k)
select * from r where rank <= case family when 'judgment' then 2 else 12 end
""")
def multi_axis_topk(d: Tables) -> DataFrame:
    family = F.when(F.col("l_returnflag") == "A", "statute").when(F.col("l_returnflag") == "R", "principle").otherwise("judgment")
    hits = d.lineitem.groupBy((F.col("l_suppkey") % 10).alias("query_id"), (F.col("l_linenumber") - 1).alias("axis"), family.alias("family"), F.col("l_partkey").alias("object_id")).agg(F.max(F.round("l_extendedprice", 2)).alias("score"))
    return retrieval.multi_axis(hits, {"statute": 6, "principle": 6}, {"judgment": 2}, {"statute": 12, "principle": 12, "judgment": 2})


@query("select case when p_type in ('SMALL', 'MEDIUM') then 'family_' || p_type else p_type end as family, count(*) as n from part group by 1")
def family_expansion(d: Tables) -> DataFrame:
    families = d.part.where("p_type in ('SMALL', 'MEDIUM')").select("p_type", F.concat(F.lit("family_"), "p_type").alias("family")).distinct()
    return retrieval.with_family(d.part.select("p_partkey", "p_type"), families, "p_type").groupBy("family").agg(F.count("*").alias("n"))


SCOPE_SQL = """
with q as (select item_id as query_id, (['en', 'fr', 'de', 'es'])[item_id % 4 + 1] as lang, 'src' || (item_id % 25) as source from benchmark),
f as (select query_id, doc_id as id, 1 + (d.source = q.source)::int as depth from documents d join q on d.lang = q.lang),
scope as (select * from (select *, max(depth) over (partition by query_id) as most from f) where depth = most)
"""


LEVELS = ["lang", "source"]


def _asking(d: Tables) -> DataFrame:
    langs = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    return d.benchmark.select(F.col("item_id").alias("query_id"), F.get(langs, F.col("item_id") % 4).alias("lang"), F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("source"))


def _scopes(d: Tables) -> DataFrame:
    """Scopes with what they hold, summed up by level before any query meets them."""
    groups = d.documents.groupBy(*LEVELS).agg(F.count("*").alias("n"), F.min("doc_id").alias("id"), F.sum("doc_id").alias("total"))
    return retrieval.staged_scope(groups, _asking(d), LEVELS)


@query(SCOPE_SQL + "select query_id, depth, count(*) as n, min(id) as first_id, sum(id)::bigint as total from scope group by all")
def stage_retrieval(d: Tables) -> DataFrame:
    return _scopes(d).groupBy("query_id", "depth").agg(F.sum("n").alias("n"), F.min("id").alias("first_id"), F.sum("total").alias("total"))


@query("""
with r as (select l_suppkey as query_id, l_orderkey * 10 + l_linenumber as id, max(l_returnflag) as object_type, max(round(l_extendedprice, 2)) as score from lineitem group by 1, 2),
t as (select *, row_number() over (partition by query_id order by case object_type when 'N' then 1 when 'A' then 2 end nulls last, score desc, id)::int as position from r)
select query_id, id, object_type, position from t where position <= 5
""")
def tier_order(d: Tables) -> DataFrame:
    r = d.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.max("l_returnflag").alias("object_type"), F.max(F.round("l_extendedprice", 2)).alias("score"))
    tiers = d.lineitem.where("l_returnflag in ('N', 'A')").select(F.col("l_returnflag").alias("object_type"), F.when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("tier")).distinct()
    return retrieval.tier_order(r, tiers).where("position <= 5").select("query_id", "id", "object_type", "position")


@query("""
with tags as (select l_orderkey as id, l_suppkey as tag from lineitem group by 1, 2),
seeds as (select o_custkey % 20 as query_id, o_orderkey as id from orders where o_orderkey in (select id from tags)),
asked as (select distinct query_id, tag from seeds join tags using (id)),
near as (select distinct query_id, id from asked join tags using (tag) where id % 11 > 0)
select query_id, count(*) as n from near n where not exists (select 1 from seeds s where s.query_id = n.query_id and s.id = n.id) and not (n.id % 13 = 0) group by 1
""")
def controlled_expansion(d: Tables) -> DataFrame:
    """Every order is a seed of its query."""
    objects = d.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("tags")).withColumn("not_for_use", F.col("id") % 11 == 0)
    seeds = d.orders.select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_orderkey").alias("id")).join(objects.select("id", "tags"), "id")
    blocked = objects.where("id % 13 = 0").select("id")
    return retrieval.controlled_expansion(objects, seeds, blocked).groupBy("query_id").agg(F.count("*").alias("n"))


RULES = {"older": "o_orderdate < timestamp '1996-01-01'", "template": "o_orderpriority = '5-LOW'", "cheap": "o_totalprice < 50000"}
JUDGED_SQL = "with j as (select o_orderkey as id, o_custkey % 30 as query_id, list_filter([case when o_orderdate < timestamp '1996-01-01' then 'older' end, case when o_orderpriority = '5-LOW' then 'template' end, case when o_totalprice < 50000 then 'cheap' end], lambda x: x is not null) as reasons from orders)"


def _judged(d: Tables) -> DataFrame:
    return retrieval.eligibility(d.orders.withColumn("id", F.col("o_orderkey")).withColumn("query_id", F.col("o_custkey") % 30), RULES)


@query(JUDGED_SQL + "select id, array_to_string(reasons, ',') as reasons, len(reasons) = 0 as eligible from j")
def eligibility(d: Tables) -> DataFrame:
    return _judged(d).select("id", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query(JUDGED_SQL + """
, numbered as (select *, (row_number() over (partition by query_id, len(reasons) = 0 order by id) - 1) // 1000 as chunk from j)
select query_id, chunk::int as chunk, coalesce(string_agg(id::varchar, ',' order by id) filter (where len(reasons) = 0), '') as used,
  coalesce(string_agg(id || ':' || array_to_string(reasons, '+'), ',' order by id) filter (where len(reasons) > 0), '') as excluded from numbered group by 1, 2
""")
def reasoning_trace(d: Tables) -> DataFrame:
    shown = F.transform("excluded", lambda x: F.concat_ws(":", x["id"].cast("string"), F.array_join(x["reasons"], "+")))
    return retrieval.reasoning_trace(_judged(d)).select("query_id", "chunk", F.array_join(F.transform("used", lambda x: x.cast("string")), ",").alias("used"), F.array_join(shown, ",").alias("excluded"))


@query("""
select o_orderkey as id from orders where o_orderdate <= timestamp '1997-06-01' and o_orderdate + interval 400 days > timestamp '1997-06-01'
  and o_orderkey not in (select l_orderkey from lineitem where l_returnflag in ('A', 'R') and l_shipdate <= timestamp '1997-06-01')
""")
def in_force(d: Tables) -> DataFrame:
    objects = d.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 400 days")).alias("valid_to"))
    relation = F.when(F.col("l_returnflag") == "A", "repeals").when(F.col("l_returnflag") == "R", "amends").otherwise("cites")
    edges = d.lineitem.select(F.col("l_orderkey").alias("to_id"), relation.alias("relation_type"), F.col("l_shipdate").alias("valid_from"))
    return retrieval.in_force(objects, edges, F.lit("1997-06-01").cast("timestamp")).select("id")


@query(SCOPE_SQL + """
, e as (select item_id as query_id, item_id * 5 as id, item_id % 2 = 0 as wanted from benchmark)
select e.query_id, e.id, wanted, s.id is not null as found, (s.id is not null) = wanted as passed from e left join scope s on s.query_id = e.query_id and s.id = e.id
""")
def regression_cases(d: Tables) -> DataFrame:
    e = d.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") * 5).alias("id"), (F.col("item_id") % 2 == 0).alias("wanted"))
    scopes = _scopes(d).select("query_id", "depth").distinct().join(_asking(d).select("query_id", *(F.col(c).alias(f"_{c}") for c in LEVELS)), "query_id")
    met = e.select("query_id", "id").distinct().join(d.documents.select(F.col("doc_id").alias("id"), *LEVELS), "id").join(scopes, "query_id")
    agree = (F.col("lang") == F.col("_lang")) & ((F.col("depth") < 2) | (F.col("source") == F.col("_source")))
    return retrieval.regression_report(met.where(agree), e)


@query("""
with s as (select p_brand as question_type, list_sort(list(distinct p_type)) as families from part group by 1),
c as (select p_type as family, count(*) as n from part group by 1),
steps as (select question_type, (f.i - 1)::int as step, families[f.i] as family from s, unnest(range(1, len(families) + 1)) as f(i))
select c_custkey as query_id, step, family, n from customer join steps on question_type = 'Brand#' || (c_custkey % 5 + 1) join c using (family)
""")
def entry_strategy(d: Tables) -> DataFrame:
    """All customers and parts: objects are counted per question type before the customers join."""
    strategy = d.part.groupBy(F.col("p_brand").alias("question_type")).agg(F.array_sort(F.collect_set("p_type")).alias("families"))
    counts = d.part.groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))
    types = strategy.select(F.col("question_type").alias("query_id"), "question_type")
    steps = retrieval.entry_strategy(types, strategy, counts).join(counts.select("family", "n"), "family").select(F.col("query_id").alias("question_type"), "step", "family", "n")
    queries = d.customer.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 5 + 1).cast("string")).alias("question_type"))
    return queries.join(steps, "question_type").select("query_id", "step", "family", "n")
