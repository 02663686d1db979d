"""Secret scans with multipart credential linking, in DataFrame operations alone.

Base patterns report what is a secret by itself. A credential often has several parts (an
identifier, a secret, an endpoint) of which some are too weak to report alone: a weak
candidate is reported only where the parts that complement it lie in the same scope. A weak
identifier or secret that overlaps a base span is that span's, and no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioworks.llm.words import row_key
from folioworks.session import staged

# The base patterns. Of assign, group 2 has 8 characters or more. An access
# match has 16 characters or more and a hex match 32: both are longest runs, so that the
# bound within the pattern drops the same matches as a bound on what was found.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Weak parts: an identifier named as one, a run of 40 base-64 characters, an address.
IDENT = r"""(?i:client_?id|user_?name|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
OPAQUE = r"[A-Za-z0-9/+]{40,}"
ENDPOINT = r"""(?i:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mongodb|redis)://[^\x20\x09-\x0D"'<>]+"""
# Who a secret may belong to.
ACCOUNT = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"

#: Kinds in the order of ties, and the role of each.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint", "account")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "opaque": "secret", "endpoint": "place", "account": "id"}
#: A text can only match a kind if it holds one of these (lower-cased); kinds without any are tried on every text.
CLUES = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "ident": ("id", "user"), "endpoint": ("://",), "account": ("@",)}
#: What must lie in a weak candidate's scope.
NEEDS = {"ident": ("secret",), "account": ("secret",), "opaque": ("id",), "endpoint": ("id", "secret")}
#: Code points between two parts of one scope, at most.
SCOPE = 200

#: Matches that are placed at once: in one text they are summed up by chunks, and the chunks again.
CHUNK = 64

SPAN = "array<struct<start:long,rank:int,end:long>>"


def found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0, most: int | None = None) -> Column:
    """Spans of ``pattern``'s leftmost non-overlapping matches, in code points, of which
    ``group`` has from ``least`` to ``most`` characters. A match starts where the pieces
    between matches and the matches before it end. Arrays are built by chunks, so that a
    text's many matches aren't copied for each other one."""
    texts, rank = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), KINDS.index(kind)
    lengths = lambda xs: F.transform(xs, F.length)
    bounded = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else texts
    parts = F.arrays_zip(lengths(texts).alias("m"), lengths(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(texts))).alias("before"), lengths(bounded).alias("g"))
    none, zero = F.array().cast(SPAN), F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        end = start + x["m"]
        keep = x["g"] >= least if most is None else x["g"].between(least, most)
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def placed(parts: Column, at: Column) -> Column:
        return F.aggregate(parts, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  ``value`` is made once, not wherever it is used
    width = lambda c: F.aggregate(c, zero, lambda n, x: n + x["before"] + x["m"])

    def many(parts: Column) -> Column:
        chunk = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(parts)))).cast("int")
        chunks = F.transform(F.sequence(F.lit(1), F.size(parts), chunk), lambda i: F.slice(parts, i, chunk))
        return bound(chunks, lambda cs: F.flatten(F.transform(F.arrays_zip(cs.alias("c"), starts(cs).alias("at")), lambda x: placed(x["c"], x["at"]))))

    def starts(chunks: Column) -> Column:
        step_on = lambda acc, c: F.struct((acc["at"] + width(c)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(chunks, F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out")), step_on, lambda acc: acc["out"])

    walked = bound(parts, lambda p: F.when(F.size(p) <= CHUNK, placed(p, zero)).otherwise(many(p)))
    clues = CLUES.get(kind)
    told = F.lit(True)
    if clues:
        told = F.lit(False)
        for clue in clues:
            told = told | F.contains(F.lower(text), F.lit(clue))
    return F.when(told & text.rlike(pattern), walked).otherwise(none)


def render(spans: Column) -> Column:
    """kind:start:end, by start and then kind, with commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["end"])), ",")


def _linked(spotted: DataFrame) -> DataFrame:
    """(key, added): the weak spans whose complements lie in scope.

    Parts open intervals that reach SCOPE beyond them. Those of a row and role are merged
    into disjoint ones, cut at multiples of twice SCOPE; candidates meet them by row, role
    and multiple. A candidate so meets a few intervals however many parts lie around it.
    """
    roles = F.create_map(*(F.lit(x) for n, k in enumerate(KINDS) for x in (n, ROLES[k])))
    parts = spotted.select("key", F.explode(F.concat("base", "weak")).alias("p")).select("key", "p.*").withColumn("role", roles[F.col("rank")])
    reach = parts.where("role <> 'place'").select("key", "role", (F.col("start") - SCOPE).alias("lo"), (F.col("end") + SCOPE).alias("hi"))
    order = "partition by key, role order by lo, hi"
    flagged = reach.withColumn("new", F.expr(f"case when lo <= max(hi) over ({order} rows between unbounded preceding and 1 preceding) then 0 else 1 end"))
    scopes = flagged.withColumn("island", F.expr(f"sum(new) over ({order} rows unbounded preceding)")).groupBy("key", "role", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cell = lambda at: F.floor(at / (2 * SCOPE))
    scopes = scopes.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    needs = F.create_map(*(x for k, v in NEEDS.items() for x in (F.lit(KINDS.index(k)), F.array(*map(F.lit, v)))))
    asked = spotted.select("key", F.explode("weak").alias("p")).select("key", "p.*")
    asked = asked.select("*", F.explode(needs[F.col("rank")]).alias("role"))
    asked = asked.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    met = asked.join(scopes, ["key", "role", "cell"]).where("end >= lo and start <= hi")
    full = met.groupBy("key", "start", "rank", "end").agg(F.count_distinct("role").alias("n"))
    wanted = F.size(needs[F.col("rank")])
    return full.where(F.col("n") == wanted).groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).cast(SPAN).alias("added"))


def _weak(text: Column) -> Column:
    return F.concat(found(text, IDENT, "ident"), found(text, OPAQUE, "opaque", 0, 40, 40), found(text, ENDPOINT, "endpoint"), found(text, ACCOUNT, "account"))


def _base(text: Column) -> Column:
    return F.concat(found(text, ASSIGN, "assign", 2, 8), found(text, ACCESS, "access"), found(text, HEX, "hex"))


def _loose(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, base, weak, ...) with only those weak spans that no base span overlaps;
    addresses may hold one. A row's spans are swept in order: a weak one is a base span's if
    the furthest end of the base spans that start before its own end lies behind its start."""
    crossing = rows.where((F.size("base") > 0) & F.exists("weak", lambda w: w["rank"] != KINDS.index("endpoint"))).select(key, "base", "weak").dropDuplicates([key])
    each = crossing.select(key, F.explode(F.concat("base", "weak")).alias("p")).select(key, "p.*").withColumn("is_base", F.col("rank") < 3)
    order = Window.partitionBy(key).orderBy(F.when(F.col("is_base"), F.col("start")).otherwise(F.col("end")), "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = each.withColumn("reach", F.max(F.when(F.col("is_base"), F.col("end"))).over(order)).where("not is_base")
    free = (F.col("rank") == KINDS.index("endpoint")) | F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))
    kept = swept.where(free).groupBy(key).agg(F.collect_list(F.struct("start", "rank", "end")).cast(SPAN).alias("_kept"))
    judged = crossing.select(key).join(kept, key, "left").select(F.col(key).alias("_key"), F.coalesce("_kept", F.array().cast(SPAN)).alias("_kept"))
    met = rows.join(judged, rows[key] == judged["_key"], "left")
    return met.withColumn("weak", F.coalesce("_kept", "weak")).select(rows.columns)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, base and added (arrays of start, rank of the kind in
    KINDS, end; code points, end exclusive). Whole texts are scanned.

    Null and empty texts have no spans. Rows are told apart by id and text, so a repeated
    row has the spans of its like. An empty table gives no rows. Other columns play no part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col), row_key(id_col, text).alias("key"), _base(t).alias("base"), _weak(t).alias("weak"))
    spotted = staged(_loose(staged(rows, "spans"), "key"), "secrets")
    loose = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    alone = spotted.where(~loose).select(id_col, "base", F.array().cast(SPAN).alias("added"))
    held = spotted.where(loose)
    linked = held.join(_linked(held.select("key", "base", "weak").distinct()), "key", "left")
    return alone.unionByName(linked.select(id_col, "base", F.coalesce("added", F.array().cast(SPAN)).alias("added")))


def credential_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, part, secret, endpoint): for every identifier (access key, named identifier
    or account) with a complement in its scope, the nearest secret and the nearest address,
    as kind:start:end; null where none is within SCOPE code points.

    Of what starts at or before the identifier that counts which ends last, of what starts
    later that which starts first; the nearer of both wins, the earlier of equals. Each part
    looks at one neighbour on either side, so nothing grows with pairs. Null and empty texts
    have no links, repeated rows have theirs each time, an empty table gives no rows, and
    other columns play no part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _base(t).alias("base"), _weak(t).alias("weak"))
    roles = F.create_map(*(F.lit(x) for n, k in enumerate(KINDS) for x in (n, ROLES[k])))
    kinds = F.array(*map(F.lit, KINDS))
    several = staged(rows.where(F.size("base") + F.size("weak") > 1), "several")  # row numbers are fixed here
    several = _loose(several, "row").select("id", "row", F.explode(F.concat("base", "weak")).alias("p")).select("id", "row", "p.*")
    parts = staged(several.withColumn("role", roles[F.col("rank")]), "parts")
    order, back_order = Window.partitionBy("row").orderBy("start", "rank"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"))
    named = lambda x: F.concat_ws(":", kinds[x["rank"]], x["start"], x["end"])

    made = parts
    for role in ("secret", "place"):
        of = F.col("role") == role
        before = F.max(F.when(of, F.struct("end", (-F.col("start")).alias("s"), (-F.col("rank")).alias("r"))))
        after = F.min(F.when(of, F.struct("start", "rank", "end")))
        made = made.withColumn(f"{role}_before", before.over(order.rowsBetween(Window.unboundedPreceding, 0)))
        made = made.withColumn(f"{role}_after", after.over(back_order.rowsBetween(Window.unboundedPreceding, -1)))
    picked = made.where("role = 'id'")
    for role in ("secret", "place"):
        b, a = F.col(f"{role}_before"), F.col(f"{role}_after")
        back = F.when(b.isNotNull(), F.greatest(F.lit(0), F.col("start") - b["end"]))
        ahead = F.when(a.isNotNull(), F.greatest(F.lit(0), a["start"] - F.col("end")))
        first = F.coalesce(back, F.lit(SCOPE + 1)) <= F.coalesce(ahead, F.lit(SCOPE + 1))
        near = F.when(first & (back <= SCOPE), F.concat_ws(":", kinds[(-b["r"]).cast("int")], -b["s"], b["end"])).when(~first & (ahead <= SCOPE), named(a))
        picked = picked.withColumn(role, near)
    part = named({c: F.col(c) for c in ("rank", "start", "end")})
    return picked.where("secret is not null or place is not null").select(F.col("id").alias(id_col), part.alias("part"), "secret", F.col("place").alias("endpoint"))


def digest(secrets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return secrets.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.concat("base", "added")).alias("spans"))


def _sql(links: bool = False) -> str:
    """The same in DuckDB's SQL: every candidate against every part of its document."""
    text = "select doc_id, coalesce(text, '') as t from documents"
    patterns = {"assign": (ASSIGN, 2, 8, None), "access": (ACCESS, 0, 0, None), "hex": (HEX, 0, 0, None), "ident": (IDENT, 0, 0, None), "opaque": (OPAQUE, 0, 40, 40), "endpoint": (ENDPOINT, 0, 0, None), "account": (ACCOUNT, 0, 0, None)}
    each = []
    for kind, (pattern, group, least, most) in patterns.items():
        rank = KINDS.index(kind)
        p = pattern.replace("'", "''")
        each.append(f"""
            select doc_id, {rank} as rank, '{kind}' as kind, unnest(range(1, len(ms) + 1)) as i, ms, ps, gs
            from (select doc_id, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as ps, regexp_extract_all(t, '{p}', {group}) as gs from docs)
        """)
    bounds = " ".join(f"when '{k}' then length(gs[i]) >= {least}" + (f" and length(gs[i]) <= {most}" if most else "") for k, (_, _, least, most) in patterns.items())
    role = "case kind " + " ".join(f"when '{k}' then '{ROLES[k]}'" for k in patterns) + " end"
    near = lambda r: f"exists (select 1 from parts p where p.doc_id = c.doc_id and p.role = '{r}' and c.e >= p.s - {SCOPE} and c.s <= p.e + {SCOPE})"
    needs = " ".join(f"when '{k}' then " + " and ".join(near(r) for r in v) for k, v in NEEDS.items())
    parts = f"""
    with docs as ({text}),
    matched as ({" union all ".join(each)}),
    placed as (
      select doc_id, kind, rank, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as s, length(ms[i]) as n
      from matched where case kind {bounds} end
    ),
    spans as (select doc_id, kind, rank, s::bigint as s, (s + n)::bigint as e, {role} as role from placed),
    base as (select * from spans where rank < 3),
    parts as (
      select * from base
      union all
      select * from spans w where rank >= 3 and (kind = 'endpoint' or not exists (select 1 from base b where b.doc_id = w.doc_id and b.s < w.e and b.e > w.s))
    )
    """
    if links:
        return parts + _links_sql()
    return f"""{parts.rstrip()},
    kept as (select doc_id, kind, rank, s, e from base union all select doc_id, kind, rank, s, e from parts c where rank >= 3 and case kind {needs} end)
    select d.doc_id,
      count(*) filter (where kind = 'assign')::bigint as n_assign,
      count(*) filter (where kind = 'access')::bigint as n_access,
      count(*) filter (where kind = 'hex')::bigint as n_hex,
      sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < 3), '')) as base_sha256,
      coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where kind is not null), '') as spans
    from docs d left join kept k on k.doc_id = d.doc_id
    group by d.doc_id
    """


def _links_sql() -> str:
    near = []
    for role in ("secret", "place"):
        near.append(f"""
            (select max({{'e': p.e, 's': -p.s, 'r': -p.rank, 'kind': p.kind}}) from parts p where p.doc_id = i.doc_id and p.role = '{role}' and (p.s < i.s or (p.s = i.s and p.rank <= i.rank))) as {role}_b,
            (select min({{'s': p.s, 'r': p.rank, 'e': p.e, 'kind': p.kind}}) from parts p where p.doc_id = i.doc_id and p.role = '{role}' and (p.s > i.s or (p.s = i.s and p.rank > i.rank))) as {role}_a""")
    far = SCOPE + 1
    back, ahead = (lambda r: f"case when {r}_b is null then {far} else greatest(0, s - {r}_b.e) end"), (lambda r: f"case when {r}_a is null then {far} else greatest(0, {r}_a.s - e) end")
    pick = lambda r: f"""case when {back(r)} <= {ahead(r)}
        then case when {back(r)} <= {SCOPE} then {r}_b.kind || ':' || (-{r}_b.s) || ':' || {r}_b.e end
        else case when {ahead(r)} <= {SCOPE} then {r}_a.kind || ':' || {r}_a.s || ':' || {r}_a.e end end"""  # noqa: E731
    return f""",
    ids as (select i.*, {','.join(near)} from parts i where i.role = 'id'),
    told as (select doc_id, kind || ':' || s || ':' || e as part, {pick('secret')} as secret, {pick('place')} as endpoint from ids)
    select * from told where secret is not null or endpoint is not null
    """


ORACLE_SQL = _sql()
LINKS_SQL = _sql(links=True)
