"""The pN_ queries of the general data problems and, where SQL can say it, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import asof, dedupe, nested, snapshots
from quillon.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observation").select("observation_id", "source_id", "provider_record_id", "observed_at", "ingested_at")
    return dedupe.later_copies(o, "observation_id", [F.col("source_id"), dedupe.identifier("provider_record_id")], ["observed_at", "ingested_at"])


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The observations after repeated deliveries are gone."""
    o = table(spark, d, "observation")
    kept = dedupe.keep_first(o, [F.col("source_id"), dedupe.identifier("provider_record_id")], ["observed_at", "ingested_at", "observation_id"])
    return kept.select("observation_id", "source_id", "batch_id")


def p1_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Each week's batch against all that was stored before it: here the last week against the rest."""
    o = table(spark, d, "observation").select("observation_id", "source_id", "provider_record_id", "observed_at", "ingested_at", "batch_id")
    last = F.broadcast(o.agg(F.max("batch_id").alias("__last")))
    marked = o.join(last)
    batch = marked.filter(F.col("batch_id") == F.col("__last")).drop("__last")
    stored = marked.filter(F.col("batch_id") < F.col("__last")).drop("__last")
    order = ["observed_at", "ingested_at", "observation_id"]
    return dedupe.admit(batch, stored, ["source_id", "provider_record_id"], order).select("observation_id", "batch_id")


def profile_nodes(spark: SparkSession, d: str, attributes: bool) -> DataFrame:
    o = table(spark, d, "observation").filter("content_type = 'profile_snapshot'")
    return nested.nodes(o, "observation_id", "raw_json", "previous_snapshot", attributes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    n = profile_nodes(spark, d, False)
    return n.select(F.col("record_id").alias("observation_id"), "node", "job_pos", "role_pos", "project_pos")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All node rows with interval labels, parent and own fields."""
    return profile_nodes(spark, d, True)


def p2_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of profiles and earlier profiles."""
    n = profile_nodes(spark, d, True)
    fields = ["headline", "current_company", "current_title", "location"]
    both = nested.typed(n, "profile", fields).withColumn("node", F.lit("profile")).unionByName(nested.typed(n, "previous", fields).withColumn("node", F.lit("previous")))
    return both.select(F.col("record_id").alias("observation_id"), "node", *fields)


def p2_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles with the job that contains each, the two tables joined by their intervals."""
    n = cut(profile_nodes(spark, d, True))
    roles, jobs = nested.typed(n, "role", ["title"]), nested.typed(n, "job", ["company"])
    keys = ["record_id", "document"]
    within = nested.contained(jobs, roles)
    linked = within.join(roles.withColumnsRenamed({"pre": "descendant_pre", "position": "role_pos"}), [*keys, "descendant_pre"]).join(jobs.withColumnsRenamed({"pre": "ancestor_pre", "position": "job_pos"}).select(*keys, "ancestor_pre", "job_pos", "company"), [*keys, "ancestor_pre"])
    return linked.select(F.col("record_id").alias("observation_id"), "job_pos", "role_pos", "company", "title")


def roster(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot_date, person_id, title, company, headline) of the roster feed, one row of a person per delivery.

    Of repeated deliveries of one person in one snapshot the first by arrival counts.
    """
    o = table(spark, d, "observation").filter("source_id = 'src-00' and content_type = 'profile_snapshot' and person_id is not null and raw_json is not null")
    opened = F.try_parse_json("raw_json")
    inner = F.try_parse_json(F.try_variant_get(opened, "$", "string"))
    is_text = F.schema_of_variant(opened) == "STRING"
    o = o.select("observation_id", "person_id", "observed_at", "ingested_at", F.when(is_text, inner).otherwise(opened).alias("v")).filter("v is not null")
    o = o.filter(F.schema_of_variant("v").startswith("OBJECT"))
    has = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.profile", "variant")).startswith("OBJECT"), F.lit(False))
    fields = {"title": "current_title", "company": "current_company", "headline": "headline"}
    pick = lambda f: F.when(has, F.try_variant_get("v", f"$.profile.{f}", "string")).otherwise(F.try_variant_get("v", f"$.{f}", "string"))
    rows = o.select("person_id", "observed_at", "ingested_at", "observation_id", F.try_variant_get("v", "$.observed_on", "string").alias("snapshot_date"), *(snapshots.canonical_text(pick(f)).alias(n) for n, f in fields.items()))
    rows = rows.filter(F.col("snapshot_date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    first = F.min_by(F.struct(*fields), F.struct("observed_at", "ingested_at", "observation_id")).alias("r")
    return rows.groupBy("snapshot_date", "person_id").agg(first).select("snapshot_date", "person_id", *(f"r.{n}" for n in fields))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.changes(cut(roster(spark, d)), "snapshot_date", "person_id", ["title", "company", "headline"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observation").filter("content_type in ('news_article', 'activity_post') and person_id is not null")
    events = o.select(F.col("person_id").alias("entity"), F.col("observation_id").alias("event_id"), F.coalesce("occurred_at", "observed_at").alias("at"))
    f = table(spark, d, "fact").filter("fact_type in ('CURRENT_TITLE', 'LOCATION')")
    known = F.coalesce("verified_at", "created_at")
    versions = f.select(F.col("subject_id").alias("entity"), F.col("fact_type").alias("attribute"), F.col("fact_id").alias("version_id"), F.coalesce(F.col("valid_from"), known).alias("start"), known.alias("known"), F.col("valid_to").alias("until"))
    return asof.as_known(events, versions).select(F.col("event_id").alias("observation_id"), F.col("version_id").alias("fact_id"))


QUERIES = {q.__name__: q for q in (p1_found, p1_kept, p1_admitted, p2_found, p2_nodes, p2_profiles, p2_roles, p5_found, p6_found)}

_P1_KEYED = """
keyed as (select observation_id, source_id, batch_id, observed_at, ingested_at,
    lower(regexp_replace(provider_record_id, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g')) as pid from observation),
ranked as (select *, row_number() over (partition by source_id, pid order by observed_at, ingested_at, observation_id) as rn
    from keyed where source_id is not null and pid is not null)
"""

#: The object a JSON text holds, or the object in the JSON string that it holds.
_OPENED = "case when json_type(try_cast({0} as json)) = 'VARCHAR' then try_cast(try_cast({0} as json) ->> '$' as json) else try_cast({0} as json) end"
_DOCS = f"""
opened as (select observation_id, {_OPENED.format('raw_json')} as d, {_OPENED.format('previous_snapshot')} as b from observation where content_type = 'profile_snapshot'),
root as (select observation_id, d from opened where json_type(d) = 'OBJECT'),
prof as (select observation_id, case when json_type(d, '$.profile') = 'OBJECT' then json_extract(d, '$.profile') else d end as p from root),
prev as (select observation_id from opened where json_type(b) = 'OBJECT')"""
_EACH = "unnest(json_extract(case when json_type({0}) = 'OBJECT' then json_array({0}) when json_type({0}) = 'ARRAY' then {0} else '[]'::json end, '$[*]')) as e, unnest(range(cast(json_array_length(case when json_type({0}) = 'OBJECT' then json_array({0}) when json_type({0}) = 'ARRAY' then {0} else '[]'::json end) as bigint))) as i"
_CANON = "coalesce(lower(regexp_replace(regexp_replace(json_extract_string(p, '$.{0}'), '[\\s\\x{{00a0}}]+', ' ', 'g'), '^ | $', '', 'g')), '')"

SQL = {
    "p1_found": f"with {_P1_KEYED} select observation_id from ranked where rn > 1",
    "p1_kept": f"with {_P1_KEYED} select observation_id, source_id, batch_id from ranked where rn = 1 union all select observation_id, source_id, batch_id from keyed where source_id is null or pid is null",
    "p6_found": """
with e as (select observation_id, person_id, coalesce(occurred_at, observed_at) as t from observation
    where content_type in ('news_article', 'activity_post') and person_id is not null),
f as (select fact_id, subject_id, fact_type, valid_to, coalesce(verified_at, created_at) as known,
    coalesce(valid_from, verified_at, created_at) as start from fact where fact_type in ('CURRENT_TITLE', 'LOCATION')),
r as (select observation_id, fact_id, row_number() over (partition by observation_id, fact_type order by start desc, known desc, fact_id) as rn
    from e join f on subject_id = person_id and start <= t and known <= t and (valid_to is null or valid_to > t))
select observation_id, fact_id from r where rn = 1""",
    "p1_admitted": f"""with {_P1_KEYED}, m as (select max(batch_id) as last from observation),
b as (select k.*, row_number() over (partition by lower(regexp_replace(source_id, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')), pid order by observed_at, ingested_at, observation_id) as rn from keyed k, m where batch_id = last),
s as (select k.* from keyed k, m where batch_id < last)
select observation_id, batch_id from b where source_id is null or pid is null
union all select observation_id, batch_id from b where source_id is not null and pid is not null and rn = 1 and not exists (select 1 from s where lower(s.source_id) = lower(b.source_id) and s.pid = b.pid)""",
    "p2_found": f"""with {_DOCS},
arr as (select observation_id, case when json_type(p, '$.experience') in ('ARRAY', 'OBJECT') then json_extract(p, '$.experience') else json_extract(p, '$.positions') end as v from prof),
j as (select observation_id, i as job_pos, e from (select observation_id, {_EACH.format('v')} from arr) where json_type(e) = 'OBJECT'),
r as (select observation_id, job_pos, i as role_pos, e from (select observation_id, job_pos, {_EACH.format("json_extract(e, '$.roles')")} from j) where json_type(e) = 'OBJECT'),
q as (select observation_id, job_pos, role_pos, i as project_pos from (select observation_id, job_pos, role_pos, {_EACH.format("json_extract(e, '$.projects')")} from r) where json_type(e) = 'OBJECT')
select observation_id, 'profile' as node, cast(-1 as int) as job_pos, cast(-1 as int) as role_pos, cast(-1 as int) as project_pos from prof
union all select observation_id, 'previous', -1, -1, -1 from prev
union all select observation_id, 'job', cast(job_pos as int), -1, -1 from j
union all select observation_id, 'role', cast(job_pos as int), cast(role_pos as int), -1 from r
union all select observation_id, 'project', cast(job_pos as int), cast(role_pos as int), cast(project_pos as int) from q""",
    "p2_profiles": f"""with {_DOCS}, every as (select observation_id, 'profile' as node, p from prof union all select observation_id, 'previous', b from opened where json_type(b) = 'OBJECT')
select observation_id, node, {', '.join(f"json_extract_string(p, '$.{f}') as {f}" for f in ('headline', 'current_company', 'current_title', 'location'))} from every""",
    "p2_roles": f"""with {_DOCS},
arr as (select observation_id, case when json_type(p, '$.experience') in ('ARRAY', 'OBJECT') then json_extract(p, '$.experience') else json_extract(p, '$.positions') end as v from prof),
j as (select observation_id, i as job_pos, e from (select observation_id, {_EACH.format('v')} from arr) where json_type(e) = 'OBJECT'),
r as (select observation_id, job_pos, json_extract_string(j, '$.company') as company, i as role_pos, e from (select observation_id, job_pos, e as j, {_EACH.format("json_extract(e, '$.roles')")} from (select observation_id, job_pos, e from j)) where json_type(e) = 'OBJECT')
select observation_id, cast(job_pos as int) as job_pos, cast(role_pos as int) as role_pos, company, json_extract_string(e, '$.title') as title from r""",
    "p5_found": f"""with {_DOCS},
r as (select o.person_id, o.observed_at, o.ingested_at, o.observation_id, json_extract_string(root.d, '$.observed_on') as day,
    {_CANON.format('current_title')} as title, {_CANON.format('current_company')} as company, {_CANON.format('headline')} as headline
    from observation o join root using (observation_id) join prof using (observation_id) where o.source_id = 'src-00' and o.person_id is not null),
s as (select day, person_id, title, company, headline from r where regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') qualify row_number() over (partition by day, person_id order by observed_at, ingested_at, observation_id) = 1),
days as (select day, lead(day) over (order by day) as next from (select distinct day from s)),
a as (select next as day, person_id, title, company, headline from s join days using (day) where next is not null),
b as (select s.* from s where day > (select min(day) from s))
select coalesce(a.day, b.day) as snapshot_date, coalesce(a.person_id, b.person_id) as person_id, case when a.person_id is null then 'added' when b.person_id is null then 'removed' else 'changed' end as change
from a full join b on a.day = b.day and a.person_id = b.person_id where a.person_id is null or b.person_id is null or (a.title, a.company, a.headline) <> (b.title, b.company, b.headline)""",
}
