"""Queries of reports: rankings, contributions, gates, runs, lists and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numbers, text, values
from quillon.operators import bundles, config, ingest, metrics, modelrun, ranking, scoring
from quillon.plans import model_queries, model_sql, models, world
from quillon.plans.model_queries import AS_OF, as_of
from quillon.plans.registry import Book
from quillon.session import cut, table

BOOK = Book()
query = BOOK.query
TARGETS = ("founder", "lp", "talent", "connector")
_RANKED = " union all ".join(f"select * from (select '{t}' as target, r.person_id, p.canonical_name, r.priority, r.rank, r.action from ({getattr(model_sql, f'{t}_sql')(AS_OF)}) r join person p using (person_id) order by r.priority desc, p.canonical_name, r.person_id limit 50)" for t in TARGETS)


@query(_RANKED)
def rankings_page(spark: SparkSession, d: str) -> DataFrame:
    """RPT-09, JN-14, SRT-03, MAP-02: the first page of each target's ranking, out of one world, frame and access."""
    w = world.build(spark, d, as_of())
    frame, access = cut(bundles.frame(w, model_queries.scored_people(w), as_of())), cut(modelrun.access_of(w, models.ACCESS, as_of()))
    out = None
    for target in TARGETS:
        r = model_queries.run(w, target, as_of(), access=access, frame=frame)
        page = ranking.page(r.withColumn("target", F.lit(target)).select("target", "person_id", "canonical_name", "priority", "rank", "action").orderBy(F.desc("priority"), "canonical_name", "person_id"), "-priority", {"priority": "priority"}, "canonical_name")
        out = page if out is None else out.unionByName(page)
    return out


_FOUNDER = config.parse(models.FOUNDER)
_PREFIX = model_sql.founder_sql(AS_OF)
_PREFIX = _PREFIX[: _PREFIX.rindex("select person_id")]
_MEANS = " union all ".join(
    f"select '{n}' as dimension, '{f}' as feature, count(n_{f}) as included, round(avg(case when n_{f} is not null then round(n_{f} * {spec.weight}::double / {model_sql._present(dim)} + 1e-9, 4) end), 4) as contribution from nw"
    for n, dim in scoring.weighted(_FOUNDER).items() for f, spec in dim.features.items()
)


def _founder_scored(spark: SparkSession, d: str) -> DataFrame:
    w = world.build(spark, d, as_of())
    frame = cut(bundles.frame(w, model_queries.scored_people(w), as_of()))
    access = modelrun.access_of(w, models.ACCESS, as_of())
    return cut(modelrun.scored(frame, w, _FOUNDER, access, as_of(), modelrun.held_sectors(w.organization)))


@query(f"{_PREFIX} {_MEANS}")
def mean_contributions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19, SCO-08: what each founder feature adds on average where it counts."""
    long = modelrun.contributions(_founder_scored(spark, d), _FOUNDER)
    by = long.groupBy("dimension", "feature")
    return by.agg(F.sum(F.col("included").cast("bigint")).alias("included"), F.round(F.avg(F.when(F.col("included"), F.col("contribution"))), 4).alias("contribution"))


@query(f"{_PREFIX}, st as (select list_sort(list(priority), 'DESC') as ps from rk) select cast(len(ps) as bigint) as n, round(list_avg(ps), 2) as mean, ps[cast(floor(len(ps) / 2) as int) + 1] as p50, ps[greatest(0, cast(floor(len(ps) * 0.1) as int) - 1) + 1] as p90, ps[1] as max from st".replace("from fin)\n,", "from fin),"))
def ranking_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-20: the spread of the founder ranking."""
    return metrics.ranking_stats(_founder_scored(spark, d).withColumn("target", F.lit("founder")), ["target"], "priority").drop("target")


@query("""with l as (select lang, contains(lower(text), 'million') as predicted, contains(lower(text), 'investors') or contains(lower(text), 'million') and n_chars > 500 as gold, published_at < timestamp '2026-01-01' as early from documents where text is not null and lang is not null),
m as (select lang, early, round(case when 2 * tp + fp + fn = 0 then 1 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from (select lang, early, count(*) filter (gold and predicted) as tp, count(*) filter (not gold and predicted) as fp, count(*) filter (gold and not predicted) as fn from l where early is not null group by 1, 2))
select n.lang, b.f1 as before, n.f1 as now, coalesce(n.f1 < b.f1 - 0.05, false) as regressed from m n left join m b on b.lang = n.lang and b.early where not n.early""")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    """SCO-11: F1 of each language's newer texts against the older ones' as baseline."""
    low = F.lower("text")
    x = table(spark, d, "documents").filter("text is not null and lang is not null and published_at is not null")
    x = x.select("lang", low.contains("million").alias("predicted"), (low.contains("investors") | (low.contains("million") & (F.col("n_chars") > 500))).alias("gold"), (F.col("published_at") < F.lit("2026-01-01").cast("timestamp_ntz")).alias("early"))
    measure = lambda c: metrics.prf(x.filter(c), "lang", "gold", "predicted")
    return metrics.gate(measure("not early"), measure("early"), "lang", "f1")


@query("""select batch_id, min(ingested_at) as started_at, count(*) as records, count(person_id) as resolved from observation where batch_id is not null group by 1 order by started_at desc, batch_id desc limit 1""")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """WIN-11, ORC-03: the run that started last."""
    by = table(spark, d, "observation").filter("batch_id is not null").groupBy("batch_id").agg(F.min("ingested_at").alias("started_at"), F.count("*").alias("records"), F.count("person_id").alias("resolved"))
    return by.orderBy(F.desc("started_at"), F.desc("batch_id")).limit(1)


@query("""select subject_id, fact_type, value.value as value, fact_id from fact where value.value is not null qualify row_number() over (partition by subject_id, fact_type order by created_at desc, fact_id) = 1""")
def newest_known(spark: SparkSession, d: str) -> DataFrame:
    """WIN-13: the newest payload that isn't null, by a combined minimum."""
    f = table(spark, d, "fact").filter("value.value is not null")
    first = F.min_by(F.struct(F.col("value.value").alias("value"), "fact_id"), F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("fact_id"))).alias("r")
    return f.groupBy("subject_id", "fact_type").agg(first).select("subject_id", "fact_type", "r.value", "r.fact_id")


@query("""select content_type, case when raw_json is null and raw_text is null then 'empty' when raw_json is not null and try_cast(raw_json as json) is null then 'failed' else 'ok' end as status, count(*) as n from observation group by 1, 2""")
def extraction_runs(spark: SparkSession, d: str) -> DataFrame:
    """SNK-13, EXT-06: how reading each observation went; an unreadable payload is recorded as failed and stops nothing."""
    failed = F.col("raw_json").isNotNull() & F.try_parse_json("raw_json").isNull()
    status = F.when(F.col("raw_json").isNull() & F.col("raw_text").isNull(), "empty").when(failed, "failed").otherwise("ok")
    return table(spark, d, "observation").groupBy("content_type", status.alias("status")).agg(F.count("*").alias("n"))


@query("""select doc_id, upper(substr(s, 1, 1)) || substr(s, 2) as label, case when length(text) > 80 then rtrim(substr(text, 1, 79), ' ') || '\u2026' else text end as shown,
case when a < 1 then 'today' when a < 7 then 'this week' when a < 30 then 'this month' when a < 365 then 'this year' when a is not null then 'earlier' end as age
from (select *, lower(regexp_replace(content_type, '_+', ' ', 'g')) as s, date_diff('microsecond', published_at, timestamp '2026-09-06 23:59:59') / 86400000000.0 as a from documents)""")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    """STR-12: codes, texts and ages as people read them."""
    age = numbers.days_between(F.col("published_at"), as_of())
    return table(spark, d, "documents").select("doc_id", text.label(F.col("content_type")).alias("label"), text.truncated(F.col("text")).alias("shown"), text.age_bucket(age).alias("age"))


_TABLES = ("person", "employment", "fact", "observation", "organization", "er_candidate", "data_source", "watchlist")


@query(" union all ".join(f"select '{t}' as name, count(*) as records, count(*) > 0 as healthy from {t}" for t in _TABLES))
def table_health(spark: SparkSession, d: str) -> DataFrame:
    """RPT-06, SRC-15: whether each table answers and how many rows it has."""
    out = None
    for name in _TABLES:
        one = table(spark, d, name).agg(F.count("*").alias("records")).select(F.lit(name).alias("name"), "records", (F.col("records") > 0).alias("healthy"))
        out = one if out is None else out.union(one)
    return out


@query("""with u as (select distinct 'founder|' || cast(cast(observed_at as date) as varchar) || '|weekly' as universe from observation where observed_at >= timestamp '2026-08-01'), s as (select 'founder|' || cast(cast(occurred_at as date) as varchar) || '|weekly' as universe from observation where occurred_at between timestamp '2026-08-01' and timestamp '2026-08-15')
select universe, universe not in (select universe from s) as is_new from u""")
def universe_keys(spark: SparkSession, d: str) -> DataFrame:
    """HSH-03, SNK-11: ranking universes by key, and which are not stored yet."""
    o = table(spark, d, "observation")
    key = lambda at: values.universe_key(F.lit("founder"), F.col(at).cast("date"), F.lit("weekly")).alias("universe")
    wanted = o.filter(F.col("observed_at") >= F.lit("2026-08-01").cast("timestamp_ntz")).select(key("observed_at")).distinct()
    stored = o.filter(F.col("occurred_at").between(F.lit("2026-08-01").cast("timestamp_ntz"), F.lit("2026-08-15").cast("timestamp_ntz"))).select(key("occurred_at"))
    new = ingest.missing(wanted, stored, ["universe"]).withColumn("is_new", F.lit(True))
    return wanted.join(new, "universe", "left").select("universe", F.coalesce("is_new", F.lit(False)).alias("is_new"))


_LISTS = """select person_id, 'job' as kind, organization_id as id, cast(started_at as timestamp) as at, coalesce(title, '') as detail from employment union all select subject_id, 'fact', fact_id, valid_from, fact_type from fact
union all select person_id, 'observation', observation_id, observed_at, content_type from observation where person_id is not null"""


@query(f"select person_id, kind, id, at, detail, cast(place as bigint) as place from (select *, row_number() over (partition by person_id, kind order by at desc nulls last, id, detail) as place from ({_LISTS})) where place <= 5 and person_id in (select person_id from person where merged_into_id is null)".replace(" as at,", ' as "at",').replace(" at,", ' "at",').replace("order by at", 'order by "at"'))
def person_resources(spark: SparkSession, d: str) -> DataFrame:
    """RPT-07, SRT-06: each live person's newest five jobs, facts and observations, undated ones last."""
    row = lambda df, person, kind, id_, at, detail: df.select(F.col(person).alias("person_id"), F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(at).cast("timestamp_ntz").alias("at"), F.coalesce(detail, F.lit("")).alias("detail"))
    every = row(table(spark, d, "employment"), "person_id", "job", "organization_id", "started_at", "title").union(row(table(spark, d, "fact"), "subject_id", "fact", "fact_id", "valid_from", "fact_type"))
    every = every.union(row(table(spark, d, "observation").filter("person_id is not null"), "person_id", "observation", "observation_id", "observed_at", "content_type"))
    live = table(spark, d, "person").filter("merged_into_id is null").select("person_id")
    top = ranking.top_k(every.join(live, "person_id", "left_semi"), ["person_id", "kind"], [F.desc_nulls_last("at"), F.asc("id"), F.asc("detail")], 5)
    return top.withColumn("place", F.col("place").cast("bigint"))
