"""Queries of features, scores, decisions and measures. Weights are this module's parameters, not recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numbers, text
from quillon.operators import features, metrics, ranking, rules, scoring
from quillon.plans.event_queries import PROFILE_PAIRS_SQL, profile_pairs
from quillon.plans.registry import Book
from quillon.session import broadcast_if_small, cut, table

BOOK = Book()
query = BOOK.query

#: A model over customers' orders: features of two dimensions, with every way to treat a missing value.
MODEL = {
    "dimensions": {
        "quality": {
            "weight": 0.6,
            "features": {
                "orders": {"weight": 0.5, "normalization": "capped_count", "params": {"max": 20}, "missing": "zero"},
                "urgent": {"weight": 0.3, "normalization": "min_ratio", "params": {"target": 5}, "missing": "unknown"},
                "balance": {"weight": 0.2, "normalization": "linear_cap", "params": {"divisor": 10000}, "missing": "neutral"},
            },
        },
        "timing": {"weight": 0.4, "features": {"days_since": {"weight": 1.0, "normalization": "exp_decay", "params": {"half_life": 365}, "missing": "unknown"}}},
    }
}

_WIDE = """wide as (select c_custkey, n as orders, u as urgent, case when c_acctbal >= 0 then c_acctbal end as balance, d as days_since from customer left join
(select o_custkey, count(*) as n, nullif(count(*) filter (o_orderpriority = '1-URGENT'), 0) as u, date_diff('day', cast(max(o_orderdate) as date), date '2002-01-01') as d from orders group by 1) on o_custkey = c_custkey)"""


def _wide(spark: SparkSession, d: str) -> DataFrame:
    urgent = F.nullif(F.sum((F.col("o_orderpriority") == "1-URGENT").cast("bigint")), F.lit(0).cast("bigint"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), urgent.alias("urgent"), F.datediff(F.lit("2002-01-01").cast("date"), F.max("o_orderdate").cast("date")).alias("days_since"))
    c = table(spark, d, "customer")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "orders", "urgent", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), "days_since")


@query("""select p_partkey, case when p_size is null then null when p_size <> 0 then 1.0::double else 0.0 end as binary, round(least(1, p_size / 20.0), 6) as capped, round(least(1, p_retailprice / 1500.0), 6) as linear,
round(greatest(0.0, 1 - p_size / 30.0), 6) as inverted, round(exp(-ln(2) / 15.0 * p_size), 6) as decay, case when p_size <= 5 then 1.0 when p_size <= 20 then 0.7 else 0.1::double end as bucket,
case p_brand when 'Brand#11' then 1.0 when 'Brand#12' then 0.6 else 0.2::double end as tiered, round(least(1, p_retailprice / 2000.0), 6) as unit from part""")
def normalizers_all(spark: SparkSession, d: str) -> DataFrame:
    """MTH-01: all normalisers."""
    n = lambda name, c, **p: F.round(numbers.normalized(name, c, p), 6)
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", n("binary", size).alias("binary"), n("capped_count", size, max=20).alias("capped"), n("linear_cap", price, divisor=1500).alias("linear"),
        n("min_ratio", size, target=30, invert=True).alias("inverted"), n("exp_decay", size, half_life=15).alias("decay"), n("bucket", size, thresholds=[5, 20], values=[1.0, 0.7, 0.1]).alias("bucket"),
        n("tiered", F.col("p_brand"), tiers={"Brand#11": 1.0, "Brand#12": 0.6, "_default": 0.2}).alias("tiered"), n("passthrough_unit", price / 2000.0).alias("unit"),
    )


_DIM = f"""{_WIDE}, n as (select c_custkey, least(1.0, coalesce(orders, 0) / 20.0) as a, case when urgent is not null then least(1.0, urgent / 5.0) end as b, case when balance is null then 0.5 else least(1.0, balance / 10000.0) end as c, case when days_since is not null then least(1.0, exp(-ln(2) / 365 * greatest(0.0, days_since))) end as t from wide),
dims as (select c_custkey, round(100 * (round(0.5 * a / (0.7 + case when b is null then 0 else 0.3 end), 6) + coalesce(round(0.3 * b / 1.0, 6), 0) + round(0.2 * c / (0.7 + case when b is null then 0 else 0.3 end), 6)), 4) as quality,
round(100 * round(t, 6), 4) as timing from n)"""


def _dimensions(spark: SparkSession, d: str) -> DataFrame:
    scoring.check_model(MODEL)
    long = scoring.contributions(_wide(spark, d), "c_custkey", MODEL)
    return scoring.dimension_scores(long, "c_custkey")


@query(f"with {_DIM} select c_custkey, 'quality' as dimension, quality as score from dims union all select c_custkey, 'timing', timing from dims")
def dim_weighted_missing(spark: SparkSession, d: str) -> DataFrame:
    """SCO-01, SCO-07, AGG-09, FEA-20: dimension scores with unknown, zero and neutral features."""
    return _dimensions(spark, d)


@query(f"with {_DIM} select c_custkey, quality, timing, round((0.6 * quality + coalesce(0.4 * timing, 0)) / (0.6 + case when timing is null then 0 else 0.4 end), 4) as priority from dims")
def priority_renorm(spark: SparkSession, d: str) -> DataFrame:
    """SCO-04, SCO-05, AGG-11: priority over the known dimensions."""
    wide = _dimensions(spark, d).groupBy("c_custkey").pivot("dimension", ["quality", "timing"]).agg(F.first("score"))
    return wide.withColumn("priority", scoring.priority({k: (F.col(k), v["weight"]) for k, v in MODEL["dimensions"].items()}))


RULES = [
    {"when": {"timing_lt": 20, "priority_gte": 45}, "then": "VERIFY", "reason_codes": ["STALE"]},
    {"when": {"priority_gte": 50}, "then": "CONTACT", "reason_codes": ["HIGH", "FRESH"]},
    {"when": {"priority_gte": 30}, "then": "MONITOR", "reason_codes": ["MIDDLE"]},
    {"when": {"always": True}, "then": "PASS", "reason_codes": ["LOW"]},
]


@query(f"""with {_DIM}, p as (select c_custkey, timing, round((0.6 * quality + coalesce(0.4 * timing, 0)) / (0.6 + case when timing is null then 0 else 0.4 end), 4) as priority from dims),
a as (select *, case when coalesce(timing, 0) < 20 and priority >= 45 then 'VERIFY' when priority >= 50 then 'CONTACT' when priority >= 30 then 'MONITOR' else 'PASS' end as action from p)
select c_custkey, action, case action when 'VERIFY' then ['STALE'] when 'CONTACT' then ['HIGH', 'FRESH'] when 'MONITOR' then ['MIDDLE'] else ['LOW'] end as reasons from a""")
def action_first_match(spark: SparkSession, d: str) -> DataFrame:
    """ACT-01, ACT-02: the first rule that holds, with its reasons."""
    decision, reasons = rules.first_match(RULES, ["timing", "priority"])
    return priority_renorm(spark, d).select("c_custkey", decision.alias("action"), reasons.alias("reasons"))


@query("""with h as (select o_custkey, o_orderdate < timestamp '1999-01-01' as early, count(*) as n, sum(o_totalprice) as v from orders group by 1, 2),
p as (select o_custkey, max(case when not early then least(1.0, n / 20.0) end) as a, max(case when early then least(1.0, n / 20.0) end) as b from h group by 1)
select o_custkey, 'orders' as feature, round(a * 0.5 / 0.5, 6) as now, round(b * 0.5 / 0.5, 6) as before, round(coalesce(round(a, 6), 0) - coalesce(round(b, 6), 0), 6) as change from p""")
def contribution_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """SCO-08, SCO-10: contributions against those of an earlier period."""
    model = {"dimensions": {"quality": {"weight": 1.0, "features": {"orders": {"weight": 0.5, "normalization": "capped_count", "params": {"max": 20}}}}}}
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    side = lambda c: scoring.contributions(o.filter(c).groupBy("o_custkey").agg(F.count("*").alias("orders")), "o_custkey", model)
    return scoring.breakdown(side(~early), side(early), ["o_custkey", "feature"])


@query("""select l_orderkey, round((0.5 * avg(case 1 + l_linenumber % 5 when 1 then 1.0 when 2 then 0.85 when 3 then 0.7 when 4 then 0.55 else 0.35 end) + 0.3 * avg(exp(-ln(2) / 365.0 * greatest(0, date_diff('day', cast(l_shipdate as date), date '2002-01-01')))) + 0.2 * least(1.0, count(distinct l_suppkey) / 3.0)), 4) as confidence from lineitem group by 1""")
def confidence_components(spark: SparkSession, d: str) -> DataFrame:
    """SCO-06, AGG-12: confidence from strength, recency and independence of evidence."""
    tier = numbers.tier_weight(1 + F.col("l_linenumber") % 5)
    recency = numbers.decayed(F.lit(1.0), F.datediff(F.lit("2002-01-01").cast("date"), F.col("l_shipdate").cast("date")).cast("double"), 365.0)
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg(tier).alias("strength"), F.avg(recency).alias("recency"), (F.count_distinct("l_suppkey") / 3.0).alias("independence"))
    return by.select("l_orderkey", scoring.confidence({"s": (F.col("strength"), 0.5), "r": (F.col("recency"), 0.3), "i": (F.col("independence"), 0.2)}).alias("confidence"))


_KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_PIVOT = ", ".join(f"max(case when o_orderpriority = '{k}' then o_totalprice end) as k{i + 1}" for i, k in enumerate(_KINDS))


@query(f"""with l as (select * from orders qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey) = 1) select o_custkey, {_PIVOT} from l where o_orderpriority in {_KINDS} group by 1""")
def features_long_pivot(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14: the latest value of each kind in a row."""
    p = features.pivoted(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", [F.desc("o_orderdate"), F.asc("o_orderkey")], list(_KINDS))
    return p.select("o_custkey", *(F.col(f"`{k}`").alias(f"k{i + 1}") for i, k in enumerate(_KINDS)))


@query("""with l as (select o_custkey, count(distinct o_orderpriority) as k from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') group by 1) select count(*) as people, round(sum(5 - k) / (5.0 * count(*)), 6) as missing_rate from l""")
def missing_rate(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21."""
    p = features_long_pivot(spark, d)
    missing = sum((F.col(f"k{i + 1}").isNull().cast("int") for i in range(5)), F.lit(0))
    return p.agg(F.count("*").alias("people"), F.round(F.sum(missing) / (5.0 * F.count("*")), 6).alias("missing_rate"))


TOPICS = ["payments", "climate", "genomics", "chip", "robotics"]
_THESIS = "list_filter([" + ", ".join(f"case when contains(lower(text), '{t}') then '{t}' end" for t in TOPICS) + "], lambda x: x is not null)"


@query(f"select doc_id, round(least(1.0, len({_THESIS}) / 4.0), 4) as score from documents where text is not null")
def thesis_dimension_match(spark: SparkSession, d: str) -> DataFrame:
    """THS-03, STR-04, STR-11."""
    x = table(spark, d, "documents").filter("text is not null")
    return x.select("doc_id", features.phrase_match(F.col("text"), TOPICS).alias("score"))


@query("""with r as (select p_partkey, p_size, p_type from part where p_brand = 'Brand#11' and p_size <= 12), c as (select c_custkey, c_nationkey, c_mktsegment from customer),
s as (select c_custkey, p_partkey, round(greatest(0.0, 1 - abs(c_nationkey - p_size) / 10.0) + case when substr(c_mktsegment, 1, 1) = substr(p_type, 1, 1) then 0.5 else 0 end, 4) as score from c, r)
select c_custkey, p_partkey, score from s qualify row_number() over (partition by c_custkey order by score desc, p_partkey) = 1""")
def role_match_best(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: the best open role of each person.

    A score knows of a role its size and the first letter of its type, of a person the nation and the first letter of the
    segment: kinds of people meet kinds of roles, and the least key stands for a kind of role.
    """
    roles = table(spark, d, "part").filter("p_brand = 'Brand#11' and p_size <= 12").groupBy("p_size", F.substring("p_type", 1, 1).alias("t")).agg(F.min("p_partkey").alias("p"))
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.substring("c_mktsegment", 1, 1).alias("m"))
    score = F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("c_nationkey") - F.col("p_size")) / 10.0) + F.when(F.col("m") == F.col("t"), 0.5).otherwise(0.0), 4)
    first = F.struct((-score).alias("s"), F.col("p").isNull().alias("none"), "p")
    best = people.select("c_nationkey", "m").distinct().crossJoin(broadcast_if_small(cut(roles))).groupBy(F.col("c_nationkey").alias("nation"), F.col("m").alias("letter")).agg(F.min(first).alias("b"))
    matched = people.join(best, F.col("c_nationkey").eqNullSafe(F.col("nation")) & F.col("m").eqNullSafe(F.col("letter")))
    return matched.groupBy("c_custkey").agg(F.min("b").alias("b")).select("c_custkey", F.col("b.p").alias("p_partkey"), (-F.col("b.s")).alias("score"))


@query("""with q as (select vec_id as query_id, embedding as qe from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, round(list_dot_product(qe::double[], embedding::double[]) / sqrt(list_dot_product(qe::double[], qe::double[]) * list_dot_product(embedding::double[], embedding::double[])), 6) as cosine from q, embeddings where vec_id <> query_id)
select query_id, vec_id, cosine, cast(row_number() over (partition by query_id order by cosine desc, vec_id) as bigint) as place from s qualify place <= 5""")
def embedding_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """SRT-04: nearest vectors of every fiftieth one, against all."""
    e = table(spark, d, "embeddings")
    return features.nearest(e, e.filter("vec_id % 50 = 0"), 5).withColumn("place", F.col("place").cast("bigint"))


@query("""with l as (select doc_id, lang, contains(lower(text), 'million') as predicted, contains(lower(text), 'investors') or contains(lower(text), 'million') and n_chars > 500 as gold from documents where text is not null and lang is not null),
c as (select lang, count(*) filter (gold and predicted) as tp, count(*) filter (not gold and predicted) as fp, count(*) filter (gold and not predicted) as fn from l group by 1)
select lang, tp, fp, fn, round(case when tp + fp = 0 then 1 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 1 else tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn = 0 then 1 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from c""")
def prf_by_category(spark: SparkSession, d: str) -> DataFrame:
    """AGG-22, MAP-04, SET-04."""
    low = F.lower("text")
    x = table(spark, d, "documents").filter("text is not null and lang is not null")
    x = x.select("lang", low.contains("million").alias("predicted"), (low.contains("investors") | (low.contains("million") & (F.col("n_chars") > 500))).alias("gold"))
    return metrics.prf(x, "lang", "gold", "predicted")


@query("""with l as (select lang, doc_id, n_chars, case when contains(lower(text), 'investors') then 2 when contains(lower(text), 'million') then 1 else 0 end as rel from documents where text is not null and lang is not null),
r as (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as r, row_number() over (partition by lang order by rel desc) as i from l)
select lang, round(count(*) filter (r <= 20 and rel > 0) / 20.0, 6) as precision, round(case when count(*) filter (rel > 0) = 0 then 1 else count(*) filter (r <= 20 and rel > 0) / count(*) filter (rel > 0) end, 6) as recall,
round(case when sum(rel) = 0 then 1 else sum(case when r <= 20 then rel / log2(r + 1) else 0 end) / sum(case when i <= 20 then rel / log2(i + 1) else 0 end) end, 6) as ndcg from r group by 1""")
def precision_ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24."""
    low = F.lower("text")
    x = table(spark, d, "documents").filter("text is not null and lang is not null").select("lang", "doc_id", "n_chars", F.when(low.contains("investors"), 2).when(low.contains("million"), 1).otherwise(0).alias("rel"))
    return metrics.at_k(x, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], "rel", 20)


@query("""with r as (select row_number() over (order by c_acctbal desc, c_custkey) as a, row_number() over (order by n desc, c_custkey) as b from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey)
select count(*) as n, round(1 - 6 * sum((a - b) * (a - b)) / (count(*)::double * (count(*)::double * count(*) - 1)), 6) as rho from r""")
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24, WIN-06: agreement of two rankings."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(o, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_acctbal", "n")
    both = ranking.placed(ranking.placed(c, [F.desc("c_acctbal"), F.asc("c_custkey")], "a"), [F.desc("n"), F.asc("c_custkey")], "b")
    return metrics.spearman(both, "a", "b")


@query("""select event_type, count(*) as n, round(avg(round(value, 2)), 4) as mean, round(median(round(value, 2)), 4) as median, list_sort(list(round(value, 2)))[cast(floor(0.9 * (count(*) - 1)) as bigint) + 1] as p90, max(round(value, 2)) as max from events group by 1""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18."""
    return metrics.distribution(table(spark, d, "events").select("event_type", F.round("value", 2).alias("value")), ["event_type"], "value")


@query("""with t as (select doc_id, text, lag(text) over (partition by source order by published_at, doc_id) as before from documents where source is not null and text is not null and published_at is not null)
select count(*) as pairs, count(*) filter (trim(text) is distinct from trim(before)) as differing from t where before is not null""")
def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN-09: consecutive texts of a source."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("published_at", "doc_id")
    x = table(spark, d, "documents").filter("source is not null and text is not null and published_at is not null").select("text", F.lag("text").over(w).alias("before")).filter("before is not null")
    return x.agg(F.count("*").alias("pairs"), F.sum((~F.trim("text").eqNullSafe(F.trim("before"))).cast("bigint")).alias("differing"))


@query(f"with {PROFILE_PAIRS_SQL} select observation_id, material from m")
def headline_materiality(spark: SparkSession, d: str) -> DataFrame:
    """DIF-02, STR-03: whether a headline changed in substance between two snapshots."""
    headline = lambda c: F.try_variant_get(c, "$.headline", "string").alias(c)
    o = profile_pairs(spark, d).select("observation_id", headline("before"), headline("after"))
    return o.select("observation_id", text.material_change(F.col("before"), F.col("after")).alias("material"))


@query("""with w as (select c_mktsegment as segment, c_custkey, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as p from customer) select segment, c_custkey, c_acctbal, cast(p as bigint) as place from w where p <= 10""")
def digest_sections(spark: SparkSession, d: str) -> DataFrame:
    """SRT-04, SRT-08: the top ten of each section."""
    top = ranking.top_k(table(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 10)
    return top.select(F.col("c_mktsegment").alias("segment"), "c_custkey", "c_acctbal", F.col("place").cast("bigint").alias("place"))


@query("""select n_name as nation, l_returnflag, sum(l_quantity) as quantity, count(*) as n, round(avg(l_discount), 6) as discount from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def evidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, JN-01: evidence rows rolled up by origin."""
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    by = li.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.sum("l_discount").alias("dsum"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    return by.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("nation", "l_returnflag").agg(F.sum("q").alias("quantity"), F.sum("n").alias("n"), F.round(F.sum("dsum") / F.sum("n"), 6).alias("discount"))


@query("""with e as (select c.candidate_id, c.name = p.canonical_name as predicted, c.email is not null and lower(trim(c.email)) = lower(p.primary_email) as gold from er_candidate c join person p on lower(trim(c.name)) = lower(p.canonical_name) or lower(trim(c.email)) = lower(p.primary_email))
select count(*) as pairs, round(avg(case when predicted and gold then 1.0::double else 0.0 end), 6) as correct, round(avg(case when predicted and not gold then 1.0::double else 0.0 end), 6) as false_merge, round(avg(case when gold and not predicted then 1.0::double else 0.0 end), 6) as missed,
round(avg(case when predicted and gold then 1.0::double else 0.0 end) - 5 * avg(case when predicted and not gold then 1.0::double else 0.0 end), 6) as score from e""")
def resolution_rates(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23: shares of right, falsely merged and missed pairs, and their score."""
    c = table(spark, d, "er_candidate").select("candidate_id", "name", F.lower(F.trim("name")).alias("ln"), F.lower(F.trim("email")).alias("mail"))
    p = table(spark, d, "person").select("person_id", "canonical_name", F.lower("canonical_name").alias("ln"), F.lower("primary_email").alias("mail"), F.col("person_id").alias("row"))
    pairs = c.join(p.select("ln", "row"), "ln").select("candidate_id", "row").union(c.join(p.select("mail", "row"), "mail").select("candidate_id", "row")).distinct()
    e = pairs.join(c, "candidate_id").join(p.withColumnsRenamed({"ln": "pln", "mail": "pmail"}), "row")
    e = e.select((F.col("name") == F.col("canonical_name")).alias("predicted"), F.coalesce(F.col("mail") == F.col("pmail"), F.lit(False)).alias("gold"))
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    right, wrong, missed = share(F.col("predicted") & F.col("gold")), share(F.col("predicted") & ~F.col("gold")), share(F.col("gold") & ~F.col("predicted"))
    return e.agg(F.count("*").alias("pairs"), F.round(right, 6).alias("correct"), F.round(wrong, 6).alias("false_merge"), F.round(missed, 6).alias("missed"), F.round(right - 5 * wrong, 6).alias("score"))
