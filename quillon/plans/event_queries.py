"""Queries over events, observations and texts: ingestion, timelines, changes, events and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import numbers, text, values
from quillon.operators import events, extraction, ingest, ranking, rules, timeline
from quillon.operators.dedupe import keep_first
from quillon.plans import sqltext
from quillon.plans.registry import Book
from quillon.session import table

BOOK = Book()
query = BOOK.query

#: Start strength, half-life in days, per event type of the timing slice: parameters of these queries.
SIGNALS = {"purchase": (0.004, 10.0), "signup": (0.006, 20.0), "error": (-0.002, 5.0)}
AS_OF = "2024-02-01 00:00:00"
_SIGNAL_SQL = "case event_type when 'purchase' then {0} when 'signup' then {1} else {2} end"
_INITIAL, _HALF = (_SIGNAL_SQL.format(*(SIGNALS[k][i] for k in ("purchase", "signup", "error"))) for i in (0, 1))
_AGE = f"date_diff('microsecond', ts, timestamp '{AS_OF}') / 86400000000.0"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin(*SIGNALS) & (F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz")))
    pick = lambda i: numbers.lookup(F.col("event_type"), {k: v[i] for k, v in SIGNALS.items()})
    return e.select("user_id", "event_type", pick(0).alias("initial"), pick(1).alias("half_life"), numbers.days_between(F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz")).alias("age"))


_TIMING_SQL = f"""
s as (select user_id, round(100 * least(1.0, greatest(0.0, sum(({_INITIAL}) * exp(-ln(2) / ({_HALF}) * greatest(0.0, {_AGE}))))), 4) as score
    from events where event_type in ('purchase', 'signup', 'error') and ts <= timestamp '{AS_OF}' group by user_id),
r as (select user_id, score, cast(rank() over (order by score desc) as bigint) as rank, round(100 * cume_dist() over (order by score), 2) as percentile from s)"""


def timing(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators.scoring import signal_score

    scores = signal_score(_signals(spark, d), "user_id", F.col("initial"), F.col("age"), F.col("half_life"))
    return ranking.ranked(scores.withColumn("universe", F.lit("all")), ["universe"], "score").drop("universe")


@query(f"""with {_TIMING_SQL}
select user_id, score, rank, percentile, case when percentile >= 90 then 'CONTACT' when percentile >= 50 then 'MONITOR' else 'PASS' end as action
from r order by rank, user_id limit 20""")
def flagship_timing_rank(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09, SCO-02, WIN-02, WIN-03, ACT-01, SRT-04: people ranked by decayed timing signals."""
    decision, _ = rules.first_match([{"when": {"percentile_gte": 90}, "then": "CONTACT"}, {"when": {"percentile_gte": 50}, "then": "MONITOR"}, {"when": {"always": True}, "then": "PASS"}], ["percentile"])
    return timing(spark, d).withColumn("action", decision).orderBy("rank", "user_id").limit(20)


@query(f"with {_TIMING_SQL} select * from r")
def rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """WIN-02, WIN-03, RNK-01."""
    return timing(spark, d)


@query(f"""select user_id, event_type, round(sum(({_INITIAL}) * exp(-ln(2) / ({_HALF}) * greatest(0.0, {_AGE}))), 6) as decayed, count(*) as n
from events where event_type in ('purchase', 'signup', 'error') and ts <= timestamp '{AS_OF}' group by 1, 2""")
def decay_by_type(spark: SparkSession, d: str) -> DataFrame:
    """SCO-02, AGG-10."""
    value = numbers.decayed(F.col("initial"), F.col("age"), F.col("half_life"))
    return _signals(spark, d).groupBy("user_id", "event_type").agg(F.round(F.sum(value), 6).alias("decayed"), F.count("*").alias("n"))


@query("""select user_id, event_id, event_type, round(value, 4) as value, round(value - lag(value) over (partition by user_id order by ts, event_id), 4) as change,
lag(event_type) over (partition by user_id order by ts, event_id) as before from events""")
def previous_event(spark: SparkSession, d: str) -> DataFrame:
    """JN-09, JN-10, STF-04, MTH-06: each event with the one before it."""
    e = timeline.previous(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_type"])
    return e.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"), F.round(F.col("value") - F.col("prev_value"), 4).alias("change"), F.col("prev_event_type").alias("before"))


@query("""with k as (select event_id, ts, user_id, event_type, sha1(concat_ws('|', cast(user_id as varchar), event_type, strftime(ts, '%Y-%m-%d'))) as dedupe_key from events)
select event_id, dedupe_key from (select *, row_number() over (partition by dedupe_key order by ts, event_id) as rn from k) where rn = 1""")
def event_exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """EVT-02, HSH-01: one event per person, type and day."""
    e = table(spark, d, "events").withColumn("dedupe_key", values.event_key(F.col("user_id"), F.col("event_type"), F.col("ts")))
    return keep_first(e, [F.col("dedupe_key")], ["ts", "event_id"]).select("event_id", "dedupe_key")


@query("""select a.user_id, a.event_type, count(*) as pairs from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type
and abs(date_diff('day', cast(a.ts as date), cast(b.ts as date))) <= 3 and (cast(a.ts as date), a.event_id) < (cast(b.ts as date), b.event_id) group by 1, 2""")
def event_window_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN-11: pairs of alike events within three days, counted by day and never made."""
    return events.near_counts(table(spark, d, "events"), ["user_id", "event_type"], "ts", 3)


@query("""with recursive k as (select user_id, event_type, ts, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1
union all select user_id, event_type, ts, event_id from (select e.*, row_number() over (partition by e.user_id, e.event_type order by e.ts, e.event_id) as rn from k join events e on e.user_id = k.user_id and e.event_type = k.event_type and e.ts > k.ts + interval 7 day) where rn = 1)
select event_id, user_id, event_type, ts from k""")
def event_greedy_collapse(spark: SparkSession, d: str) -> DataFrame:
    """EVT-03, STF-02: alike events within seven days of the last one kept are dropped."""
    return events.collapsed(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 7)


@query("""select event_type, case when event_type in ('view', 'click') then 'inference' else 'event' end as route, count(*) as n,
max(ts + to_days(case event_type when 'purchase' then 90 when 'signup' then 365 else 180 end)) as last_expiry from events group by 1, 2""")
def event_route_class(spark: SparkSession, d: str) -> DataFrame:
    """DT-04: events against inferences and when they expire."""
    days = numbers.lookup(F.col("event_type"), {"purchase": 90, "signup": 365}, 180).cast("int")
    expiry = F.col("ts") + F.make_dt_interval(days)
    route = F.when(F.col("event_type").isin("view", "click"), "inference").otherwise("event")
    return table(spark, d, "events").groupBy("event_type", route.alias("route")).agg(F.count("*").alias("n"), F.max(expiry).alias("last_expiry"))


@query("""select user_id, list_sort(list(distinct c)) as classes from (select user_id, case event_type when 'purchase' then 'buyer' when 'signup' then 'member' end as c from events
union select user_id, 'heavy' as c from events group by user_id having count(*) > 60) where c is not null group by user_id""")
def classify_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """SET-01, AGG-16, EVT-07."""
    e = table(spark, d, "events")
    named = e.select("user_id", F.when(F.col("event_type") == "purchase", "buyer").when(F.col("event_type") == "signup", "member").alias("c")).filter("c is not null")
    heavy = e.groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 60").select("user_id", F.lit("heavy").alias("c"))
    return named.union(heavy).groupBy("user_id").agg(F.array_sort(F.collect_set("c")).alias("classes"))


_WEEKLY = """w as (select user_id, date_trunc('week', ts) as week, round(sum(value), 4) as score from events group by 1, 2),
r as (select *, cast(rank() over (partition by week order by score desc) as bigint) as rank from w)"""


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.round(F.sum("value"), 4).alias("score"))
    return ranking.ranked(w, ["week"], "score").drop("percentile")


@query(f"""with {_WEEKLY} select user_id, week, score, rank, round(score - lag(score) over p, 4) as score_change, cast(lag(rank) over p - rank as bigint) as rank_change
from r window p as (partition by user_id order by week)""")
def rank_delta_weekly(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04, RNK-02, SNK-10."""
    return ranking.changes(_weekly(spark, d), ["user_id"], "week", "score", "rank")


@query(f"""with {_WEEKLY}, c as (select user_id, week, round(score - lag(score) over (partition by user_id order by week), 4) as score_change from r)
select week, user_id, score_change, cast(row_number() over (partition by week order by abs(score_change) desc, user_id) as bigint) as place from c where abs(score_change) > 1e-4
qualify place <= 12""")
def top_movers(spark: SparkSession, d: str) -> DataFrame:
    """SRT-05, SCO-08, DIG-02."""
    c = ranking.changes(_weekly(spark, d), ["user_id"], "week", "score", "rank")
    return ranking.movers(c, ["week"], "score_change", "user_id").select("week", "user_id", "score_change", F.col("place").cast("bigint").alias("place"))


@query("""select s.step, count(distinct e.user_id) as people, count(*) as events, round(sum(e.value), 2) as value from
(select unnest(generate_series(timestamp '2024-01-08', timestamp '2024-01-29', interval 7 day)) as step) s join events e on e.ts <= s.step group by 1""")
def backtest_steps(spark: SparkSession, d: str) -> DataFrame:
    """DT-03: one plan for all weeks; each event counts in every step at or after it."""
    steps = [r[0] for r in timeline.weekly_steps(spark, "2024-01-08", "2024-01-29").collect()]
    later = F.explode(F.filter(F.array(*(F.lit(s).cast("timestamp_ntz") for s in steps)), lambda s: s >= F.col("ts")))
    return table(spark, d, "events").select("user_id", "value", later.alias("step")).groupBy("step").agg(F.count_distinct("user_id").alias("people"), F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))


@query("""select event_type, cast(json_extract_string(props, '$.k') as bigint) % 10 as k, count(*) as n, count(*) filter (try_cast(json_extract_string(props, '$.k') as double) <> 0) as truthy from events group by 1, 2""")
def json_path_extract(spark: SparkSession, d: str) -> DataFrame:
    """JSN-01, JSN-03."""
    k = values.path(F.col("props"), "k")
    return table(spark, d, "events").groupBy("event_type", (k.cast("bigint") % 10).alias("k")).agg(F.count("*").alias("n"), F.sum(values.truthy(k).cast("bigint")).alias("truthy"))


@query("""select window_start, event_type, count(*) as n from (select date_trunc('day', ts) as window_start, event_type from events) group by 1, 2""")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Batch form of the streaming window count."""
    from quillon.streaming.observations import counts

    return counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""with g as (select user_id, ts, case when date_diff('microsecond', lag(ts) over (partition by user_id order by ts), ts) < 43200000000 then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, s""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events less than twelve hours apart."""
    from quillon.streaming.observations import sessions

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", "12 hours", ["user_id"]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""select observation_id from (select observation_id, row_number() over (partition by content_hash order by ingested_at, observation_id) as rn from observation where content_hash is not null) where rn = 1
union all select observation_id from observation where content_hash is null""")
def dedupe_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """ING-02: the first delivery of each content."""
    o = table(spark, d, "observation").select("observation_id", "content_hash", "ingested_at")
    return keep_first(o, [F.col("content_hash")], ["ingested_at", "observation_id"]).select("observation_id")


@query("""with n as (select *, row_number() over (partition by content_hash order by ingested_at, observation_id) as rn from observation where batch_id > '2026-03'),
s as (select * from observation where batch_id <= '2026-03')
select observation_id from n where rn = 1 and content_hash is not null and content_hash not in (select content_hash from s where content_hash is not null)
and not exists (select 1 from s where s.source_id = n.source_id and s.provider_record_id = n.provider_record_id)""")
def accept_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """ING-02, ING-06, ING-07, JN-06, SNK-01: new drafts against what is stored, by content and by provider key."""
    o = table(spark, d, "observation").select("observation_id", "source_id", "provider_record_id", "content_hash", "ingested_at", "batch_id")
    return ingest.accept_new(o.filter("batch_id > '2026-03'"), o.filter("batch_id <= '2026-03'"), "content_hash", ["source_id", "provider_record_id"], ["ingested_at", "observation_id"]).filter("content_hash is not null").select("observation_id")


@query()
def content_hash_canonical(spark: SparkSession, d: str) -> DataFrame:
    """ING-01, HSH: content identity by canonical JSON, equal for other layouts of one object."""
    o = table(spark, d, "observation")
    h = values.content_hash(F.col("content_type"), F.col("subject_hint"), F.col("source_url"), F.col("raw_text"), values.canonical_json(F.col("raw_json")))
    return o.select("observation_id", h.alias("content_id"))


_STOP_SQL = ", ".join(f"'{w}'" for w in text.STORY_STOP)


@query(f"""with t as (select observation_id, observed_at, source_url, sha1(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(raw_text), '([a-z0-9]+)', 1),
lambda x: length(x) > 2 and x not in ({_STOP_SQL}))))[1:12], ' ')) as cluster_key from observation where content_type = 'news_article' and raw_text is not null)
select cluster_key, count(*) as articles, min(observed_at) as first_seen, cast(greatest(1, count(distinct nullif(regexp_replace(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), ''))) as bigint) as domains
from t group by 1""")
def story_cluster(spark: SparkSession, d: str) -> DataFrame:
    """ING-03, ING-04, ING-05."""
    news = table(spark, d, "observation").filter("content_type = 'news_article' and raw_text is not null")
    c = ingest.story_clusters(news, "raw_text", "source_url", "observed_at", "observation_id")
    return c.select("cluster_key", "articles", "first_seen", F.col("domains").cast("bigint").alias("domains"))


@query("""select doc_id, substr(text, greatest(1, p - 40), 120) as snippet from (select doc_id, text, case when instr(lower(text), 'million') > 0 then instr(lower(text), 'million')
when instr(lower(text), 'partner') > 0 then instr(lower(text), 'partner') else 1 end as p from documents where text is not null)""")
def snippet_extract(spark: SparkSession, d: str) -> DataFrame:
    """STR-09."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.snippet(F.col("text"), ["million", "partner"]).alias("snippet"))


RULES = [
    {"name": "funding", "keywords": ["million", "investors", "fund"], "excluded": ["insurance"], "min_signals": 2},
    {"name": "health", "keywords": ["clinic", "genomics", "health"], "min_signals": 1},
    {"name": "launch", "keywords": ["launch", "prototype"], "min_signals": 1},
]
_HITS = lambda words: "list_filter([" + ", ".join(f"case when contains(l, '{w}') then '{w}' end" for w in words) + "], lambda x: x is not null)"


@query(f"""with t as (select doc_id, lower(text) as l from documents where text is not null),
h as (select doc_id, {_HITS(RULES[0]['keywords'])} as a, {_HITS(RULES[1]['keywords'])} as b, {_HITS(RULES[2]['keywords'])} as c, contains(l, 'insurance') as x from t)
select doc_id, case when len(a) >= 2 and not x then 'funding' when len(b) >= 1 then 'health' else 'launch' end as rule,
case when len(a) >= 2 and not x then a when len(b) >= 1 then b else c end as reasons,
cast(len(case when len(a) >= 2 and not x then a when len(b) >= 1 then b else c end) as bigint) as signals from h where (len(a) >= 2 and not x) or len(b) >= 1 or len(c) >= 1""")
def discovery_rule_match(spark: SparkSession, d: str) -> DataFrame:
    """DSC-01, DSC-02, DSC-03, JN-12."""
    return rules.discovered(table(spark, d, "documents"), "text", "doc_id", RULES).withColumn("signals", F.col("signals").cast("bigint"))


@query(f"with tx as (select observation_id, content_type, subject_hint, raw_text as said from observation where raw_text is not null) {sqltext.text_rules('tx')}")
def text_findings(spark: SparkSession, d: str) -> DataFrame:
    """EXT-03, STR-06, STR-09, STR-10: all twenty rules on free text, one row per finding."""
    o = table(spark, d, "observation").filter("raw_text is not null")
    found = rules.findings(o, rules.text_rules("raw_text", "subject_hint", "content_type"), ["observation_id"])
    return found.drop("unit")


_QUOTED = sqltext.quoted
_STOPS = ", ".join(f"'{_QUOTED(w)}'" for w in text.HEADLINE_STOP)
_RANK = "case lower({0}) " + " ".join(f"when '{k}' then {v}" for k, v in rules.SENIORITY.items()) + " else 0 end"
_FIELD = "json_extract_string({0}, '$.{1}') as {2}"
_FIELDS = ", ".join(_FIELD.format(doc, f, f"{side}_{n}") for doc, side in (("j", "a"), ("p", "b")) for n, f in (("headline", "headline"), ("company", "current_company"), ("title", "current_title"), ("seniority", "current_seniority"), ("location", "location"), ("building", "building"), ("founder", "founder_status"), ("open", "open_to_work")))
_WORDS = "coalesce(list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda x: length(x) > 1 and x not in (" + _STOPS + ")), [])"
_HAS = "coalesce(trim({0}) <> '', false)"
_SAYS = lambda side, p: f"coalesce(regexp_matches({side}_headline, '{_QUOTED(p)}'), false)"
_NEWLY = lambda p: f"({_SAYS('a', p)} and not {_SAYS('b', p)})"
_FLAG = lambda side, name: f"(coalesce({side}_{name}, 'false') not in ('false', '', 'null', '0'))"
_NOW = {n: [f"({_FLAG(side, n)} or {_SAYS(side, p)})" for side in ("a", "b")] for n, p in (("building", rules.BUILDING), ("founder", rules.FOUNDER))}
_TURNED = {n: f"({now} and not {before})" for n, (now, before) in _NOW.items()}
PROFILE_PAIRS_SQL = f"""
docs as (select observation_id, {sqltext.opened('raw_json')} as j, {sqltext.opened('previous_snapshot')} as p from observation where content_type = 'profile_snapshot'),
pairs as (select observation_id, {sqltext.profile('j')} as j, {sqltext.profile('p')} as p from docs where j is not null and p is not null),
f as (select observation_id, {_FIELDS} from pairs),
w as (select *, {_WORDS.format('a_headline')} as aw, {_WORDS.format('b_headline')} as bw from f),
c as (select *, len(list_filter(aw, lambda x: not list_contains(bw, x))) + len(list_filter(bw, lambda x: not list_contains(aw, x))) as changed, len(list_distinct(list_concat(aw, bw))) as total from w),
m as (select *, trim(coalesce(a_headline, '')) <> trim(coalesce(b_headline, '')) and changed > 0 and (changed >= 2 or changed > 0.35 * total) as material from c)"""
_STAYED = f"({_HAS.format('a_company')} and a_company = b_company)"
_LEFT = f"({_HAS.format('b_company')} and a_company is distinct from b_company)"
_JOINED = f"({_HAS.format('a_company')} and a_company is distinct from b_company)"
_RETITLED = f"({_STAYED} and {_HAS.format('a_title')} and a_title is distinct from b_title)"
_OPENED = f"({_FLAG('a', 'open')} and not {_FLAG('b', 'open')})"
_SIGNALS = f"({_LEFT}::int + {_TURNED['building']}::int + {_SAYS('a', rules.STEALTH)}::int + {_TURNED['founder']}::int)"
_FINDINGS = [
    ("event", "EMPLOYMENT_ENDED", _LEFT, "0.95", "b_company", "b_company"), ("fact", "EMPLOYMENT_ENDED_AT", _LEFT, "0.95", "b_company", "b_company"),
    ("event", "EMPLOYMENT_STARTED", _JOINED, "0.9", "a_company", "a_company"), ("fact", "CURRENT_TITLE", _JOINED, "0.9", "coalesce(a_title, 'unknown')", "a_company"),
    ("event", "TITLE_CHANGED", _RETITLED, "0.9", "a_title", "a_company"), ("event", "PROMOTION", f"{_RETITLED} and {_RANK.format('a_seniority')} > {_RANK.format('b_seniority')}", "0.9", "a_title", "a_company"),
    ("fact", "HEADLINE_CHANGED", "material", "0.98", "a_headline", "null"), ("fact", "HEADLINE_TEXT", "material", "0.99", "coalesce(a_headline, '')", "null"), ("event", "HEADLINE_CHANGED", "material", "0.98", "a_headline", "null"),
    ("event", "FOUNDER_TITLE_ADDED", _TURNED["founder"], "0.95", "a_headline", "null"), ("inference", "STEALTH_COMPANY_SIGNAL", _NEWLY(rules.STEALTH), "0.7", "a_headline", "null"),
    ("event", "COFOUNDER_SEARCH", _SAYS("a", rules.COFOUNDER_SEARCH), "0.85", "a_headline", "null"), ("event", "HIRING_STARTED", _NEWLY(rules.HIRING), "0.7", "a_headline", "null"),
    ("inference", "POSSIBLE_COMPANY_FORMATION", f"{_SIGNALS} >= 1 and ({_NOW['building'][0]} or {_NOW['founder'][0]} or {_SAYS('a', rules.STEALTH)})", f"round(least(0.85, 0.35 + 0.2 * {_SIGNALS}), 4)", "null", "null"),
    ("event", "OPEN_TO_WORK_SIGNAL", _OPENED, "0.9", "null", "null"), ("fact", "OPEN_TO_WORK_DECLARED", _OPENED, "0.95", "'true'", "null"),
    ("fact", "LOCATION", f"{_HAS.format('a_location')} and a_location is distinct from b_location", "0.85", "a_location", "null"),
]


def findings_rows() -> str:
    """Rows of the profile rules over the pairs of PROFILE_PAIRS_SQL."""
    return " union all ".join(f"select observation_id, '{kind}' as kind, '{name}' as name, cast({conf} as double) as confidence, {value} as value, {org} as organization from m where {test}" for kind, name, test, conf, value, org in _FINDINGS)


def profile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(observation_id, before, after): the profile of each snapshot and of the one before it, where both hold an object."""
    o = table(spark, d, "observation").filter("content_type = 'profile_snapshot' and raw_json is not null and previous_snapshot is not null")
    o = o.select("observation_id", values.opened(F.col("previous_snapshot")).alias("b"), values.opened(F.col("raw_json")).alias("a")).filter("a is not null and b is not null")
    return o.select("observation_id", values.profile(F.col("b")).alias("before"), values.profile(F.col("a")).alias("after"))


@query(f"with {PROFILE_PAIRS_SQL} {findings_rows()}")
def profile_findings(spark: SparkSession, d: str) -> DataFrame:
    """DIF-01, DIF-02, EXT-01: events, facts and inferences between a profile and the snapshot before it."""
    o = profile_pairs(spark, d).select("observation_id", extraction.side("before").alias("before"), extraction.side("after").alias("after"))
    return rules.findings(o, rules.profile_rules("before", "after"), ["observation_id"]).drop("unit")


_MATERIAL = [*extraction.TEXTS.values(), *extraction.FLAGS.values()]


@query(f"""with {PROFILE_PAIRS_SQL} select observation_id, array_to_string(list_filter([{', '.join(f"case when json_extract_string(j, '$.{f}') is distinct from json_extract_string(p, '$.{f}') then '{f}' end" for f in _MATERIAL)}], lambda x: x is not null), ',') as changed from pairs""")
def changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """DIF-03: which of the eight material fields differ between a profile and the one before it."""
    return profile_pairs(spark, d).select("observation_id", F.array_join(extraction.changed_fields(F.col("before"), F.col("after")), ",").alias("changed"))


@query(f"""with o as (select person_id, observed_at, observation_id, {sqltext.opened('raw_json')} as j from observation where content_type = 'profile_snapshot' and person_id is not null),
h as (select person_id, observed_at, observation_id, json_extract_string({sqltext.profile('j')}, '$.headline') as headline from o),
t as (select headline, lag(headline) over (partition by person_id order by observed_at, observation_id) as prev from h)
select count(*) as pairs, count(*) filter (trim(headline) is distinct from trim(prev)) as differing from t where headline is not null and prev is not null""")
def headline_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN-09, SET-03: consecutive headlines of a person."""
    w = Window.partitionBy("person_id").orderBy("observed_at", "observation_id")
    headline = F.try_variant_get(values.profile(F.col("v")), "$.headline", "string")
    o = table(spark, d, "observation").filter("content_type = 'profile_snapshot' and person_id is not null")
    o = o.select("person_id", "observed_at", "observation_id", values.opened(F.col("raw_json")).alias("v")).select("person_id", "observed_at", "observation_id", headline.alias("headline"))
    t = o.select("headline", F.lag("headline").over(w).alias("prev")).filter("headline is not null and prev is not null")
    return t.agg(F.count("*").alias("pairs"), F.sum((~F.trim("headline").eqNullSafe(F.trim("prev"))).cast("bigint")).alias("differing"))


@query("""select s.provider, s.enabled, count(o.observation_id) as records, max(o.observed_at) as last_seen from data_source s left join observation o using (source_id) group by 1, 2""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11, SRC-15, JN-07: records of each source."""
    s, o = table(spark, d, "data_source"), table(spark, d, "observation")
    by = o.groupBy("source_id").agg(F.count("*").alias("n"), F.max("observed_at").alias("seen"))
    return s.join(by, "source_id", "left").groupBy("provider", "enabled").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.max("seen").alias("last_seen"))


@query("""select o.observation_id, s.reliability_tier, round(least(0.8, 0.8 * case s.reliability_tier when 1 then 1.0 when 2 then 0.85 when 3 then 0.7 when 4 then 0.55 when 5 then 0.35 else 0.5 end)::double, 2) as confidence
from observation o join data_source s using (source_id)""")
def evidence_confidence(spark: SparkSession, d: str) -> DataFrame:
    """MTH-04, EXT-04: confidence by the source's tier."""
    o = table(spark, d, "observation").select("observation_id", "source_id").join(table(spark, d, "data_source"), "source_id")
    return o.select("observation_id", "reliability_tier", numbers.capped_confidence(F.lit(0.8), numbers.tier_weight(F.col("reliability_tier"))).alias("confidence"))


@query("""select subject_hint, observation_id, cast(place as bigint) as place from (select *, row_number() over (partition by subject_hint order by observed_at desc, observation_id) as place from observation
where subject_hint is not null and content_type in ('news_article', 'activity_post')) where place <= 20""")
def activity_feed(spark: SparkSession, d: str) -> DataFrame:
    """RPT-04, SRT-04, SRT-09: the latest twenty items of each subject."""
    o = table(spark, d, "observation").filter("subject_hint is not null and content_type in ('news_article', 'activity_post')")
    return ranking.top_k(o, ["subject_hint"], [F.desc_nulls_last("observed_at"), F.asc("observation_id")], 20).select("subject_hint", "observation_id", F.col("place").cast("bigint").alias("place"))


@query("""select lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, count(*) as n, count(distinct regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(source_url)), '\\?.*$', ''), '/+$', ''), '^https?://', ''), '^www\\.', '')) as addresses
from observation where source_url is not null group by 1""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """STR-02, ING-05."""
    o = table(spark, d, "observation").filter("source_url is not null")
    host = F.lower(F.regexp_extract("source_url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return o.groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(text.normal_address(F.col("source_url")), F.lit(""))).alias("addresses"))


@query("""select doc_id, published_at as starts_at, coalesce(source, 'unknown') as host from documents where published_at >= timestamp '2026-06-01' order by published_at, doc_id limit 50""")
def calendar_upcoming(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06, RPT-10, SRT-06: what starts at or after a moment, earliest first, a page of fifty."""
    x = table(spark, d, "documents").filter(F.col("published_at") >= F.lit("2026-06-01").cast("timestamp_ntz"))
    return x.select("doc_id", F.col("published_at").alias("starts_at"), F.coalesce("source", F.lit("unknown")).alias("host")).orderBy("starts_at", "doc_id").limit(50)


@query("""select content_type, count(*) as n, count(*) filter (observed_at - coalesce(occurred_at, observed_at) > interval 7 day) as late,
count(*) filter (occurred_at is null) as undated, count(*) filter (coalesce(occurred_at, observed_at) <= timestamp '2026-06-01' and observed_at <= timestamp '2026-06-01') as visible from observation group by 1""")
def visible_observations(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03: what occurred and was known by a moment, and what came late."""
    at = F.lit("2026-06-01").cast("timestamp_ntz")
    o = table(spark, d, "observation").withColumn("when", F.coalesce("occurred_at", "observed_at"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    late = F.timestamp_diff("MICROSECOND", F.col("when"), F.col("observed_at")) > 7 * 86_400_000_000
    return o.groupBy("content_type").agg(F.count("*").alias("n"), count(late).alias("late"), count(F.col("occurred_at").isNull()).alias("undated"), count((F.col("when") <= at) & (F.col("observed_at") <= at)).alias("visible"))


@query("""with g as (select story_cluster_key, count(*) as articles, count(distinct source_id) as sources from observation where story_cluster_key is not null group by 1 having count(*) > 1)
select story_cluster_key, observation_id, articles, sources from observation join g using (story_cluster_key)""")
def evidence_by_story(spark: SparkSession, d: str) -> DataFrame:
    """EVT-04, SCO-10: the observations behind each story, a row each, with the story's size and sources."""
    o = table(spark, d, "observation").filter("story_cluster_key is not null").select("story_cluster_key", "observation_id", "source_id")
    by = o.groupBy("story_cluster_key").agg(F.count("*").alias("articles"), F.count_distinct("source_id").alias("sources")).filter("articles > 1")
    return o.join(by, "story_cluster_key").select("story_cluster_key", "observation_id", "articles", "sources")
