"""The model queries' questions in SQL, worked out from the same configurations by another engine."""

from __future__ import annotations

import re

from quillon.operators import bundles, config, extraction, scoring, taxonomy
from quillon.operators.config import Dimension, Feature, Model
from quillon.operators.features import THESIS_WORD
from quillon.operators.rules import SENIORITY
from quillon.plans import models, sqltext, world
from quillon.plans.event_queries import PROFILE_PAIRS_SQL, findings_rows

_J = lambda c, f: f"json_extract_string({c}, '$.{f}')"
_MAP = lambda c, mapping, default: f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in mapping.items()) + f" else {default} end"
_TIERS = "case tier when 1 then 1.0 when 2 then 0.85 when 3 then 0.7 when 4 then 0.55 when 5 then 0.35 else 0.5 end"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _truthy(text: str) -> str:
    return f"case when {text} is null then null when {text} in ('false', '', 'null') then false when try_cast({text} as double) is not null then try_cast({text} as double) <> 0 else true end"


def _day(doc: str, field: str) -> str:
    return f"try_cast(regexp_extract({_J(doc, field)}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date)"


def _row(source: str, kind: str, name: str, confidence: str, value: str, organization: str, test: str) -> str:
    return f"select observation_id, '{kind}' as kind, {name} as name, cast({confidence} as double) as confidence, {value} as value, {organization} as organization from {source} where {test}"


def _baseline() -> str:
    has = lambda f: f"coalesce({_J('j', f)} <> '', false)"
    rows = [
        _row("firsts", "fact", "'HEADLINE_TEXT'", "0.99", _J("j", "headline"), "null", has("headline")),
        _row("firsts", "fact", "'CURRENT_TITLE'", "0.95", _J("j", "current_title"), _J("j", "current_company"), f"{has('current_title')} and {has('current_company')}"),
        _row("firsts", "fact", "'LOCATION'", "0.9", _J("j", "location"), "null", has("location")),
        _row("firsts", "fact", "'FUNDRAISING_STATUS'", "1.0", "null", "null", f"coalesce({_J('j', 'fundraising_status')}, '') in ('', 'unknown')"),
    ]
    rows += [_row("firsts", "fact", f"'{t}'", "0.9", _J("j", f), "null", f"{_J('j', f)} is not null") for f, (t, _) in extraction.NUMBER_FACTS.items()]
    rows += [_row("firsts", "fact", f"'{t}'", "0.9", f"cast({_truthy(_J('j', f))} as varchar)", "null", f"{_J('j', f)} is not null") for f, t in extraction.FLAG_FACTS.items()]
    return " union all ".join(rows)


def _structured() -> str:
    within = "coalesce(json_type(j, '$.value') = 'OBJECT', false)"
    value = f"case when coalesce({_J('j', 'value.status')} = 'unknown', false) then null else coalesce(case when {within} then {_J('j', 'value.value')} end, {_J('j', 'raw_value')}, case when not {within} then {_J('j', 'value')} end) end"
    sure = f"coalesce(try_cast({_J('j', 'confidence')} as double), 0.9)"
    guess = f"(coalesce({_truthy(_J('j', 'is_inference'))}, false) or coalesce({_J('j', 'event_type')} in {_IN(taxonomy.INFERENCE_TYPES)}, false))"
    named = f"{_J('j', 'event_type')} is not null"
    return " union all ".join([
        _row("records", "fact", _J("j", "fact_type"), sure, value, _J("j", "organization_name"), f"{_J('j', 'fact_type')} is not null"),
        _row("records", "event", _J("j", "event_type"), sure, "null", _J("j", "organization_name"), f"{named} and not {guess}"),
        _row("records", "inference", _J("j", "event_type"), f"coalesce(try_cast({_J('j', 'probability')} as double), {sure})", "null", _J("j", "organization_name"), f"{named} and {guess}"),
    ])


def world_sql(as_of: str, cutoff: str | None = None) -> str:
    """CTEs obs, x, facts, latest, ev, signals, jobs, edges, classes and people as of a moment."""
    at = f"timestamp '{as_of}'"
    cut = f"timestamp '{cutoff}'" if cutoff else None
    fact_seen = f"coalesce(valid_from, created_at) <= {at} and created_at <= {cut}" if cut else f"(valid_from is null or valid_from <= {at})"
    also = lambda c: f" and {c} <= {cut}" if cut else ""
    part = lambda f: f"nullif({_J('v', f)}, '')"
    ttl = _MAP("name", {k: d for k, (_, d) in taxonomy.EVENT_TYPES.items()}, taxonomy.TTL_DEFAULT)
    known = "(status is distinct from 'unknown' and (value is not null or status = 'known'))"
    return f"""recursive live as (select person_id, coalesce(merged_into_id, person_id) as live_id from person),
obs as ({sqltext.first_wins('observation', f'observed_at <= {at}')}),
{PROFILE_PAIRS_SQL.strip().replace('from observation', 'from obs')},
op as (select *, {sqltext.opened('raw_json')} as v, {sqltext.opened('previous_snapshot')} as b from obs),
firsts as (select observation_id, {sqltext.profile('v')} as j from op where content_type = 'profile_snapshot' and v is not null and b is null),
records as (select observation_id, v as j from op where content_type in ('csv_row', 'json_record') and ({_J('v', 'fact_type')} is not null or {_J('v', 'event_type')} is not null)),
tx as (select observation_id, content_type, subject_hint, nullif(trim(concat_ws(' ', nullif(raw_text, ''), {part('title')}, {part('body')}, {part('summary')})), '') as said from op
    where content_type is distinct from 'profile_snapshot' and observation_id not in (select observation_id from records)),
rows as ({findings_rows()} union all {_baseline()} union all {_structured()} union all {sqltext.text_rules('tx')}),
day as (select observation_id, case when content_type = 'profile_snapshot' then coalesce({_day('v', 'observed_on')}, {_day('v', 'as_of')})
    when content_type in ('csv_row', 'json_record') and ({_J('v', 'fact_type')} is not null or {_J('v', 'event_type')} is not null) then {_day('v', 'occurred_at')} end as occurred from op),
x as (select r.*, l.live_id as person_id, o.observed_at, o.ingested_at, cast(d.occurred as timestamp) as occurred, coalesce(cast(d.occurred as timestamp), o.occurred_at, o.observed_at) as moment, coalesce(s.reliability_tier, 3) as tier, s.provider
    from rows r join obs o using (observation_id) join live l on l.person_id = o.person_id join day d using (observation_id) left join data_source s on s.source_id = o.source_id),
facts as (select l.live_id as person_id, fact_id, fact_type, value.status as status, value.value as value, valid_from, created_at, extraction_confidence as extraction, null::double as strength, null::varchar as provider
    from fact join live l on l.person_id = subject_id where superseded_by_id is null and subject_type = 'person'
    union all select person_id, 'ob:' || observation_id || ':' || name, name, case when value is null then 'unknown' else 'known' end, value, coalesce(occurred, observed_at), ingested_at, confidence, round({_TIERS}, 3)::double, provider from x where kind = 'fact'),
latest as (select *, case when {known} then coalesce(value, '') end as said from facts where {fact_seen}
    qualify row_number() over (partition by person_id, fact_type order by valid_from is null, valid_from desc, coalesce(created_at, timestamp '1970-01-01') desc, fact_id) = 1),
keyed as (select person_id, name as event_type, coalesce(trim(organization), '') as organization, moment as occurred_at, ingested_at as detected_at, observation_id, round(least(confidence, round(least(1.0, {_TIERS} * confidence), 2)), 2) as confidence
    from x where kind = 'event' qualify row_number() over (partition by person_id, name, cast(moment as date) order by moment, observation_id, coalesce(trim(organization), '')) = 1),
near as (select * from keyed where event_type in {_IN(taxonomy.WINDOWED_TYPES)}),
kept as (select * from near qualify row_number() over (partition by person_id, event_type, organization order by occurred_at, observation_id) = 1
    union all select * exclude (rn) from (select e.*, row_number() over (partition by e.person_id, e.event_type, e.organization order by e.occurred_at, e.observation_id) as rn
    from kept k join near e on e.person_id = k.person_id and e.event_type = k.event_type and e.organization = k.organization and e.occurred_at > k.occurred_at + interval 60 day) where rn = 1),
counted as (select * from kept union all select * from keyed where event_type not in {_IN(taxonomy.WINDOWED_TYPES)}),
ev as (select * from (select * from counted union all select * replace ('PROFESSIONAL_DEPARTURE' as event_type) from counted where event_type = 'EMPLOYMENT_ENDED' and organization <> '')
    where occurred_at <= {at}{also('detected_at')}),
inf as (select person_id, name as event_type, round(least(1.0, greatest(0.0, confidence)), 4) as probability, moment as created_at from x where kind = 'inference' and moment + to_days(cast({ttl} as int)) >= {at}{also('moment')}),
signals as (select person_id, event_type, date_diff('microsecond', occurred_at, {at}) / 86400000000.0 as days, null::double as probability from ev
    union all select person_id, event_type, date_diff('microsecond', created_at, {at}) / 86400000000.0, probability from inf),
jobs as (select e.* replace (l.live_id as person_id), o.organization_type, o.location, o.aum_usd, coalesce(o.is_portfolio, false) as held, o.canonical_name as org_name, nullif(lower(o.attributes.stage), '') as stage,
    list_filter(list_distinct(list_transform(list_concat([o.attributes.sector], coalesce(o.attributes.sectors, [])), lambda s: lower(s))), lambda s: s is not null and s <> '') as sectors,
    nullif(array_to_string(list_filter(list_concat(list_concat([nullif(o.canonical_name, '')], coalesce(o.attributes.sectors, [])), [nullif(o.attributes.sector, '')]), lambda s: s is not null), ' . '), '') as org_text
    from employment e join live l using (person_id) left join organization o using (organization_id)),
checked as (select l.live_id as person_id, max(verified_at) as verified from fact join live l on l.person_id = subject_id where verified_at <= {at} group by 1),
dj as (select distinct person_id, organization_id, function, started_at, ended_at, coalesce(current, false) as current from jobs where organization_id is not null),
senior as (select * from dj qualify row_number() over (partition by organization_id order by started_at is null, started_at, person_id, function is null, function, current) = 1),
edges as (select j.person_id as src, s.person_id as dst, case when j.function is null or s.function is null then 0 when j.function = s.function then 3 when j.current and s.current then 2 else 1 end as strength,
    case when j.current and s.current then 0.85::double when j.started_at is not null then 0.6::double end as confidence, c.verified
    from dj j join senior s using (organization_id) left join checked c on c.person_id = j.person_id
    where j.person_id <> s.person_id and coalesce(cast(greatest(j.started_at, s.started_at) as timestamp), timestamp '2025-09-01') <= {at}{" and timestamp '2025-09-01' <= " + cut if cut else ''}),
classes as (select distinct person_id, c as person_class from (
    select person_id, unnest([case when contains(lower(title), 'founder') then 'FOUNDER' end, case when organization_type in ('family_office', 'endowment', 'venture_fund') and seniority in ('partner', 'c_level') then 'LP' end,
        case when held and seniority in ('c_level', 'vp') then 'PORTFOLIO_EXECUTIVE' end]) as c from jobs where current and organization_id in (select organization_id from organization)
    union all select person_id, {_MAP('event_type', {k: f"'{v}'" for k, v in taxonomy.CLASS_OF.items()}, 'null::varchar')} from ev
    union all select person_id, {_MAP('name', {k: f"'{v}'" for k, v in taxonomy.CLASS_OF.items()}, 'null')} from x where kind = 'inference') where c is not null),
people as (select person_id, monitoring_status, entity_resolution_status from person where merged_into_id is null and monitoring_status in {_IN(world.SCORED)})"""


def access_sql(as_of: str) -> str:
    """CTE acc(person_id, access): the score of the best path from the team's people."""
    at = f"timestamp '{as_of}'"
    order = "weakest desc, verified desc nulls last, sum desc, known desc, path desc"
    step = lambda n, source: f"""p{n} as (select * exclude (rn) from (select *, row_number() over (partition by seed, target, hops, first_hop order by {order}) as rn from (
    select seed, u.dst as target, {n} as hops, first_hop, least(weakest, u.strength) as weakest, least(p.verified, u.verified) as verified, p.sum + u.sum as sum, p.known + u.known as known, list_append(path, u.dst) as path
    from {source} p join u on u.src = p.target where u.dst <> seed and u.dst <> first_hop)) where rn = 1)"""  # noqa: E731
    base = models.ACCESS["path_base"]
    by = lambda h: f"case weakest when 3 then {base[f'HOP{h}_STRONG']}.0 when 2 then {base[f'HOP{h}_MODERATE']}.0 when 1 then {base[f'HOP{h}_WEAK']}.0 end"
    return f"""ue as (select src, dst, strength, verified, coalesce(confidence, 0.0) as sum, cast(confidence is not null as int) as known from (select * from edges union all select dst, src, strength, confidence, verified from edges) where src <> dst),
u as (select * from ue qualify row_number() over (partition by src, dst order by strength desc, verified desc nulls last, sum desc, known desc) = 1),
seeds as (select person_id as node from person where is_team_seed and merged_into_id is null),
p1 as (select node as seed, dst as target, 1 as hops, dst as first_hop, strength as weakest, verified, sum, known, [node, dst] as path from seeds join u on src = node),
{step(2, 'p1')}, f2 as (select * from p2 where not exists (select 1 from p1 where p1.seed = p2.seed and p1.target = p2.target)), {step(3, 'f2')},
allp as (select *, case when hops = 1 then {by(1)} when hops = 2 then {by(2)} else {base['HOP3_ANY']}.0 end as base, round(sum / nullif(known, 0), 3) as confidence from (select * from p1 union all select * from p2 union all select * from p3)),
routes as (select target, count(distinct first_hop) as routes from allp group by 1),
bestp as (select target, base, hops, verified, confidence, path, routes, date_diff('microsecond', verified, {at}) / 86400000000.0 - 365 as over from allp join routes using (target)
    qualify row_number() over (partition by target order by base is null, coalesce(base, 0) desc, hops, path) = 1),
acc as (select p.person_id, case when p.is_team_seed then 100.0 when b.target is null then 0.0 when base is not null then round(round(least(100.0, greatest(0.0, (base + least(8.0, 4.0 * (routes - 1)) - case when over > 0 then least(15.0, 4.0 * over / 30.0) else 0 end)
    * case when confidence is not null then greatest(0.5, confidence) else 1.0 end)), 4), 2) end as access from person p left join bestp b on b.target = p.person_id where merged_into_id is null)"""


def _normal(spec: Feature, c: str) -> str:
    p = spec.params
    n = f"cast({c} as double)"
    value = {
        "binary": lambda: f"case when {n} <> 0 then 1.0 when {n} = 0 then 0.0 end",
        "capped_count": lambda: f"{n} / {float(p['max'])}",
        "linear_cap": lambda: f"{n} / {float(p['divisor'])}",
        "min_ratio": lambda: f"1.0 - {n} / {float(p['target'])}" if p.get("invert") else f"{n} / {float(p['target'])}",
        "passthrough_unit": lambda: n,
        "bucket": lambda: f"case when {n} is null then null " + " ".join(f"when {n} <= {t} then {v}" for t, v in zip(p["thresholds"], p["values"])) + f" else {p['values'][-1]} end",
        "tiered": lambda: f"case when {c} is null then null " + " ".join(f"when {c} = '{k}' then {v}" for k, v in p["tiers"].items()) + " else 0.0 end",
    }[spec.normalization]()
    clipped = f"round(case when ({value}) is not null then least(1.0, greatest(0.0, cast({value} as double))) end + 1e-9, 4)"
    filler = {"zero": "0.0", "neutral": "0.5"}.get(spec.missing)
    return clipped if filler is None else f"coalesce({clipped}, {filler})"


def _present(dim: Dimension) -> str:
    full = sum(f.weight for f in dim.features.values())
    if not dim.renormalize:
        return str(full)
    total = " + ".join(f"case when n_{n} is not null then {f.weight}::double else 0.0 end" for n, f in dim.features.items())
    return f"coalesce(nullif(round({total}, 6), 0), 1.0)"


def _dimension(dim: Dimension) -> str:
    total = " + ".join(f"coalesce(n_{n} * {f.weight}::double, 0.0)" for n, f in dim.features.items())
    return f"round(100.0 * ({total}) / {_present(dim)} + 1e-9, 4)"


def _signal(dim: Dimension, n: str) -> str:
    rows = []
    for kind, c in dim.signals.items():
        initial = f"{c.get('factor', 1.0)} * coalesce(probability, 0.0)" if c.get("initial_from") == "probability" else str(float(c["initial"]))
        rows.append(f"when '{kind}' then ({initial}) * exp(-ln(2) / {float(c['half_life_days'])} * greatest(0.0, coalesce(days, 0.0)))")
    return f"sig_{n} as (select person_id, round(100.0 * least(1.0, greatest(0.0, sum(case event_type {' '.join(rows)} end))), 4) as score from signals where event_type in {_IN(dim.signals)} group by 1)"


def _action(target: str) -> str:
    numbers = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<"}
    flags = {"data_stale": "false", "has_role_match": f"(priority >= {models.ROLE_MATCH})" if target == "talent" else "false"}

    def test(k: str, v: object) -> str:
        f, _, op = k.rpartition("_")
        if k == "always":
            return str(bool(v)).lower()
        if k == "model_target":
            return f"'{target}' = '{v}'"
        return f"{flags[k]} = {str(v).lower()}" if k in flags else f"coalesce({f}, 0) {numbers[op]} {v}"

    return "case " + " ".join(f"when {' and '.join(test(k, v) for k, v in r['when'].items())} then '{r['then']}'" for r in models.ACTIONS) + " end"


def score_sql(model: Model, wide: str, feeding: str, as_of: str, more: str = "", best: str = "", row: str = "person_id") -> str:
    """CTEs over ``wide`` (row, features) and ``feeding`` (person_id, fact_id, at, extraction, strength, provider), and the select."""
    weighted = {n: d for n, d in model.dimensions.items() if d.kind == "weighted_features"}
    signals = {n: d for n, d in model.dimensions.items() if d.kind == "decay_signals"}
    features = {f: s for d in weighted.values() for f, s in d.features.items()}
    full = scoring.full_weight(model)
    dims = list(model.dimensions)
    known = " + ".join(f"case when d_{n} is not null then {d.weight}::double else 0.0 end" for n, d in model.dimensions.items())
    total = " + ".join(f"coalesce(d_{n} * {d.weight}::double, 0.0)" for n, d in model.dimensions.items())
    w = model.confidence
    identity = _MAP("entity_resolution_status", scoring.IDENTITY, scoring.IDENTITY_DEFAULT)
    parts = {"reliability": "coalesce(reliability, 0.5)", "independence": "coalesce(independence, 0.5)", "recency": "coalesce(recency, 0.5)", "extraction": "coalesce(extraction, 1.0)", "identity": identity, "completeness": f"round(present / {full} + 1e-9, 4)"}
    sure = " + ".join(f"{w.get(k, 0.0)}::double * {c}" for k, c in parts.items())
    get = {n: _dimension(d) for n, d in weighted.items()} | {n: f"(select coalesce(max(score), 0.0) from sig_{n} s where s.person_id = q.person_id)" for n in signals} | {n: "(select access from acc a where a.person_id = q.person_id)" for n, d in model.dimensions.items() if d.kind == "access_model"}
    return f"""{', '.join(_signal(d, n) for n, d in signals.items())}{',' if signals else ''}
wide as ({wide}),
nw as (select {row}, {', '.join(f'{_normal(s, f)} as n_{f}' for f, s in features.items())} from wide),
ds as (select {row}, {', '.join(f'{get[n]} as d_{n}' for n in dims)}, {' + '.join(_present(d) for d in weighted.values())} as present from nw q),
pr as (select *, coalesce(round(({total}) / nullif({known}, 0.0) + 1e-9, 4), 0.0) as priority from ds),
bs as (select * from pr {best}),
feeding as ({feeding}),
conf as (select person_id, round(avg(strength) + 1e-9, 4) as reliability, case when count(provider) > 0 then least(1.0, 0.5 + 0.25 * count(distinct provider)) end as independence,
    round(avg(exp(-{scoring.RECENCY_RATE} * greatest(0.0, date_diff('microsecond', moment, timestamp '{as_of}') / 86400000000.0))) + 1e-9, 4) as recency, round(avg(extraction) + 1e-9, 4) as extraction from (select distinct * from feeding) group by 1),
fin as (select b.*, round(least(1.0, greatest(0.0, ({sure}) / {sum(w.values())})) + 1e-9, 4) as confidence from bs b join people using (person_id) left join conf c using (person_id)),
rk as (select *, cast(rank() over (order by priority desc) as bigint) as rank, round(100 * cume_dist() over (order by priority), 2) as percentile, {'d_access' if 'access' in dims else 'null'} as access from fin)
select person_id{more}, {', '.join(f'd_{n} as {n}' for n in dims)}, priority, confidence, rank, percentile, {_action(model.target)} as action from rk"""


def _fact(kind: str) -> str:
    return f"(select max(said) from latest f where f.person_id = p.person_id and fact_type = '{kind}')"


def _number(kind: str) -> str:
    return f"try_cast(trim(t_{kind}) as double)"


def _feeding(conditions: dict[str, str]) -> str:
    rows = " or ".join(f"(fact_type = '{k}' and {c})" for k, c in conditions.items())
    return f"select person_id, fact_id, coalesce(valid_from, created_at) as moment, extraction, strength, provider from latest where {rows}"


_IS_NUMBER, _IS_KNOWN = "try_cast(trim(said) as double) is not null", "said is not null"


def _phrases(phrases: list[str], text: str = "words") -> str:
    if not phrases:
        return "0.0"
    whole = "list_filter([" + ", ".join(f"case when contains(lower({text}), '{p.lower()}') then '{p}' end" for p in phrases) + "], lambda s: s is not null)"
    words = lambda p: "[" + ", ".join(f"'{w}'" for w in re.findall(THESIS_WORD, p.lower())) + "]"
    tokens = f"regexp_extract_all(lower({text}), '({THESIS_WORD})', 1)"
    shared = "list_filter([" + ", ".join(f"case when list_has_any({tokens}, {words(p)}) then '{p}' end" for p in phrases) + "], lambda s: s is not null)"
    return f"round(least(1.0, len(case when len({whole}) > 0 then {whole} else {shared} end) / {float(max(1, min(len(phrases), 4)))}), 4)"


def founder_sql(as_of: str, cutoff: str | None = None) -> str:
    model = config.parse(models.FOUNDER)
    kinds = [*bundles.FOUNDER_NUMBERS.values(), *bundles.FOUNDER_FLAGS.values(), "PRIOR_FOUNDER", "TEAM_SIZE_MANAGED", "COMPANIES_FOUNDED_COUNT", "HEADLINE_TEXT", "LOCATION"]
    flag = lambda k: f"coalesce({_truthy(f't_{k}')}, false)"
    t = models.THESIS
    held = "(select list_distinct(flatten(list(sectors))) from jobs_held)"
    columns = {n: flag(k) for n, k in bundles.FOUNDER_FLAGS.items()} | {n: _number(k) for n, k in bundles.FOUNDER_NUMBERS.items()}
    columns |= {"prior_founder": f"coalesce({_number('COMPANIES_FOUNDED_COUNT')}, cast({flag('PRIOR_FOUNDER')} as int))", "org_built_team_size": _number("TEAM_SIZE_MANAGED")}
    columns |= {n: _phrases(t[dim]) for n, dim in bundles.THESIS.items()}
    columns["portfolio_adjacency"] = f"least(1.0, len(list_filter({held}, lambda s: contains(lower(words), s))) / cast(greatest(1, least(len({held}), 3)) as double))"
    columns["thesis_embedding_similarity"] = "null::double"
    wide = f"""with jobs_held as (select list_filter(list_distinct(list_transform(list_concat([attributes.sector], coalesce(attributes.sectors, [])), lambda s: lower(s))), lambda s: s is not null and s <> '') as sectors from organization where is_portfolio),
    tf as (select person_id, {', '.join(f"max(case when fact_type = '{k}' then said end) as t_{k}" for k in dict.fromkeys(kinds))} from latest group by 1),
    tj as (select person_id, list_sort(list(distinct org_text) filter (org_text is not null)) as texts from jobs group by 1),
    c as (select p.person_id, tf.* exclude (person_id), array_to_string(list_filter(list_concat([nullif(t_HEADLINE_TEXT, ''), nullif(t_LOCATION, '')], coalesce(texts, [])), lambda s: s is not null), ' . ') as words from people p left join tf using (person_id) left join tj using (person_id))
    select person_id, {', '.join(f'{c} as {n}' for n, c in columns.items())} from c"""
    numbers = [*bundles.FOUNDER_NUMBERS.values(), "TEAM_SIZE_MANAGED", "COMPANIES_FOUNDED_COUNT"]
    feed = dict.fromkeys(bundles.FOUNDER_FLAGS.values(), _IS_KNOWN) | dict.fromkeys(numbers, _IS_NUMBER)
    feed["PRIOR_FOUNDER"] = f"{_IS_KNOWN} and person_id not in (select person_id from latest where fact_type = 'COMPANIES_FOUNDED_COUNT' and {_IS_NUMBER})"
    return f"with {world_sql(as_of, cutoff)}, {access_sql(as_of)}, {score_sql(model, wide, _feeding(feed), as_of)}"


def lp_sql(as_of: str) -> str:
    model = config.parse(models.LP)
    kinds = ("DECISION_AUTHORITY_ROLE", "CURRENT_TITLE", "HEADLINE_TEXT", "VENTURE_ALLOCATION_EVIDENCE", "EMERGING_MANAGER_EVIDENCE")
    happened = lambda t: f"exists (select 1 from ev where ev.person_id = c.person_id and event_type = '{t}')"
    manager = f"({happened('EMERGING_MANAGER_SIGNAL')} or coalesce({_truthy('t_EMERGING_MANAGER_EVIDENCE')}, false))"
    near = "(" + " or ".join(f"coalesce(contains(lower(location), '{g.lower()}'), false)" for g in models.THESIS["geographies"]) + ")"
    columns = {n: "(" + " or ".join(f"contains(words, '{w}')" for w in words) + ")" for n, words in bundles.AUTHORITY.items()}
    columns |= {
        "is_ic_member": f"({happened('INVESTMENT_COMMITTEE_ROLE')} or contains(words, 'investment committee'))",
        "principal_with_mandate": "(contains(words, 'principal') and exists (select 1 from latest f where f.person_id = c.person_id and fact_type = 'INVESTMENT_MANDATE'))",
        "org_is_allocator_type": f"coalesce(organization_type in {_IN(bundles.ALLOCATORS)}, false)", "disclosed_aum": "nullif(cast(aum_usd as double), 0)", "known_fund_investment_activity": happened("FUND_INVESTMENT_ACTIVITY"),
        "allocates_to_vc": _truthy("t_VENTURE_ALLOCATION_EVIDENCE"), "allocates_early_stage": _truthy("t_VENTURE_ALLOCATION_EVIDENCE"), "allocates_to_emerging_managers": manager, "emerging_manager_program_evidence": manager,
        "geo_match": f"case when {near} then 1.0 else 0.0 end", "strategy_match": "0.0", "prior_emerging_commitments": f"coalesce({_number('EMERGING_MANAGER_EVIDENCE')}, 0.0)",
        "stage_fit": "case when organization_id is not null then 0.4 end", "size_fit": "case when organization_id is not null then 0.4 end", "sector_fit": "case when organization_id is not null then 0.4 end",
        "geo_fit": f"case when organization_id is not null then case when {near} then 1.0 else 0.4 end end",
    }
    wide = f"""with tf as (select person_id, {', '.join(f"max(case when fact_type = '{k}' then said end) as t_{k}" for k in kinds)} from latest group by 1),
    cur as (select person_id, organization_id, organization_type, location, aum_usd from jobs where current and organization_id is not null qualify row_number() over (partition by person_id order by started_at desc nulls last, organization_id) = 1),
    c as (select p.person_id, tf.* exclude (person_id), cur.* exclude (person_id), lower(concat_ws(' ', coalesce(t_DECISION_AUTHORITY_ROLE, ''), coalesce(t_CURRENT_TITLE, ''), coalesce(t_HEADLINE_TEXT, ''))) as words from people p left join tf using (person_id) left join cur using (person_id))
    select person_id, {', '.join(f'{c} as {n}' for n, c in columns.items())} from c"""
    feed = {"DECISION_AUTHORITY_ROLE": "true", "VENTURE_ALLOCATION_EVIDENCE": _IS_KNOWN, "EMERGING_MANAGER_EVIDENCE": _IS_NUMBER}
    return f"with {world_sql(as_of)}, {access_sql(as_of)}, {score_sql(model, wide, _feeding(feed), as_of)}"


def connector_sql(as_of: str) -> str:
    model = config.parse(models.CONNECTOR)
    wide = f"""with bothe as (select src as person_id, dst as other, verified from edges union all select dst, src, verified from edges),
    fr as (select person_id, round(avg(case when date_diff('microsecond', verified, timestamp '{as_of}') / 86400000000.0 <= 365 then 1.0 else 0.0 end), 4) as fresh from bothe group by 1),
    nb as (select distinct person_id, other from bothe where person_id <> other),
    cl as (select person_id as other, bool_or(person_class in ('FOUNDER', 'POTENTIAL_FOUNDER')) as founder, bool_or(person_class in ('LP', 'POTENTIAL_LP')) as lp, bool_or(person_class = 'PORTFOLIO_EXECUTIVE') as executive from classes group by 1),
    pj as (select person_id as other, bool_or(held) as held from jobs group by 1),
    ct as (select nb.person_id, count(*) filter (coalesce(founder, false) or coalesce(lp, false) or coalesce(executive, false)) as relevant_connections, count(*) filter (founder) as founder_connectivity, count(*) filter (lp) as lp_connectivity,
        count(*) filter (executive) + count(*) filter (held) as portfolio_connectivity, count(*) filter (p.is_team_seed) as independent_path_count
        from nb left join cl using (other) left join pj using (other) left join person p on p.person_id = nb.other and p.merged_into_id is null group by 1),
    sec as (select person_id, count(distinct s) as distinct_sectors from (select nb.person_id, unnest(j.sectors) as s from nb join jobs j on j.person_id = nb.other and j.current) group by 1),
    intro as (select l.live_id as person_id, count(*) as n from observation o join live l on l.person_id = o.person_id where content_type = 'manual_note' and contains(lower(raw_text), 'told') and observed_at <= timestamp '{as_of}' group by 1)
    select person_id, {', '.join(f'coalesce({c}, 0) as {c}' for c in ('relevant_connections', 'founder_connectivity', 'lp_connectivity', 'portfolio_connectivity', 'independent_path_count', 'distinct_sectors'))}, fresh as fresh_edge_share, coalesce(n, 0) as successful_intros
    from people left join ct using (person_id) left join sec using (person_id) left join fr using (person_id) left join intro using (person_id)"""
    nothing = "select person_id, fact_id, valid_from as moment, extraction, strength, provider from latest where false"
    return f"with {world_sql(as_of)}, {score_sql(model, wide, nothing, as_of)}"


def talent_sql(as_of: str) -> str:
    model = config.parse(models.TALENT)
    rank = lambda c: _MAP(f"lower({c})", SENIORITY, 0)
    pick = lambda words, k: "[" + ", ".join(f"'{w}'" for w in words) + f"][cast(floor(n / {k}) as int) % {len(words)} + 1]"
    adjacent = "case function " + " ".join(f"when '{k}' then {list(vs)}" for k, vs in bundles.ADJACENT.items()) + " else [] end"
    columns = {
        "function_alignment": f"case when len(functions) > 0 then case when list_contains(functions, function) then 'exact' when list_has_any(functions, {adjacent}) then 'adjacent' else 'none' end end",
        "seniority_distance": f"case when top_rank > 0 then abs({rank('seniority')} - top_rank) end",
        "domain_overlap": "case when len(domains) > 0 then round(len(list_filter(domains, lambda x: contains(words, lower(x)))) / len(domains)::double, 4) end",
        "stage_overlap": "case when len(needs) > 0 then case when list_has_any(list_transform(needs, lambda x: lower(x)), stages) then 'match' when len(stages) > 0 then 'adjacent' else 'none' end end",
        "years_operating": "years", "product_shipped": f"coalesce({_truthy('t_PRODUCT_SHIPPED')}, false)", "budget_ownership": f"coalesce({_truthy('t_BUDGET_OWNERSHIP')}, false)",
        "org_built_team_size": _number("TEAM_SIZE_MANAGED"), "promotions": f"coalesce({_number('PROMOTION_COUNT')}, 0.0)",
        "location_alignment": "case when lower(t_LOCATION) <> '' then case when remote then 'remote_ok' when metro <> '' and contains(lower(t_LOCATION), lower(metro)) then 'same_metro' when country <> '' and contains(lower(t_LOCATION), lower(country)) then 'same_country' else 'mismatch' end end",
    }
    kinds = ("PRODUCT_SHIPPED", "BUDGET_OWNERSHIP", "TEAM_SIZE_MANAGED", "PROMOTION_COUNT", "LOCATION", "HEADLINE_TEXT")
    counted = "not coalesce(lower(seniority) in ('founder', 'board', 'advisor'), false) and started_at is not null"
    wide = f"""with tf as (select person_id, {', '.join(f"max(case when fact_type = '{k}' then said end) as t_{k}" for k in kinds)} from latest group by 1),
    nr as (select *, cast(substr(organization_id, 4) as int) as n from organization where is_portfolio),
    ro as (select organization_id as role_id, {pick(world.ROLE_FUNCTIONS, 1)} as function, {pick(world.ROLE_SENIORITIES, 2)} as seniority, coalesce(attributes.sectors, []) as domains, case when attributes.stage is null then [] else [attributes.stage] end as needs,
        split_part(coalesce(location, ''), ', ', 1) as metro, split_part(coalesce(location, ''), ', ', 2) as country, n % 7 = 0 as remote from nr),
    tj as (select person_id, list_distinct(list(function) filter (function is not null)) as functions, max({rank('seniority')}) as top_rank, round(sum(case when {counted} then greatest(0, date_diff('day', started_at, coalesce(ended_at, date '{as_of[:10]}'))) / 365.25 end), 2) as years,
        list_distinct(list(stage) filter (stage is not null)) as stages, list_sort(list_distinct(list(org_name) filter (org_name is not null))) as names from jobs group by 1),
    c as (select p.person_id, tf.* exclude (person_id), coalesce(functions, []) as functions, coalesce(top_rank, 0) as top_rank, years, coalesce(stages, []) as stages, lower(array_to_string(list_concat([coalesce(t_HEADLINE_TEXT, '')], coalesce(names, [])), ' ')) as words
        from people p left join tf using (person_id) left join tj using (person_id))
    select person_id, role_id, {', '.join(f'{c} as {n}' for n, c in columns.items())} from c, ro"""
    feed = {"PRODUCT_SHIPPED": _IS_KNOWN, "BUDGET_OWNERSHIP": _IS_KNOWN, "TEAM_SIZE_MANAGED": _IS_NUMBER, "PROMOTION_COUNT": _IS_NUMBER}
    best = "qualify row_number() over (partition by person_id order by priority desc, role_id) = 1"
    return f"with {world_sql(as_of)}, {access_sql(as_of)}, {score_sql(model, wide, _feeding(feed), as_of, ', role_id', best, 'person_id, role_id')}"


def rows_sql(as_of: str, select: str) -> str:
    """A select over the CTEs of world_sql()."""
    return f"with {world_sql(as_of)} {select}"


def expiry_sql(event_type: str, at: str) -> str:
    return f"{at} + to_days(cast({_MAP(event_type, {k: d for k, (_, d) in taxonomy.EVENT_TYPES.items()}, taxonomy.TTL_DEFAULT)} as int))"


def severity_sql(event_type: str) -> str:
    return _MAP(event_type, {k: f"'{s}'" for k, (s, _) in taxonomy.EVENT_TYPES.items()}, f"'{taxonomy.SEVERITY_DEFAULT}'")


def backtest_sql(steps: tuple[str, ...]) -> str:
    """Distribution of the founder's priorities at each step, with nothing that was recorded later."""
    one = lambda s: f"""select '{s[:10]}' as step, count(*) as n, round(avg(priority), 2) as mean, round(median(priority), 2) as median, round(list_sort(list(priority))[cast(floor(0.9 * (count(*) - 1)) as bigint) + 1], 2) as p90, round(max(priority), 2) as max,
    max(case when rank = 1 then person_id end) as first from ({founder_sql(s, s)})"""  # noqa: E731
    return " union all ".join(one(s) for s in steps)


def discovery_sql(as_of: str, rules: list[dict]) -> str:
    """Candidates of the discovery stream by first matching rule."""
    low = "lower(coalesce(txt, ''))"
    hit = lambda words: "list_filter([" + ", ".join(f"case when contains({low}, '{w.lower()}') then '{w}' end" for w in words) + "]::varchar[], lambda y: y is not null)"
    tests, reasons = [], []
    for r in (r for r in rules if r.get("active", True)):
        groups = {"keywords": (r.get("keywords") or [], 4), "topics": (r.get("technical_topics") or [], 4), "titles": (r.get("titles") or [], 3)}
        events = sorted(r.get("required_events") or [])
        met = f"list_sort(list_intersect(coalesce(types, []), {events}::varchar[]))" if events else "[]::varchar[]"
        gate = f"len({met}) > 0" if events else "true"
        signals = " + ".join(f"len({hit(ws)})" for ws, _ in groups.values()) + f" + cast({gate} as int)"
        said = [f"case when len({hit(ws)}) > 0 then '{label}:' || array_to_string({hit(ws)}[1:{n}], ',') end" for label, (ws, n) in groups.items()] + [f"case when len({met}) > 0 then 'events:' || array_to_string({met}, ',') end"]
        why = f"array_to_string(list_filter([{', '.join(said)}]::varchar[], lambda y: y is not null), '; ')"
        tests.append(f"when len({hit(r.get('excluded_keywords') or [])}) = 0 and {gate} and {signals} >= {r.get('min_signals', 1)} and {why} <> '' then ")
        reasons.append((r, why))
    case = lambda value: "case " + " ".join(t + value(r, why) for t, (r, why) in zip(tests, reasons)) + " end"
    name = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"""with {world_sql(as_of)}, ty as (select observation_id, list(distinct name) as types from x where kind <> 'fact' group by 1),
dt as (select op.observation_id, source_id, person_id, subject_hint, observed_at, types, concat_ws(' ', nullif(raw_text, ''), nullif({_J('v', 'title')}, ''), nullif({_J('v', 'summary')}, ''), nullif({_J('v', 'body')}, ''), nullif({_J('v', 'profile.headline')}, '')) as txt
    from op left join ty using (observation_id) where mode = 'discover' and trim(subject_hint) <> ''),
mt as (select *, {case(lambda r, w: f"'{r['name']}'")} as rule, {case(lambda r, w: f"'{r['target_class']}'")} as target_class, {case(lambda r, w: w)} as reasons from dt),
br as (select {name.format('canonical_name')} as nm, count(*) as bearers from person where merged_into_id is null group by 1),
st as (select mt.*, l.live_id, coalesce(bearers, 0) as bearers from mt left join live l on l.person_id = mt.person_id left join br on nm = {name.format('subject_hint')} and nm <> '' where rule is not null),
cd as (select *, coalesce(live_id, 'new:' || lower(trim(subject_hint))) as pid from st where live_id is not null or bearers < 2)
select rule, target_class, pid as person_id, trim(subject_hint) as subject, live_id is null as is_new, cast(case when live_id is not null then 1.0 when bearers = 1 then 0.2 else 0.0 end as double) as identity_confidence, observation_id, source_id, reasons
from cd qualify row_number() over (partition by rule, pid order by observed_at, observation_id) = 1"""
