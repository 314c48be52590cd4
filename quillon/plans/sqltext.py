"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations

from quillon.operators import rules


def opened(column: str) -> str:
    """The object a JSON text holds, or the object in the JSON string that it holds; null for all else."""
    outer = f"try_cast({column} as json)"
    inner = f"try_cast({outer} ->> '$' as json)"
    whole = f"case when json_type({outer}) = 'VARCHAR' then {inner} else {outer} end"
    return f"case when json_type({whole}) = 'OBJECT' then {whole} end"


def profile(document: str) -> str:
    """The object ``profile`` of an opened document, else the document."""
    return f"case when json_type({document}, '$.profile') = 'OBJECT' then json_extract({document}, '$.profile') else {document} end"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def said(words: tuple[str, ...], column: str = "said") -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{quoted(w)}')" for w in words) + ")"


def _snippet(*needles: str) -> str:
    at = "coalesce(" + ", ".join(f"nullif(instr(lower(said), '{n}'), 0)" for n in needles) + ", 1)"
    return f"substr(said, greatest(1, {at} - 40), 120)"


def text_rules(source: str) -> str:
    """Rows (observation_id, kind, name, confidence, value, organization) of the rules on free text in ``source``.said."""
    has = lambda p: f"regexp_matches(said, '{quoted(p)}')"
    after = quoted(rules.ORG_AFTER.replace("(?=", "(?:"))
    clean = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^[ .,-]+|[ .,-]+$', '', 'g')"
    org = f"nullif({clean.format(f"regexp_extract(said, '{after}', 1)")}, '')"
    ended = f"({said(rules.LEAVING)} and {said(rules.LEAVING_TOO)})"
    funded = f"({has(rules.RAISED)} and {has(rules.SERIES)})"
    launched, infra = f"({has(rules.LAUNCH)} and {said(rules.PRODUCT_WORDS)})", said(("infrastructure", "infra"))
    rows = [
        ("event", "NEWS_MENTION", "content_type = 'news_article' and subject_hint is not null", 0.75, "subject_hint", "null"),
        ("event", "EMPLOYMENT_ENDED", ended, 0.8, "null", org),
        ("fact", "EMPLOYMENT_ENDED_AT", ended, 0.8, _snippet("left", "after", "depart"), org),
        ("event", "FUNDRAISE_ANNOUNCED", funded, 0.85, "null", "null"),
        ("fact", "INSTITUTIONAL_FUNDRAISE", funded, 0.85, _snippet("rais", "seed", "series"), "null"),
        ("event", "TECHNICAL_PROJECT_LAUNCHED", f"{launched} and {infra}", 0.75, "null", "null"),
        ("event", "PRODUCT_LAUNCH", f"{launched} and not {infra}", 0.75, "null", "null"),
        ("fact", "PRODUCT_SHIPPED", launched, 0.7, _snippet("launch", "introduc", "unveil"), "null"),
        ("inference", "STEALTH_COMPANY_SIGNAL", has(rules.TEXT_STEALTH), 0.65, "null", "null"),
        ("inference", "POSSIBLE_COMPANY_FORMATION", f"{has(rules.TEXT_BUILDING)} and content_type <> 'profile_snapshot'", 0.5, "null", "null"),
        ("event", "COFOUNDER_SEARCH", f"regexp_matches(lower(said), '{rules.TEXT_COFOUNDER}')", 0.8, "null", "null"),
        ("event", "OPEN_TO_WORK_SIGNAL", has(rules.OPEN_TO_WORK), 0.85, "null", "null"),
        ("fact", "OPEN_TO_WORK_DECLARED", has(rules.OPEN_TO_WORK), 0.85, "'true'", "null"),
        ("event", "PARTNER_ROLE_STARTED", has(rules.PARTNER), 0.8, "null", org),
        ("event", "CIO_ROLE_STARTED", f"{has(rules.CIO)} and {said(rules.APPOINTED)}", 0.8, "null", org),
        ("event", "INVESTMENT_MANDATE_CHANGED", has(rules.MANDATE), 0.8, "null", "null"),
        ("fact", "INVESTMENT_MANDATE", has(rules.MANDATE), 0.8, "'venture allocation'", "null"),
        ("event", "PATENT_FILED", has(rules.PATENT), 0.7, "null", "null"),
        ("event", "PAPER_PUBLISHED", has(rules.PAPER), 0.7, "null", "null"),
        ("event", "COMPANY_ACQUIRED", has(rules.ACQUIRED), 0.8, "null", org),
    ]
    return " union all ".join(f"select observation_id, '{k}' as kind, '{n}' as name, cast({c} as double) as confidence, {v} as value, {o} as organization from {source} where {test}" for k, n, test, c, v, o in rows)


def first_wins(source: str, where: str = "true") -> str:
    """Rows of an observation table without the repeated deliveries of a provider's record."""
    pid = "lower(regexp_replace(provider_record_id, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g'))"
    place = f"row_number() over (partition by source_id, {pid} order by observed_at, ingested_at, observation_id)"
    return f"select * from {source} where {where} qualify source_id is null or provider_record_id is null or {place} = 1"
