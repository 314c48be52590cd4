"""Event types: severity, days they live, and which are inferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.numbers import lookup

#: Event type: severity and days until it expires. Fixed values.
EVENT_TYPES = {
    "EMPLOYMENT_STARTED": ("low", 365),
    "EMPLOYMENT_ENDED": ("medium", 240),
    "TITLE_CHANGED": ("low", 180),
    "PROMOTION": ("medium", 240),
    "SENIORITY_INCREASED": ("low", 240),
    "BOARD_ROLE_STARTED": ("low", 400),
    "ADVISOR_ROLE_STARTED": ("low", 300),
    "FOUNDER_TITLE_ADDED": ("high", 200),
    "COMPANY_FORMATION_CONFIRMED": ("high", 400),
    "POSSIBLE_COMPANY_FORMATION": ("medium", 150),
    "STEALTH_COMPANY_SIGNAL": ("medium", 150),
    "COFOUNDER_SEARCH": ("medium", 120),
    "PRODUCT_LAUNCH": ("medium", 200),
    "COMPANY_WEBSITE_LAUNCHED": ("low", 200),
    "FUNDRAISE_ANNOUNCED": ("high", 300),
    "FUNDING_ROUND_CONFIRMED": ("high", 400),
    "ACCELERATOR_JOINED": ("medium", 300),
    "COMPANY_EXIT": ("high", 3650),
    "COMPANY_ACQUIRED": ("high", 3650),
    "HIRING_STARTED": ("low", 120),
    "DOMAIN_ACTIVITY_SPIKE": ("low", 90),
    "HEADLINE_CHANGED": ("low", 90),
    "PAPER_PUBLISHED": ("low", 730),
    "PATENT_FILED": ("low", 1460),
    "OPEN_SOURCE_PROJECT_LAUNCHED": ("low", 365),
    "TECHNICAL_PROJECT_LAUNCHED": ("low", 200),
    "RESEARCH_COMMERCIALIZATION_SIGNAL": ("medium", 180),
    "LP_ROLE_STARTED": ("medium", 400),
    "FAMILY_OFFICE_ROLE_STARTED": ("medium", 400),
    "CIO_ROLE_STARTED": ("high", 500),
    "PARTNER_ROLE_STARTED": ("high", 400),
    "INVESTMENT_MANDATE_CHANGED": ("high", 300),
    "VENTURE_ALLOCATION_SIGNAL": ("medium", 365),
    "FUND_INVESTMENT_ACTIVITY": ("medium", 365),
    "EMERGING_MANAGER_SIGNAL": ("medium", 365),
    "INVESTMENT_COMMITTEE_ROLE": ("medium", 400),
    "PROFESSIONAL_DEPARTURE": ("medium", 180),
    "OPEN_TO_WORK_SIGNAL": ("medium", 120),
    "NEW_EXECUTIVE_ROLE": ("medium", 365),
    "FUNCTIONAL_LEADERSHIP_ROLE": ("low", 365),
    "PORTFOLIO_ROLE_MATCH_CREATED": ("low", 90),
    "NEW_TEAM_CONNECTION": ("medium", 730),
    "RELATIONSHIP_STRENGTH_UPDATED": ("low", 365),
    "WARM_PATH_CREATED": ("medium", 180),
    "WARM_PATH_LOST": ("medium", 180),
    "NEWS_MENTION": ("low", 120),
    "AWARD": ("low", 400),
    "CONFERENCE_APPEARANCE": ("low", 120),
    "PUBLIC_TALK": ("low", 180),
    "MAJOR_COMPANY_MILESTONE": ("low", 240),
}
#: Types that are inferences and never events: fixed values.
INFERENCE_TYPES = ("POSSIBLE_COMPANY_FORMATION", "STEALTH_COMPANY_SIGNAL", "RESEARCH_COMMERCIALIZATION_SIGNAL")
#: Types of which two reports within 60 days are one change: fixed values.
WINDOWED_TYPES = ("EMPLOYMENT_ENDED", "EMPLOYMENT_STARTED", "PROFESSIONAL_DEPARTURE", "FOUNDER_TITLE_ADDED", "COMPANY_FORMATION_CONFIRMED", "FUNDRAISE_ANNOUNCED", "PROMOTION")
TTL_DEFAULT, SEVERITY_DEFAULT = 180, "low"
#: Classes that an event or inference type gives a person: fixed values.
CLASS_OF = {
    "FOUNDER_TITLE_ADDED": "POTENTIAL_FOUNDER", "COMPANY_FORMATION_CONFIRMED": "POTENTIAL_FOUNDER", "PROFESSIONAL_DEPARTURE": "TALENT", "OPEN_TO_WORK_SIGNAL": "TALENT",
    "CIO_ROLE_STARTED": "POTENTIAL_LP", "PARTNER_ROLE_STARTED": "POTENTIAL_LP", "INVESTMENT_MANDATE_CHANGED": "POTENTIAL_LP", "POSSIBLE_COMPANY_FORMATION": "POTENTIAL_FOUNDER",
}


def ttl_days(event_type: Column) -> Column:
    return lookup(event_type, {k: days for k, (_, days) in EVENT_TYPES.items()}, TTL_DEFAULT).cast("int")


def severity(event_type: Column) -> Column:
    return lookup(event_type, {k: s for k, (s, _) in EVENT_TYPES.items()}, SEVERITY_DEFAULT)


def expiry(event_type: Column, at: Column) -> Column:
    return at + F.make_dt_interval(ttl_days(event_type))
