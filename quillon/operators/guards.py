"""What models, logs and reports may not contain."""

from __future__ import annotations

#: Parts of feature names that no model may use: fixed values.
FORBIDDEN = ("race", "ethnic", "religio", "sexual", "gender", "health", "disab", "politic", "ideolog", "union_member", "genetic", "biometric")
#: Words a report may not use of people: fixed values.
BANNED_PROSE = ("exciting", "compelling", "impressive", "amazing", "fascinating", "promising", "visionary", "great founder", "strong leader", "worth keeping an eye")
#: Keys whose values never reach a log: fixed values.
SENSITIVE_KEYS = ("email", "primary_email", "linkedin_url", "primary_linkedin_url", "api_key")


def guard_features(names: list[str]) -> None:
    """Refuse models that name a forbidden feature."""
    bad = [n for n in names if any(f in n.lower() for f in FORBIDDEN)]
    if bad:
        raise ValueError(f"forbidden features: {', '.join(bad)}")


def guard_prose(text: str) -> str:
    """The text, refused if it uses banned words."""
    bad = [w for w in BANNED_PROSE if w in text.lower()]
    if bad:
        raise ValueError(f"banned prose: {', '.join(bad)}")
    return text


def redacted(record: dict) -> dict:
    """A log record without sensitive values; empty ones stay as they are."""
    return {k: "***redacted***" if k.lower() in SENSITIVE_KEYS and v else v for k, v in record.items()}
