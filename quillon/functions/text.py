"""Text expressions: normalised names and addresses, token sets, snippets and phrase hits. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a headline comparison ignores: fixed values.
HEADLINE_STOP = ("a", "an", "the", "at", "of", "in", "on", "for", "to", "and", "or", "with", "building", "builds", "is", "are", "i'm", "im", "my", "me", "new")
#: Words that a story key ignores: fixed values.
STORY_STOP = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "with", "is", "are", "as", "at", "by", "from", "into", "over", "after", "new", "round", "report", "says", "say", "said",
    "announces", "announce", "announced", "reveals", "unveils", "update", "startup", "company", "firm", "inc", "llc", "ltd", "exclusive", "breaking", "today", "this", "week", "amid",
)


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_name(c: Column) -> Column:
    """Lower case letters, digits and single blanks; every other character is a blank."""
    return squeezed(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))


def normal_address(c: Column) -> Column:
    """A profile address without query, last slashes, scheme, www and letter case; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\?.*$", ""), "/+$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, "^https?://", ""), r"^www\.", ""), F.lit(""))


def domain(c: Column) -> Column:
    """Host of an address with its port, without www and letter case; null for none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), F.lit(""))


def tokens(c: Column, pattern: str = "[a-z0-9]+", stop: tuple[str, ...] = (), longer_than: int = 0) -> Column:
    """Distinct lower case tokens in order of appearance; the empty array for a null text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), F.lit(1)))
    kept = F.filter(found, lambda t: (F.length(t) > longer_than) & ~t.isin(*stop)) if stop or longer_than else found
    return F.coalesce(kept, F.array().cast("array<string>"))


def story_key(c: Column, most: int = 12) -> Column:
    """Digest of a title's first ``most`` sorted distinct words; titles reworded in order only share it."""
    words = F.slice(F.array_sort(tokens(c, stop=STORY_STOP, longer_than=2)), 1, most)
    return F.sha1(F.array_join(words, " ").cast("binary"))


def material_change(before: Column, after: Column, stop: tuple[str, ...] = HEADLINE_STOP, least: int = 2, share: float = 0.35) -> Column:
    """Whether two headlines differ in substance: ``least`` changed tokens, or more than ``share`` of all tokens."""
    a, b = tokens(before, stop=stop, longer_than=1), tokens(after, stop=stop, longer_than=1)
    changed = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    union = F.size(F.array_union(a, b))
    differs = ~F.trim(F.coalesce(before, F.lit(""))).eqNullSafe(F.trim(F.coalesce(after, F.lit(""))))
    return differs & (changed > 0) & ((changed >= least) | (changed > share * union))


def hits(text: Column, phrases: list[str]) -> Column:
    """Those of ``phrases`` that occur in the text, letter case aside, in the order given."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(lowered.contains(p.lower()), F.lit(p)) for p in phrases))) if phrases else F.array().cast("array<string>")


def snippet(text: Column, needles: list[str], before: int = 40, width: int = 120) -> Column:
    """``width`` characters around the first needle that occurs, else the text's beginning."""
    lowered = F.lower(text)
    at = F.coalesce(*(F.nullif(F.instr(lowered, n.lower()), F.lit(0)) for n in needles), F.lit(1))
    return F.substring(text, F.greatest(F.lit(1), at - before), F.lit(width))


def clean_org(c: Column) -> Column:
    """An organisation's name as captured from prose, without outer blanks, points, commas and dashes."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^[ .,-]+|[ .,-]+$", "")


def listed(c: Column) -> Column:
    """'["a", 'b']' as 'a, b'; other text as it is."""
    items = F.regexp_extract_all(c, F.lit("['\"]([^'\"]*)['\"]"), F.lit(1))
    return F.when(F.trim(c).startswith("["), F.array_join(items, ", ")).otherwise(F.trim(c))


def titled_name(title: Column, url: Column, marker: str = "/in/") -> Column:
    """The person named before the first ' - ' or ' | ' of a profile page's title: two to five capitalised words; else null."""
    head = F.trim(F.element_at(F.split(title, r"\s[-–|]\s"), 1))
    words = F.split(head, r"\s+")
    good = F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}[\p{L}.'’-]*$")) & url.contains(marker)
    return F.when(good, head)


def label(code: Column) -> Column:
    """A code as people read it: 'EMPLOYMENT_ENDED' as 'Employment ended'."""
    words = F.lower(F.regexp_replace(code, "_+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def truncated(c: Column, most: int = 80) -> Column:
    """A text of at most ``most`` characters, cut ones ending in an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("\u2026"))).otherwise(c)


def age_bucket(days: Column) -> Column:
    """How long ago: today, this week, this month, this year or earlier; null for an unknown age."""
    return F.when(days < 1, "today").when(days < 7, "this week").when(days < 30, "this month").when(days < 365, "this year").when(days.isNotNull(), "earlier")
