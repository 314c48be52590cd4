"""Values with a status, and typed reads of JSON text."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column, unit: Column | None = None) -> Column:
    """A known value as the struct (status, value, unit); a null value is unknown."""
    return F.struct(F.when(value.isNull(), "unknown").otherwise("known").alias("status"), value.cast("string").alias("value"), (unit if unit is not None else F.lit(None).cast("string")).alias("unit"))


def is_unknown(value: Column) -> Column:
    """Null, empty or marked unknown."""
    return value.isNull() | F.coalesce(value["status"] == "unknown", F.lit(False)) | (value["value"].isNull() & ~F.coalesce(value["status"] == "known", F.lit(False)))


def path(json_text: Column, field: str, within: str = "profile") -> Column:
    """A field of the nested object, else of the root."""
    return F.coalesce(F.get_json_object(json_text, f"$.{within}.{field}"), F.get_json_object(json_text, f"$.{field}"))


def opened(json_text: Column) -> Column:
    """The object a JSON text holds, or the object in the JSON string that it holds, as a variant; null for all else."""
    outer = F.try_parse_json(json_text)
    inner = F.try_parse_json(F.try_variant_get(outer, "$", "string"))
    is_text = F.schema_of_variant(outer) == "STRING"
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_text & is_object(inner), inner).when(~is_text & is_object(outer), outer)


def profile(document: Column) -> Column:
    """The object ``profile`` of an opened() document, else the document."""
    within = F.try_variant_get(document, "$.profile", "variant")
    return F.when(F.coalesce(F.schema_of_variant(within).startswith("OBJECT"), F.lit(False)), within).otherwise(document)


def as_number(text: Column) -> Column:
    """A number, null where the text is none."""
    return F.try_cast(F.trim(text), "double") if hasattr(F, "try_cast") else F.trim(text).try_cast("double")


def truthy(text: Column) -> Column:
    """Truth of a JSON scalar: false for false, 0, null and the empty text; the text "false" in quotes is not told apart."""
    number = text.try_cast("double")
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(text.isin("false", "", "null"), False).when(number.isNotNull(), number != 0).otherwise(True)


def canonical_json(json_text: Column) -> Column:
    """JSON with sorted keys and no outer white space, null for unreadable text: two layouts of one object are equal.

    Arbitrary keys can't be sorted by built-in functions, so this is an Arrow-batched function.
    """

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return canonical(json_text)


def config_hash(config: dict) -> str:
    """Identity of a configuration, independent of its key order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def content_hash(content_type: Column, subject: Column, url: Column, text: Column, payload: Column) -> Column:
    """Identity of a delivered record's content; ``payload`` should be canonical_json(). Ids and arrival don't count."""
    trimmed = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    parts = (F.coalesce(content_type, F.lit("")), trimmed(subject), trimmed(url), F.coalesce(F.trim(text), F.lit("")), F.coalesce(payload, F.lit("")))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def event_key(person: Column, event_type: Column, at: Column) -> Column:
    """Key under which an event counts once: person, type and day."""
    return F.sha1(F.concat_ws("|", person.cast("string"), event_type, F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("none"))).cast("binary"))


def derived_key(person: Column, event_type: Column, at: Column) -> Column:
    """Key of an event that follows from another, in plain text: person:type:day."""
    return F.concat_ws(":", person.cast("string"), event_type, F.date_format(at, "yyyy-MM-dd"))


def universe_key(target: Column, day: Column, name: Column) -> Column:
    """Key of a ranking universe: its target, day and label."""
    return F.concat_ws("|", target, day.cast("string"), name)
