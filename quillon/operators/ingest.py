"""Ingestion: content dedupe, story clusters, upserts and idempotent loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import domain, story_key
from quillon.operators.dedupe import keep_first


def accept_new(drafts: DataFrame, stored: DataFrame, content: str, provider: list[str], order: list[str]) -> DataFrame:
    """Drafts whose content is new and whose provider key isn't stored; of equal contents the first by ``order``.

    ``content`` is a hash column of both tables; ``provider`` the columns of the provider's key, null keys are never
    stored ones. Equal provider keys within one batch are not folded.
    """
    first = keep_first(drafts, [F.col(content)], order)
    fresh = first.join(stored.select(content).distinct(), content, "left_anti")
    return fresh.join(stored.select(*provider).dropna().distinct(), provider, "left_anti").select(*drafts.columns)


def story_clusters(news: DataFrame, title: str, url: str, seen_at: str, order: str) -> DataFrame:
    """(cluster_key, first_url, first_seen, articles, domains) of news by story; domains is 1 where none is readable."""
    keyed = news.withColumn("cluster_key", story_key(F.col(title)))
    return keyed.groupBy("cluster_key").agg(
        F.min_by(url, F.struct(seen_at, order)).alias("first_url"),
        F.min(seen_at).alias("first_seen"),
        F.count("*").alias("articles"),
        F.greatest(F.lit(1), F.count_distinct(domain(F.col(url)))).alias("domains"),
    )


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with equal keys, all others stay. Columns are those of ``old``."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def missing(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that are not stored, for get-or-create and idempotent loads; null keys are left out."""
    return wanted.select(*keys).dropna().distinct().join(stored, keys, "left_anti")
