"""Feature tables: latest facts pivoted, neighbour counts, tenure, phrase and tier matches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import hits, tokens
from quillon.operators.timeline import latest

#: Words of a thesis text: fixed value.
THESIS_WORD = "[a-z0-9][a-z0-9+.#-]*"


def pivoted(facts: DataFrame, subject: str, kind: str, value: str, order: list[Column], kinds: list[str]) -> DataFrame:
    """(subject, one column per kind): the latest value of each; a kind without a fact is null, i.e. unknown."""
    last = latest(facts.filter(F.col(kind).isin(*kinds)), [subject, kind], order)
    return last.groupBy(subject).pivot(kind, kinds).agg(F.first(value))


def neighbour_features(edges: DataFrame, marks: DataFrame, flags: list[str], verified: str, as_of: Column, fresh_days: int = 365) -> DataFrame:
    """(node, neighbours, one count per flag, fresh_share) of an undirected edge list src, dst.

    marks: node and boolean flags. fresh_share is the share of edges verified within ``fresh_days``; an edge that was
    never verified isn't fresh.
    """
    age = F.datediff(as_of, F.col(verified))
    joined = edges.join(marks.withColumnRenamed("node", "dst"), "dst", "left")
    counts = [F.count_distinct(F.when(F.coalesce(F.col(f), F.lit(False)), F.col("dst"))).alias(f) for f in flags]
    fresh = F.round(F.avg(F.when(F.coalesce(age <= fresh_days, F.lit(False)), 1.0).otherwise(0.0)), 4).alias("fresh_share")
    return joined.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("neighbours"), *counts, fresh)


def tenure_years(jobs: DataFrame, person: str, start: str, end: str, as_of: Column, counted: Column) -> DataFrame:
    """(person, years): summed lengths of counted jobs, open ones up to ``as_of``; null where none counts."""
    days = F.greatest(F.lit(0), F.datediff(F.coalesce(F.col(end), as_of), F.col(start)))
    return jobs.groupBy(person).agg(F.round(F.sum(F.when(counted & F.col(start).isNotNull(), days / 365.25)), 4).alias("years"))


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Phrases found in the text, else those that share a word with it; each once, in alphabetical order."""
    words = tokens(text, THESIS_WORD)
    whole = hits(text, phrases)
    within = lambda p: F.array(*(F.lit(w) for w in re.findall(THESIS_WORD, p.lower()) or [""]))
    shared = F.array_compact(F.array(*(F.when(F.arrays_overlap(words, within(p)), F.lit(p)) for p in phrases))) if phrases else whole
    return F.array_sort(F.array_distinct(F.when(F.size(whole) > 0, whole).otherwise(shared)))


def phrase_match(text: Column, phrases: list[str]) -> Column:
    """Score in [0, 1] of a topic list by phrase_hits(); four finds are enough, no topics score 0."""
    return F.round(F.least(F.lit(1.0), F.size(phrase_hits(text, phrases)) / float(max(1, min(len(phrases), 4)))), 4)


def overlap(have: Column, wanted: Column) -> Column:
    """Share of wanted items that are there; null where nothing is wanted."""
    return F.round(F.size(F.array_intersect(have, wanted)) / F.nullif(F.size(wanted), F.lit(0)), 4)


def tier(have: Column, exact: Column, adjacent: Column) -> Column:
    """'exact', 'adjacent' or 'none'."""
    return F.when(F.arrays_overlap(have, exact), "exact").when(F.arrays_overlap(have, adjacent), "adjacent").otherwise("none")


def best_of(scored: DataFrame, key: str, choice: str, score: str) -> DataFrame:
    """(key, choice, score): the choice of highest score, least choice on ties."""
    return scored.groupBy(key).agg(F.min_by(F.struct(choice, score), F.struct(-F.col(score), F.col(choice))).alias("b")).select(key, f"b.{choice}", f"b.{score}")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, cosine, place): the k nearest of all vectors to each query, by blocks and not by pairs.

    vectors and queries: vec_id, embedding; queries must be few enough to send to every task and are counted first.
    Each batch of vectors is multiplied with all queries and keeps k per query, so what is shuffled is k rows per query
    and batch.
    """
    import numpy as np

    most = 10_000
    rows = queries.select("vec_id", "embedding").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries; search them in blocks")
    ids = np.array([r[0] for r in rows])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    matrix = unit(np.array([r[1] for r in rows], np.float64)) if rows else np.zeros((0, 1))

    def run(batches):
        import pandas as pd

        for b in batches:
            if not len(b) or not len(ids):
                continue
            sims = unit(np.stack(b["embedding"].to_numpy()).astype(np.float64)) @ matrix.T
            other = b["vec_id"].to_numpy()
            sims[other[:, None] == ids[None, :]] = -2.0
            n = min(k, len(b))
            top = np.argpartition(-sims, n - 1, axis=0)[:n]
            q = np.tile(np.arange(len(ids)), (n, 1))
            frame = pd.DataFrame({"query_id": ids[q.ravel()], "vec_id": other[top.ravel()], "cosine": np.round(sims[top.ravel(), q.ravel()], 6)})
            yield frame[frame["cosine"] > -1.5]

    near = vectors.select("vec_id", "embedding").filter("embedding is not null").mapInPandas(run, "query_id bigint, vec_id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
