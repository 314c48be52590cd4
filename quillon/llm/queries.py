"""The pN_ queries of the llm problems and, where SQL can say it, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import canonical, names, packing, people, spans, tokens
from quillon.session import broadcast_if_small, cut, table

CAPACITY = 2_048


def _lists(spark: SparkSession, d: str) -> dict:
    return {
        "current_title": (canonical.read_list(table(spark, d, "title_ref"), "title_id", "title"), canonical.TITLES),
        "current_company": (canonical.read_list(table(spark, d, "organization"), "organization_id", "canonical_name"), canonical.COMPANIES),
        "location": (canonical.read_list(table(spark, d, "place_ref"), "place_id", "name", "country"), canonical.PLACES),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observation").filter("content_type = 'profile_snapshot'")
    return canonical.map_profiles(o, "observation_id", "raw_json", _lists(spark, d))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values without an entry, by field."""
    return p3_found(spark, d).groupBy("field").agg(F.count("*").alias("rows"), F.sum((F.col("ref_id") == "").cast("bigint")).alias("unmatched"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return people.best(people.matches(spark, d, confidence=False)).select("candidate_id", "person_id")


def p4_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The match of each candidate with its confidence and what agrees."""
    return people.best(people.matches(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observation").select("observation_id", "subject_hint").filter("subject_hint is not null")
    people = table(spark, d, "watchlist").groupBy("canonical_name").agg(F.min("person_id").alias("person_id"), F.count_distinct("person_id").alias("n")).filter("n = 1")
    linked = names.link(o.select(F.col("subject_hint").alias("name")), people.select(F.col("canonical_name").alias("name")))
    linked = linked.filter("name <> center").join(people, F.col("center") == F.col("canonical_name")).select(F.col("name").alias("subject_hint"), "person_id")
    return o.join(broadcast_if_small(cut(linked)), "subject_hint").select("observation_id", "person_id")


def p7_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The spelling of each er_candidate linked to a live person's name."""
    c = table(spark, d, "er_candidate").select("candidate_id", "name")
    people = table(spark, d, "person").filter("merged_into_id is null").select(F.col("canonical_name").alias("name"))
    linked = names.link(c, people)
    return c.join(linked, "name").select("candidate_id", F.col("center").alias("canonical_name"), F.round("similarity", 4).alias("similarity"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each piece of each document and its container of CAPACITY tokens."""
    sizes = cut(tokens.count_tokens(table(spark, d, "documents").select("doc_id", "text"), "text"))
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers by fill: how many, tokens held, room unused and the spread of cost."""
    n = F.col("n").cast("double")
    by = p9_packed(spark, d).filter("container is not null").groupBy("container").agg(F.sum("n").alias("tokens"), F.sum(n + n * n / CAPACITY).alias("cost"))
    return by.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum(CAPACITY - F.col("tokens")).alias("unused"), F.round(F.min("cost"), 2).alias("least_cost"), F.round(F.max("cost"), 2).alias("most_cost"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    shared = spans.SharedSpans(table(spark, d, "documents"), "doc_id", "text")
    return shared.pairs().select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p10_members(spark: SparkSession, d: str) -> DataFrame:
    """The form without pairs: each document that shares a passage, with the passage, named by its first document, how many
    documents share it, copies of a text among them. Linear in the documents of a passage."""
    shared = spans.SharedSpans(table(spark, d, "documents"), "doc_id", "text")
    passages = cut(shared.passages())
    copies = shared.members.select(F.col("text_key"), F.col("key").alias("doc_id"))
    rows = passages.join(copies, "text_key", "left").select("passage", F.coalesce("doc_id", "text_key").alias("doc_id"))
    whole = shared.members.select(F.xxhash64("text_key", F.lit("copies")).alias("passage"), F.col("key").alias("doc_id"))
    every = cut(rows.unionByName(whole))
    named = every.groupBy("passage").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("documents"))
    return every.join(named, "passage").select("first_doc", "doc_id", "documents", F.hex("passage").alias("passage"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """Of each document how many characters also stand elsewhere, and in how many intervals; copies count as shared whole."""
    docs = table(spark, d, "documents")
    shared = spans.SharedSpans(docs, "doc_id", "text")
    by_text = shared.intervals().groupBy("text_key").agg(F.sum(F.col("end") - F.col("start")).alias("shared"), F.count("*").alias("spans"))
    copies = shared.members.select(F.col("key").alias("doc_id"), "text_key")
    rows = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(copies, "doc_id", "left")
    rows = rows.withColumn("own", F.coalesce("text_key", "doc_id")).join(by_text.withColumnRenamed("text_key", "own"), "own", "left")
    whole = F.col("text_key").isNotNull()
    return rows.select(
        "doc_id",
        "chars",
        F.when(whole, F.col("chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("bigint").alias("shared_chars"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("intervals"),
    )


QUERIES = {q.__name__: q for q in (p3_found, p3_unmatched, p4_found, p4_confidence, p7_found, p7_candidates, p8_ids, p9_packed, p9_containers, p10_found, p10_shared, p10_members)}
_WINDOWS = f"""d as (select doc_id, text, length(text) as n from documents where doc_id is not null and length(text) >= {spans.LENGTH}),
w as (select doc_id, i, md5_number(substr(text, i, {spans.LENGTH})) as h from (select doc_id, text, unnest(range(1, n - {spans.LENGTH} + 2)) as i from d)),
s as (select h from w group by h having count(distinct doc_id) > 1), p as (select doc_id, i, h from w semi join s using (h))"""
SQL: dict[str, str] = {
    "p10_found": f"with {_WINDOWS}, k as (select distinct doc_id, h from p) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from k a join k b on a.h = b.h and a.doc_id < b.doc_id",
    "p10_shared": f"""with {_WINDOWS}, r as (select doc_id, i, case when i > lag(i) over o + {spans.LENGTH} or lag(i) over o is null then 1 else 0 end as new from (select distinct doc_id, i from p) window o as (partition by doc_id order by i)),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from r), v as (select doc_id, run, max(i) - min(i) + {spans.LENGTH} as covered from g group by 1, 2), t as (select doc_id, sum(covered) as shared, count(*) as runs from v group by 1)
select doc_id, coalesce(length(text), 0) as chars, cast(coalesce(shared, 0) as bigint) as shared_chars, coalesce(runs, 0) as intervals from documents left join t using (doc_id)""",
}
