"""The weekly cycle: stages, idempotence, guards and rendering."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import guards
from quillon.plans import pipeline

DATA = "/root/testdata/sf0.01"


def test_a_week_twice_is_the_same(spark):
    a, run = pipeline.weekly(spark, DATA, "2026-09-06")
    b, _ = pipeline.weekly(spark, DATA, "2026-09-06")
    assert [s["stage"] for s in run.stages][:5] == ["source_health", "normalize_and_dedupe", "resolve_subjects", "extract", "resolve_extract_detect"] and run.log(spark).count() == 12
    for name in ("observations", "attachments", "events", "candidates", "scores", "digest"):
        assert a[name].exceptAll(b[name]).count() == 0 == b[name].exceptAll(a[name]).count(), name
    scores = a["scores"]
    assert {r.target for r in scores.select("target").distinct().collect()} == set(pipeline.TARGETS)
    assert scores.filter("priority < 0 or priority > 100 or rank < 1 or confidence not between 0 and 1").count() == 0
    text = pipeline.render(a["digest"])
    assert text.startswith("## ") and pipeline.as_json(a["digest"]).startswith("[")
    # The same week once more on what it stored has no new events and no change.
    again, _ = pipeline.weekly(spark, DATA, "2026-09-06", a)
    assert again["new_events"].count() == 0 and again["deltas"].filter("score_change <> 0 or rank_change <> 0").count() == 0
    assert again["digest"].filter("section = 'important_departures'").count() == 0 < a["digest"].filter("section = 'important_departures'").count()


def test_nothing_later_is_used(spark):
    early, _ = pipeline.weekly(spark, DATA, "2026-03-01")
    assert early["observations"].filter("observed_at > timestamp_ntz'2026-03-01 23:59:59'").count() == 0


def test_texts_give_events(spark, tmp_path):
    """News, posts and papers count like profiles, whether their text stands in raw_text or in raw_json."""
    for name in ("observation", "person"):
        t = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "observation":
            at = F.lit("2026-09-02 10:00:00").cast("timestamp_ntz")
            rows = [
                ("o1", "a", "activity_post", "Ann has left Acme after ten years at the firm.", None),
                ("o2", "b", "news_article", None, '{"title": "Bo Li", "summary": "Bo has left Acme after ten years at the firm.", "subjects": ["Bo Li"]}'),
                ("o3", "c", "patent", None, '{"title": "A patent", "summary": "quiet"}'),
                ("o4", "d", "json_record", "a patent", '{"fact_type": "PATENT_COUNT", "value": "1"}'),
                ("o5", "e", "news_article", None, "{broken"),
                ("o6", None, "paper", "published a paper", None),
            ]
            made = spark.createDataFrame(rows, "observation_id string, person_id string, content_type string, raw_text string, raw_json string")
            made = made.select("*", *(at.alias(c) for c in ("occurred_at", "observed_at", "ingested_at")), F.lit("s").alias("source_id"), F.col("observation_id").alias("provider_record_id"), F.lit("2026-08-31").alias("batch_id"))
            t = made.select(*(F.col(c) if c in made.columns else F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns))
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    w = pipeline.world
    live = pipeline.resolve.live_ids(spark.createDataFrame([(p, None) for p in "abcde"], "person_id string, merged_into_id string"))
    spark.createDataFrame([("s", "p", 1)], "source_id string, provider string, reliability_tier int").write.parquet(f"{tmp_path}/data_source.parquet")
    at = F.lit("2026-09-06 23:59:59").cast("timestamp_ntz")
    got = w.events_of(w.found(spark, str(tmp_path), w.visible(spark, str(tmp_path), at), live))
    assert {(r.observation_id, r.event_type) for r in got.collect()} == {("o1", "EMPLOYMENT_ENDED"), ("o2", "EMPLOYMENT_ENDED"), ("o3", "PATENT_FILED"), ("o1", "PROFESSIONAL_DEPARTURE"), ("o2", "PROFESSIONAL_DEPARTURE")}


def test_seven_types_fold_within_sixty_days_by_organisation(spark):
    rows = [("o1", "EMPLOYMENT_ENDED", "Acme", 0), ("o2", "EMPLOYMENT_ENDED", "Acme", 30), ("o3", "EMPLOYMENT_ENDED", "Bolt", 31), ("o4", "EMPLOYMENT_ENDED", "Acme", 61), ("o5", "PATENT_FILED", None, 0), ("o6", "PATENT_FILED", None, 1), ("o7", "PATENT_FILED", None, 1)]
    x = spark.createDataFrame(rows, "observation_id string, name string, organization string, n int").select("*", F.lit("event").alias("kind"), F.lit("p").alias("person_id"), F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(n)").alias("at"), F.lit(0.8).alias("confidence"), F.lit(2).alias("tier"))
    x = x.withColumn("ingested_at", F.col("at"))
    got = {(r.observation_id, r.event_type) for r in pipeline.world.events_of(x).collect()}
    assert got == {(o, t) for o in ("o1", "o3", "o4") for t in ("EMPLOYMENT_ENDED", "PROFESSIONAL_DEPARTURE")} | {("o5", "PATENT_FILED"), ("o6", "PATENT_FILED")}


def test_guards():
    for name in ("gender_score", "ideology", "union_member", "genetic_risk"):
        with pytest.raises(ValueError):
            guards.guard_features([name])
    guards.guard_features(["average_deal_size", "team_size"])
    assert guards.redacted({"api_key": "x", "Email": "a@b.example", "n": 1, "linkedin_url": ""}) == {"api_key": "***redacted***", "Email": "***redacted***", "n": 1, "linkedin_url": ""}
    assert guards.guard_prose("Ada: 12.0") == "Ada: 12.0"
    with pytest.raises(ValueError):
        guards.guard_prose("An Exciting week")
    stored = pipeline.register_model({}, {"name": "m", "version": 1, "w": 1})
    assert pipeline.register_model(stored, {"version": 1, "w": 1, "name": "m"}) == stored
    with pytest.raises(ValueError):
        pipeline.register_model(stored, {"name": "m", "version": 1, "w": 2})


def test_failing_stage_is_logged(spark):
    run = pipeline.Run("w")
    with pytest.raises(Exception):
        run.stage("bad", lambda: spark.range(1).select(F.raise_error(F.lit("no"))))
    assert run.stages[0]["error"]


def test_banned_prose(spark):
    with pytest.raises(ValueError):
        pipeline.render(spark.createDataFrame([("top", 1, "p", "P", "a compelling move")], "section string, place bigint, person_id string, person string, detail string"))


def test_sampled_edges(spark):
    n = spark.range(50).select(F.col("id").alias("node"))
    have = spark.createDataFrame([(0, i) for i in range(1, 25)], "src bigint, dst bigint")
    e = pipeline.sampled_edges(n.filter("node < 5"), n, have, 4)
    assert [r["count"] for r in e.groupBy("src").count().collect()] == [4] * 5 and e.join(have, ["src", "dst"]).count() == 0 and e.filter("src = dst").count() == 0
    assert e.exceptAll(pipeline.sampled_edges(n.filter("node < 5"), n, have, 4)).count() == 0
