"""The general pN queries on odd tables."""

from __future__ import annotations

import edges
import pytest

from quillon.plans import data_queries

QUERIES = sorted(data_queries.QUERIES)


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_nothing_gives_nothing_found(spark, tmp_path, kind):
    d = edges.write(tmp_path / kind, kind)
    for q in QUERIES:
        n = data_queries.QUERIES[q](spark, d).count()
        assert n == (3 if (q, kind) == ("p1_kept", "null") else 0), q


def test_clashing_columns_change_nothing(spark, tmp_path):
    d = edges.write(tmp_path / "clashing", "clashing")
    for q in QUERIES:
        assert edges.rows(data_queries.QUERIES[q](spark, d)) == edges.rows(data_queries.QUERIES[q](spark, edges.SOURCE)), q


def test_repeated_rows(spark, tmp_path):
    d = edges.write(tmp_path / "repeated", "repeated")
    same = lambda q: edges.rows(data_queries.QUERIES[q](spark, d).distinct()) == edges.rows(data_queries.QUERIES[q](spark, edges.SOURCE).distinct())
    assert same("p5_found") and same("p2_found") and same("p6_found")
    assert data_queries.p5_found(spark, d).count() == data_queries.p5_found(spark, edges.SOURCE).count()


BUILT = ["founder_scores", "lp_scores", "talent_scores", "connector_scores", "fact_evidence", "event_rows", "inference_list", "discovery_candidates", "subject_attachment", "er_decision", "person_resources", "spearman_rank", "employment_after_events"]


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_models_of_nothing(spark, tmp_path, kind):
    """Without people nobody is scored and nothing is found, whatever is missing."""
    from quillon.plans import reference_queries

    d = edges.write(tmp_path / kind, kind)
    for q in BUILT:
        n = reference_queries.QUERIES[q](spark, d).count()
        assert n == {"spearman_rank": 1, "employment_after_events": 3 if kind == "null" else 0}.get(q, 0), q


def test_models_ignore_clashing_columns(spark, tmp_path):
    from quillon.plans import reference_queries

    d = edges.write(tmp_path / "clashing", "clashing")
    for q in ("founder_scores", "talent_scores", "event_rows", "er_decision", "spearman_rank"):
        assert edges.rows(reference_queries.QUERIES[q](spark, d)) == edges.rows(reference_queries.QUERIES[q](spark, edges.SOURCE)), q
