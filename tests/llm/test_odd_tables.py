"""The llm pN queries on odd tables."""

from __future__ import annotations

import edges
import pytest

from quillon.llm import queries

FOUND = ["p3_found", "p4_found", "p7_found", "p7_candidates", "p8_ids", "p9_packed", "p10_found", "p10_shared"]


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_nothing_gives_nothing_found(spark, tmp_path, kind):
    d = edges.write(tmp_path / kind, kind)
    for q in FOUND:
        n = queries.QUERIES[q](spark, d).count()
        assert n == (3 if kind == "null" and q in ("p8_ids", "p9_packed", "p10_shared") else 0), q


def test_clashing_columns_change_nothing(spark, tmp_path):
    d = edges.write(tmp_path / "clashing", "clashing")
    for q in FOUND:
        assert edges.rows(queries.QUERIES[q](spark, d)) == edges.rows(queries.QUERIES[q](spark, edges.SOURCE)), q


def test_repeated_rows(spark, tmp_path):
    d = edges.write(tmp_path / "repeated", "repeated")
    for q in ("p3_found", "p4_found", "p7_found", "p8_ids"):
        assert set(edges.rows(queries.QUERIES[q](spark, d))) == set(edges.rows(queries.QUERIES[q](spark, edges.SOURCE))), q
