"""Queries that have a plain-SQL form, against it."""

import pytest
from compare import connect, difference

from matchlens.llm import queries


@pytest.mark.parametrize(
    "name, sf",
    [
        ("op5_hyperplane_links", "0.1"),
        ("op6_run_length_index", "0.001"),
        ("op11_capture_index", "0.01"),
        ("op12_hirschberg_repair", "0.01"),
        ("op13_geometric_blocks", "0.01"),
    ],
)
def test_matches_plain_sql(spark, name, sf):
    where = f"/root/testdata/sf{sf}"
    assert difference(queries.QUERIES[name](spark, where), connect(where), queries.CHECKS[name]) == ""


def test_numbered_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in found and set(__spark_entry__.oracle_sql()) <= set(found)
