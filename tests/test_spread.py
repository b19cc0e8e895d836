"""Rows that cost much are dealt over all cores, however small their table is."""

import pytest

from corrobora import document_queries, queries, workflow_queries


@pytest.mark.parametrize("name", ["trusted_texts", "name_comparisons", "code_payloads", "repair_checksum", "card_codes", "folded_names"])
def test_a_small_table_is_not_one_task(spark, name):
    assert document_queries and workflow_queries
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
