"""Plans of the queries: what they must not hold, and what must reach the scans."""

from pathlib import Path

import pytest

from manloom import queries
from manloom.operators import manuals

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plan(spark, name):
    return queries.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"replicate_subtree", "grammar_expand"}))
def test_no_product_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "EvalPython" not in text and "InPandas" not in text


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in plan(spark, "signature_dedup")
    assert "ReadSchema: struct<o_orderkey:bigint>" in queries._table(spark, str(SF), "orders").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan(spark, "card_gate") and "text:string" not in plan(spark, "missing_blocks")


def test_filters_are_pushed(spark):
    df = queries._table(spark, str(SF), "documents").where("lang = 'de'").select("doc_id")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["card_marks", "card_measurement"])
def test_tables_of_cards_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(spark, name)


def test_a_measurement_broadcasts_nothing_and_reads_the_manuals_once(spark):
    text = plan(spark, "card_measurement")
    assert "Broadcast" not in text and "/part.parquet" not in text


def test_words_of_cards_are_cut_after_their_lines_are_dealt(spark):
    df = queries.queries()["card_evidence"](spark, str(SF))
    filters = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in x]
    assert not any("transform(" in x for x in filters)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_documents_are_dealt_over_all_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(spark, "table_rows")
    lines = manuals.doc_lines(spark.createDataFrame([(1, "a\nb")], "doc long, text string"))
    assert "REPARTITION_BY_NUM" in lines._jdf.queryExecution().executedPlan().toString()
