"""What the plans of the wide operators must look like."""

import pytest

from conftest import SMALL

import __spark_entry__ as entry


def plan(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


BLOCKS = (
    "aac dpc tpc gaac gdpc gtpc cksaap cksaagp dde moran geary nmbroto ctdt ctriad ksctriad socnumber qsorder paac apaac asdc "
    "ac cc acc eaac egaac aaindex matrix_row zscale"
).split()


@pytest.mark.parametrize("name", BLOCKS)
def test_blocks_stay_where_the_strings_are(spark, name):
    # the only exchange spreads the single-file input over the cores
    text = plan(spark, name)
    assert text.count("Exchange") - text.count("BroadcastExchange") <= 1 and "SinglePartition" not in text
    assert "Aggregate" not in text and "NestedLoop" not in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["featurize_selected", "featurize_legacy", "ctdc", "ctdd", "physicochemical", "titration_zero"])
def test_named_features_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange") <= 1 and "Python" not in text and "Aggregate" not in text


def test_scans_read_what_is_used(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, "dpc")
    text = plan(spark, "r2")
    assert "l_tax" not in text and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["join_blocks", "dense_vectors", "all_blocks"])
def test_all_blocks_come_from_one_read(spark, name):
    text = plan(spark, name)
    assert text.count("documents.parquet") == 1 and text.count("MapInArrow") == 1
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text and "HashAggregate(keys=[ID" not in text


def test_stored_blocks_join_without_an_exchange(spark):
    text = plan(spark, "join_stored_blocks")
    assert text.count("SortMergeJoin") == 5 and "Exchange hashpartitioning(ID" not in text
    assert text.count("Bucketed: true") == 6
