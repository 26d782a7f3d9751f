"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")


@pytest.mark.parametrize("name", ["reconstruct_songs", "f_beta_rows", "f_pivot", "confusion_normalised", "iou_edges_2d", "mutual_best_match", "csv_rows", "scientific_names", "session_merge", "p3_found", "p5_found", "p5_key_quantiles"])
def test_query_equals_its_sql(spark, name):
    assert ": equal" in (said := compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])), said


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
