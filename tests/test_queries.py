"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from tablemill.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["agg1_quality_report", "agg5_category_distribution", "agg9_group_centres", "agg17_category_summary", "cln1_clean_table",
          "cln7_sequential_iqr_filter", "out2_category_anomalies", "out5_robust_ellipse", "enc7_encoding_stats", "scf7_ean13",
          "scf12_language", "scl3_robust_scaling", "smp4_smart_sample", "smp6_numeric_drift", "src3_skip_bad_lines",
          "clu3_given_centres", "clu7_one_em_step", "clu8_core_clusters", "met1_silhouette_euclidean", "str1_encoded_stream"]


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert all(fn is not None for fn in QUERIES.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    pytest.importorskip("duckdb")
    from tablemill.catalog.check import compare

    status, _, _, note = compare(spark, FOLDER, name)
    assert status == "ok", note
