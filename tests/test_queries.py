"""Every registered query against its DuckDB twin, and the driver's entry points."""

import importlib

import pytest
from conftest import canonical

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck, sf_dir):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck(SQL[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Columns that carry a rule: each must take several values, or its query proves little.
VARYING = {
    "gate_status": ("status", "reasons", "categories"), "prediction_review": ("reasons",), "cluster_anchors": ("anchor_class", "notes", "verdict"), "feature_readiness": ("status", "blockers"),
    "crop_audit": ("reasons",), "upload_resolution": ("clean", "resolution_status"), "primary_view": ("view",), "hard_blockers": ("blocker",), "transform_audit": ("reasons", "shift"),
    "grouping_identity": ("regions", "blank", "unique_rows"), "training_split": ("split",), "file_pairs": ("status",), "scanned_lines": ("reason",), "either_key_context": ("matched_by",),
    "merged_proposals": ("decision", "reason"), "nation_holdout": ("status",), "candidate_screen": ("chosen",), "screen_predictions": ("out_of_fold",), "fold_features": ("by_f", "by_variance"),
}


@pytest.mark.parametrize("name", sorted(VARYING))
def test_ruled_columns_vary(name, duck):
    rows = duck(SQL[name], "/root/testdata/sf0.01")
    for column in VARYING[name]:
        assert rows[column].nunique(dropna=False) > 1, column
