"""Every query of the core over empty tables and over tables of the worst rows."""

from __future__ import annotations

import pytest

from marginalia.plans.catalog import oracle_sql, queries

#: Reports of fixed rows: they have rows whatever the tables hold.
REPORTS = {"ag11_null_shares", "ag12_outliers", "ag13_numeric_profile", "ag15_table_sizes", "ag16_schema_check", "ag19_stage_checks", "ag27_gap", "ag28_pass_rates", "ag29_gate", "ag30_rollback", "ag31_p_values", "ag31_sensitivity", "ag40_bounds", "flt28_constraints", "prj07_two_outputs", "snk03_versions", "snk07_upsert", "snk12_insert_absent", "snk15_cascade", "src05_files", "src06_any_format", "src23_default", "ag18_anomalies", "flt25_optional", "snk06_chunks", "snk19_schema", "snk24_report", "snk25_checks", "uf15_timed_steps"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty_dir, name):
    n = queries()[name](spark, empty_dir).count()
    assert n == 0 or name in REPORTS


@pytest.mark.parametrize("name", sorted(queries()))
def test_worst_rows(spark, dirty_dir, name):
    queries()[name](spark, dirty_dir).write.format("noop").mode("overwrite").save()


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries()) and len(oracle_sql()) > 190
