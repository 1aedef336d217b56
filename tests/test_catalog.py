"""A cross-section of the registered queries against their oracles, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles_rows import rows_of
from veilspan.plans.catalog import full_catalog

FOLDER = "/root/testdata/sf0.001"
CROSS_SECTION = ("all_spans_in_documents", "resolved_spans", "merged_spans_safe",
                 "merged_spans_parity_long", "keyed_redacted_forms", "ordinal_redacted_forms",
                 "keyed_restored_by_lookup", "vault_after_delete", "routes_by_model_then_rules",
                 "leak_check", "live_redacted_messages", "live_sessions",
                 "live_vault_after_delete", "whole_flow", "vault_second_upsert", "live_dashboard_by_route",
                 "entities_without_overlap", "requests_by_run", "rolled_up_items", "gated_by_route")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "documents", "conversations", "events", "pages"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    catalog = full_catalog()
    assert set(catalog.queries) == set(catalog.oracles)


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = duck.execute(entry.oracle_sql()[name])
    want = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(want)
    assert rows_of(df.columns, df.collect()) == rows_of(want, rel.fetchall())


def test_entry_reports_every_session_and_type(spark):
    rows = entry.entry(spark).collect()
    assert len({r.session_id for r in rows}) == 25 and sum(r.n_items for r in rows) == 1675
