"""The registry covers the inventory, and a sample of queries matches its SQL on the small tables."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, table_rows

INVENTORY = {
    "s": [n for n in range(1, 18) if n != 13],
    "f": range(1, 20),
    "j": range(1, 12), "a": range(1, 43), "w": range(1, 13), "k": range(1, 10), "u": range(1, 6),
    "h": range(1, 34), "p": range(1, 9), "o": range(1, 11), "m": range(1, 20), "t": range(1, 15),
}
SAMPLE = [
    "s01_log_page", "f02_log_search", "j01_rule_match", "j08_recent_context", "a10_network_summary", "a19_secure_average",
    "a30_latency_percentiles", "w03_rate_limit", "o03_audit", "p04_rewrite", "m13_stratified_split", "h25_summary_shapes",
]


def test_every_inventory_id_has_a_query():
    have = {(m[1], int(m[2])) for m in (re.match(r"([a-z])(\d\d)_", key) for key in queries()) if m}
    assert {(g, n) for g, ns in INVENTORY.items() for n in ns} - have == set()


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
    without = sorted(set(queries()) - set(oracle_sql()))
    own = [k for k in without if re.match(r"[a-z]\d\d_", k)]
    assert all(k[0] in "mthas" for k in own) and len(own) < 20


def test_entry(spark, small_folder):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("key", SAMPLE)
def test_sample_matches_sql(spark, small_folder, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small_folder}/{t}.parquet')")
    df = queries()[key](spark, small_folder)
    cur = con.execute(oracle_sql()[key])
    assert table_rows(df.columns, df.collect()) == table_rows([d[0] for d in cur.description], cur.fetchall())
