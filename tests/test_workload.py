"""Every catalogue query against its oracle SQL, and the entry point's contract."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from quillsql.plans import workload


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for name in workload.TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 4) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = workload.queries()[name](spark, sf_dir)
    want = oracle.sql(workload.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(want.columns, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6
    assert df.columns == ["l_returnflag", "l_linestatus", "sum_qty", "sum_price", "avg_price", "avg_disc", "n"]


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_library_does_not_import_the_training_data_operators():
    from pathlib import Path

    root = Path(workload.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


WHOLE = {
    "json_extract_many": "events", "json_arrow_ops": "events", "json_valid_type": "events", "json_mutators": "events", "json_patch": "events",
    "json_each_lateral": "events", "arith_int_div_mod": "lineitem", "win_count_distinct": "lineitem",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_reads_the_whole_table(spark, oracle, sf_dir, name):
    n = oracle.sql(f"SELECT COUNT(*) FROM {WHOLE[name]}").fetchall()[0][0]
    assert workload.queries()[name](spark, sf_dir).count() == n
    assert oracle.sql(f"SELECT COUNT(*) FROM ({workload.oracle_sql()[name]})").fetchall()[0][0] == n
