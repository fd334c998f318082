"""Queries over rule predicates: names of modules, short and gapped series, against DuckDB."""

import ast
from pathlib import Path

import duckdb
import pytest

from tests.test_queries import plain
from tradeloom.plans import catalog

SOURCE = "/root/testdata/sf0.001"


def both(spark, sf, name):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ("events", "lineitem"):
        if (sf / f"{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = c.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    rows = lambda found: sorted((tuple(plain(v) for v in r) for r in found), key=str)
    return rows(catalog.QUERIES[name](spark, str(sf)).select(*names).collect()), rows(out.fetchall())


def some(tmp_path, table, where):
    duckdb.execute(f"COPY (SELECT * FROM '{SOURCE}/{table}.parquet' WHERE {where}) TO '{tmp_path}/{table}.parquet'")


def test_no_name_of_a_module_is_imported_twice():
    """`matches` had taken the letter of `rules`, so every rule was looked up in the wrong module."""
    for path in Path(catalog.__file__).parents[1].rglob("*.py"):
        tree = ast.parse(path.read_text())
        names = [a.asname or a.name for node in tree.body if isinstance(node, (ast.Import, ast.ImportFrom)) for a in node.names]
        assert sorted(names) == sorted(set(names)), path


def test_bar_rules_on_series_shorter_than_their_frames(spark, tmp_path):
    """one symbol has fewer bars than any frame, one has many."""
    some(tmp_path, "events", "user_id % 8 = 1 OR user_id % 8 = 2 AND event_id < 60")
    got, want = both(spark, tmp_path, "bar_rules")
    assert got == want and len(want) > 40


def test_context_rules_of_decisions_on_every_edge(spark, tmp_path):
    """decisions whose age, last exit and symbol lie on both sides of each rule's limit."""
    some(tmp_path, "events", "event_type = 'click'")
    got, want = both(spark, tmp_path, "context_rules")
    assert got == want and {r[1] for r in want} == {"True", "False"}


def test_daily_confirm_with_few_days(spark, tmp_path):
    """one symbol has days enough for a level, one has too few."""
    some(tmp_path, "events", "user_id % 8 = 1 OR user_id % 8 = 2 AND ts < TIMESTAMP '2024-01-04'")
    got, want = both(spark, tmp_path, "daily_confirm")
    assert got == want and {r[2] for r in want if r[0] == "S2"} == {None} and {r[2] for r in want if r[0] == "S1"} != {None}


def test_exits_from_bars_of_trades_without_bars(spark, tmp_path):
    """trades of symbols without bars, and before the bars that an ATR needs."""
    some(tmp_path, "events", "user_id % 8 < 3")
    some(tmp_path, "lineitem", "l_orderkey % 5 = 0")
    got, want = both(spark, tmp_path, "exits_from_bars")
    assert got == want and {r[3] for r in want} >= {"SL", "TL", "UNKNOWN"}


def test_prebreak_congestion_of_a_short_series(spark, tmp_path):
    """one symbol has fewer bars than the range and the ATR need."""
    some(tmp_path, "events", "user_id % 8 = 1 OR user_id % 8 = 2 AND event_id < 60")
    got, want = both(spark, tmp_path, "prebreak_congestion")
    assert got == want and {r[2] for r in want if r[0] == "S2"} == {None} != {r[2] for r in want if r[0] == "S1"}
