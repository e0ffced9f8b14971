"""Every registered query with SQL against DuckDB on the smallest tables; the others against plain Python."""

import glob
import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright import catalog
from barwright.functions import signals
from barwright.operators import backtest as bt
from barwright.plans import search


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    return str(x)[:19] if hasattr(x, "isoformat") else x


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).toPandas().astype(object).itertuples(index=False)), key=repr)
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want) and len(got) > 0
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6), (a, b)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, catalog.queries()[name], catalog.oracle_sql()[name])


def test_each_query_without_sql_is_tested_below():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"votes_all_sparse", "votes_all_dense", "search_sparse_2", "search_adx_gated", "search_exhaustive_pairs", "report_top", "report_by_return", "report_lines", "report_details", "run_status", "select_ensemble", "select_newest"}


@pytest.mark.parametrize("dense", [False, True])
def test_votes_of_all_instances(spark, sf_dir, dense):
    """Sums of each instance's votes against the votes of that instance alone."""
    name = "votes_all_dense" if dense else "votes_all_sparse"
    got = {(r["symbol"], r["instance_key"]): (r["net"], r["voted"], r["bars"]) for r in catalog.queries()[name](spark, sf_dir).collect()}
    every = signals.enumerate_instances(dense=dense)
    bars = {r["symbol"]: r["n"] for r in catalog.by_type(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {(s, i.key) for s in bars for i in every}
    assert all(v[2] == bars[s] and abs(v[0]) <= v[1] <= v[2] for (s, _), v in got.items())
    for i in every[:: len(every) // 5]:
        alone = signals.with_votes(catalog.by_type(spark, sf_dir), [i]).groupBy("symbol").agg(F.sum("v0").alias("net"), F.count(F.when(F.col("v0") != 0, 1)).alias("voted"))
        assert {r["symbol"]: (int(r["net"]), r["voted"]) for r in alone.collect()} == {s: v[:2] for (s, k), v in got.items() if k == i.key}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return [r.asDict() for r in catalog.found(spark, sf_dir).collect()]


def half(row, name):
    return json.loads(row["metrics_json"])[name]


@pytest.mark.parametrize(("name", "config"), [("search_sparse_2", catalog.SPARSE_2), ("search_adx_gated", catalog.GATED), ("search_exhaustive_pairs", catalog.EXHAUSTIVE)])
def test_search_against_the_relational_backtest(spark, sf_dir, name, config):
    rows = {(r["symbol"], r["ordinal"]): r for r in catalog.queries()[name](spark, sf_dir).collect()}
    space = search.Space(config)
    assert {s for s, _ in rows} == {"click", "error", "purchase", "signup", "view"} and max(o for _, o in rows) < space.total
    bars = catalog.by_type(spark, sf_dir)
    for symbol, ordinal in sorted(rows)[:: len(rows) // 4]:
        r, spec = rows[symbol, ordinal], dict(space.specs(np.array([ordinal])))[ordinal]
        want = bt.scored(bt.split_backtest(search.spec_positions(bars.where(F.col("symbol") == symbol), spec))).first()
        assert r["signature"] == spec.signature
        assert (r["score"], r["win_rate"]) == pytest.approx((want["score"], want["win_rate"]), rel=1e-8, abs=1e-10)


def brute_top(rows, n, by, keep, dedupe):
    out = []
    for symbol in sorted({r["symbol"] for r in rows}):
        seen, taken = set(), 0
        for r in sorted((r for r in rows if r["symbol"] == symbol and keep(r)), key=lambda r: (-round(r[by], 9), r["ordinal"])):
            key = (round(r["is_sharpe"], 4), round(r["oos_sharpe"], 4), round(r["oos_return"], 6), round(r["oos_max_drawdown"], 6), r["num_trades"], round(r["win_rate"], 6))
            if (dedupe and key in seen) or taken == n:
                continue
            seen.add(key)
            taken += 1
            out.append((symbol, r["ordinal"]))
    return out


def test_reports(spark, sf_dir, found):
    for name, want in (
        ("report_top", brute_top(found, 25, "score", lambda r: r["num_trades"] >= 5, True)),
        ("report_by_return", brute_top(found, 25, "oos_return", lambda r: half(r, "oos")["trade_count"] >= 3, False)),
    ):
        assert sorted((r["symbol"], r["id"]) for r in catalog.queries()[name](spark, sf_dir).collect()) == sorted(want)
    top = brute_top(found, 15, "score", lambda r: True, True)
    assert catalog.queries()["report_lines"](spark, sf_dir).count() == len(top)
    space = search.Space(catalog.SPARSE_2)
    want = sorted((s, o, i.factory, i.category, i.key) for s, o in brute_top(found, 10, "score", lambda r: True, True) for i in dict(space.specs(np.array([o])))[o].instances)
    assert sorted(map(tuple, catalog.queries()["report_details"](spark, sf_dir).collect())) == want


def test_status_and_selection(spark, sf_dir, found):
    got = {r["symbol"]: (r["completed"], r["total_combos"]) for r in catalog.queries()["run_status"](spark, sf_dir).collect()}
    assert got == {s: (sum(r["symbol"] == s for r in found), search.count(catalog.SPARSE_2)) for s in got} and len(got) == 5
    want = brute_top(found, 3, "score", lambda r: r["num_trades"] >= 5 and half(r, "oos")["trade_count"] >= 2, True)
    live = catalog.queries()["select_ensemble"](spark, sf_dir).collect()
    assert sorted((r["symbol"], r["result_id"]) for r in live) == sorted(want) and {r["status"] for r in live} == {"active"}
    newest = catalog.queries()["select_newest"](spark, sf_dir).collect()
    assert [r["live_id"] for r in newest] == [max(r["live_id"] for r in live)]
