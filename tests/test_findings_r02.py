"""What the second review found: keys that start at nought or pass a million, and work that grows with the square of a common argument."""

import shutil
from pathlib import Path

import pytest
from test_queries import rows

from claimgrid.operators import concepts, paths, preassembly, transforms
from claimgrid.schema import AGENTS, EVIDENCE, STATEMENTS, Corpus

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with an order 0 of three lines, and a seventh line about part 1,200,000."""
    import duckdb

    at = tmp_path_factory.mktemp("odd")
    for f in SF.glob("*.parquet"):
        shutil.copy(f, at / f.name)
    src = f"'{SF}/lineitem.parquet'"
    (at / "lineitem.parquet").unlink()
    duckdb.connect().execute(f"copy (select * from {src} where l_orderkey > 0 union all select * exclude (n) replace (0 as l_orderkey, n as l_linenumber, n::bigint as l_suppkey) from (from {src} limit 1), (select unnest([1, 2, 3])::int as n) union all select * replace (7 as l_linenumber, 1200000 as l_partkey) from (from {src} limit 1)) to '{at}/lineitem.parquet' (format parquet)")
    return str(at)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["statement_full_hash", "complex_refinements", "expand_complexes"])
def test_odd_keys(spark, odd, name):
    import __spark_entry__ as entry
    import duckdb

    con = duckdb.connect()
    for f in Path(odd).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, odd).toPandas()
    assert rows(got) == rows(want)


def corpus(spark, stmts):
    """``stmts``: (id, type, [(ns, id), ...])."""
    st = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t, _ in stmts], STATEMENTS)
    ag = spark.createDataFrame([(i, "r", j, f"{ns}{k}", {ns: k}, None, None, None, None, None) for i, _, a in stmts for j, (ns, k) in enumerate(a)], AGENTS)
    return Corpus(st, ag, spark.createDataFrame([(i, 0, "reach", "s", None, None, None, None, None, None, None) for i, _, _ in stmts], EVIDENCE))


CLOSED = "ns string, id string, p_ns string, p_id string"


def test_common_arguments_propose_nothing(spark, monkeypatch):
    stmts = [(i, "Activation", [("HGNC", "1"), ("UP", str(i))]) for i in range(200)] + [(1000 + i, "Activation", [("FPLX", "f"), ("UP", str(i))]) for i in range(0, 200, 2)]
    met, real = [], preassembly._proposed
    monkeypatch.setattr(preassembly, "_proposed", lambda *a: (met.append(real(*a)), met[-1])[1])
    got = preassembly.refinements(corpus(spark, stmts), spark.createDataFrame([("HGNC", "1", "FPLX", "f")], CLOSED)).collect()
    assert sorted(map(tuple, got)) == [(i, 1000 + i) for i in range(0, 200, 2)]
    assert met[0].count() == 100


def test_expansions_are_counted_as_they_would_be_made(spark):
    closed = spark.createDataFrame([("HGNC", str(i), "FPLX", f) for f, n in (("a", 3), ("b", 2)) for i in range(n)], CLOSED)
    nodes = spark.createDataFrame([("HGNC", str(i), f"g{i}") for i in range(3)], "ns string, id string, name string")
    c = corpus(spark, [(1, "Complex", [("FPLX", "a"), ("FPLX", "b"), ("HGNC", "7")]), (2, "Complex", [("FPLX", "none"), ("FPLX", "a")]), (3, "Activation", [("HGNC", "1"), ("UP", "2")])])
    made = transforms.expand_families(c, closed, nodes)
    assert sorted(map(tuple, transforms.expansions(c, closed, nodes).collect())) == [(1, 6), (2, 3), (3, 1)] and made.statements.count() == 10
    want = made.statements.join(made.agents.where("idx = 0"), "stmt_id").groupBy("stmt_type", "name").count()
    assert sorted(map(tuple, transforms.expansions_by(c, closed, nodes, ["stmt_type"], 0).collect())) == sorted(map(tuple, want.collect()))


def test_costs_of_a_held_graph_are_those_of_the_rounds(spark, monkeypatch):
    e = spark.createDataFrame([(i, (i * 7 + 3) % 50, float(i % 11)) for i in range(50)] + [(i, (i * 13 + 5) % 50, float(i % 5) / 2) for i in range(50)], "u long, v long, weight double")
    starts = spark.createDataFrame([(0,), (7,), (99,)], "start long")
    for reverse in (False, True):
        held = sorted(map(tuple, paths.open_dijkstra(e, starts, reverse=reverse).collect()))
        with monkeypatch.context() as m:
            m.setattr(paths, "HELD", 0)
            assert held == sorted(map(tuple, paths.open_dijkstra(e, starts, reverse=reverse).collect()))
    with pytest.raises(Exception, match="costs still fall"):
        paths.open_dijkstra(e, starts, max_rounds=1).collect()


def test_a_check_searches_half_the_depth_from_either_end(spark, monkeypatch):
    chain = spark.createDataFrame([(f"n{i}", 0, f"n{i + 1}", 0) for i in range(9)], "u string, us int, v string, vs int")
    st = spark.createDataFrame([(1, "Activation", "n0", "n5"), (2, "Activation", "n0", "n8"), (3, "Activation", "n0", "n9"), (4, "Activation", "n0", "n0")], "stmt_id long, stmt_type string, subj string, obj string")
    depths, real = [], paths.bfs_levels
    monkeypatch.setattr(paths, "bfs_levels", lambda e, s, d, **k: (depths.append(d), real(e, s, d, **k))[1])
    got = sorted(map(tuple, paths.check_model(chain, st).collect()))
    assert got == [(1, paths.FOUND, 5), (2, paths.TOO_LONG, 8), (3, paths.NO_PATH, None), (4, paths.NO_PATH, None)] and depths == [4, 4]


def test_contradictions_meet_on_both_concepts(spark):
    n = 400
    st = spark.createDataFrame([(i, "Influence") for i in range(2 * n)], "stmt_id long, stmt_type string")
    ev = spark.createDataFrame([r for i in range(2 * n) for r in ((i, 0, "WM", "hub", 1), (i, 1, "WM", f"c{i % n}", 1 if i < n else -1))], concepts.EVENTS)
    none = spark.createDataFrame([], "ns string, id string, p_ns string, p_id string")
    edges = spark.createDataFrame([], "s_ns string, s_id string, t_ns string, t_id string, rel string")
    got = concepts.contradictions(st, ev, none, edges)
    assert sorted(map(tuple, got.collect())) == [(i, i + n) for i in range(n)]
    assert "t1" in got._jdf.queryExecution().optimizedPlan().toString()  # the second concept is in the join's key
