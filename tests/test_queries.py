"""Registered engine queries against their SQL on the smallest tables (where these are present)."""

from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
#: One or two of each family; the driver compares all of them at a larger scale.
NAMES = ("filter_by_type", "combine_duplicates", "prior_belief", "digraph", "infer_activations", "infer_active_forms", "replace_activations", "filter_inconsequential_mods", "get_unreachable_mods", "ontology_closure", "expand_families", "edge_scorer_belief", "tsv_table", "query_page", "hub_neighbours", "shortest_paths")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import __spark_entry__ as entry
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(SF)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_linked_belief_of_every_assertion(spark):
    import __spark_entry__ as entry

    test_query(spark, "linked_belief_all")
    known = entry.queries()
    assert known["linked_belief_all"](spark, str(SF)).groupBy().sum("n").first()[0] == known["combine_duplicates"](spark, str(SF)).count()
