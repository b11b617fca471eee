"""Queries over whole tables and whole texts, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from quillon.plans import register, registry  # noqa: F401

SMALL = "/root/testdata/sf0.001"
#: Queries over all pairs, all nodes or all words.
WHOLE = """shingle_suggestions top3_per_parent two_hop_neighbors graph_walk_scores graph_augmented graph_export knn_l2_score vector_search_filtered
bm25_top10 bm25_minmax bm25_reasons keyword_search_filtered broad_search tfidf_true_df sparse_reference""".split()


def rows_of(names, columns, rows):
    """The rows' values in order: those that are no fractions first, which are compared exactly."""
    plain = lambda v: ("-" if v is None else str(v), 0.0) if not isinstance(v, float) else ("", v)
    rows = [[plain(r[names.index(c)]) for c in columns] for r in rows]
    return sorted(([t for t, _ in r], [x for _, x in r]) for r in rows)


@pytest.mark.parametrize("name", WHOLE)
def test_whole(spark, name):
    found = register.QUERIES[name](spark, SMALL)
    db = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    cursor = db.execute(register.ORACLES[name])
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    columns = sorted(found.columns)
    assert sorted(names) == columns
    got, want = rows_of(found.columns, columns, found.collect()), rows_of(names, columns, want)
    assert [t for t, _ in got] == [t for t, _ in want]
    assert all(abs(x - y) < 1e-8 for (_, a), (_, b) in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
