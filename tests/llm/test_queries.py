"""Queries of the subpackage against their SQL."""

import os
from collections import Counter

import pytest

from nestql.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")
@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toArrow()
    want = c.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.column_names) == sorted(names)
    rows = want.fetchall()
    assert Counter(zip(*[got.column(n).to_pylist() for n in names], strict=True)) == Counter(rows)
    if name == "tool_call_statuses":
        status = {r[names.index("status")] for r in rows}
        assert status == {"ok", "cyclic", "duplicate", "unanswered", "orphan", "unknown tool nope", "$.limit: out of range", "$.query: missing"}


def test_linked_vectors_same_as_sql(spark, tmp_path):
    """Vectors with close partners, chains of them, copies, and ones that link with nothing."""
    import duckdb
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 32))
    rows = [(b + rng.standard_normal(32) * spread * (1 + i % 3)).tolist() for i, b in enumerate(base) for spread in (0, 0.02, 0.05, 0.08)]
    rows += [rows[0], rows[0], None, [], [0.0] * 32, [float("nan")] * 32, [1.0] + [None] * 31, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0]]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(7 * i % 1009, r) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = c.execute(ORACLES["op9_p_stable_embeddings"])
    names, rows = [d[0] for d in want.description], want.fetchall()
    got = QUERIES["op9_p_stable_embeddings"](spark, str(tmp_path)).toArrow()
    assert Counter(zip(*[got.column(n).to_pylist() for n in names], strict=True)) == Counter(rows)
    assert sum(r[names.index("n_links")] > 0 for r in rows) > 40
