"""Relations by a condition: lists that are made once for each value of the equalities, at every depth, against plain Python."""

import pytest

from nestql.engine import Engine
from nestql.operators import blocks
from nestql.sources.schema import Col, Edge, Entity, schema

PEOPLE = [(1, 1, 5.0), (2, 1, 7.0), (3, 1, None), (4, 2, 1.0), (5, None, 9.0), (6, None, 1.0), (7, 2, 1.0), (8, 3, 4.0)]
VISITS = [(10, 1, 2), (11, 1, 4), (12, 2, 5), (13, 2, 9), (14, 3, 1), (15, 4, 1), (16, 4, 8)]


def above(p, c, args, ctx):
    return (p["team"] == c["team"]) & (c["score"] > p["score"] + 1) & (c["id"] != p["id"])


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("blocks"))  # files: Spark knows their size
    spark.createDataFrame(PEOPLE, "id int, team int, score double").write.parquet(f"{folder}/people.parquet")
    spark.createDataFrame(VISITS, "id int, place int, person int").write.parquet(f"{folder}/visits.parquet")
    people, visits = f"{folder}/people.parquet", spark.read.parquet(f"{folder}/visits.parquet")
    person = Entity("Person", people, ["id"], {
        "id": Col(),
        "above": Edge("Person", on=above, order_by="id"),
        "fellows": Edge("Person", on=lambda p, c, args, ctx: (c["team"] == p["team"]) & (p["id"] != c["id"]), order_by=[("score", "desc"), ("id", "asc")]),
        "lower": Edge("Person", on=lambda p, c, args, ctx: c["score"] < p["score"], order_by=[("id", "desc")]),
    })
    visit = Entity("Visit", visits, ["id"], {"id": Col(), "person": Edge("Person", many=False, on=("person", "id"))})
    place = Entity("Place", visits.select("place").distinct(), ["place"], {"id": Col("place"), "visits": Edge("Visit", on=("place", "place"), order_by="id")})
    return Engine(spark, schema([person, visit, place], {"people": Edge("Person", order_by=[("id", "desc")]), "places": Edge("Place", order_by="place"), "visits": Edge("Visit"), "one": Edge("Person", many=False, where=lambda t, args, ctx, node: t["id"] == 1)}))


def listed(kind, i):
    got = {p[0]: p for p in PEOPLE}.get(i)
    if got is None:
        return None
    _, team, score = got
    if kind == "above":
        return [p[0] for p in PEOPLE if p[1] == team is not None and score is not None and p[2] is not None and p[2] > score + 1 and p[0] != i]
    if kind == "fellows":
        near = [p for p in PEOPLE if p[1] == team is not None and p[0] != i]
        return [p[0] for p in sorted(near, key=lambda p: (p[2] is None, -(p[2] or 0), p[0]))]
    return sorted((p[0] for p in PEOPLE if score is not None and p[2] is not None and p[2] < score), reverse=True)


def ids(rows):
    return [r["id"] for r in rows]


@pytest.mark.parametrize("kind", ["above", "fellows", "lower"])
def test_lists_at_the_root_and_below(engine, kind):
    rows = engine.data(f"{{ people {{ id {kind} {{ id }} }} }}")["people"]
    assert [(r["id"], ids(r[kind])) for r in rows] == [(p[0], listed(kind, p[0])) for p in reversed(PEOPLE)]
    rows = engine.data(f"{{ places {{ id visits {{ id person {{ id {kind} {{ id }} }} }} }} }}")["places"]
    want = {v[0]: v for v in VISITS}
    assert [(p["id"], ids(p["visits"])) for p in rows] == [(k, [v[0] for v in VISITS if v[1] == k]) for k in (1, 2, 3, 4)]
    for v in [v for p in rows for v in p["visits"]]:
        who = want[v["id"]][2]
        assert v["person"] is None if listed(kind, who) is None else ids(v["person"][kind]) == listed(kind, who)
    rows = engine.data(f"{{ visits {{ id person {{ {kind} {{ id }} }} }} }}")["visits"]
    assert len(rows) == len(VISITS)
    assert all((r["person"] and ids(r["person"][kind])) == listed(kind, want[r["id"]][2]) for r in rows)
    assert ids(engine.data(f"{{ one {{ {kind} {{ id }} }} }}")["one"][kind]) == listed(kind, 1)


def test_a_list_in_a_list(engine):
    rows = engine.data("{ people { id fellows { id above { id } fellows { id } } lower { id } } }")["people"]
    for r in rows:
        assert ids(r["lower"]) == listed("lower", r["id"])
        assert [(f["id"], ids(f["above"]), ids(f["fellows"])) for f in r["fellows"]] == [(i, listed("above", i), listed("fellows", i)) for i in listed("fellows", r["id"])]


def test_large_children_are_joined(engine, monkeypatch):
    text = "{ people { id fellows { id above { id } } lower { id } } }"
    want = engine.data(text)
    monkeypatch.setattr(blocks, "LISTED", 0)
    assert engine.data(text) == want
    assert "Join" in plan(engine.query(text))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_pass_no_join_and_parents_are_not_merged_into_a_few_tasks(engine, spark):
    df = engine.query("{ people { id fellows { id } } }")
    assert "Join" not in plan(df)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lists_below_a_list_pass_no_shuffle(engine):
    text = plan(engine.query("{ places { id visits { id person { id fellows { id } } } } }"))
    assert "filter(" in text.split("Exchange")[0]  # above the last shuffle only
    assert "filter(" not in "".join(x for x in text.split("Exchange")[1:] if "Subquery" not in x)


def test_tasks_that_make_lists_grow_with_the_tables(engine, monkeypatch):
    text = "{ places { id visits { id } } }"
    want = engine.data(text)
    assert "REPARTITION_BY_NUM" not in plan(engine.query(text))  # small tables are left to Spark
    size = blocks.size(engine.query("{ visits { id } }"))
    monkeypatch.setattr(blocks, "SHARE", 64)
    n = blocks.tasks(engine.query(text))
    assert n >= size // 64 > blocks.FEW
    dealt = [x for x in plan(engine.query(text)).split("\n") if "REPARTITION_BY_NUM" in x]
    assert any("hashpartitioning(_l0" in x for x in dealt) and any(f", {n}), REPARTITION_BY_NUM" in x for x in dealt if "rangepartitioning" in x)
    assert engine.data(text) == want


def test_a_size_that_is_unknown_is_left_to_spark(spark):
    assert blocks.tasks(spark.createDataFrame([(1,)] * 3, "id int")) == 0
