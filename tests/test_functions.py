import datetime as dt
from itertools import islice

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nestql.engine import Engine
from nestql.errors import QueryError, SchemaError
from nestql.functions import cursors, order
from nestql.functions.literals import sql_literal
from nestql.functions.names import Namespace, short
from nestql.sources.schema import Arg, Col, Edge, Entity, schema, tagged
from nestql.streaming.live import each_batch


def test_order_forms():
    assert order.spec("a", {}, None) == [("a", False)]
    assert order.spec({"a": "DESC", "b": "asc"}, {}, None) == [("a", True), ("b", False)]
    assert order.spec({"order": "desc", "key": ["a", "b"]}, {}, None) == [("a", True), ("b", True)]
    assert order.spec(lambda args, ctx: [{"column": args["c"], "direction": "desc"}], {"c": "x"}, None) == [("x", True)]
    assert order.spec(None, {}, None) == []
    for bad in ({"a": "up"}, 5, [3]):
        with pytest.raises(SchemaError):
            order.spec(bad, {}, None)


def test_cursors_read_back():
    assert cursors.read_offset(cursors.make(7)) == 7
    assert cursors.read_key(cursors.make({"a": 1, "b": None}), ["a", "b"]) == {"a": 1, "b": None}
    for bad in ("%%", cursors.make({"a": 1})):
        with pytest.raises(QueryError):
            cursors.read_offset(bad)
    with pytest.raises(QueryError):
        cursors.read_key(cursors.make({"a": 1, "c": 2}), ["a"])
    with pytest.raises(QueryError):
        cursors.read_key(cursors.make({"a": 1}), ["a", "b"])


def test_literals_round_trip(spark):
    values = [None, True, 5, -2.5, "it's \\ \"quoted\"\n", b"\x00\xff", dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 678000)]
    got = spark.sql("SELECT " + ", ".join(f"{sql_literal(v)} AS c{i}" for i, v in enumerate(values))).first()
    assert [bytes(x) if isinstance(x, bytearray) else x for x in got] == values
    assert sql_literal([1, "a"]) == "(1, 'a')"


def test_names():
    assert list(islice(short(), 28)) == [*"abcdefghijklmnopqrstuvwxyz", "aa", "ab"]
    n = Namespace()
    assert [n.name(x) for x in ("a b", "a_b", "a-b", "a_b_2", "c")] == ["a_b", "a_b_2", "a_b_3", "a_b_2_2", "c"]
    assert [Namespace(True, "p_").name("x")] == ["p_a"]


ROW = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from("ab")))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=1, max_size=9), st.sampled_from(["asc", "desc"]), st.sampled_from(["asc", "desc"]), st.integers(1, 4))
def test_pages_make_the_whole_list_both_ways(spark, rows, d1, d2, size):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a int, b string").coalesce(1)
    sort = [("a", d1), ("b", d2), ("id", "asc")]
    t = Entity("T", df, ["id"], {"id": Col()})
    e = Engine(spark, schema([t], {"all": Edge("T", order_by=sort), "page": Edge("T", sort_key=sort, connection=True, paginate=True)}))
    whole = [r["id"] for r in e.data("{ all { id } }")["all"]]
    for size_arg, cursor_arg, more, edge in (("first", "after", "hasNextPage", "endCursor"), ("last", "before", "hasPreviousPage", "startCursor")):
        seen, rest = [], ""
        while True:
            got = e.data(f"{{ page({size_arg}: {size}{rest}) {{ pageInfo {{ {more} {edge} }} edges {{ node {{ id }} }} }} }}")["page"]
            part = [x["node"]["id"] for x in got["edges"]]
            seen = seen + part if size_arg == "first" else part + seen
            if not got["pageInfo"][more]:
                break
            rest = f', {cursor_arg}: "{got["pageInfo"][edge]}"'
        assert seen == whole


def test_deep_offsets_are_sorted(spark, monkeypatch):
    from nestql.operators import compiler

    t = Entity("T", spark.range(50).withColumnRenamed("id", "n"), ["n"], {"n": Col()})
    e = Engine(spark, schema([t], {"page": Edge("T", order_by={"n": "desc"}, connection=True, paginate=True)}))
    text = f'{{ page(first: 3, after: "{cursors.make(9)}") {{ total edges {{ cursor node {{ n }} }} }} }}'
    top = e.data(text)
    monkeypatch.setattr(compiler, "DEEP", 5)
    assert e.data(text) == top and [x["node"]["n"] for x in top["page"]["edges"]] == [39, 38, 37]


def test_tables_of_all_kinds(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "id int, v string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.createOrReplaceTempView("kind_of_table")
    for table in ("kind_of_table", "(SELECT * FROM kind_of_table)", str(tmp_path / "t.parquet"), df, lambda args, ctx: ctx):
        t = Entity("T", table, ["id"], {"v": Col()}, unique=False)
        assert Engine(spark, schema([t], {"all": Edge("T")})).data("{ all { v } }", ctx="kind_of_table") == {"all": [{"v": "x"}]}
    both = tagged({"A": df, "B": spark.createDataFrame([(2,)], "id int")}, distinct=True)
    assert sorted(map(tuple, both.select("id", "$type").collect())) == [(1, "A"), (2, "B")]
    with pytest.raises(SchemaError):
        Engine(spark, schema([Entity("T", 5, ["id"], {"v": Col()})], {"all": Edge("T")})).data("{ all { v } }")


def test_wrong_schemas(spark):
    df = spark.range(1)
    t = Entity("T", df, ["id"], {"id": Col(), "sub": Edge("T"), "page": Edge("T", on=("id", "id"), paginate=True)})
    e = Engine(spark, schema([t], {"ok": Edge("T"), "sorted": Edge("T", limit=3), "joined": Edge("T", on=("id", "id")), "odd": Edge("T", strategy="magic"), "none": Edge("U")}))
    for text in ("{ ok { sub { id } } }", "{ ok { page { total } } }", "{ sorted { id } }", "{ joined { id } }", "{ odd { id } }", "{ none { id } }"):
        with pytest.raises(SchemaError):
            e.data(text)


def test_a_stream_feeds_an_entity(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema("id long").parquet(str(tmp_path / "in")), []

    def build(batch):
        return schema([Entity("T", batch, ["id"], {"id": Col()})], {"all": Edge("T", where=lambda t, args, ctx, node: t["id"] > args["over"], order_by="id", args={"over": Arg(type="Int")})})

    each_batch(stream, build, "query($n: Int) { all(over: $n) { id } }", lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "c"), {"n": 2}).awaitTermination(60)
    assert seen == [3, 4]


def test_json_and_minified_rows(spark):
    t = Entity("T", spark.createDataFrame([(1, None)], "id int, v string"), ["id"], {"id": Col(), "v": Col()})
    e = Engine(spark, schema([t], {"all": Edge("T")}))
    assert e.json("{ all { id v } }").first()["value"] == '{"id":1,"v":null}'
    assert e.flat("{ all { v } }", minify=True).columns == ["a", "b"]
    assert e.flat("{ all { v } }", prefix="x_").select(F.col("x_v")).count() == 1
