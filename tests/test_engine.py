from dataclasses import replace

import pytest

from nestql.engine import Engine, from_global_id, global_id
from nestql.errors import QueryError, SchemaError
from nestql.functions import cursors
from tests.workshop import GRANTS, LABELS, MAKERS, NOTES, PRAISES, PROJECTS, WATCHES, workshop

M = {m[0]: m for m in MAKERS}
NAME = {i: f"{m[2]} {m[3]}" for i, m in M.items()}


@pytest.fixture(scope="module", params=["join", "batch"])
def engine(spark, request):
    return Engine(spark, workshop(spark, request.param))


@pytest.fixture(scope="module")
def joined(spark):
    return Engine(spark, workshop(spark))


def ids(rows):
    return [r["id"] for r in rows]


def notes_of(maker, shown=False):
    return [n[0] for n in NOTES if n[2] == maker and not (shown and n[3])]


def in_project(project):
    return sorted((n[0] for n in NOTES if n[1] == project), reverse=True)


def words(project):
    return [x[2] for x in sorted(LABELS, key=lambda x: x[3]) if x[1] == project]


def watched(maker):
    return sorted((w[1], w[2]) for w in WATCHES if w[0] == maker)


def own(maker):
    return sorted((p[0] for p in PROJECTS if p[1] == maker), reverse=True)


def test_lists_of_children(engine):
    got = engine.data("{ makers { id notes { id } } }")["makers"]
    assert [(m["id"], ids(m["notes"])) for m in got] == [(i, notes_of(i)) for i in M]


def test_lists_through_a_junction(engine):
    got = engine.data("{ makers { watching { name } } }")["makers"]
    assert [[x["name"] for x in m["watching"]] for m in got] == [[NAME[w] for w, _ in watched(i)] for i in M]


def test_values_of_the_junction(engine):
    for i in M:
        got = engine.data(f"{{ maker(id: {i}) {{ id watching {{ id level same big }} }} }}")["maker"]
        assert [tuple(x.values()) for x in got["watching"]] == [(w, v, v, v.upper()) for w, v in watched(i)]


def test_filter_and_order_of_the_junction(spark):
    batch = Engine(spark, workshop(spark, "batch")).data("{ makers { near: watching(level: NEAR) { id } back: watching(backwards: true) { id } } }")["makers"]
    assert [(ids(m["near"]), ids(m["back"])) for m in batch] == [([w for w, v in watched(i) if v == "near"], [w for w, _ in watched(i)][::-1]) for i in M]


def test_circles_and_nested_orders(engine):
    got = engine.data("{ makers { projects { notes { id } } notes(backwards: true) { id project { notes { id } } } } }")["makers"]
    where = {n[0]: n[1] for n in NOTES}
    for m, i in zip(got, M, strict=True):
        assert [ids(p["notes"]) for p in m["projects"]] == [in_project(p) for p in own(i)]
        assert [(n["id"], ids(n["project"]["notes"])) for n in m["notes"]] == [(n, in_project(where[n])) for n in notes_of(i)[::-1]]


def test_computed_fields(engine):
    got = engine.data("{ makers { __typename contact shout three projects { id noteCount } } }")["makers"]
    assert got == [{"__typename": "Maker", "contact": m[1], "shout": m[3].upper(), "three": [3, 1, 2], "projects": [{"id": p, "noteCount": len(in_project(p))} for p in own(m[0])]} for m in MAKERS]


def test_a_filter_below_decides_about_parents_in_one_query_only(spark):
    join, batch = (Engine(spark, workshop(spark, s)).data("{ makers { id notes(shown: true) { id } } }")["makers"] for s in ("join", "batch"))
    assert [(m["id"], ids(m["notes"])) for m in batch] == [(i, notes_of(i, True)) for i in M]
    assert [(m["id"], ids(m["notes"])) for m in join] == [(i, notes_of(i, True)) for i in M if notes_of(i, True)]


def test_condition_without_equality_below_a_junction(joined, spark):
    from nestql.sources.schema import Col, Edge, Entity, Junction, schema

    links, values = [(1, 3), (2, 3), (1, 2)], {1: 1, 2: 2, 3: 3}
    rows = spark.createDataFrame(list(values.items()), "id int, v int")
    down = Edge("A", on=lambda p, c, args, ctx: c["v"] < p["v"], order_by="id")
    lax = Edge("A", on=lambda p, c, args, ctx: c["v"] < p["v"], order_by="id", where=lambda t, args, ctx, node: t["v"].isNull() | (t["v"] > 1))
    a = Entity("A", rows, ["id"], {"id": Col(), "friends": Edge("A", junction=Junction(spark.createDataFrame(links, "a int, b int"), parent=("id", "a"), child=("b", "id")), order_by="id"), "below": down, "lax": lax})
    e = Engine(spark, schema([a], {"all": Edge("A", order_by="id")}))
    got = e.data("{ all { id friends { id below { id } } } }")["all"]
    assert {x["id"]: {f["id"]: ids(f["below"]) for f in x["friends"]} for x in got} == {1: {2: [1], 3: [1, 2]}, 2: {3: [1, 2]}, 3: {}}
    # 1 has no partner and the filter holds for nulls; 2 has partners, none of which passes
    assert [(x["id"], ids(x["lax"])) for x in e.data("{ all { id lax { id } } }")["all"]] == [(1, []), (3, [2])]
    got = joined.data("{ notes { id earlier { id } } }")["notes"]
    assert [(n["id"], ids(n["earlier"])) for n in got] == [(n[0], [x for x in notes_of(n[2]) if x < n[0]]) for n in NOTES]


def test_what_is_missing(joined):
    lost = next(p[0] for p in PROJECTS if p[1] == 99)
    assert joined.data(f"{{ project(id: {lost}) {{ id owner {{ id }} }} }}")["project"] == {"id": lost, "owner": None}
    assert joined.data("{ maker(id: 12345) { id } }")["maker"] is None


def test_scalar_tables_and_limits(joined):
    for p in PROJECTS:
        assert joined.data(f"{{ project(id: {p[0]}) {{ labels firstLabels }} }}")["project"] == {"labels": words(p[0]), "firstLabels": words(p[0])[:2]}


def test_composite_key(joined):
    assert len(joined.data("{ grants { round purpose } }")["grants"]) == len(set(GRANTS))


def test_several_types_in_one_list(joined):
    got = joined.data("{ makers { works { __typename id ... on Note { within praisedBy { id } } ... on Project { labels } } } }")["makers"]
    for m, i in zip(got, M, strict=True):
        want = [{"__typename": "Project", "id": p[0], "within": None, "praisedBy": None, "labels": words(p[0])} for p in PROJECTS if p[1] == i]
        want += [{"__typename": "Note", "id": n[0], "within": n[1], "praisedBy": [{"id": a} for a, b in PRAISES if b == n[0]], "labels": None} for n in NOTES if n[2] == i]
        assert m["works"] == sorted(want, key=lambda w: w["id"])


def test_limit_offset(joined):
    assert ids(joined.data("{ makers(limit: 2, offset: 1) { id } }")["makers"]) == list(M)[1:3]
    assert ids(joined.data("{ makers(offset: 4) { id } }")["makers"]) == list(M)[4:]


def test_offset_page(joined):
    text = '{ pages(first: 3, after: "%s") { total pageInfo { hasNextPage startCursor endCursor } edges { cursor node { id } } } }'
    got = joined.data(text % cursors.make(3))["pages"]
    assert got["total"] == len(M) and got["pageInfo"] == {"hasNextPage": False, "startCursor": cursors.make(4), "endCursor": cursors.make(6)}
    assert [(e["cursor"], e["node"]["id"]) for e in got["edges"]] == [(cursors.make(k), list(M)[k]) for k in (4, 5, 6)]
    past = joined.data(text % cursors.make(50))["pages"]
    assert past == {"total": 0, "pageInfo": {"hasNextPage": False, "startCursor": None, "endCursor": None}, "edges": []}


def test_keyset_pages_make_the_list(joined):
    whole = sorted(sorted(M), key=lambda i: M[i][3], reverse=True)
    seen, after = [], ""
    while True:
        got = joined.data(f"{{ keyset(first: 3{after}) {{ pageInfo {{ hasNextPage endCursor }} edges {{ node {{ id }} }} }} }}")["keyset"]
        seen += [e["node"]["id"] for e in got["edges"]]
        if not got["pageInfo"]["hasNextPage"]:
            break
        after = f', after: "{got["pageInfo"]["endCursor"]}"'
    assert seen == whole
    back = joined.data("{ keyset(last: 2) { pageInfo { hasPreviousPage } edges { node { id } } } }")["keyset"]
    assert back["pageInfo"]["hasPreviousPage"] and [e["node"]["id"] for e in back["edges"]] == whole[-2:]


def test_variables_fragments_directives(joined):
    text = "query q($id: Int!, $no: Boolean = true) { maker(id: $id) { ...F ... on Named { name } ... on Grant { nothing } id @skip(if: $no) } } fragment F on Maker { contact }"
    assert joined.data(text, {"id": 2})["maker"] == {"contact": M[2][1], "name": NAME[2]}
    with pytest.raises(QueryError):
        joined.data(text)


def test_fields_asked_for_twice(joined):
    got = joined.data("{ maker(id: 1) { projects { id } projects { noteCount } } maker(id: 1) { id } }")["maker"]
    assert got == {"projects": [{"id": p, "noteCount": len(in_project(p))} for p in own(1)], "id": 1}
    with pytest.raises(QueryError):
        joined.data("{ maker(id: 3) { notes(shown: true) { id } notes { id } } }")


def test_node(joined):
    df = joined.node("Maker", 2, "{ id projects { id } }")
    assert [r.asDict(recursive=True) for r in df.collect()] == [{"id": 2, "projects": [{"id": p} for p in own(2)], "__type__": "Maker"}]
    assert joined.node("Grant", list(GRANTS[0]), "{ purpose }").count() == 1
    assert joined.node("Maker", lambda t, args, ctx: t["mail"] == M[3][1], "{ id }").first()["id"] == 3
    assert joined.node("Maker", 999, "{ id }").count() == 0
    assert from_global_id(global_id("Maker", 5)) == ("Maker", "5")
    with pytest.raises(SchemaError):
        joined.node("Nobody", 1, "{ id }")


@pytest.mark.parametrize(
    "text",
    ["{ nobody { id } }", "{ maker { id } }", "{ makers { nothing } }", "{ makers }", "{ makers { id { x } } }", "{ pages(first: 1000) { total } }", "{ pages(last: 1) { total } }",
     '{ keyset(first: 1, before: "x") { total } }', '{ keyset(first: 1, after: "eyJub3RoaW5nIjoxfQ==") { edges { node { id } } } }', "{ makers { ...Nope } }",
     "{ makers(nothing: 1) { id } }", "{ makers { id(x: 1) } }", '{ maker(id: "1") { id } }', "query q { maker(id: $id) { id } }", "query q($id: Int!) { maker(id: $id) { id } }",
     "{ makers { ...F } } fragment F on Maker { id ...G } fragment G on Maker { ...F }", "{ makers { watching(level: UP) { id } } }", '{ pages(first: "2") { total } }'],
)
def test_wrong_queries(joined, text):
    with pytest.raises(QueryError):
        joined.data(text, {"id": "x"} if "$id: Int" in text else {})


def test_flat_rows_nest_to_the_same(joined):
    text = "{ makers { id notes(shown: true) { id } } }"
    flat = joined.flat(text)
    assert flat.columns == ["id", "notes__id"]
    assert sorted(tuple(r) for r in flat.collect()) == sorted((n[2], n[0]) for n in NOTES if not n[3])


def test_plan_reads_only_what_is_asked(joined, spark, tmp_path):
    from nestql.sources.schema import Col, Edge, Entity, schema

    spark.range(10).selectExpr("id", "id AS a", "id AS b").write.parquet(str(tmp_path / "t.parquet"))
    s = schema([Entity("T", str(tmp_path / "t.parquet"), ["id"], {"id": Col(), "a": Col(), "b": Col()})], {"ts": Edge("T", where=lambda t, args, ctx, node: t["a"] > 5)})
    plan = Engine(spark, s).query("{ ts { a } }")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<a:bigint>" in plan and "GreaterThan(a,5)" in plan


def test_repeated_junction_rows_leave_the_first_in_the_order(spark):
    from nestql.sources.schema import Col, Edge, Entity, Junction, schema

    lines = [(p, s, q, n) for p in range(20) for s in (1, 2) for n, q in enumerate((3, 9, 9, 5))]
    table = spark.createDataFrame(lines, "part int, supplier int, quantity int, line int").repartition(7, "quantity", "line")
    seller = Entity("Seller", spark.createDataFrame([(1,), (2,)], "id int"), ["id"], {"id": Col(), "quantity": Col(), "line": Col()})

    def edge(order, **more):
        j = Junction(table, parent=("id", "part"), child=("supplier", "id"), include={"quantity": Col(), "line": Col()}, key=("line",), order_by=order)
        return Edge("Seller", junction=j, **more)

    part = Entity("Part", spark.range(20).selectExpr("cast(id AS int) AS id"), ["id"], {
        "id": Col(), "most": edge([("quantity", "desc"), ("supplier", "asc")]), "least": edge([("quantity", "asc"), ("supplier", "desc")]),
        "top": edge([("quantity", "desc"), ("supplier", "asc")], limit=1), "plain": edge(None, order_by="id"),
    })
    s = schema([seller, part], {"parts": Edge("Part", order_by="id")})
    fields = "{ id quantity line }"
    got = Engine(spark, s).data(f"{{ parts {{ most {fields} least {fields} top {fields} plain {fields} }} }}")["parts"]
    for p in got:
        rows = {k: [tuple(x.values()) for x in v] for k, v in p.items()}
        assert rows == {"most": [(1, 9, 1), (2, 9, 1)], "least": [(2, 3, 0), (1, 3, 0)], "top": [(1, 9, 1)], "plain": [(1, 3, 0), (2, 3, 0)]}


def test_columns_always_fetched(spark):
    s = workshop(spark)
    maker, work = s.types["Maker"], replace(s.types["Work"], always_fetch=("by",))
    edge = maker.fields["watching"]
    edge = replace(edge, junction=replace(edge.junction, always_fetch=("level",)))
    maker = replace(maker, always_fetch=("mail", "id"), fields={**maker.fields, "watching": edge})
    s = replace(s, types={**s.types, "Maker": maker, "Work": work})
    text = "{ makers { id watching { name } works { __typename } } }"
    for m in Engine(spark, s, hidden=True).data(text)["makers"]:
        assert m["mail"] == M[m["id"]][1]
        assert m["watching"] == [{"name": NAME[w], "mail": M[w][1], "id": w, "level": level} for w, level in watched(m["id"])]
        assert all(w["by"] == m["id"] for w in m["works"])
    assert all(set(m) == {"id", "watching", "works"} for m in Engine(spark, s).data(text)["makers"])
    got = Engine(spark, s, hidden=True).node("Maker", 2, "{ name }").first().asDict()
    assert got == {"name": NAME[2], "mail": M[2][1], "id": 2, "__type__": "Maker"}


def test_strategy_hook(spark):
    text = "{ makers { id notes(shown: true) { id } } }"
    want = [(i, notes_of(i, True)) for i in M]
    got = Engine(spark, workshop(spark, "join"), strategy=lambda key, edge: "batch" if key == "notes" else edge.strategy).data(text)["makers"]
    assert [(m["id"], ids(m["notes"])) for m in got] == want
    got = Engine(spark, workshop(spark, "batch"), strategy=lambda key, edge: "join").data(text)["makers"]
    assert [(m["id"], ids(m["notes"])) for m in got] == [x for x in want if x[1]]
    with pytest.raises(SchemaError):
        Engine(spark, workshop(spark), strategy=lambda key, edge: "guess").query(text)


def test_long_names_give_a_warning(joined, recwarn):
    long = "n" * 60
    joined.flat(f"{{ makers {{ {long}: notes {{ id }} }} }}", minify=True)
    assert not recwarn.list
    with pytest.warns(UserWarning, match=f"{long}__id"):
        joined.flat(f"{{ makers {{ {long}: notes {{ id }} }} }}")
