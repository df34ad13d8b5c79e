"""Queries over the sample star schema: one for each group of operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import cursors
from .sources.schema import IGNORED, Arg, Col, Deps, Edge, Entity, Expr, Junction, Plain, Polymorphic, ScalarTable, Schema, schema, tagged

DATE = "yyyy-MM-dd"


def star(spark: SparkSession, sf_dir: str) -> Schema:
    """Entities, edges and roots over the tables of sf_dir."""

    def path(name: str) -> str:
        return f"{sf_dir}/{name}.parquet"

    def status(t, args, ctx, node):
        return t["o_orderstatus"] == args["status"] if args.get("status") is not None else None

    def segment(t, args, ctx, node):
        return t["c_mktsegment"] == args["segment"] if args.get("segment") is not None else None

    def ids(column: str):
        return lambda t, args, ctx, node: t[column].isin(list(args["ids"])) if args.get("ids") is not None else None

    orders = ("c_custkey", "o_custkey")
    by_price = [("o_totalprice", "desc"), ("o_orderkey", "asc")]
    by_date = [("o_orderdate", "desc"), ("o_orderkey", "desc")]
    supplies = Junction(
        path("lineitem"), parent=("p_partkey", "l_partkey"), child=("l_suppkey", "s_suppkey"),
        include={"quantity": Col("l_quantity"), "discounted": Expr("round({t}.l_extendedprice * (1 - {t}.l_discount), 2)")},
        key=("l_orderkey", "l_linenumber"), always_fetch=("l_linenumber",),
    )

    def supply(**more) -> Junction:
        return Junction(**{**supplies.__dict__, **more})

    region = Entity("Region", path("region"), ["r_regionkey"], {"id": Col("r_regionkey"), "name": Col("r_name"), "nations": Edge("Nation", on=("r_regionkey", "n_regionkey"), order_by="n_name")})
    nation = Entity(
        "Nation", path("nation"), ["n_nationkey"],
        {"id": Col("n_nationkey"), "name": Col("n_name"), "region": Edge("Region", many=False, on=("n_regionkey", "r_regionkey")),
         "customers": Edge("Customer", on=("n_nationkey", "c_nationkey"), order_by="c_custkey"), "suppliers": Edge("Supplier", on=("n_nationkey", "s_nationkey"), order_by="s_suppkey", strategy="batch")},
    )
    customer = Entity(
        "Customer", path("customer"), ["c_custkey"],
        {
            "id": Col("c_custkey"), "c_custkey": Col(), "name": Col("c_name"), "segment": Col("c_mktsegment"), "secret": IGNORED,
            "label": Deps(("c_name", "c_custkey"), lambda n, k: F.concat(n, F.lit("#"), k.cast("string"))),
            "shout": Expr("upper({t}.c_mktsegment)"),
            "balance": Expr(lambda t, args, ctx, node: F.round(t["c_acctbal"], 2)),
            "orderCount": Expr("(SELECT count(*) FROM nestql_orders WHERE nestql_orders.o_custkey = {t}.c_custkey)"),
            "orderKeys": Expr("(SELECT to_json(sort_array(collect_list(nestql_orders.o_orderkey))) FROM nestql_orders WHERE nestql_orders.o_custkey = {t}.c_custkey)"),
            "nation": Edge("Nation", many=False, on=("c_nationkey", "n_nationkey")),
            "nationBatch": Edge("Nation", many=False, on=("c_nationkey", "n_nationkey"), strategy="batch"),
            "orders": Edge("Order", on=orders, order_by="o_orderkey", where=status, args={"status": Arg(type="String")}),
            "ordersBatch": Edge("Order", on=orders, order_by="o_orderkey", where=status, strategy="batch", args={"status": Arg(type="String")}),
            "dearest": Edge("Order", on=orders, order_by=by_price, limit=2),
            "byPrice": Edge("Order", on=orders, order_by=by_price),
            "orderPage": Edge("Order", on=orders, order_by=by_date, connection=True, paginate=True),
            "orderKeyset": Edge("Order", on=orders, sort_key=by_date, connection=True, paginate=True),
            "orderSlice": Edge("Order", on=orders, order_by="o_orderkey", connection=True),
            "orderDefault": Edge("Order", on=orders, order_by="o_orderkey", connection=True, paginate=True, default_page_size=2, page_limit=100),
            "events": Edge("Event", on=("c_custkey", "user_id"), order_by="event_id", strategy="batch"),
            "ordersAbove": Edge("Order", on=orders, order_by="o_orderkey", where="{t}.o_totalprice > 20 * {parent}.c_acctbal", where_uses_parent=True),
            "orderPageBatch": Edge("Order", on=orders, order_by=by_date, connection=True, paginate=True, strategy="batch"),
            "orderKeysetBatch": Edge("Order", on=orders, sort_key=by_date, connection=True, paginate=True, strategy="batch"),
            "dearestBatch": Edge("Order", on=orders, order_by=by_price, limit=2, strategy="batch"),
            "richer": Edge("Customer", on=lambda p, c, args, ctx: (p["c_nationkey"] == c["c_nationkey"]) & (c["c_acctbal"] > p["c_acctbal"] + 5000), order_by="c_custkey"),
        },
        interfaces=("Named",),
    )
    order = Entity(
        "Order", path("orders"), ["o_orderkey"],
        {"id": Col("o_orderkey"), "status": Col("o_orderstatus"), "price": Col("o_totalprice"), "day": Deps(("o_orderdate",), lambda d: F.date_format(d, DATE)),
         "wealthy": Edge("Customer", many=False, on=("o_custkey", "c_custkey"), where=lambda t, args, ctx, node: t["c_acctbal"] > 5000, strategy="batch", inner=True),
         "customer": Edge("Customer", many=False, on=("o_custkey", "c_custkey")),
         "lines": Edge("Line", on=("o_orderkey", "l_orderkey"), order_by=[("l_linenumber", "asc"), ("l_partkey", "asc"), ("l_suppkey", "asc")])},
    )
    line = Entity(
        "Line", path("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        {"number": Col("l_linenumber"), "part": Col("l_partkey"), "supplier": Col("l_suppkey"), "quantity": Col("l_quantity")}, unique=False,
    )
    flags = Entity("Flag", path("lineitem"), ["l_returnflag", "l_linestatus"], {"flag": Col("l_returnflag"), "status": Col("l_linestatus")}, unique=False)
    place = Entity("Place", f"(SELECT n_nationkey, named_struct('code', n_regionkey, 'label', n_name) AS at FROM parquet.`{path('nation')}`)", ["n_nationkey"], {"id": Col("n_nationkey"), "at": Plain()})
    event = Entity("Event", path("events"), ["event_id"], {"id": Col("event_id"), "kind": Col("event_type")})
    part = Entity(
        "Part", path("part"), ["p_partkey"],
        {"id": Col("p_partkey"), "brand": Col("p_brand"), "suppliers": Edge("Supplier", junction=supplies, order_by="s_suppkey"),
         "suppliersBatch": Edge("Supplier", junction=supplies, order_by="s_suppkey", strategy="batch"),
         "bulk": Edge("Supplier", junction=supply(where=lambda j, args, ctx, node: j["l_quantity"] >= 45), order_by="s_suppkey", strategy="batch"),
         "byQuantity": Edge("Supply", junction=supply(order_by=[("l_quantity", "desc"), ("l_orderkey", "asc"), ("l_linenumber", "asc")])),
         "topSuppliers": Edge("Supplier", junction=supplies, order_by=[("s_acctbal", "desc"), ("s_suppkey", "asc")], limit=2),
         "supplierPage": Edge("Supplier", junction=supplies, order_by=[("s_acctbal", "desc"), ("s_suppkey", "asc")], connection=True, paginate=True),
         "supplierPageBatch": Edge("Supplier", junction=supplies, order_by=[("s_acctbal", "desc"), ("s_suppkey", "asc")], connection=True, paginate=True, strategy="batch"),
         "supplierKeyset": Edge("Supplier", junction=supplies, sort_key=[("s_suppkey", "desc")], connection=True, paginate=True)},
    )
    supplier = Entity(
        "Supplier", path("supplier"), ["s_suppkey"],
        {"id": Col("s_suppkey"), "name": Col("s_name"), "neighbours": Edge("Supplier", on=lambda p, c, args, ctx: (p["s_nationkey"] == c["s_nationkey"]) & (p["s_suppkey"] != c["s_suppkey"]), order_by="s_suppkey")},
        interfaces=("Named",),
    )
    parts = path("supplier")
    # an object of a junction row: the same supplier once for each line
    supply_type = Entity("Supply", parts, ["s_suppkey"], {"id": Col("s_suppkey"), "quantity": Col("l_quantity"), "discounted": Col()})

    def parties(args, ctx):
        c = spark.read.parquet(path("customer")).selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment")
        s = spark.read.parquet(path("supplier")).selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS nation", "s_acctbal AS balance")
        return tagged({"Customer": c, "Supplier": s})

    party = Polymorphic(
        "Party", parties, ["$type", "id"],
        {"Customer": {"segment": Col(), "orders": Edge("Order", on=("id", "o_custkey"), order_by="o_orderkey"), "ordersBatch": Edge("Order", on=("id", "o_custkey"), order_by="o_orderkey", strategy="batch")}, "Supplier": {"balance": Col()}},
        fields={"id": Col(), "name": Col()}, unique=True, interfaces=("Named",),
    )
    speech = ScalarTable("Role", path("conversations"), ["conv_id", "turn"], "role")
    talk = Entity("Talk", f"(SELECT DISTINCT conv_id FROM parquet.`{path('conversations')}`)", ["conv_id"], {"id": Col("conv_id"), "roles": Edge("Role", on=("conv_id", "conv_id"), order_by="turn")})
    spark.read.parquet(path("orders")).createOrReplaceTempView("nestql_orders")
    size = lambda t, args, ctx, node: None
    roots = {
        "customers": Edge("Customer", where=segment, order_by="c_custkey", args={"segment": Arg(type="String")}),
        "customersById": Edge("Customer", where=ids("c_custkey"), order_by="c_custkey", args={"ids": Arg(type=["Int"])}),
        "customer": Edge("Customer", many=False, where=lambda t, args, ctx, node: t["c_custkey"] == args["id"], args={"id": Arg(required=True, type="Int")}),
        "richest": Edge("Customer", order_by=[("c_acctbal", "desc"), ("c_custkey", "asc")], limit=lambda args, ctx: args.get("limit"), offset=lambda args, ctx: args.get("offset"), args={"limit": Arg(type="Int"), "offset": Arg(type="Int")}),
        "customerPage": Edge("Customer", order_by="c_custkey", connection=True, paginate=True, where=size, page_limit=1000),
        "customerKeyset": Edge("Customer", sort_key="c_custkey", connection=True, paginate=True),
        "orderKeyset": Edge("Order", sort_key=[("o_orderstatus", "asc"), ("o_orderdate", "desc"), ("o_orderkey", "asc")], connection=True, paginate=True),
        "ordersAll": Edge("Order", order_by="o_orderkey"),
        "nations": Edge("Nation", order_by="n_nationkey"),
        "regions": Edge("Region", order_by="r_regionkey"),
        "parts": Edge("Part", order_by="p_partkey"),
        "suppliers": Edge("Supplier", order_by="s_suppkey"),
        "parties": Edge("Party", where=lambda t, args, ctx, node: t["nation"] == args["nation"] if args.get("nation") is not None else None, args={"nation": Arg(type="Int")}),
        "talks": Edge("Talk", order_by="conv_id"),
        "flags": Edge("Flag"),
        "places": Edge("Place", order_by="n_nationkey"),
        "mine": Edge("Customer", where=lambda t, args, ctx, node: t["c_mktsegment"] == ctx["segment"], order_by="c_custkey"),
    }
    return schema([region, nation, customer, order, line, flags, place, event, part, supplier, supply_type, party, speech, talk], roots)


Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]
CATALOGUE: dict[str, Query] = {}


def _add(name: str, text: str, sql: str | None, flatten: Callable[[DataFrame], DataFrame] = lambda df: df, variables: dict | None = None, ctx: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten(Engine(spark, star(spark, sf_dir)).query(text, variables, ctx))

    run.__name__ = name
    CATALOGUE[name] = (run, sql)


def _each(*steps: str) -> Callable[[DataFrame], DataFrame]:
    """Unnest step by step: "orders outer" or "orders" explodes that array and opens its structs; "pos x" keeps places."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            column, *how = step.split()
            place = "pos" in how
            f = (F.posexplode_outer if place else F.explode_outer) if "outer" in how else (F.posexplode if place else F.explode)
            rest = [c for c in df.columns if c != column]
            df = df.select(*rest, f(column).alias(*(["pos", "_x"] if place else ["_x"])))
            kept = [*rest, *(["pos"] if place else [])]
            fields = df.schema["_x"].dataType
            opened = [F.col(f"_x.{n}").alias(f"{column}_{n}") for n in fields.names] if hasattr(fields, "names") else [F.col("_x").alias(column)]
            df = df.select(*kept, *opened)
        return df

    return run


def _open(column: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != column]
        return then(df.select(*rest, *[F.col(f"{column}.{n}").alias(f"{column}_{n}") for n in df.schema[column].dataType.names]))

    return run


def _then(*fs: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for f in fs:
            df = f(df)
        return df

    return run


_add("scan_filter", '{ customers(segment: "BUILDING") { id name } }', "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("column_rename", "{ suppliers { id name } }", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
_add("deps_resolver", "{ customers { label } }", "SELECT c_name || '#' || c_custkey AS label FROM customer")
_add("sql_expr_upper", "{ customers { id shout balance } }", "SELECT c_custkey AS id, upper(c_mktsegment) AS shout, round(c_acctbal, 2) AS balance FROM customer")
_add("list_arg_in", "{ customersById(ids: [1, 5, 7]) { id } }", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (1, 5, 7)")
_add("variables", "query q($s: String = \"MACHINERY\", $no: Boolean!) { customers(segment: $s) { id name @skip(if: $no) segment } }", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'MACHINERY'", variables={"no": True})
_add("context_where", "{ mine { id } }", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'FURNITURE'", ctx={"segment": "FURNITURE"})
_add("fragment_spread", "{ customers { ...F ... on Named { name } ... on Supplier { nope } ... { segment } } } fragment F on Customer { id label }", "SELECT c_custkey AS id, c_name || '#' || c_custkey AS label, c_name AS name, c_mktsegment AS segment FROM customer")
_add("typename_introspection", "{ nations { __typename id } }", "SELECT 'Nation' AS __typename, n_nationkey AS id FROM nation")
_add("ignored_field", "{ customers { id secret } }", "SELECT c_custkey AS id FROM customer")
_add(
    "alias_two_args", '{ customers { id done: ordersBatch(status: "F") { id } open: ordersBatch(status: "O") { id } } }',
    "SELECT c_custkey AS id, CAST(count(o_orderkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS done, CAST(count(o_orderkey) FILTER (o_orderstatus = 'O') AS BIGINT) AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    lambda df: df.select("id", F.size("done").cast("long").alias("done"), F.size("open").cast("long").alias("open")),
)
_add("dup_field_merge", "{ nations { region { id } region { name } id } }", "SELECT n_nationkey AS id, r_regionkey AS region_id, r_name AS region_name FROM nation JOIN region ON r_regionkey = n_regionkey", _open("region"))
_add("join_one_many", "{ customers { id orders { id price } } }", "SELECT c_custkey AS id, o_orderkey AS orders_id, o_totalprice AS orders_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey", _each("orders outer"))
_add("join_many_one", "{ ordersAll { id customer { name nation { name region { name } } } } }",
     "SELECT o_orderkey AS id, c_name AS customer, n_name AS nation, r_name AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
     lambda df: df.select("id", F.col("customer.name").alias("customer"), F.col("customer.nation.name").alias("nation"), F.col("customer.nation.region.name").alias("region")))
_add("join_three_level", "{ customers { id orders { id lines { number part supplier quantity } } } }",
     "SELECT c_custkey AS id, o_orderkey AS orders_id, l_linenumber AS number, l_partkey AS part, l_suppkey AS supplier, any_value(l_quantity) AS quantity FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
     lambda df: _each("orders outer", "orders_lines outer")(df).withColumnsRenamed({f"orders_lines_{c}": c for c in ("number", "part", "supplier", "quantity")}))
_add("join_theta_range", "{ customers { id richer { id } } }", "SELECT p.c_custkey AS id, c.c_custkey AS richer_id FROM customer p LEFT JOIN customer c ON p.c_nationkey = c.c_nationkey AND c.c_acctbal > p.c_acctbal + 5000", _each("richer outer"))
_add("join_self", "{ suppliers { id neighbours { id } } }", "SELECT p.s_suppkey AS id, c.s_suppkey AS neighbours_id FROM supplier p LEFT JOIN supplier c ON p.s_nationkey = c.s_nationkey AND p.s_suppkey <> c.s_suppkey", _each("neighbours outer"))
_MANY = "SELECT DISTINCT p_partkey AS id, s_suppkey AS {0}_id FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey"
_add("join_many_many", "{ parts { id suppliers { id } } }", _MANY.format("suppliers"), _each("suppliers outer"))
_add("batch_many_many", "{ parts { id suppliersBatch { id } } }", _MANY.format("suppliersBatch"), _each("suppliersBatch outer"))
_add("junction_where", "{ parts { id bulk { id } } }", "SELECT DISTINCT p_partkey AS id, l_suppkey AS bulk_id FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 45", _each("bulk outer"))
_add("junction_include", "{ parts { id byQuantity { id quantity } } }",
     "SELECT l_partkey AS id, s_suppkey AS supplier, min(l_quantity) <= max(l_quantity) AS known FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2",
     lambda df: _each("byQuantity")(df).select("id", F.col("byQuantity_id").alias("supplier"), F.col("byQuantity_quantity").isNotNull().alias("known")))
_FIRST = "SELECT l_partkey AS id, s_suppkey, l_quantity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, s_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM part)"
_add("junction_order", "{ parts { id byQuantity { id quantity } } }",
     f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY l_quantity DESC, l_orderkey, l_linenumber, s_suppkey) - 1 AS INTEGER) AS pos, s_suppkey AS supplier, l_quantity AS quantity FROM ({_FIRST}) WHERE r = 1",
     lambda df: _each("byQuantity pos")(df).withColumnsRenamed({"byQuantity_id": "supplier", "byQuantity_quantity": "quantity"}))
_add("where_outer_join", '{ customers { id orders(status: "P") { id } } }', "SELECT c_custkey AS id, o_orderkey AS orders_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'", _each("orders outer"))
_add("where_batch", '{ customers { id ordersBatch(status: "P") { id } } }', "SELECT c_custkey AS id, o_orderkey AS ordersBatch_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'", _each("ordersBatch outer"))
_add("batch_one_many", "{ customers { id events { id kind } } }", "SELECT c_custkey AS id, event_id AS events_id, event_type AS events_kind FROM customer LEFT JOIN events ON user_id = c_custkey", _each("events outer"))
_add("batch_to_one", "{ customers { id nationBatch { name } } }", "SELECT c_custkey AS id, n_name AS nationBatch_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", _open("nationBatch"))
_add("sibling_lists", "{ customers { id orders { id } events { id } } }",
     "SELECT c_custkey AS id, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS orders, CAST((SELECT count(*) FROM events WHERE user_id = c_custkey) AS BIGINT) AS events FROM customer",
     lambda df: df.select("id", F.size("orders").cast("long").alias("orders"), F.size("events").cast("long").alias("events")))
_add("correlated_count", "{ customers { id orderCount } }", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orderCount FROM customer")
_add("child_json_agg", "{ customers { id orderKeys } }", "SELECT c_custkey AS id, (SELECT '[' || string_agg(o_orderkey, ',' ORDER BY o_orderkey) || ']' FROM orders WHERE o_custkey = c_custkey) AS orderKeys FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", lambda df: df.filter("orderKeys <> '[]'"))
_RANK = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
_add("order_nested", "{ customers { id byPrice { id } } }", f"SELECT o_custkey AS id, CAST({_RANK} - 1 AS INTEGER) AS pos, o_orderkey AS byPrice_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", _each("byPrice pos"))
_add("limit_root", "{ richest(limit: 5) { id } }", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
_add("limit_offset_root", "{ richest(limit: 5, offset: 3) { id } }", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 3")
_add("limit_per_parent", "{ customers { id dearest { id } } }", f"SELECT * FROM (SELECT o_custkey AS id, CAST({_RANK} - 1 AS INTEGER) AS pos, o_orderkey AS dearest_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE pos < 2", _each("dearest pos"))
_PAIRS = "(SELECT DISTINCT l_partkey, s_suppkey, s_acctbal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM part))"
_SUPPLIERS = f"SELECT l_partkey AS id, s_suppkey, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY l_partkey) AS n FROM {_PAIRS}"
_add("limit_many_many", "{ parts { id topSuppliers { id } } }", f"SELECT id, pos, s_suppkey AS topSuppliers_id FROM ({_SUPPLIERS}) WHERE pos < 2", _each("topSuppliers pos"))


def _edges(field: str | None, *more: str) -> Callable[[DataFrame], DataFrame]:
    """edges { cursor node { id } } of a connection, one a row."""

    def run(df: DataFrame) -> DataFrame:
        c = (lambda n: F.col(n)) if field is None else (lambda n: F.col(f"{field}.{n}"))
        rest = [] if field is None else ["id"]
        df = df.select(*rest, *[c(m).alias(m.replace(".", "_")) for m in more], F.posexplode(c("edges")).alias("pos", "e"))
        cursor = ["e.cursor"] if "cursor" in df.schema["e"].dataType.names else []
        return df.select(*rest, *[m.replace(".", "_") for m in more], "pos", *cursor, F.col("e.node.id").alias("node"))

    return run


_OFFSET = "to_base64(encode('arrayconnection:' || (pos + {0})))"
_add("page_offset_root", f'{{ customerPage(first: 3, after: "{cursors.make(1)}") {{ total pageInfo {{ hasNextPage hasPreviousPage startCursor endCursor }} edges {{ cursor node {{ id }} }} }} }}',
     f"SELECT (SELECT count(*) FROM customer) AS total, true AS pageInfo_hasNextPage, false AS pageInfo_hasPreviousPage, to_base64(encode('arrayconnection:2')) AS pageInfo_startCursor, to_base64(encode('arrayconnection:4')) AS pageInfo_endCursor, CAST(pos - 2 AS INTEGER) AS pos, {_OFFSET.format(0)} AS cursor, id AS node FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) WHERE pos BETWEEN 2 AND 4",
     _edges(None, "total", "pageInfo.hasNextPage", "pageInfo.hasPreviousPage", "pageInfo.startCursor", "pageInfo.endCursor"))
_DATED = "SELECT o_custkey AS id, o_orderkey AS node, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"
_add("page_offset_nested", f'{{ customers {{ id orderPage(first: 2, after: "{cursors.make(0)}") {{ total pageInfo {{ hasNextPage }} edges {{ cursor node {{ id }} }} }} }} }}',
     f"SELECT id, n AS total, n > 3 AS pageInfo_hasNextPage, CAST(pos - 1 AS INTEGER) AS pos, {_OFFSET.format(0)} AS cursor, node FROM ({_DATED}) WHERE pos BETWEEN 1 AND 2", _edges("orderPage", "total", "pageInfo.hasNextPage"))
_add("page_offset_many_many", "{ parts { id supplierPage(first: 2) { total edges { node { id } } } } }", f"SELECT id, n AS total, pos, s_suppkey AS node FROM ({_SUPPLIERS}) WHERE pos < 2", _edges("supplierPage", "total"))
_add("page_offset_batch", f'{{ customers {{ id orderPageBatch(first: 2, after: "{cursors.make(0)}") {{ total pageInfo {{ hasNextPage }} edges {{ cursor node {{ id }} }} }} }} }}',
     f"SELECT id, n AS total, n > 3 AS pageInfo_hasNextPage, CAST(pos - 1 AS INTEGER) AS pos, {_OFFSET.format(0)} AS cursor, node FROM ({_DATED}) WHERE pos BETWEEN 1 AND 2", _edges("orderPageBatch", "total", "pageInfo.hasNextPage"))
_add("page_offset_many_many_batch", "{ parts { id supplierPageBatch(first: 2) { total edges { node { id } } } } }", f"SELECT id, n AS total, pos, s_suppkey AS node FROM ({_SUPPLIERS}) WHERE pos < 2", _edges("supplierPageBatch", "total"))
_add("page_keyset_batch", "{ customers { id orderKeysetBatch(last: 2) { pageInfo { hasPreviousPage } edges { node { id } } } } }",
     f"SELECT id, n > 2 AS pageInfo_hasPreviousPage, CAST(pos - greatest(n - 2, 0) AS INTEGER) AS pos, node FROM ({_DATED}) WHERE pos >= n - 2", _edges("orderKeysetBatch", "pageInfo.hasPreviousPage"))
_add("limit_per_parent_batch", "{ customers { id dearestBatch { id } } }", f"SELECT * FROM (SELECT o_custkey AS id, CAST({_RANK} - 1 AS INTEGER) AS pos, o_orderkey AS dearestBatch_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE pos < 2", _each("dearestBatch pos"))
_add("where_uses_parent", "{ customers { id ordersAbove { id } } }", "SELECT c_custkey AS id, o_orderkey AS ordersAbove_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 20 * c_acctbal", _each("ordersAbove outer"))
_add("theta_under_junction", "{ parts { id suppliersBatch { id neighbours { id } } } }",
     "SELECT m.id, m.supplier, c.s_suppkey AS neighbour FROM (SELECT DISTINCT p_partkey AS id, s_suppkey AS supplier, s_nationkey AS nation FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey) m LEFT JOIN supplier c ON c.s_nationkey = m.nation AND c.s_suppkey <> m.supplier",
     lambda df: _each("suppliersBatch outer", "suppliersBatch_neighbours outer")(df).withColumnsRenamed({"suppliersBatch_id": "supplier", "suppliersBatch_neighbours_id": "neighbour"}))
_add("batch_to_one_inner", "{ ordersAll { id wealthy { name } } }", "SELECT o_orderkey AS id, c_name AS wealthy_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000", _open("wealthy"))
_add("union_typed_relation_batch", "{ parties(nation: 3) { __typename id ... on Customer { ordersBatch { id } } } }",
     "SELECT 'Customer' AS __typename, c_custkey AS id, o_orderkey AS ordersBatch_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 UNION ALL SELECT 'Supplier', s_suppkey, NULL FROM supplier WHERE s_nationkey = 3", _each("ordersBatch outer"))
_add("plain_object", "{ places { id at { label } } }", "SELECT n_nationkey AS id, n_name AS at_label FROM nation", _open("at"))
_add("page_past_end", f'{{ customerPage(first: 3, after: "{cursors.make(10**9)}") {{ total pageInfo {{ hasNextPage startCursor }} edges {{ node {{ id }} }} }} }}', "SELECT CAST(0 AS BIGINT) AS total, false AS more, CAST(NULL AS VARCHAR) AS first, CAST(0 AS INTEGER) AS n",
     lambda df: df.select("total", F.col("pageInfo.hasNextPage").alias("more"), F.col("pageInfo.startCursor").alias("first"), F.size("edges").alias("n")))
_add("page_keyset_root", f'{{ customerKeyset(first: 3, after: "{cursors.make({"c_custkey": 4})}") {{ pageInfo {{ hasNextPage }} edges {{ cursor node {{ id }} }} }} }}',
     "SELECT true AS pageInfo_hasNextPage, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS pos, to_base64(encode('{\"c_custkey\":' || id || '}')) AS cursor, id AS node FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey > 4 ORDER BY 1 LIMIT 3)", _edges(None, "pageInfo.hasNextPage"))
_add("page_keyset_compound", f'{{ orderKeyset(first: 7, after: "{cursors.make({"o_orderstatus": "F", "o_orderdate": "1996-06-01T00:00:00.000Z", "o_orderkey": 100})}") {{ edges {{ node {{ id }} }} }} }}',
     "SELECT CAST(row_number() OVER (ORDER BY o_orderstatus, o_orderdate DESC, o_orderkey) - 1 AS INTEGER) AS pos, o_orderkey AS node FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND (o_orderdate < TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey > 100))) ORDER BY o_orderstatus, o_orderdate DESC, o_orderkey LIMIT 7", _edges(None))
_add("page_keyset_backward", f'{{ customerKeyset(last: 3, before: "{cursors.make({"c_custkey": 40})}") {{ pageInfo {{ hasNextPage hasPreviousPage }} edges {{ node {{ id }} }} }} }}',
     "SELECT false AS pageInfo_hasNextPage, true AS pageInfo_hasPreviousPage, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS pos, id AS node FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey < 40 ORDER BY 1 DESC LIMIT 3)", _edges(None, "pageInfo.hasNextPage", "pageInfo.hasPreviousPage"))
_add("page_keyset_nested", "{ customers { id orderKeyset(first: 2) { pageInfo { hasNextPage } edges { cursor node { id } } } } }",
     f"SELECT id, n > 2 AS pageInfo_hasNextPage, CAST(pos AS INTEGER) AS pos, to_base64(encode('{{\"o_orderdate\":\"' || strftime(d, '%Y-%m-%dT%H:%M:%S.%g') || 'Z\",\"o_orderkey\":' || node || '}}')) AS cursor, node FROM ({_DATED}) WHERE pos < 2", _edges("orderKeyset", "pageInfo.hasNextPage"))
_add("page_keyset_many_many", f'{{ parts {{ id supplierKeyset(first: 2, after: "{cursors.make({"s_suppkey": 50})}") {{ edges {{ node {{ id }} }} }} }} }}',
     f"SELECT * FROM (SELECT l_partkey AS id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY s_suppkey DESC) - 1 AS INTEGER) AS pos, s_suppkey AS node FROM {_PAIRS} WHERE s_suppkey < 50) WHERE pos < 2", _edges("supplierKeyset"))
_add("app_layer_page", f'{{ customers {{ id orderSlice(first: 2, after: "{cursors.make(0)}") {{ total pageInfo {{ hasNextPage }} edges {{ cursor node {{ id }} }} }} }} }}',
     f"SELECT id, n AS total, n > 3 AS pageInfo_hasNextPage, CAST(pos - 1 AS INTEGER) AS pos, {_OFFSET.format(0)} AS cursor, node FROM (SELECT o_custkey AS id, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE pos BETWEEN 1 AND 2",
     _edges("orderSlice", "total", "pageInfo.hasNextPage"))
_add("default_page_size", "{ customers { id orderDefault { edges { node { id } } } } }", "SELECT * FROM (SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, o_orderkey AS node FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE pos < 2", _edges("orderDefault"))
_add("union_type", "{ parties { __typename id ... on Customer { segment } ... on Supplier { balance } } }", "SELECT 'Customer' AS __typename, c_custkey AS id, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT 'Supplier', s_suppkey, NULL, s_acctbal FROM supplier")
_add("union_typed_relation", "{ parties(nation: 3) { __typename id ... on Customer { orders { id } } } }",
     "SELECT 'Customer' AS __typename, c_custkey AS id, o_orderkey AS orders_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 UNION ALL SELECT 'Supplier', s_suppkey, NULL FROM supplier WHERE s_nationkey = 3", _each("orders outer"))
_add("interface_common", "{ parties { ... on Named { name } id } }", "SELECT c_name AS name, c_custkey AS id FROM customer UNION ALL SELECT s_name, s_suppkey FROM supplier")
_add("scalar_table", "{ talks { id roles } }", "SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role AS roles FROM conversations", _each("roles pos"))
_add("composite_key_dedup", "{ flags { flag status } }", "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem")
_add("derived_table_roots", "{ regions { id nations { id customers { id } suppliers { id } } } }",
     "SELECT r_regionkey AS id, n_nationkey AS nation, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS customers, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey",
     lambda df: _each("nations")(df).select("id", F.col("nations_id").alias("nation"), F.size("nations_customers").cast("long").alias("customers"), F.size("nations_suppliers").cast("long").alias("suppliers")))


def _special(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CATALOGUE[name] = (f, sql)
        return f

    return add


@_special("node_lookup", "SELECT c_custkey AS id, c_name AS name, 'Customer' AS __type__, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS orders FROM customer WHERE c_custkey = 7")
def _node(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(spark, star(spark, sf_dir)).node("Customer", 7, "{ id name orders { id } }")
    return df.withColumn("orders", F.size("orders").cast("long"))


@_special("node_composite", "SELECT DISTINCT l_orderkey AS o, l_linenumber AS number, 'Line' AS __type__ FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey, l_linenumber) = (SELECT (l_orderkey, l_partkey, l_suppkey, l_linenumber) FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 1)")
def _node_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    first = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys).orderBy(*keys).first()
    return Engine(spark, star(spark, sf_dir)).node("Line", list(first), "{ number }").select(F.lit(first[0]).cast("long").alias("o"), "number", "__type__")


@_special("node_missing", "SELECT c_custkey AS id, 'Customer' AS __type__ FROM customer WHERE c_custkey = -1")
def _node_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, star(spark, sf_dir)).node("Customer", -1, "{ id }")


@_special("connection_json", "SELECT '{\"total\":' || (SELECT count(*) FROM region) || ',\"edges\":[{\"node\":{\"id\":0}},{\"node\":{\"id\":1}}]}' AS value")
def _connection_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    roots = {**s.roots, "regionPage": Edge("Region", order_by="r_regionkey", connection=True, paginate=True)}
    return Engine(spark, Schema(s.types, roots)).json("{ regionPage(first: 2) { total edges { node { id } } } }")


@_special("flat_rows", "SELECT c_custkey, c_custkey AS id, o_orderkey AS orders__o_orderkey, o_orderkey AS orders__id, o_totalprice AS orders__price FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, star(spark, sf_dir)).flat('{ customers(segment: "BUILDING") { id orders { id price } } }')


@_special(
    "junction_always_fetch",
    f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY l_quantity DESC, l_orderkey, l_linenumber, s_suppkey) - 1 AS INTEGER) AS pos, s_suppkey AS supplier, l_linenumber AS line FROM ({_FIRST}) WHERE r = 1",
)
def _junction_always_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(spark, star(spark, sf_dir), hidden=True).query("{ parts { id byQuantity { id } } }")
    return _each("byQuantity pos")(df).withColumnsRenamed({"byQuantity_id": "supplier", "byQuantity_l_linenumber": "line"})


@_special("strategy_hook", "SELECT c_custkey AS id, o_orderkey AS orders_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'")
def _strategy_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, star(spark, sf_dir), strategy=lambda key, edge: "batch" if edge.many else edge.strategy)
    return _each("orders outer")(engine.query('{ customers { id orders(status: "F") { id } } }'))
