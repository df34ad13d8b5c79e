"""A generated workshop, for the engine's tests: makers run projects, write notes, watch and praise each other.

Expectations are computed from these rows in plain Python, never written down.
"""

import random

from pyspark.sql import functions as F

from nestql.sources.schema import Arg, Col, Constant, Deps, Edge, Entity, Expr, Junction, Polymorphic, ScalarTable, schema, tagged

_RNG = random.Random(20)
MAKERS = [(i, f"m{i}@workshop.test", _RNG.choice(["Ola", "Kim", "Sam"]), f"Nr{_RNG.randrange(5)}") for i in range(1, 8)]
PROJECTS = [(10 + i, _RNG.choice([1, 2, 3, 99]), _RNG.random() < 0.4) for i in range(9)]  # owner 99 isn't there
NOTES = [(100 + i, _RNG.choice(PROJECTS)[0], _RNG.randrange(1, 6), _RNG.random() < 0.3) for i in range(30)]
WATCHES = sorted({(a, b, _RNG.choice(["near", "far"])) for a, b in [(_RNG.randrange(1, 8), _RNG.randrange(1, 8)) for _ in range(14)] if a != b and a != 7})
WATCHES = [w for i, w in enumerate(WATCHES) if w[:2] not in [x[:2] for x in WATCHES[:i]]]
PRAISES = sorted({(_RNG.randrange(1, 8), _RNG.choice(NOTES)[0]) for _ in range(25)})
GRANTS = [(_RNG.randrange(2), _RNG.choice("xy"), _RNG.choice("pq")) for _ in range(14)]
LABELS = [(1000 + i, _RNG.choice(PROJECTS[:5])[0], f"w{_RNG.randrange(9)}", i) for i in range(18)]


def frames(spark):
    make = spark.createDataFrame
    return {
        "makers": make(MAKERS, "id int, mail string, given string, family string"),
        "projects": make(PROJECTS, "id int, owner int, closed boolean"),
        "notes": make(NOTES, "id int, project int, writer int, hidden boolean"),
        "watches": make(WATCHES, "watcher int, watched int, level string"),
        "praises": make(PRAISES, "maker int, note int"),
        "grants": make(GRANTS, "round int, giver string, purpose string"),
        "labels": make(LABELS, "id int, project int, word string, place int"),
    }


def workshop(spark, strategy="join"):
    t = frames(spark)
    t["notes"].createOrReplaceTempView("workshop_notes")
    flag, text = Arg(type="Boolean"), Arg(type="String")

    def shown(t, args, ctx, node):
        return ~t["hidden"] if args.get("shown") else None

    watching = Junction(
        t["watches"], parent=("id", "watcher"), child=("watched", "id"),
        where=lambda j, args, ctx, node: j["level"] == args["level"] if args.get("level") else None,
        order_by=lambda args, ctx: {"watched": "desc"} if args.get("backwards") else None,
        include={"level": Col(), "same": Expr(lambda j, args, ctx, node: j["level"]), "big": Deps(("level",), F.upper)},
    )
    praised = Junction(t["praises"], parent=("id", "note"), child=("maker", "id"))
    maker = Entity("Maker", t["makers"], ["id"], {
        "id": Col(), "contact": Col("mail"), "name": Deps(("given", "family"), lambda a, b: F.concat_ws(" ", a, b)), "shout": Expr("upper({t}.family)"),
        "three": Constant(lambda args, ctx: F.array(F.lit(3), F.lit(1), F.lit(2))),
        "notes": Edge("Note", on=("id", "writer"), where=shown, order_by=lambda args, ctx: {"id": "desc" if args.get("backwards") else "asc"}, strategy=strategy, args={"shown": flag, "backwards": flag}),
        "projects": Edge("Project", on=("id", "owner"), order_by={"id": "desc"}, strategy=strategy),
        "watching": Edge("Maker", junction=watching, order_by=lambda args, ctx: None if args.get("backwards") else "id", args={"level": Arg(enum={"NEAR": "near", "FAR": "far"}), "backwards": flag}, strategy=strategy),
        "works": Edge("Work", on=("id", "by"), order_by="id", strategy=strategy),
    }, interfaces=("Named",))
    note = Entity("Note", t["notes"], ["id"], {
        "id": Col(), "hidden": Col(), "writer": Edge("Maker", many=False, on=("writer", "id"), strategy=strategy), "project": Edge("Project", many=False, on=("project", "id"), strategy=strategy),
        "praisedBy": Edge("Maker", junction=praised, order_by="id", strategy=strategy),
        "earlier": Edge("Note", on=lambda p, c, args, ctx: (p["writer"] == c["writer"]) & (c["id"] < p["id"]), order_by="id"),
    })
    project = Entity("Project", t["projects"], ["id"], {
        "id": Col(), "owner": Edge("Maker", many=False, on=("owner", "id"), strategy=strategy),
        "notes": Edge("Note", on=("id", "project"), where=shown, order_by={"id": "desc"}, strategy=strategy, args={"shown": flag}),
        "noteCount": Expr("(SELECT count(*) FROM workshop_notes n WHERE n.project = {t}.id)"),
        "labels": Edge("Label", on=("id", "project"), order_by="place"), "firstLabels": Edge("Label", on=("id", "project"), order_by="place", limit=2),
    })
    label = ScalarTable("Label", t["labels"], ["id"], "word")
    grant = Entity("Grant", t["grants"], ["round", "giver", "purpose"], {"purpose": Col(), "round": Col()}, unique=False)
    work = tagged({"Note": t["notes"].selectExpr("id", "writer AS by", "project"), "Project": t["projects"].selectExpr("id", "owner AS by")})
    works = Polymorphic("Work", work, ["$type", "id"], {"Note": {"within": Col("project"), "praisedBy": Edge("Maker", junction=praised, order_by="id")}, "Project": {"labels": Edge("Label", on=("id", "project"), order_by="place")}}, fields={"id": Col()}, unique=True)
    by_id = {"where": lambda t, args, ctx, node: t["id"] == args["id"], "args": {"id": Arg(required=True, type="Int")}}
    return schema([maker, note, project, label, grant, works], {
        "makers": Edge("Maker", order_by="id", limit=lambda args, ctx: args.get("limit"), offset=lambda args, ctx: args.get("offset"), args={"limit": Arg(type="Int"), "offset": Arg(type="Int"), "tag": text}),
        "maker": Edge("Maker", many=False, **by_id), "project": Edge("Project", many=False, **by_id), "notes": Edge("Note", order_by="id"),
        "pages": Edge("Maker", order_by="id", connection=True, paginate=True, page_limit=100), "keyset": Edge("Maker", sort_key=[("family", "desc"), ("id", "asc")], connection=True, paginate=True),
        "grants": Edge("Grant"),
    })
