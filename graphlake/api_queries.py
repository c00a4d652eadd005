"""More of the engine as registered queries: result forms, ordering, text indexes, GraphQL arguments, changes, feeds, query tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.values import display_name
from .operators import fulltext
from .operators.mutate import Handled, Transaction
from .operators.nodes import NodeInfo, differing, merged, node_clone, node_compare, node_merge, sorted_nodes
from .operators.traverse import oriented
from .plans.graphql import Executor, GraphQLError, introspect, run_graphql
from .plans.planner import run_query
from .plans.syntax import Node, QueryError, parse, pretty, refine
from .session import Session
from .sources.blobs import Blobs
from .sources.graph import Edges, Graph
from .sources.json_io import read_export, read_zip, sorted_dump, write_export, write_zip
from .sources.store import shared_dir
from .streaming.feed import Feed, Subscription

Query = Callable[[Graph], DataFrame]

#: name: (query, result columns, SQL)
TEXTS: dict[str, tuple[str, list[str], str]] = {
    "where_long_arithmetic": ("get Part where retailprice + 1 + 1 + 1 + 1 + 1 + 1 > 1000 and size * 2 - 1 + 3 * size / 2 % 5 > 20 show key", ["key"], "SELECT p_partkey AS key FROM part WHERE p_retailprice + 6 > 1000 AND p_size * 2 - 1 + trunc(3 * p_size / 2)::BIGINT % 5 > 20"),
    "where_constants": ("get Nation where true and not false and not null show key", ["key"], "SELECT n_nationkey AS key FROM nation"),
    "where_null": ("get Document traverse :::Label where eattr:quality != null and attr:toxic = 1 end show 1:n:key", ["key"], "SELECT d.doc_id AS key FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND toxic = 1"),
    "where_bare_value": ("get Customer where acctbal show key", ["key"], "SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0"),
    "where_prefixes": ("get Nation where val:name = name or attr:name = NATION_3 show key", ["key"], "SELECT n_nationkey AS key FROM nation WHERE n_name = 'name' OR n_name = 'NATION_3'"),
    "where_list_mixed": ("get Part where size in [1, '2', 3.0, x] show key, size", ["key", "size"], "SELECT p_partkey AS key, p_size AS size FROM part WHERE p_size IN (1, 2, 3)"),
    "where_date_attr": ("get Order where @parseDate(orderdate, '2006-01-02 15:04:05') >= 883612800 show key", ["key"], "SELECT o_orderkey AS key FROM orders WHERE epoch(o_orderdate) >= 883612800"),
    "show_as_format": ("get Supplier show name as who format text, key", ["who", "key"], "SELECT s_name AS who, s_suppkey AS key FROM supplier"),
    "show_edge_columns": ("get Nation traverse Home:FromNation:Resident:Supplier end show 1:n:key, 2:e:key, 2:e:kind, Supplier:key", ["nation", "edge", "kind", "supplier"], "SELECT n_nationkey AS nation, 'S:' || s_suppkey AS edge, 'FromNation' AS kind, s_suppkey AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "hop_up": (
        "get Order where totalprice > 400000 traverse Purchase:Placed:Buyer:Customer where acctbal > 0 traverse Resident:FromNation:Home:Nation traverse Member:InRegion:Container:Region end end end show 1:n:key, 2:n:key, 3:n:name, 4:n:name",
        ["order", "customer", "nation", "region"],
        "SELECT o_orderkey AS \"order\", c_custkey AS customer, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 400000 AND c_acctbal > 0",
    ),
    "unique_chained": (
        "get Customer show key, nationkey, mktsegment with filtering(unique nationkey, unique mktsegment)",
        ["key", "nation", "segment"],
        "WITH a AS (SELECT arg_max(c_custkey, c_custkey::VARCHAR) AS k FROM customer GROUP BY c_nationkey) SELECT arg_max(c_custkey, c_custkey::VARCHAR) AS key, arg_max(c_nationkey, c_custkey::VARCHAR) AS nation, c_mktsegment AS segment FROM customer JOIN a ON c_custkey = k GROUP BY c_mktsegment",
    ),
    "partial_spec": ("get Nation traverse ::Container: end traverse Home::: end show 1:n:key, 2:n:key", ["nation", "region"], "SELECT n_nationkey AS nation, n_regionkey AS region FROM nation JOIN (SELECT n AS k, count(*) AS m FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY n) ON k = n_nationkey, range(0, m)"),
}


def _rows(g: Graph, rows: list[tuple], schema: str) -> DataFrame:
    return g.spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: list[str], kinds: dict[str, str] | None = None) -> str:
    """A VALUES list as SQL."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    cols = ", ".join(f"{n}::{(kinds or {})[n]} AS {n}" if n in (kinds or {}) else n for n in names)
    return f"SELECT {cols} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(names)})"


def _contacts(g: Graph) -> Graph:
    """Customers with a nested attribute."""
    c = g.nodes["Customer"]
    return g.with_(nodes=g.nodes | {"Customer": c.withColumn("contact", F.struct(F.col("mktsegment").alias("segment"), F.struct(F.col("nationkey").alias("nation")).alias("at")))})


def _ordered(text: str, names: list[str]) -> Query:
    """With the place of each row, so that order is compared too."""

    def run(g: Graph) -> DataFrame:
        out = run_query(g, text)
        rows = out.numbered()
        return rows.select(F.col("_row").alias("place"), *[F.col(f"`{c}`").alias(n) for c, n in zip(out.columns, names)])

    return run


def _header(g: Graph) -> DataFrame:
    out = run_query(g, "get Nation traverse Home:FromNation:Resident:Supplier end primary Supplier show Nation:key, 2:n:acctbal format number, 2:e:key as link, @count(1, :::Customer)")
    return _rows(g, [(i, a, b, c, out.primary, out.partition) for i, (a, b, c) in enumerate(zip(out.labels, out.formats, out.data))], "place int, label string, format string, data string, primary string, part string")


def _defaults(g: Graph) -> DataFrame:
    out = run_query(g, "get Region traverse :InRegion:: end")
    return out.frame()


def _sources(g: Graph) -> DataFrame:
    out = run_query(g, "get Nation where key < 3 traverse Home:FromNation:Resident:Supplier end show 1:n:name, 2:n:key, 2:e:key, @count(1, :::Region)").with_sources()
    return out.select(F.explode("_source").alias("source"))


def _csv(g: Graph) -> DataFrame:
    at = f"{shared_dir(g.spark)}/csv-{uuid.uuid4().hex}"
    run_query(g, "get Supplier traverse :::Nation end show 1:n:key, acctbal, Nation:name").write_csv(at)
    return g.spark.read.csv(at, header=True).toDF("key", "acctbal", "nation")


def _text_table(g: Graph) -> DataFrame:
    lines = run_query(g, "get Region show key, name").text(stable=True).splitlines()
    return _rows(g, list(enumerate(lines)), "place int, line string")


def _geography(g: Graph) -> Graph:
    return g.with_(nodes={k: g.nodes[k] for k in ("Region", "Nation")}, edges=tuple(e for e in g.edges if e.kind == "InRegion"))


def _export_import(g: Graph) -> DataFrame:
    at = f"{shared_dir(g.spark)}/export-{uuid.uuid4().hex}"
    write_export(_geography(g), at)
    return run_query(read_export(g.spark, at), "get Region traverse Container:InRegion:Member:Nation end show 1:n:name, 2:n:name, 2:e:key").frame(["region", "nation", "edge"])


def _zip(g: Graph) -> DataFrame:
    with tempfile.TemporaryDirectory() as d:
        at = str(Path(d) / "graphs.zip")
        write_zip([_geography(g)], at)
        again = read_zip(g.spark, at)["main"]
    return again.nodes["Nation"].select("key", "name")


def _dump(g: Graph) -> DataFrame:
    d = sorted_dump(_geography(g)).withColumn("place", F.monotonically_increasing_id())
    return d.select("section", "kind", "key", (F.row_number().over(_by("place")) - 1).cast("long").alias("place"))


def _by(c: str):
    from pyspark.sql import Window

    return Window.orderBy(c)


def _blobs(g: Graph) -> DataFrame:
    b, ids = Blobs.empty(g.spark).insert(b"one", b"two", b"three")
    b = b.update(ids[1], b"zwei").delete(ids[0])
    return b.df.select("id", F.hex("data").alias("data"))


def _page(g: Graph) -> DataFrame:
    return run_query(g, "get Supplier show key, acctbal with ordering(descending acctbal)").page(5, 10).toDF("key", "acctbal")


def _sorted_nodes(g: Graph) -> DataFrame:
    d = sorted_nodes(g, ["Region", "Nation"]).withColumn("p", F.monotonically_increasing_id())
    return d.select("kind", "key", (F.row_number().over(_by("p")) - 1).cast("long").alias("place"))


def _traverse_all(g: Graph) -> DataFrame:
    return oriented(g, "Nation", "3", "Home:FromNation:Resident:Supplier").select("key", "end1key", "end1kind", "end1role", "end2key", "end2kind", "end2role")


def _dangling(g: Graph) -> DataFrame:
    some = g.with_(nodes=g.nodes | {"Nation": g.nodes["Nation"].where("key < 10")})
    return run_query(some, "get Supplier traverse :::Nation end show 1:n:key, 2:n:key, 2:n:name").frame(["supplier", "nation", "name"])


def _stats(g: Graph) -> DataFrame:
    return g.stats()


def _objget(g: Graph) -> DataFrame:
    return run_query(_contacts(g), "get Customer where contact.at.nation = 3 show key, @objget(1, contact, segment), contact.at.nation").frame(["key", "segment", "nation"])


def _index_map(g: Graph) -> DataFrame:
    d = _contacts(g).nodes["Customer"].where("key < 50").select("key", "name", "contact")
    return fulltext.texts(d)


def _tokens(g: Graph) -> DataFrame:
    said = ["Hello, World-wide $5 a_b", "éà ÉTÉ… a+b=c", " ", "x\ty"]
    return _rows(g, [(i, s) for i, s in enumerate(said)], "i int, s string").select("i", F.posexplode(fulltext.word_array(F.col("s"))).alias("pos", "word")).select("i", (F.col("pos") + 1).alias("pos"), "word")


def _stored_index(g: Graph) -> fulltext.StoredIndex:
    at = f"{shared_dir(g.spark)}/index-{uuid.uuid4().hex}"
    return fulltext.StoredIndex(g.spark, at, 16).build({"Document": g.nodes["Document"].select("key", "text"), "Customer": g.nodes["Customer"].select("key", "mktsegment")})


def _index_words(g: Graph) -> DataFrame:
    return _stored_index(g).lookup_word("Document", "text", "LICENSE").select("key", F.size("positions").cast("long").alias("n"))


def _index_phrase(g: Graph) -> DataFrame:
    return _stored_index(g).lookup_phrase("Document", "text", "under the, APACHE")


def _index_maintained(g: Graph) -> DataFrame:
    index = _stored_index(g)
    index.change("Customer", _rows(g, [(1, "NEW WORDS"), (5000001, "BUILDING")], "key long, mktsegment string"), _rows(g, [("2",)], "key string"))
    index.change("Customer", _rows(g, [(3, "BUILDING")], "key long, mktsegment string"))
    index.compact()
    return index.lookup_value("Customer", "mktsegment", "building").unionByName(index.lookup_word("Customer", "mktsegment", "words").select("key"))


def _edge_search(g: Graph) -> DataFrame:
    e = g.edges[0]
    noted = g.with_(edges=(Edges("Note", e.kind1, e.role1, e.kind2, e.role2, e.df.select("key", "end1key", "end2key", F.concat(F.lit("nation number "), F.col("key").cast("string")).alias("said"))),))
    return fulltext.lookup_phrase(fulltext.edge_texts(noted, "Note"), "said", "number 7")


def _find(g: Graph) -> DataFrame:
    return fulltext.find(g, "nation_3").unionByName(fulltext.find(g, "ASIA", value=True))


def _graphql(text: str, root: str, variables: dict | None = None, operation: str = "") -> Query:
    return lambda g: Executor(g, {"operationName": operation, "query": text, "variables": variables or {}}).run()[root]


def _nested(text: str, root: str, path: str, names: dict[str, str], variables: dict | None = None) -> Query:
    """Rows of a nested list, with their place in it."""

    def run(g: Graph) -> DataFrame:
        out = _graphql(text, root, variables)(g)
        rows = out.select(*[F.col(c) for c in out.columns if c != path], F.posexplode(path).alias("place", "x"))
        return rows.select(*[F.col(c).alias(n) for n, c in names.items()])

    return run


def _graphql_errors(g: Graph) -> DataFrame:
    out = run_graphql(g, '{ Region(foo: 1, key: "1") { key key name } Nope { key } }')
    rows = [("data", str(len(out["data"]["Region"]))), ("data", str(len(out["data"]["Nope"])))] + [("error", e["message"]) for e in out["errors"]]
    for request in ({"query": "{ Region { key } }", "variables": {}}, {"operationName": "b", "query": "query a { Region { key } }", "variables": {}}, {"operationName": "", "query": '{ Region(ascending: "key", descending: "key") { key } }', "variables": {}}, {"operationName": "", "query": '{ Region(storeNode: {key: "9"}) { key } }', "variables": {}}):
        try:
            Executor(g, request).data()
        except GraphQLError as e:
            rows.append(("refused", str(e)))
    return _rows(g, rows, "what string, said string")


def _graphql_mutation(g: Graph) -> DataFrame:
    text = """mutation {
      a: Region(storeNode: {key: "90", name: "ATLANTIS"}) { key }
      b: Region(removeNode: {key: "0"}, ascending: "key") { key name }
    }"""
    return _graphql(text, "b")(g)


def _introspection(g: Graph) -> DataFrame:
    types = introspect(g)["__schema"]["types"]
    return _rows(g, [(t["name"], f["name"], f.get("spec")) for t in types for f in t["fields"] if t["name"] in ("Region", "Nation")], "kind string, field string, spec string")


def _changed(g: Graph) -> Graph:
    """Stores, updates, removals and edges in one transaction; what comes later counts."""
    t = Transaction(g)
    t.store_node({"kind": "Region", "key": "90", "name": "ATLANTIS"})
    t.store_node({"kind": "Region", "key": "1", "name": "WEST"})
    t.update_node({"kind": "Region", "key": "2", "motto": "more"})
    t.update_node({"kind": "Region", "key": "3", "name": None})
    t.store_node({"kind": "Region", "key": "91"})
    t.remove_node("Region", "91")
    t.remove_node("Region", "4")
    t.store_edge({"kind": "InRegion", "key": "e90", "end1kind": "Nation", "end1key": "7", "end1role": "Member", "end2kind": "Region", "end2key": "90", "end2role": "Container"})
    t.remove_edge("InRegion", "5")
    return t.commit()


def _store_types(g: Graph) -> DataFrame:
    """A text where numbers were makes the attribute text, and its numbers their printed form."""
    t = Transaction(g)
    t.store_node({"kind": "Supplier", "key": "s-new", "name": "New", "acctbal": "much"})
    return t.commit().nodes["Supplier"].select("key", F.col("acctbal").alias("acctbal"))


def _cascade(last: bool) -> Query:
    """Suppliers go with their nation; or, in steps, nations whose last supplier went."""

    def run(g: Graph) -> DataFrame:
        edges = []
        for e in g.edges:
            if e.kind == "FromNation" and e.kind1 == "Supplier":
                e = Edges(e.kind, e.kind1, e.role1, e.kind2, e.role2, e.df.select("key", "end1key", "end2key"), cascading=(last, not last), cascadinglast=(last, False))
                edges.append(e)
        small = g.with_(nodes={k: g.nodes[k] for k in ("Nation", "Supplier")}, edges=tuple(edges))
        t = Transaction(small)
        for k in range(0, 60 if last else 3):
            t.remove_node("Supplier" if last else "Nation", str(k))
        return sorted_nodes(t.commit())

    return run


def _rules(g: Graph) -> DataFrame:
    """A rule turns down a change, another notes what passes; a rolling transaction commits every two."""
    log: list[tuple[str, str]] = []

    def veto(name: str, item: dict, _) -> None:
        if name == "node.store" and item.get("name") == "BAD":
            raise Handled
        log.append((name, item["key"]))

    t = Transaction(g, rules=[veto], every=2)
    for key, name in (("70", "GOOD"), ("71", "BAD"), ("72", "FINE"), ("73", "LATE")):
        t.store_node({"kind": "Region", "key": key, "name": name})
    t.rollback()  # the last one, which wasn't committed yet
    stored = t.graph.nodes["Region"].where("key >= '70' AND length(key) = 2").select(F.lit("stored").alias("what"), F.col("key").cast("string").alias("key"))
    return stored.unionByName(_rows(g, log, "what string, key string"))


def _node_tools(g: Graph) -> DataFrame:
    a, b = {"key": "1", "kind": "x", "n": 1}, {"key": "1", "kind": "x", "n": 2, "m": [1]}
    c = node_clone(b)
    c["m"].append(2)
    rows = [("same", str(node_compare(a, dict(a)))), ("differ", str(node_compare(a, b))), ("some", str(node_compare(a, b, ["key", "kind"]))), ("clone", str(b["m"])), ("merge", str(node_merge(a, b)["n"]))]
    return _rows(g, rows, "what string, said string")


def _differing(g: Graph) -> DataFrame:
    now = merged(g, "Supplier", _rows(g, [(7, 1.5), (8, None)], "key long, acctbal double"))
    return differing(g.nodes["Supplier"], now)


def _node_info(g: Graph) -> DataFrame:
    info = NodeInfo(g, summary=lambda kind: ["name", "key"] if kind == "Nation" else None, display=lambda kind, attr: attr.upper() if attr == "name" else None)
    out = run_query(g, "get Nation", info)
    return out.frame()


def _subscription(g: Graph) -> DataFrame:
    """A feed in batches, one of them replayed and one that changes nothing shown; what is published, in turn."""
    said: list[dict] = []
    events: list[tuple[str, int]] = []
    feed = Feed(g.with_(nodes=g.nodes | {"Region": g.nodes["Region"].withColumn("key", F.col("key").cast("string"))}), "Region", compact=2)
    feed.subscriptions.append(Subscription({"operationName": "", "query": '{ Region(ascending: "key") { key name } }', "variables": {}}, said.append))
    feed.bridge.on("*", lambda name, batch: events.append((name, batch.count())))
    batches = [[("created", "90", "NEW")], [("updated", "1", "WEST"), ("deleted", "0", None)], [("updated", "1", "WEST")], [("deleted", "90", None)]]
    for epoch, rows in enumerate(batches):
        batch = _rows(g, rows, "op string, key string, name string")
        feed.apply(batch, epoch)
        feed.apply(batch, epoch)
    rows = [(i, "published", r["key"], r["name"], None) for i, d in enumerate(said) for r in d["data"]["Region"]]
    rows += [(i, name, None, None, n) for i, (name, n) in enumerate(events)]
    return _rows(g, rows, "turn int, what string, key string, name string, n int")


def _feed_resumed(g: Graph) -> DataFrame:
    """Structured Streaming over files, then a second feed on the same folder that goes on where the first stopped."""
    at = f"{shared_dir(g.spark)}/stream-{uuid.uuid4().hex}"
    base = g.with_(nodes=g.nodes | {"Region": g.nodes["Region"].withColumn("key", F.col("key").cast("string"))})
    schema = "op string, key string, name string"
    for k, rows in enumerate(([("created", "90", "NEW")], [("updated", "90", "NEWER"), ("deleted", "3", None)])):
        _rows(g, rows, schema).coalesce(1).write.mode("append").json(f"{at}/in")
        feed = Feed(base, "Region", f"{at}/state")
        feed.start(g.spark.readStream.schema(schema).json(f"{at}/in"), f"{at}/checkpoint").awaitTermination()
    return Feed(base, "Region", f"{at}/state").graph.nodes["Region"].select("key", "name")


_TRICKY = "get Customer where (a = 1 or not b) and -c + 2 * (3 - d) > 5 % 2 and e notin [1, 'x y', [z]] traverse :::Order where eattr:key like '^[0-9]+$' end primary Order show Customer:name as 'who is it', @count(1, :::Order, 'totalprice > 5') format number with nulltraversal(true), ordering(descending name), filtering(unique name)"


def _query_tools(g: Graph) -> DataFrame:
    tree = parse(_TRICKY)
    canonical = pretty(tree)
    again = parse(canonical)
    rows = [
        ("fixpoint", str(pretty(again) == canonical)),
        ("tree", str(again.plain() == tree.plain())),
        ("from_plain", str(pretty(Node.from_plain(tree.plain())) == canonical)),
        ("refined", refine("get Region where name != x traverse :::Nation end show 2:n:name", [("1",), ("3",), ("1",)])),
        ("display", display_name("RFC3339_value") + "|" + display_name("a.b_c")),
    ]
    return _rows(g, rows, "what string, said string")


def _refined(g: Graph) -> DataFrame:
    rows = [(str(r.key),) for r in run_query(g, "get Nation where key > 20 show key").frame().toDF("key").collect()]
    return run_query(g, refine("get Nation traverse :::Region end show 1:n:key, 2:n:name", rows)).frame(["nation", "region"])


_WRONG = [
    ("get Nope", "Unknown node kind"),
    ("get Nation where eattr:key = 1", "No edge data available at this level"),
    ("get Nation show 0:n:key", "index must be greater than 0"),
    ("get Nation show 3:n:key", "Data index out of range"),
    ("get Nation show 1:x:key", "Invalid data source"),
    ("get Nation show 1:e:key", "No edge data available at this level"),
    ("get Nation traverse a:b:c end", "Invalid traversal spec"),
    ("get Nation where @nope(1) = 1", "Unknown function"),
    ("get Nation show @nope(1, 2)", "Unknown function"),
    ("get Nation show key where key = 1", "Invalid construct"),
    ("get Nation where name like '[1'", "not a valid regex"),
    ("get Nation where name in key", "not a list"),
    ("get Nation show key with ordering(ascending foo)", "Cannot determine column"),
    ("get Nation where", "Unexpected end"),
]


def _wrong(g: Graph) -> DataFrame:
    out = []
    for text, part in _WRONG:
        try:
            run_query(g, text)
            out.append((text, "no error"))
        except QueryError as e:
            out.append((text, part if part in str(e) else str(e)))
    return _rows(g, out, "query string, said string")


def _session(g: Graph) -> DataFrame:
    """Results by id, the oldest forgotten."""
    s = Session(g, keep=2)
    for k in ("a", "b", "c"):
        s.query(f"get Region where key {'<' if k == 'a' else '>'} 1 show key", k)
    rows = []
    for k in ("a", "b", "c"):
        try:
            rows.append((k, str(s.result(k).total())))
        except ValueError as e:
            rows.append((k, str(e)))
    for k in ("a", "b", "c"):
        s.forget(k)
    return _rows(g, rows, "id string, said string")


def _selections(g: Graph) -> DataFrame:
    out = run_query(g, "get Nation show key with ordering(ascending key)")
    rows = []
    for step, what in enumerate(("all", [3, 4], "invert", [0], "none", [7])):
        out.select(what)
        rows.append(out.selected().select(F.lit(step).alias("step"), F.col(out.columns[0]).alias("key"), "_row"))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.toDF("step", "key", "place")


def _group_rows(g: Graph) -> DataFrame:
    """Rows selected join a group, others leave theirs; who is in which group then."""
    out = run_query(g, "get Customer where acctbal > 9900 show key with ordering(ascending key)")
    out.select("all")
    groups = g.nodes["group"].unionByName(_rows(g, [("rich", "rich")], "key string, name string"))
    then = out.add_to_group(g.with_(nodes=g.nodes | {"group": groups}), "rich")
    then = out.remove_from_group(then, "BUILDING")
    return out.selection_state(then).select("group", F.explode(F.arrays_zip("keys", "kinds")).alias("x")).select("group", F.col("x.keys").alias("key"), F.col("x.kinds").alias("kind"))


def _row_groups(g: Graph) -> DataFrame:
    out = run_query(g, "get Customer where acctbal > 9900 show name, key with ordering(ascending key)")
    return out.grouping(g).select(F.col("_row").alias("place"), "group")


_KINDS = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "Lineitem": "lineitem", "Event": "events", "Document": "documents", "Page": "pages", "Label": "labels", "Turn": "conversations"}
_GROUPS = "(SELECT DISTINCT p_brand AS key FROM part UNION ALL SELECT DISTINCT c_mktsegment FROM customer)"
NODE_COUNT_SQL = " UNION ALL ".join([*(f"SELECT '{k}' AS kind, count(*) AS n FROM {t}" for k, t in _KINDS.items()), "SELECT 'User', count(DISTINCT user_id) + count(DISTINCT user_id IS NULL OR NULL) FROM events", f"SELECT 'group', count(*) FROM {_GROUPS}"])
#: kind, first end's kind and role, second end's, rows
_SETS = [
    ("InRegion", "Nation", "Member", "Region", "Container", "SELECT 1 FROM nation WHERE n_regionkey IS NOT NULL"),
    ("FromNation", "Customer", "Resident", "Nation", "Home", "SELECT 1 FROM customer WHERE c_nationkey IS NOT NULL"),
    ("FromNation", "Supplier", "Resident", "Nation", "Home", "SELECT 1 FROM supplier WHERE s_nationkey IS NOT NULL"),
    ("Placed", "Customer", "Buyer", "Order", "Purchase", "SELECT 1 FROM orders WHERE o_custkey IS NOT NULL"),
    ("HasItem", "Order", "Whole", "Lineitem", "Part", "SELECT 1 FROM lineitem WHERE l_orderkey IS NOT NULL"),
    ("OfPart", "Lineitem", "Item", "Part", "Product", "SELECT 1 FROM lineitem WHERE l_partkey IS NOT NULL"),
    ("SuppliedBy", "Lineitem", "Item", "Supplier", "Source", "SELECT 1 FROM lineitem WHERE l_suppkey IS NOT NULL"),
    ("Did", "User", "Actor", "Event", "Action", "SELECT 1 FROM events WHERE user_id IS NOT NULL"),
    ("Labelled", "Document", "Subject", "Label", "Mark", "SELECT 1 FROM labels"),
    ("Replies", "Turn", "Previous", "Turn", "Next", "SELECT 1 FROM conversations a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"),
    ("Contains", "group", "group", "Part", "Member", "SELECT 1 FROM part WHERE p_brand IS NOT NULL"),
    ("Contains", "group", "group", "Customer", "Member", "SELECT 1 FROM customer WHERE c_mktsegment IS NOT NULL"),
]
EDGE_COUNT_SQL = "SELECT kind, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, (SELECT count(*) FROM ({q})) AS n" for k, _, _, _, _, q in _SETS) + ") GROUP BY kind"
_ATTRS = {
    "Region": ("region", "r_", "regionkey name"), "Nation": ("nation", "n_", "nationkey name regionkey"), "Customer": ("customer", "c_", "custkey name nationkey acctbal mktsegment"), "Supplier": ("supplier", "s_", "suppkey name nationkey acctbal"),
    "Part": ("part", "p_", "partkey name brand type size retailprice"), "Order": ("orders", "o_", "orderkey custkey orderstatus totalprice orderdate orderpriority"), "Event": ("events", "", "event_id ts user_id event_type value props"),
    "Document": ("documents", "", "doc_id text lang source n_chars"), "Page": ("pages", "", "page_id url html"), "Label": ("labels", "", "doc_id quality toxic"),
}


def _stats_sql() -> str:
    parts = [f"SELECT 'node' AS item, kind, '' AS name, n FROM ({NODE_COUNT_SQL})", f"SELECT 'edge', kind, '', n FROM ({EDGE_COUNT_SQL})"]
    for kind, (table, prefix, names) in _ATTRS.items():
        for i, a in enumerate(names.split()):
            parts.append(f"SELECT 'attribute', '{kind}', '{a if i else 'key'}', count({prefix}{a}) FROM {table}")
    line = "orderkey linenumber partkey suppkey quantity extendedprice discount tax returnflag linestatus shipdate"
    parts += [f"SELECT 'attribute', 'Lineitem', '{a}', count(l_{a}) FROM lineitem" for a in line.split()] + ["SELECT 'attribute', 'Lineitem', 'key', count(*) FROM lineitem"]
    parts += [f"SELECT 'attribute', 'Turn', '{a}', count({a}) FROM conversations" for a in "conv_id turn role text".split()] + ["SELECT 'attribute', 'Turn', 'key', count(*) FROM conversations"]
    parts += ["SELECT 'attribute', 'User', 'key', count(DISTINCT user_id) FROM events"] + [f"SELECT 'attribute', 'group', '{a}', count(key) FROM {_GROUPS}" for a in ("key", "name")]
    for k, k1, r1, k2, r2, q in _SETS:
        parts.append(f"SELECT 'spec', '{k1}', '{r1}:{k}:{r2}:{k2}', (SELECT count(*) FROM ({q}))")
        parts.append(f"SELECT 'spec', '{k2}', '{r2}:{k}:{r1}:{k1}', (SELECT count(*) FROM ({q}))")
    return " UNION ALL ".join(parts)


_SUPPLIER_TEXT = "CASE WHEN s_acctbal = trunc(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE s_acctbal::VARCHAR END"

OTHERS: dict[str, tuple[Query, str]] = {
    # sources and sinks
    "key_iterator": (lambda g: g.keys("Supplier"), "SELECT s_suppkey AS key FROM supplier"),
    "fetch_edge": (
        lambda g: g.fetch_edge("FromNation", "C:7"),
        "SELECT 'FromNation' AS kind, 'C:7' AS key, c_custkey AS end1key, 'Customer' AS end1kind, 'Resident' AS end1role, false AS end1cascading, false AS end1cascadinglast, c_nationkey AS end2key, 'Nation' AS end2kind, 'Home' AS end2role, false AS end2cascading, false AS end2cascadinglast FROM customer WHERE c_custkey = 7",
    ),
    "export_import": (_export_import, "SELECT r_name AS region, n_name AS nation, n_nationkey::VARCHAR AS edge FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "zip_round_trip": (_zip, "SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation"),
    "sorted_dump": (
        _dump,
        "SELECT section, kind, key, row_number() OVER (ORDER BY section DESC, kind, key) - 1 AS place FROM (SELECT 'nodes' AS section, 'Region' AS kind, r_regionkey::VARCHAR AS key FROM region UNION ALL SELECT 'nodes', 'Nation', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'edges', 'InRegion', n_nationkey::VARCHAR FROM nation)",
    ),
    "csv_sink": (_csv, f"SELECT s_suppkey::VARCHAR AS key, {_SUPPLIER_TEXT} AS acctbal, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "text_table": (
        _text_table,
        "SELECT 0 AS place, 'Labels: Region Key, Region Name' AS line UNION ALL SELECT 1, 'Format: auto, auto' UNION ALL SELECT 2, 'Data: 1:n:key, 1:n:name' UNION ALL SELECT (2 + row_number() OVER (ORDER BY r_regionkey::VARCHAR || r_name))::INTEGER, r_regionkey || ', ' || r_name FROM region",
    ),
    "blobs": (_blobs, "SELECT 2::BIGINT AS id, '7A776569' AS data UNION ALL SELECT 3, '7468726565'"),
    # results
    "default_columns": (_defaults, 'SELECT r_regionkey AS "Region Key", r_name AS "Region Name", n_nationkey AS "Key", \'Nation\' AS "Kind", n_name AS "Name" FROM region JOIN nation ON n_regionkey = r_regionkey'),
    "result_header": (
        _header,
        _values([(0, "Nation Key", "auto", "1:n:key", "Supplier", "main"), (1, "Acctbal", "number", "2:n:acctbal", "Supplier", "main"), (2, "link", "auto", "2:e:key", "Supplier", "main"), (3, "Count", "auto", "1:func:count()", "Supplier", "main")], ["place", "label", "format", "data", "primary", "part"]).replace("primary,", '"primary",').replace("primary, part)", '"primary", part)'),
    ),
    "result_sources": (
        _sources,
        "WITH x AS (SELECT n_nationkey AS n, s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey < 3) SELECT 'n:Nation:' || n AS source FROM x UNION ALL SELECT 'n:Supplier:' || s FROM x UNION ALL SELECT 'e:FromNation:S:' || s FROM x UNION ALL SELECT 'q:lookup Nation \"' || n || '\" traverse :::Region end show 2:n:key' FROM x",
    ),
    "order_places": (_ordered("get Supplier show key, nationkey, acctbal with ordering(ascending key, descending acctbal, ascending nationkey)", ["key", "nation", "acctbal"]), "SELECT row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) - 1 AS place, s_suppkey AS key, s_nationkey AS nation, s_acctbal AS acctbal FROM supplier"),
    "order_nulls": (
        _ordered("get Document where key < 200 traverse :::Label where toxic = 0 end show 1:n:key, 2:n:quality with nulltraversal(true), ordering(ascending 1:n:key, ascending Label:quality)", ["key", "quality"]),
        "SELECT row_number() OVER (ORDER BY quality ASC NULLS LAST, d.doc_id) - 1 AS place, d.doc_id AS key, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND toxic = 0 WHERE d.doc_id < 200",
    ),
    "order_mixed": (
        lambda g: _ordered("get Thing show value, key with ordering(ascending key, ascending value)", ["value", "key"])(g.with_(nodes={"Thing": _rows(g, [("a", "10"), ("b", "9"), ("c", "x"), ("d", None), ("e", "-1"), ("f", "A")], "key string, value string")}, edges=())),
        _values([(0, "-1", "e"), (1, "9", "b"), (2, "10", "a"), (3, None, "d"), (4, "A", "f"), (5, "x", "c")], ["place", "value", "key"], {"place": "BIGINT"}),
    ),
    "result_page": (_page, "SELECT s_suppkey AS key, s_acctbal AS acctbal FROM supplier ORDER BY s_acctbal DESC LIMIT 10 OFFSET 5"),
    "node_list": (lambda g: sorted_nodes(g, ["Customer"]).offset(100).limit(20), "SELECT 'Customer' AS kind, c_custkey::VARCHAR AS key FROM customer ORDER BY key LIMIT 20 OFFSET 100"),
    "node_sort": (_sorted_nodes, "SELECT kind, key, row_number() OVER (ORDER BY kind, key) - 1 AS place FROM (SELECT 'Region' AS kind, r_regionkey::VARCHAR AS key FROM region UNION ALL SELECT 'Nation', n_nationkey::VARCHAR FROM nation)"),
    "row_groups": (_row_groups, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_mktsegment AS \"group\" FROM customer WHERE c_acctbal > 9900"),
    "row_selections": (
        _selections,
        "SELECT s AS step, n_nationkey AS key, p AS place FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation), (VALUES (0), (1), (2), (3), (4), (5)) t(s) WHERE CASE s WHEN 0 THEN true WHEN 1 THEN p NOT IN (3, 4) WHEN 2 THEN p IN (3, 4) WHEN 3 THEN p IN (0, 3, 4) WHEN 4 THEN false ELSE p = 7 END",
    ),
    "group_selected": (_group_rows, "SELECT g AS \"group\", c_custkey::VARCHAR AS key, 'Customer' AS kind FROM (SELECT 'rich' AS g, c_custkey FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal > 9900 AND c_mktsegment <> 'BUILDING')"),
    "result_cache": (_session, "SELECT 'a' AS id, 'Unknown query result' AS said UNION ALL SELECT id, (SELECT count(*) FROM region WHERE r_regionkey > 1)::VARCHAR FROM (VALUES ('b'), ('c')) t(id)"),
    "node_info": (_node_info, 'SELECT n_name AS "NAME", n_nationkey AS "Nation Key" FROM nation'),
    # traversals, names, catalogue
    "nested_path": (lambda g: run_query(_contacts(g), "get Customer where contact.segment = BUILDING and contact.at.nation < 5 and contact.nope = null show key, contact.segment").frame(["key", "segment"]), "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5"),
    "objget": (_objget, "SELECT c_custkey AS key, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_nationkey = 3"),
    "traverse_all_data": (_traverse_all, "SELECT 'S:' || s_suppkey AS key, s_nationkey::VARCHAR AS end1key, 'Nation' AS end1kind, 'Home' AS end1role, s_suppkey::VARCHAR AS end2key, 'Supplier' AS end2kind, 'Resident' AS end2role FROM supplier WHERE s_nationkey = 3"),
    "dangling_target": (_dangling, "SELECT s_suppkey AS supplier, s_nationkey AS nation, CASE WHEN s_nationkey < 10 THEN n_name END AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey"),
    "catalogue_stats": (_stats, _stats_sql()),
    # text
    "index_map": (
        _index_map,
        "WITH c AS (SELECT c_custkey::VARCHAR AS key, * FROM customer WHERE c_custkey < 50) SELECT key, 'name' AS attr, c_name AS text FROM c UNION ALL SELECT key, 'contact.segment', c_mktsegment FROM c UNION ALL SELECT key, 'contact.at.nation', c_nationkey::VARCHAR FROM c UNION ALL SELECT key, 'contact.at', '{\"nation\":' || c_nationkey || '}' FROM c UNION ALL SELECT key, 'contact', '{\"segment\":\"' || c_mktsegment || '\",\"at\":{\"nation\":' || c_nationkey || '}}' FROM c",
    ),
    "tokenizer": (_tokens, _values([(0, 1, "hello"), (0, 2, "world"), (0, 3, "wide"), (0, 4, "$5"), (0, 5, "a_b"), (1, 1, "éà"), (1, 2, "été"), (1, 3, "a+b=c"), (3, 1, "x"), (3, 2, "y")], ["i", "pos", "word"])),
    "index_words": (_index_words, r"SELECT doc_id::VARCHAR AS key, len(list_filter(string_split_regex(lower(text), '[\s\p{Z}\p{Cc}\p{P}]+'), lambda w: w = 'license')) AS n FROM documents WHERE list_contains(string_split_regex(lower(text), '[\s\p{Z}\p{Cc}\p{P}]+'), 'license')"),
    "index_phrase": (_index_phrase, r"SELECT doc_id::VARCHAR AS key FROM documents WHERE contains(' ' || array_to_string(string_split_regex(lower(text), '[\s\p{Z}\p{Cc}\p{P}]+'), ' ') || ' ', ' under the apache ')"),
    "index_maintained": (_index_maintained, "SELECT c_custkey::VARCHAR AS key FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (1, 2, 3) UNION ALL SELECT '5000001' UNION ALL SELECT '3' UNION ALL SELECT '1'"),
    "edge_search": (_edge_search, "SELECT '7' AS key"),
    "find": (_find, "SELECT 'Nation' AS kind, n_nationkey::VARCHAR AS key FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT 'Region', r_regionkey::VARCHAR FROM region WHERE r_name = 'ASIA'"),
    # GraphQL
    "graphql_key": (_graphql('{ c: Customer(key: "7") { key who: name none: nothing kind } }', "c"), "SELECT c_custkey AS key, c_name AS who, NULL::VARCHAR AS \"none\", 'Customer' AS kind FROM customer WHERE c_custkey = 7"),
    "graphql_matches_list": (_graphql('{ Customer(matches: {mktsegment: ["BUILDING", "MACHINERY"], not_name: "00$"}) { key } }', "Customer"), "SELECT c_custkey AS key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT regexp_matches(c_name, '00$')"),
    "graphql_traverse": (
        _nested('{ Nation(key: "3") { name list: nothing(traverse: "Home:FromNation:Resident:Supplier", descending: "key", items: 3, from: 1) { key acctbal } } }', "Nation", "list", {"nation": "name", "place": "place", "key": "x.key", "acctbal": "x.acctbal"}),
        "SELECT n_name AS nation, (row_number() OVER (ORDER BY s_suppkey DESC) - 1)::INTEGER AS place, key, acctbal FROM (SELECT n_name, s_suppkey, s_suppkey AS key, s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 3 ORDER BY s_suppkey DESC LIMIT (SELECT CASE WHEN count(*) > 1 THEN 3 ELSE 3 END FROM supplier WHERE s_nationkey = 3) OFFSET (SELECT CASE WHEN count(*) > 1 THEN 1 ELSE 0 END FROM supplier WHERE s_nationkey = 3))",
    ),
    "graphql_nested_last": (
        _nested('{ Nation { key list: Supplier(ascending: "key", last: 2) { key } } }', "Nation", "list", {"nation": "key", "place": "place", "key": "x.key"}),
        "SELECT nation, (row_number() OVER (PARTITION BY nation ORDER BY key) - 1)::INTEGER AS place, key FROM (SELECT s_nationkey AS nation, s_suppkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS k FROM supplier) WHERE k <= 2",
    ),
    "graphql_last": (_graphql("{ Nation(last: 4) { key name } }", "Nation"), "SELECT n_nationkey AS key, n_name AS name FROM nation ORDER BY n_nationkey::VARCHAR DESC LIMIT 4"),
    "graphql_from_beyond": (_graphql('{ Region(ascending: "key", from: 100, items: 2) { key } }', "Region"), "SELECT r_regionkey AS key FROM region ORDER BY r_regionkey LIMIT 2"),
    "graphql_fragments": (
        _graphql("query q($deep: Boolean = true, $skip: Boolean!) { Nation(ascending: \"key\") { ...base ... on Region { wrong: name } ... @include(if: $deep) { regionkey } hidden: name @skip(if: $skip) } } fragment base on Nation { key name }", "Nation", {"skip": True}),
        "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS regionkey FROM nation",
    ),
    "graphql_operations": (_graphql('query a { x: Region { key } } query b($k: String = "2") { x: Nation(key: $k) { key } }', "x", {"k": "5"}, "b"), "SELECT n_nationkey AS key FROM nation WHERE n_nationkey = 5"),
    "graphql_errors": (
        _graphql_errors,
        _values([("data", "1"), ("data", "0"), ("error", "Unknown argument: foo"), ("error", "Field identifier key used multiple times"), ("refused", "Mandatory field 'operationName' missing from query object"), ("refused", "Operation b not found"), ("refused", "Cannot specify ascending and descending sorting"), ("refused", "Operation must be a mutation to modify data")], ["what", "said"]),
    ),
    "graphql_mutation": (_graphql_mutation, "SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region WHERE r_regionkey <> 0 UNION ALL SELECT '90', 'ATLANTIS'"),
    "graphql_introspection": (
        _introspection,
        _values([("Nation", "key", None), ("Nation", "name", None), ("Nation", "regionkey", None), ("Nation", "Customer", "Home:FromNation:Resident:Customer"), ("Nation", "Supplier", "Home:FromNation:Resident:Supplier"), ("Nation", "Region", "Member:InRegion:Container:Region"), ("Region", "key", None), ("Region", "name", None), ("Region", "Nation", "Container:InRegion:Member:Nation")], ["kind", "field", "spec"]),
    ),
    # changes
    "transaction": (
        lambda g: _changed(g).nodes["Region"].select("key", "name", "motto"),
        "SELECT r_regionkey::VARCHAR AS key, CASE r_regionkey WHEN 1 THEN 'WEST' WHEN 3 THEN NULL ELSE r_name END AS name, CASE r_regionkey WHEN 2 THEN 'more' END AS motto FROM region WHERE r_regionkey <> 4 UNION ALL SELECT '90', 'ATLANTIS', NULL",
    ),
    "transaction_edges": (
        lambda g: run_query(_changed(g), "get Region traverse :InRegion::Nation end show 1:n:key, 2:n:key, 2:e:key").frame(["region", "nation", "edge"]),
        "SELECT n_regionkey::VARCHAR AS region, n_nationkey::VARCHAR AS nation, n_nationkey::VARCHAR AS edge FROM nation WHERE n_nationkey <> 5 AND n_regionkey <> 4 UNION ALL SELECT '90', '7', 'e90'",
    ),
    "store_other_type": (_store_types, f"SELECT s_suppkey::VARCHAR AS key, {_SUPPLIER_TEXT} AS acctbal FROM supplier UNION ALL SELECT 's-new', 'much'"),
    "cascade": (_cascade(False), "SELECT 'Nation' AS kind, n_nationkey::VARCHAR AS key FROM nation WHERE n_nationkey > 2 UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey > 2"),
    "cascade_last": (
        _cascade(True),
        "SELECT 'Supplier' AS kind, s_suppkey::VARCHAR AS key FROM supplier WHERE s_suppkey >= 60 UNION ALL SELECT 'Nation', n_nationkey::VARCHAR FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey >= 60) OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    ),
    "rules_and_rolling": (_rules, _values([("stored", "70"), ("stored", "72"), ("node.store", "70"), ("node.store", "72"), ("node.store", "73")], ["what", "key"])),
    "node_tools": (_node_tools, _values([("same", "True"), ("differ", "False"), ("some", "True"), ("clone", "[1]"), ("merge", "2")], ["what", "said"])),
    "nodes_differing": (_differing, f"SELECT s_suppkey::VARCHAR AS key, 'acctbal' AS attr, {_SUPPLIER_TEXT} AS a, CASE s_suppkey WHEN 7 THEN '1.5' END AS b FROM supplier WHERE s_suppkey IN (7, 8)"),
    # feeds
    "subscription_replay": (
        _subscription,
        """WITH p AS (SELECT 0 AS turn, r_regionkey::VARCHAR AS key, r_name AS name FROM region UNION ALL SELECT 0, '90', 'NEW'
UNION ALL SELECT 1, r_regionkey::VARCHAR, CASE r_regionkey WHEN 1 THEN 'WEST' ELSE r_name END FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 1, '90', 'NEW'
UNION ALL SELECT 2, r_regionkey::VARCHAR, CASE r_regionkey WHEN 1 THEN 'WEST' ELSE r_name END FROM region WHERE r_regionkey <> 0)
SELECT turn::INTEGER AS turn, 'published' AS what, key, name, NULL::INTEGER AS n FROM p
UNION ALL SELECT t, w, NULL, NULL, n FROM (VALUES (0, 'node.created', 1), (1, 'node.deleted', 1), (2, 'node.updated', 1), (4, 'node.updated', 1), (5, 'node.deleted', 1)) x(t, w, n)
UNION ALL SELECT 3, 'edge.deleted', NULL, NULL, count(*)::INTEGER FROM nation WHERE n_regionkey = 0""",
    ),
    "feed_resumed": (_feed_resumed, "SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT '90', 'NEWER'"),
    # query tools
    "query_tools": (_query_tools, _values([("fixpoint", "True"), ("tree", "True"), ("from_plain", "True"), ("refined", "lookup Region '1', '3'\n  where name != x\n  traverse :::Nation\n  end\n  show 2:n:name"), ("display", "Rfc3339 Value|A.B C")], ["what", "said"])),
    "query_refined": (_refined, "SELECT n_nationkey AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 20"),
    "query_errors": (_wrong, _values(_WRONG, ["query", "said"])),
}
