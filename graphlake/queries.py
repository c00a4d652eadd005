"""The engine's operators as registered queries over the star-schema tables, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api_queries
from .operators import fulltext
from .operators.results import quick_filter
from .plans.graphql import Executor
from .plans.planner import run_query
from .sources.graph import Graph
from .sources.tables import line_key, star_graph

#: name: (query, result columns, SQL)
TEXTS: dict[str, tuple[str, list[str], str]] = {
    "get_where_gt": ("get Customer where acctbal > 9000 show key, name, acctbal with ordering(descending acctbal)", ["key", "name", "acctbal"], "SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 9000"),
    "where_bool_prec": ("get Order where not orderstatus = F and totalprice < 50000 show key", ["key"], "SELECT o_orderkey AS key FROM orders WHERE NOT o_orderstatus = 'F' AND o_totalprice < 50000"),
    "where_or_noteq": ("get Order where orderpriority != '1-URGENT' and (totalprice >= 400000 or totalprice <= 2000) show key", ["key"], "SELECT o_orderkey AS key FROM orders WHERE o_orderpriority <> '1-URGENT' AND (o_totalprice >= 400000 OR o_totalprice <= 2000)"),
    "where_regex": ("get Part where name like '^(red|blue) ' show key, name", ["key", "name"], "SELECT p_partkey AS key, p_name AS name FROM part WHERE regexp_matches(p_name, '^(red|blue) ')"),
    "where_arith": ("get Part where size % 7 = 3 and size // 2 * 2 + 1 = size show key, size", ["key", "size"], "SELECT p_partkey AS key, p_size AS size FROM part WHERE p_size % 7 = 3 AND (p_size // 2) * 2 + 1 = p_size"),
    "where_div_minus": ("get Part where retailprice / 2 - 10 > 450 or -retailprice + 910 > 0 show key", ["key"], "SELECT p_partkey AS key FROM part WHERE p_retailprice / 2 - 10 > 450 OR -p_retailprice + 910 > 0"),
    "where_in": ("get Customer where mktsegment in [BUILDING, MACHINERY] show key", ["key"], "SELECT c_custkey AS key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "where_notin": ("get Customer where mktsegment notin [BUILDING, MACHINERY] show key", ["key"], "SELECT c_custkey AS key FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "where_strings": ("get Part where name contains e and name containsnot x and type endswith 'L' or name beginswith 'b' show key", ["key"], "SELECT p_partkey AS key FROM part WHERE (contains(p_name, 'e') AND NOT contains(p_name, 'x') AND suffix(p_type, 'L')) OR prefix(p_name, 'b')"),
    "where_date": ("get Region where @parseDate('2012-10-12T19:00:55+02:00') = 1350061255 show key", ["key"], "SELECT r_regionkey AS key FROM region WHERE epoch(TIMESTAMPTZ '2012-10-12 19:00:55+02:00') = 1350061255"),
    "lookup_keys": ("lookup Nation '1', '2', '2' show key, name", ["key", "name"], "SELECT n_nationkey AS key, n_name AS name FROM nation JOIN (VALUES (1), (2), (2)) k(k) ON n_nationkey = k"),
    "hop1": ("lookup Region '2' traverse Container:InRegion:Member:Nation end show Region:name, Nation:name", ["region", "nation"], "SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 2"),
    "hop3": (
        "get Region where name != ASIA traverse Container:InRegion:Member:Nation where key < 20 traverse Home:FromNation:Resident:Customer where acctbal > 0 traverse Buyer:Placed:Purchase:Order where totalprice > 100000 end end end show Region:name, Nation:name, Customer:key, Order:key, Order:totalprice",
        ["region", "nation", "customer", "order", "totalprice"],
        "SELECT r_name AS region, n_name AS nation, c_custkey AS customer, o_orderkey AS \"order\", o_totalprice AS totalprice FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name <> 'ASIA' AND n_nationkey < 20 AND c_acctbal > 0 AND o_totalprice > 100000",
    ),
    "hop_items": (
        "get Order where totalprice > 400000 traverse Whole:HasItem:Part:Lineitem where quantity > 30 traverse Item:OfPart:Product:Part end end show 1:n:key, 2:n:key, 2:n:quantity, 3:n:brand",
        ["order", "item", "quantity", "brand"],
        f"SELECT o_orderkey AS \"order\", k AS item, l_quantity AS quantity, p_brand AS brand FROM (SELECT *, {line_key()} AS k FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 400000 AND l_quantity > 30",
    ),
    "edge_attr": ("get Document traverse Subject:Labelled:Mark:Label where eattr:quality = 0 and toxic = 1 end show 1:n:key, 2:e:quality, 1:n:lang", ["key", "quality", "lang"], "SELECT d.doc_id AS key, quality, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0 AND toxic = 1"),
    "wildcard_kind": (
        "get Nation traverse :FromNation:: end show 1:n:name, 2:n:kind, 2:n:key",
        ["nation", "kind", "key"],
        "SELECT n_name AS nation, 'Customer' AS kind, c_custkey::VARCHAR AS key FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'Supplier', s_suppkey::VARCHAR FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "self_edges": ("get Turn where role = user traverse Previous:Replies:Next:Turn where role = assistant end show 1:n:key, 2:n:key", ["key", "next"], "SELECT a.conv_id || ':' || a.turn AS key, b.conv_id || ':' || b.turn AS next FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"),
    "null_traversal": (
        "get Document traverse :::Label where toxic = 1 end show 1:n:key, 2:n:quality with nulltraversal(true)",
        ["key", "quality"],
        "SELECT d.doc_id AS key, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND toxic = 1",
    ),
    "not_null": ("get Document traverse :::Label where toxic = 1 end show 1:n:key, 2:n:quality with nulltraversal(true), filtering(isnotnull 2:n:quality)", ["key", "quality"], "SELECT doc_id AS key, quality FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)"),
    "count_where": ("get Customer where @count(:Placed::Order) > 15 show key", ["key"], "SELECT o_custkey AS key FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "count_show_cond": (
        "get Customer show key, @count(1, :Placed::Order, 'totalprice > 400000') as n",
        ["key", "n"],
        "SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey",
    ),
    "count_zero": ("get Document where @count(:::Label) = 0 show key", ["key"], "SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "count_semi": ("get Document where @count(:::Label) > 0 show key", ["key"], "SELECT doc_id AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "siblings": (
        "get Nation traverse Home:FromNation:Resident:Customer end traverse Home:FromNation:Resident:Supplier end show 1:n:key, 2:n:key, 3:n:key",
        ["nation", "customer", "supplier"],
        """WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'C:' || c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer),
s AS (SELECT s_nationkey AS n, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY 'S:' || s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier),
t AS (SELECT a.n, a.m AS m1, b.m AS m2, unnest(range(0, a.m + b.m - 1)) AS p FROM (SELECT DISTINCT n, m FROM c) a JOIN (SELECT DISTINCT n, m FROM s) b ON a.n = b.n)
SELECT t.n AS nation, c.k AS customer, s.k AS supplier FROM t JOIN c ON c.n = t.n AND c.i = least(p, m1 - 1) JOIN s ON s.n = t.n AND s.i = least(greatest(p - (m1 - 1), 0), m2 - 1)""",
    ),
    "unique": ("get Part show brand with filtering(unique brand)", ["brand"], "SELECT DISTINCT p_brand AS brand FROM part"),
    "unique_count": ("get Part show brand with filtering(uniquecount brand)", ["brand"], "SELECT p_brand || ' (' || count(*) || ')' AS brand FROM part GROUP BY p_brand"),
    "from_group": ("get Part from group 'Brand#2' show key", ["key"], "SELECT p_partkey AS key FROM part WHERE p_brand = 'Brand#2'"),
    "lookup_group": ("lookup Customer '1', '2', '3', '4', '5', '6', '7', '8', '9' from group BUILDING show key", ["key"], "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey BETWEEN 1 AND 9"),
    "group_names": ("get Customer where acctbal > 9900 traverse Member:Contains:group:group end show 1:n:key, group:name", ["key", "group"], "SELECT c_custkey AS key, c_mktsegment AS \"group\" FROM customer WHERE c_acctbal > 9900"),
    "user_events": ("get User traverse Actor:Did:Action:Event where event_type = purchase and value > 100 end show 1:n:key, 2:n:key, 2:n:value", ["user", "event", "value"], "SELECT user_id AS user, event_id AS event, value FROM events WHERE event_type = 'purchase' AND value > 100"),
}


_graphs: dict[tuple[str, str], Graph] = {}


def _open(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over a folder, opened once a session: schemas are read once, rows at every query."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _graphs:
        _graphs[at] = star_graph(spark, sf_dir)
    return _graphs[at]


def _text_query(text: str, names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(_open(spark, sf_dir), text).frame(names)


def _graph(f: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_open(spark, sf_dir))


def _graphql(text: str, root: str) -> Callable[[Graph], DataFrame]:
    return lambda g: Executor(g, {"operationName": "", "query": text, "variables": {}}).run()[root]


def _nested(g: Graph) -> DataFrame:
    out = _graphql('{ Region(matches: {not_name: "^ASIA$"}) { name Nation { name customers: Customer(matches: {mktsegment: "BUILD"}) { key } } } }', "Region")(g)
    n = out.select("name", F.explode("Nation").alias("n"))
    return n.select(F.col("name").alias("region"), F.col("n.name").alias("nation"), F.explode("n.customers.key").alias("customer"))


OTHERS: dict[str, tuple[Callable[[Graph], DataFrame], str]] = {
    "text_word": (
        lambda g: fulltext.lookup_word(g.nodes["Document"], "text", "License").select("key", F.size("positions").cast("long").alias("n")),
        r"SELECT doc_id::VARCHAR AS key, len(list_filter(string_split_regex(lower(text), '[\s\p{Z}\p{Cc}\p{P}]+'), lambda w: w = 'license')) AS n FROM documents WHERE list_contains(string_split_regex(lower(text), '[\s\p{Z}\p{Cc}\p{P}]+'), 'license')",
    ),
    "text_phrase": (
        lambda g: fulltext.lookup_phrase(g.nodes["Document"], "text", "under the, APACHE"),
        r"SELECT doc_id::VARCHAR AS key FROM documents WHERE contains(' ' || array_to_string(string_split_regex(lower(text), '[\s\p{Z}\p{Cc}\p{P}]+'), ' ') || ' ', ' under the apache ')",
    ),
    "text_value": (lambda g: fulltext.lookup_value(g.nodes["Customer"], "mktsegment", "Building"), "SELECT c_custkey::VARCHAR AS key FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "text_count": (lambda g: fulltext.count_word(g.nodes["Document"], "text", "license"), r"SELECT count(*) AS n FROM documents WHERE list_contains(string_split_regex(lower(text), '[\s\p{Z}\p{Cc}\p{P}]+'), 'license')"),
    "quickfilter": (
        lambda g: quick_filter(run_query(g, "get Order show orderpriority").frame(["p"]), "p").select("value", "frequency", (F.row_number().over(Window.orderBy(F.desc("frequency"), "value")) - 1).cast("long").alias("place")),
        "SELECT o_orderpriority AS value, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS place FROM orders GROUP BY o_orderpriority",
    ),
    "node_count": (lambda g: g.node_count(), api_queries.NODE_COUNT_SQL),
    "edge_count": (lambda g: g.edge_count(), api_queries.EDGE_COUNT_SQL),
    "node_specs": (
        lambda g: g.node_specs("Nation", "3"),
        "SELECT DISTINCT 'Home:FromNation:Resident:Customer' AS spec FROM customer WHERE c_nationkey = 3 UNION ALL SELECT DISTINCT 'Home:FromNation:Resident:Supplier' FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'Member:InRegion:Container:Region' FROM nation WHERE n_nationkey = 3 AND n_regionkey IS NOT NULL",
    ),
    "fetch_node": (lambda g: g.fetch_node("Customer", "7", ["key", "name"]), "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey = 7"),
    "graphql_nested": (_nested, "SELECT r_name AS region, n_name AS nation, c_custkey AS customer FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name <> 'ASIA' AND contains(c_mktsegment, 'BUILD')"),
    "graphql_top": (_graphql('{ Nation(descending: "key", items: 5, from: 2) { key name } }', "Nation"), "SELECT n_nationkey AS key, n_name AS name FROM nation ORDER BY n_nationkey DESC LIMIT 5 OFFSET 2"),
}

TEXTS |= api_queries.TEXTS
OTHERS |= api_queries.OTHERS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _text_query(t, names) for k, (t, names, _) in TEXTS.items()} | {k: _graph(f) for k, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {k: sql for k, (_, _, sql) in TEXTS.items()} | {k: sql for k, (_, sql) in OTHERS.items()}
