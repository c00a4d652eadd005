"""The star-schema tables as a graph: rows are nodes, foreign keys are edges read from the owning table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Edges, Graph

_PREFIX = {"Region": "r_", "Nation": "n_", "Customer": "c_", "Supplier": "s_", "Part": "p_", "Order": "o_"}
_KEYS = {"Region": "r_regionkey", "Nation": "n_nationkey", "Customer": "c_custkey", "Supplier": "s_suppkey", "Part": "p_partkey", "Order": "o_orderkey"}
_TABLE = {"Order": "orders"}
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _nodes(df: DataFrame, key: str, prefix: str = "") -> DataFrame:
    return df.select(F.col(key).alias("key"), *[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns if c != key])


def line_key() -> str:
    """A line is known by its values, and by a number, in the order of dates, among lines that are the same in all of them.

    Conditions on any of these columns thus pass the numbering, which sorts only the rows that are left.
    """
    return f"concat_ws(':', {', '.join(_LINE)}, row_number() over (partition by {', '.join(_LINE)} order by l_shipdate))"


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    tables = {k: read(_TABLE.get(k, k.lower())) for k in _KEYS}
    nodes = {k: _nodes(t, _KEYS[k], _PREFIX[k]) for k, t in tables.items()}
    line = read("lineitem")
    line = line.selectExpr(f"{line_key()} AS key", "*")
    nodes["Lineitem"] = _nodes(line, "key", "l_")
    events, docs, labels, turns = read("events"), read("documents"), read("labels"), read("conversations")
    nodes["Event"] = _nodes(events, "event_id")
    nodes["User"] = events.select(F.col("user_id").alias("key")).distinct()
    nodes["Document"] = _nodes(docs, "doc_id")
    nodes["Page"] = _nodes(read("pages"), "page_id")
    nodes["Label"] = _nodes(labels, "doc_id")
    turn = turns.select(F.concat_ws(":", "conv_id", "turn").alias("key"), "*")
    nodes["Turn"] = turn
    groups = tables["Part"].select(F.col("p_brand").alias("key")).distinct().unionByName(tables["Customer"].select(F.col("c_mktsegment").alias("key")).distinct())
    nodes["group"] = groups.withColumn("name", F.col("key"))

    def owned(kind: str, k1: str, r1: str, k2: str, r2: str, owner: int, fk: str, prefix: str = "") -> Edges:
        """Edges held as a foreign key column ``fk`` (its name in the node table) of the owner's rows."""
        table = nodes[k2 if owner == 2 else k1]
        own, other = F.col("key"), F.col(fk)
        ends = (other, own) if owner == 2 else (own, other)
        df = table.where(F.col(fk).isNotNull()).select((F.concat(F.lit(prefix), own.cast("string")) if prefix else own).alias("key"), ends[0].alias("end1key"), ends[1].alias("end2key"), *[F.col(c).alias(f"n_{c}") for c in table.columns if c != "key"])
        return Edges(kind, k1, r1, k2, r2, df, owner, fk, prefix)

    after = turn.select(F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("end2key"), F.col("key").alias("end1key"), "key")
    edges = (
        owned("InRegion", "Nation", "Member", "Region", "Container", 1, "regionkey"),
        owned("FromNation", "Customer", "Resident", "Nation", "Home", 1, "nationkey", "C:"),
        owned("FromNation", "Supplier", "Resident", "Nation", "Home", 1, "nationkey", "S:"),
        owned("Placed", "Customer", "Buyer", "Order", "Purchase", 2, "custkey"),
        owned("HasItem", "Order", "Whole", "Lineitem", "Part", 2, "orderkey"),
        owned("OfPart", "Lineitem", "Item", "Part", "Product", 1, "partkey"),
        owned("SuppliedBy", "Lineitem", "Item", "Supplier", "Source", 1, "suppkey"),
        owned("Did", "User", "Actor", "Event", "Action", 2, "user_id"),
        Edges("Labelled", "Document", "Subject", "Label", "Mark", labels.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("end1key"), F.col("doc_id").alias("end2key"), "quality")),
        Edges("Replies", "Turn", "Previous", "Turn", "Next", after.join(turn.select(F.col("key").alias("end2key")), "end2key", "left_semi").select("key", "end1key", "end2key")),
        owned("Contains", "group", "group", "Part", "Member", 2, "brand", "P:"),
        owned("Contains", "group", "group", "Customer", "Member", 2, "mktsegment", "C:"),
    )
    return Graph(spark, nodes, edges)
