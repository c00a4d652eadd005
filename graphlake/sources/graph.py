"""The graph as DataFrames: one table of nodes per kind, one of edges per pair of ends, and the catalogue."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z0-9_]+")
ENDS = ["end1key", "end2key"]


def check_name(what: str, name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"{what} {name} is not alphanumeric - can only contain [a-zA-Z0-9_]")
    return name


@dataclass(frozen=True)
class Edges:
    """Edges of one kind between two fixed ends.

    ``df``: key, end1key, end2key and attributes.  ``owner`` (1 or 2) says that every edge is a row of that end's
    node table (a foreign key): ``df`` then has the node's attributes as ``n_<attr>``, and reaching that end
    needs no join with its nodes.  ``fk`` is the column of the owner's node table that holds the other end's key, and
    ``prefix`` what an edge's key has in front of the owner's key: leaving from the owner then needs no edge table.
    """

    kind: str
    kind1: str
    role1: str
    kind2: str
    role2: str
    df: DataFrame
    owner: int = 0
    fk: str = ""
    prefix: str = ""
    cascading: tuple[bool, bool] = (False, False)
    cascadinglast: tuple[bool, bool] = (False, False)

    @property
    def attrs(self) -> list[str]:
        return [c for c in self.df.columns if c not in ENDS and not (self.owner and c.startswith("n_"))]

    @property
    def symmetric(self) -> bool:
        return (self.kind1, self.role1) == (self.kind2, self.role2)

    def spec(self, source: int) -> tuple[str, str, str, str]:
        ends = [(self.role1, self.kind1), (self.role2, self.kind2)]
        (r1, _), (r2, k2) = ends if source == 1 else ends[::-1]
        return r1, self.kind, r2, k2


@dataclass(frozen=True)
class Graph:
    """One partition: nodes by kind (``key`` and attributes) and edges.  Graphs are values: changing one gives another."""

    spark: SparkSession
    nodes: dict[str, DataFrame]
    edges: tuple[Edges, ...] = ()
    partition: str = "main"
    more_attrs: frozenset[str] = frozenset()

    def node_kinds(self) -> list[str]:
        return sorted(self.nodes)

    def edge_kinds(self) -> list[str]:
        return sorted({e.kind for e in self.edges})

    def attrs(self, kind: str) -> list[str]:
        return [c for c in self.nodes[kind].columns if c != "kind"]

    def type_of(self, kind: str, attr: str) -> T.DataType | None:
        fields = {f.name: f.dataType for f in self.nodes[kind].schema.fields}
        return fields.get(attr)

    def is_attr(self, name: str) -> bool:
        """Was an attribute of this name ever stored, on any node or edge?"""
        return name in self.all_attrs()

    def all_attrs(self) -> set[str]:
        fixed = {"key", "kind", "name", *(f"end{i}{w}" for i in (1, 2) for w in ("key", "kind", "role", "cascading", "cascadinglast"))}
        return fixed | {c for d in self.nodes.values() for c in d.columns} | {c for e in self.edges for c in e.attrs} | set(self.more_attrs)

    def specs(self, kind: str) -> list[str]:
        """Sorted full traversal specs that start at nodes of a kind."""
        out = set()
        for e in self.edges:
            out |= {":".join(e.spec(i)) for i, k in ((1, e.kind1), (2, e.kind2)) if k == kind}
        return sorted(out)

    def match(self, kinds: Iterable[str], spec: str) -> list[tuple[Edges, int]]:
        """Edges and the end they are entered from that fit a spec; parts left empty fit anything."""
        parts = spec.split(":")
        if len(parts) != 4:
            raise ValueError(f"Invalid spec: {spec}")
        kinds, out = set(kinds), []
        for e in self.edges:
            for i, k in ((1, e.kind1), (2, e.kind2)):
                if k in kinds and all(not p or p == q for p, q in zip(parts, e.spec(i))) and not (i == 2 and e.symmetric):
                    out.append((e, i))
        return sorted(out, key=lambda m: m[0].spec(m[1]))

    def node_count(self, kind: str | None = None) -> DataFrame:
        parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in self.nodes.items() if kind in (None, k)]
        return _union(parts)

    def edge_count(self) -> DataFrame:
        return _union([e.df.agg(F.count("*").alias("n")).select(F.lit(e.kind).alias("kind"), "n") for e in self.edges]).groupBy("kind").agg(F.sum("n").alias("n"))

    def fetch_node(self, kind: str, key: str, attrs: list[str] | None = None) -> DataFrame:
        d = self.nodes[kind].where(F.col("key").cast("string") == key)
        return d if attrs is None else d.select(*[F.col(f"`{a}`") if a in d.columns else F.lit(None).cast("string").alias(a) for a in attrs])

    def fetch_edge(self, kind: str, key: str) -> DataFrame:
        """The edge with all its end attributes, whatever its ends are; no row if there is none."""
        if kind not in self.edge_kinds():
            raise ValueError(f"Unknown edge kind: {kind}")
        return _union([flat_edges(e).where(F.col("key").cast("string") == key) for e in self.edges if e.kind == kind])

    def node_specs(self, kind: str, key: str) -> DataFrame:
        """Sorted distinct specs of one node."""
        parts = []
        for e, i in self.match([kind], ":::"):
            for side in (1, 2) if e.symmetric else (i,):
                parts.append(e.df.where(F.col(ENDS[side - 1]).cast("string") == key).select(F.lit(":".join(e.spec(side))).alias("spec")))
        return _union(parts).distinct().orderBy("spec") if parts else self.spark.createDataFrame([], "spec string")

    def keys(self, kind: str) -> DataFrame:
        """All keys of a kind; a kind never stored has none."""
        if kind not in self.nodes:
            return self.spark.createDataFrame([], "key string")
        return self.nodes[kind].select("key")

    def stats(self) -> DataFrame:
        """(item, kind, name, n): nodes and edges by kind, values by attribute, edges by full spec and source kind; one aggregate a table."""
        parts = []
        for kind, d in self.nodes.items():
            attrs = [a for a in d.columns if a != "kind"]
            counts = d.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{a}`")).alias(f"a_{a}") for a in attrs])
            rows = [F.struct(F.lit("node").alias("item"), F.lit("").alias("name"), F.col("n"))]
            rows += [F.struct(F.lit("attribute").alias("item"), F.lit(a).alias("name"), F.col(f"`a_{a}`").alias("n")) for a in attrs]
            parts.append(counts.select(F.lit(kind).alias("kind"), F.explode(F.array(*rows)).alias("x")).select("x.item", "kind", "x.name", "x.n"))
        for e in self.edges:
            rows = [F.struct(F.lit("edge").alias("item"), F.lit(e.kind).alias("kind"), F.lit("").alias("name"))]
            rows += [F.struct(F.lit("spec").alias("item"), F.lit((e.kind1, e.kind2)[i - 1]).alias("kind"), F.lit(":".join(e.spec(i))).alias("name")) for i in ((1,) if e.symmetric else (1, 2))]
            parts.append(e.df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*rows)).alias("x"), "n").select("x.item", "x.kind", "x.name", "n"))
        return _union(parts).groupBy("item", "kind", "name").agg(F.sum("n").alias("n"))

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flat_edges(e: Edges) -> DataFrame:
    """Edges with all their end attributes."""
    ends = []
    for i, (kind, role) in enumerate(((e.kind1, e.role1), (e.kind2, e.role2)), 1):
        ends += [F.col(f"end{i}key"), F.lit(kind).alias(f"end{i}kind"), F.lit(role).alias(f"end{i}role"), F.lit(e.cascading[i - 1]).alias(f"end{i}cascading"), F.lit(e.cascadinglast[i - 1]).alias(f"end{i}cascadinglast")]
    return e.df.select(F.lit(e.kind).alias("kind"), *[F.col(f"`{a}`") for a in e.attrs], *ends)


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict], partition: str = "main") -> Graph:
    """A graph from plain node and edge maps (import documents, small graphs)."""
    kinds: dict[str, list[dict]] = {}
    for n in nodes:
        for must in ("key", "kind"):
            if n.get(must) in (None, ""):
                raise ValueError(f"Node is missing a {must} value")
        kinds.setdefault(check_name("Node kind", n["kind"]), []).append({k: v for k, v in n.items() if k != "kind"})
    groups: dict[tuple, list[dict]] = {}
    for e in edges:
        for must in ("key", "kind", "end1key", "end1kind", "end1role", "end2key", "end2kind", "end2role"):
            if e.get(must) in (None, ""):
                raise ValueError(f"Edge is missing a {must} value")
        flags = tuple(bool(e.get(f"end{i}{w}")) for w in ("cascading", "cascadinglast") for i in (1, 2))
        ends = (e["kind"], e["end1kind"], e["end1role"], e["end2kind"], e["end2role"], flags)
        groups.setdefault(ends, []).append({k: v for k, v in e.items() if k in ENDS or not k.startswith(("end1", "end2")) and k != "kind"})
    sets = tuple(Edges(k[0], k[1], k[2], k[3], k[4], frame(spark, rows), cascading=k[5][:2], cascadinglast=k[5][2:]) for k, rows in groups.items())
    return Graph(spark, {k: frame(spark, rows) for k, rows in kinds.items()}, sets, partition)


def _type(values: list) -> T.DataType:
    if any(isinstance(v, dict) for v in values):
        names = sorted({k for v in values for k in v})
        return T.StructType([T.StructField(n, _type([v[n] for v in values if v.get(n) is not None])) for n in names])
    if any(isinstance(v, (list, tuple)) for v in values):
        return T.ArrayType(_type([x for v in values for x in v]))
    if values and all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if values and all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return T.LongType()
    if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return T.DoubleType()
    return T.BinaryType() if values and all(isinstance(v, bytes) for v in values) else T.StringType()


def _fit(v, t: T.DataType):
    from ..functions.values import show

    if v is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(_fit(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [_fit(x, t.elementType) for x in v]
    return float(v) if isinstance(t, T.DoubleType) else show(v) if isinstance(t, T.StringType) and not isinstance(v, str) else v


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows to a DataFrame; an attribute with values of several types becomes a string of their printed forms."""
    names = list(dict.fromkeys(["key", *(k for r in rows for k in r)]))
    schema = T.StructType([T.StructField(n, _type([r[n] for r in rows if r.get(n) is not None]) if n not in ("key", *ENDS) else T.StringType()) for n in names])
    return spark.createDataFrame([tuple(_fit(r.get(f.name), f.dataType) for f in schema.fields) for r in rows], schema)
