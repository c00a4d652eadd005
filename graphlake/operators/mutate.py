"""Changes to a graph as deltas: a transaction gathers them and one commit makes the next graph.

Stores replace whole rows, updates merge attributes, removals cascade: a node's edges go with it, and an edge whose
end on the removed side cascades takes the other node along (``cascadinglast``: only if no edge of its kind is left
there).  The cascade is a fixpoint of joins whose waves are written out; commits otherwise write nothing but plan
anti-joins and unions, which callers may write out (``sources/store.py``) between transactions to keep plans short.

A value of another type than its attribute's widens the attribute: numbers to a wider number, anything else to
printed text.  An update that sets nil removes the attribute.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import column, printed
from ..sources.graph import ENDS, Edges, Graph, check_name, frame, from_rows
from ..sources.store import settle

GIVEN = "__given"

EVENTS = ("node.created", "node.updated", "node.deleted", "edge.created", "edge.updated", "edge.deleted", "node.store", "node.update", "node.delete", "edge.store", "edge.delete")


class Handled(Exception):
    """Raised by a rule to say that it dealt with the event: the change is left out."""


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def _as(c: Column, had: T.DataType, want: T.DataType) -> Column:
    if had == want:
        return c
    return F.when(c.isNotNull(), printed(column(c, had))) if isinstance(want, T.StringType) else c.cast(want)


def _align(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Both, with attributes of a type that fits either."""
    if old is None:
        return new
    types = {c: _common(old.schema[c].dataType, new.schema[c].dataType) for c in old.columns if c in new.columns}
    alike = lambda d: d.select(*[_as(F.col(f"`{c}`"), d.schema[c].dataType, types.get(c, d.schema[c].dataType)).alias(c) for c in d.columns])
    return alike(old).unionByName(alike(new), allowMissingColumns=True)


def _without(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(F.col("key").cast("string").alias("__gone")), F.col("key").cast("string") == F.col("__gone"), "left_anti")


class Transaction:
    """Buffered changes; a later change to the same item takes the place of an earlier one."""

    def __init__(self, graph: Graph, rules: list[Callable] | None = None, every: int = 0):
        self.graph, self.rules, self.every = graph, rules or [], every
        self.rollback()

    def rollback(self) -> None:
        self._stores: dict[tuple, dict] = {}
        self._updates: dict[tuple, dict] = {}
        self._removes: set[tuple] = set()
        self._edges: dict[tuple, dict] = {}
        self._edge_removes: set[tuple] = set()

    @property
    def pending(self) -> int:
        return sum(map(len, (self._stores, self._updates, self._removes, self._edges, self._edge_removes)))

    def _event(self, name: str, item: dict) -> bool:
        try:
            for rule in self.rules:
                rule(name, item, self)
        except Handled:
            return False
        return True

    def _rolled(self) -> None:
        if self.every and self.pending >= self.every:
            self.commit()

    def store_node(self, node: dict) -> None:
        check_name("Node kind", node["kind"])
        if not node.get("key"):
            raise ValueError("Node is missing a key value")
        if self._event("node.store", node):
            k = (node["kind"], node["key"])
            self._removes.discard(k)
            self._updates.pop(k, None)
            self._stores[k] = dict(node)
        self._rolled()

    def update_node(self, node: dict) -> None:
        if self._event("node.update", node):
            k = (node["kind"], node["key"])
            if k in self._stores:
                self._stores[k].update(node)
            else:
                self._updates[k] = self._updates.get(k, {}) | dict(node)
        self._rolled()

    def remove_node(self, kind: str, key: str) -> None:
        if self._event("node.delete", {"kind": kind, "key": key}):
            self._stores.pop((kind, key), None)
            self._updates.pop((kind, key), None)
            self._removes.add((kind, key))
        self._rolled()

    def store_edge(self, edge: dict) -> None:
        if self._event("edge.store", edge):
            k = (edge["kind"], edge["key"])
            self._edge_removes.discard(k)
            self._edges[k] = dict(edge)
        self._rolled()

    def remove_edge(self, kind: str, key: str) -> None:
        if self._event("edge.delete", {"kind": kind, "key": key}):
            self._edges.pop((kind, key), None)
            self._edge_removes.add((kind, key))
        self._rolled()

    def commit(self) -> Graph:
        g = self.graph
        by: dict[str, list[dict]] = {}
        for (kind, _), n in self._stores.items():
            by.setdefault(kind, []).append({k: v for k, v in n.items() if k != "kind"})
        for kind, rows in by.items():
            g = upsert_nodes(g, kind, frame(g.spark, rows))
        by = {}
        for (kind, _), n in self._updates.items():
            by.setdefault(kind, []).append({k: v for k, v in n.items() if k != "kind"} | {GIVEN: [k for k in n if k != "kind"]})
        for kind, rows in by.items():
            g = update_nodes(g, kind, frame(g.spark, rows))
        if self._edges:
            for e in from_rows(g.spark, [], list(self._edges.values())).edges:
                g = upsert_edges(g, e)
        for kind in {k for k, _ in self._edge_removes}:
            g = remove_edges(g, kind, g.spark.createDataFrame([(key,) for k, key in self._edge_removes if k == kind], "key string"))
        if self._removes:
            g = remove_nodes(g, g.spark.createDataFrame(sorted(self._removes), "kind string, key string"))
        self.graph = g
        self.rollback()
        return g


def upsert_nodes(g: Graph, kind: str, rows: DataFrame) -> Graph:
    old = g.nodes.get(kind)
    new = rows if old is None else _align(_without(old, rows), rows)
    return g.with_(nodes=g.nodes | {kind: new}, more_attrs=g.more_attrs | set(rows.columns))


def update_nodes(g: Graph, kind: str, rows: DataFrame) -> Graph:
    """Given attributes replace old ones, null removing them; others stay; unknown nodes are made.

    Rows give all their columns, or those named in an array column ``__given``.
    """
    names = [c for c in rows.columns if c != GIVEN]
    old = g.nodes.get(kind)
    if old is None:
        return upsert_nodes(g, kind, rows.select(*[F.col(f"`{c}`") for c in names]))
    r = rows.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in names], *([F.col(GIVEN).alias("__of")] if GIVEN in rows.columns else []))
    both = old.join(r, F.col("key").cast("string") == F.col("__key").cast("string"), "full")
    cols = []
    for c in dict.fromkeys([*old.columns, *names]):
        had = old.schema[c].dataType if c in old.columns else None
        got = rows.schema[c].dataType if c in names else None
        t = got if had is None else had if got is None else _common(had, got)
        stays = F.lit(None).cast(t) if had is None else _as(F.col(f"`{c}`"), had, t)
        if got is None:
            cols.append(stays.alias(c))
        elif c == "key":
            cols.append(F.coalesce(stays, _as(F.col("__key"), got, t)).alias(c))
        else:
            told = F.array_contains("__of", c) if GIVEN in rows.columns else F.col("__key").isNotNull()
            cols.append(F.when(told, _as(F.col(f"`__{c}`"), got, t)).otherwise(stays).alias(c))
    return g.with_(nodes=g.nodes | {kind: both.select(*cols)}, more_attrs=g.more_attrs | set(names))


def _ends_exist(g: Graph, e: Edges) -> None:
    for i, kind in ((0, e.kind1), (1, e.kind2)):
        ends = e.df.select(F.col(ENDS[i]).cast("string").alias("__k"))
        missing = ends if kind not in g.nodes else ends.join(g.nodes[kind].select(F.col("key").cast("string").alias("__have")), F.col("__k") == F.col("__have"), "left_anti")
        if row := missing.first():
            raise ValueError(f"Can't find edge endpoint: {row[0]} ({kind})")


def _plain(e: Edges) -> Edges:
    return replace(e, df=e.df.select(*[F.col(f"`{a}`").cast("string") if a == "key" else F.col(f"`{a}`") for a in e.attrs], *[F.col(x).cast("string").alias(x) for x in ENDS]), owner=0)


def upsert_edges(g: Graph, e: Edges) -> Graph:
    _ends_exist(g, e)
    g = remove_edges(g, e.kind, e.df.select("key"))
    ends = lambda x: (x.kind, x.kind1, x.role1, x.kind2, x.role2, x.cascading, x.cascadinglast)
    old = [x for x in g.edges if ends(x) == ends(e)]
    if not old:
        return g.with_(edges=(*g.edges, e))
    return g.with_(edges=tuple(replace(_plain(x), df=_align(_plain(x).df, e.df)) if x is old[0] else x for x in g.edges))


def remove_edges(g: Graph, kind: str, keys: DataFrame) -> Graph:
    return g.with_(edges=tuple(replace(e, df=_without(e.df, keys)) if e.kind == kind else e for e in g.edges))


def remove_nodes(g: Graph, gone: DataFrame) -> Graph:
    """``gone``: (kind, key).  Nodes that follow are found wave by wave, each a written table; then all go at once."""
    total = wave = settle(gone.select("kind", F.col("key").cast("string").alias("key")).distinct(), "removed")
    if any(any(e.cascading) for e in g.edges):
        while True:
            more = _following(g, total, wave)
            wave = settle(more.join(total, ["kind", "key"], "left_anti").distinct(), "removed")
            if wave.isEmpty():
                break
            total = settle(total.unionByName(wave), "removed")
    nodes = {k: _without(d, total.where(F.col("kind") == k)) for k, d in g.nodes.items()}
    return g.with_(nodes=nodes, edges=tuple(replace(e, df=_detached(e, total)) for e in g.edges))


def _touching(e: Edges, i: int, gone: DataFrame, how: str) -> DataFrame:
    """Edges by whether their end ``i`` (0, 1) is among the nodes ``gone``."""
    w = gone.where(F.col("kind") == (e.kind1, e.kind2)[i]).select(F.col("key").alias("__w"))
    return e.df.join(w, F.col(ENDS[i]).cast("string") == F.col("__w"), how)


def _detached(e: Edges, gone: DataFrame) -> DataFrame:
    return _touching(replace(e, df=_touching(e, 0, gone, "left_anti")), 1, gone, "left_anti")


def removed_edges(g: Graph, gone: DataFrame) -> DataFrame | None:
    """(kind, key) of the edges that go with the nodes ``gone`` themselves."""
    parts = [_touching(e, i, gone, "left_semi").select(F.lit(e.kind).alias("kind"), F.col("key").cast("string").alias("key")) for e in g.edges for i in (0, 1)]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return None if out is None else out.distinct()


def _following(g: Graph, total: DataFrame, wave: DataFrame) -> DataFrame:
    """Nodes that go because one of the ``wave`` went; all of ``total`` are gone already."""
    more = wave.limit(0)
    for e in g.edges:
        for i, other in ((0, e.kind2), (1, e.kind1)):
            if e.cascading[i]:
                hit = _touching(e, i, wave, "left_semi").select(F.lit(other).alias("kind"), F.col(ENDS[1 - i]).cast("string").alias("key"))
                if e.cascadinglast[i]:
                    rest = _detached(e, total).select(F.col(ENDS[1 - i]).cast("string").alias("__rest"))
                    hit = hit.join(rest, F.col("key") == F.col("__rest"), "left_anti")
                more = more.unionByName(hit)
    return more
