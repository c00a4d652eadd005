"""Nodes as maps, and node tables side by side: comparing, merging, sorting, and what to show of them."""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import column, display_name, printed
from ..sources.graph import Graph
from .mutate import update_nodes


def node_compare(a: dict, b: dict, attrs: list[str] | None = None) -> bool:
    """Are two nodes the same in the attributes named, or in all of them?"""
    if attrs is None:
        return a == b
    return all(a.get(x) == b.get(x) for x in attrs)


def node_clone(a: dict) -> dict:
    return copy.deepcopy(a)


def node_merge(a: dict, b: dict) -> dict:
    """All attributes of both; of those in both, the second's."""
    return a | b


def differing(a: DataFrame, b: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """(key, attr, a, b): attributes in which the nodes of two tables differ, in printed form; one join by key."""
    names = sorted({c for d in (a, b) for c in d.columns if c not in ("key", "kind")} if attrs is None else attrs)
    side = lambda d, w: d.select(F.col("key").cast("string").alias(f"{w}_key"), *[(F.when(F.col(f"`{c}`").isNotNull(), printed(column(F.col(f"`{c}`"), d.schema[c].dataType))) if c in d.columns else F.lit(None).cast("string")).alias(f"{w}_{c}") for c in names])
    both = side(a, "a").join(side(b, "b"), F.col("a_key") == F.col("b_key"), "full")
    cells = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"`a_{c}`").alias("a"), F.col(f"`b_{c}`").alias("b")) for c in names])
    return both.select(F.coalesce("a_key", "b_key").alias("key"), F.explode(cells).alias("x")).select("key", "x.*").where(~F.col("a").eqNullSafe(F.col("b")))


def merged(graph: Graph, kind: str, rows: DataFrame) -> DataFrame:
    """The nodes of a kind with the attributes of ``rows`` laid over theirs."""
    return update_nodes(graph, kind, rows).nodes[kind]


def sorted_nodes(graph: Graph, kinds: list[str] | None = None) -> DataFrame:
    """(kind, key) of all nodes in the order of kind and key; keys compare as text."""
    parts = [graph.nodes[k].select(F.lit(k).alias("kind"), F.col("key").cast("string").alias("key")) for k in kinds or graph.node_kinds()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("kind", "key")


class NodeInfo:
    """What a list view shows of a kind, and how attributes are called; rules of one's own take the place of the default."""

    def __init__(self, graph: Graph, summary: Callable[[str], list[str]] | None = None, display: Callable[[str, str], str] | None = None):
        self.graph, self._summary, self._display = graph, summary, display

    def summary_attributes(self, kind: str) -> list[str]:
        if self._summary is not None and (own := self._summary(kind)) is not None:
            return own
        return ["key", *sorted(a for a in self.graph.attrs(kind) if a != "key")] if kind in self.graph.nodes else ["key", "kind", "name"]

    def attribute_display(self, kind: str, attr: str) -> str:
        if self._display is not None and (own := self._display(kind, attr)) is not None:
            return own
        a = display_name(attr)
        return f"{display_name(kind)} {a}" if kind and attr in ("key", "kind", "name") else a

    def is_valid_attr(self, attr: str) -> bool:
        return self.graph.is_attr(attr)
