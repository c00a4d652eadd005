"""Operators on result rows: filters for uniqueness and presence, frequencies, and written forms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import NIL, Value, column, printed
from ..sources.graph import ENDS, Edges
from ..sources.store import settle
from .mutate import upsert_edges


def unique(df: DataFrame, cell: Value, order: list[Column], count_as: str | None = None) -> DataFrame:
    """Of the rows with equal printed cells the last in ``order`` stays; ``count_as`` adds how many there were.

    A window over the cell would bring all rows of a frequent value to one task; instead the last row per value is an
    aggregate with map-side combining.
    """
    names = df.columns
    key = F.struct(*order, *[printed(column(df[c], df.schema[c].dataType)) for c in names])
    g = df.groupBy(printed(cell).alias("__cell")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), key).alias("__row"), F.count("*").alias("__n"))
    return g.select("__row.*", *([F.col("__n").alias(count_as)] if count_as else []))


def quick_filter(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Value and frequency of a result column, most frequent first, then by value."""
    out = df.groupBy(printed(column(F.col(f"`{col}`"), df.schema[col].dataType)).alias("value")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "value")
    return out if limit is None else out.limit(limit)


@dataclass
class Result:
    """Rows with their header: labels, formats, where each column comes from, the primary kind and the partition."""

    df: DataFrame
    columns: list[str]
    labels: list[str]
    formats: list[str]
    data: list[str]
    primary: str
    partition: str
    sources: dict[str, Column] = field(default_factory=dict)
    steps: list[tuple[int, str]] = field(default_factory=list)  # of each column: its step and the kind there, if one
    toggled: frozenset[int] = frozenset()
    inverted: bool = False

    def frame(self, names: list[str] | None = None) -> DataFrame:
        """The rows, under labels (made distinct) or given names."""
        seen: dict[str, int] = {}
        out = []
        for c, label in zip(self.columns, names or self.labels):
            n = seen[label] = seen.get(label, 0) + 1
            out.append(F.col(f"`{c}`").alias(label if n == 1 else f"{label} {n}"))
        return self.df.select(*out)

    def with_sources(self) -> DataFrame:
        """The rows with ``_source``: for every cell the node, edge or query it comes from."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.columns], F.array(*[self.sources.get(c, F.lit("")) for c in self.columns]).alias("_source"))

    def page(self, offset: int, limit: int) -> DataFrame:
        out = self.frame().offset(offset).limit(limit)
        if offset and out.isEmpty():
            raise ValueError("Offset exceeds available rows")
        return out

    def total(self) -> int:
        return self.df.count()

    def numbered(self) -> DataFrame:
        """The rows with ``_row`` from 0, in their order: parts of the sorted rows are counted, then numbered on from there."""
        parts = self.df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        parts = settle(parts, "rows")
        sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
        before = sizes.select("__part", "__first", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # as many rows as partitions
        return parts.join(F.broadcast(before), "__part").withColumn("_row", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")

    def primary_column(self) -> int:
        """The last column whose cells come from the primary kind."""
        hit = [i for i, (_, kind) in enumerate(self.steps) if kind == self.primary]
        if not hit:
            raise ValueError("Could not determine key of primary node - query needs a primary expression")
        return hit[-1]

    def grouping(self, spec_graph, groups: str | None = None) -> DataFrame:
        """(_row, group): the groups of each row's primary node, or those named; rows without one are left out."""
        i = self.primary_column()
        rows = self.numbered().select("_row", F.col(f"s{self.steps[i][0]}_n_key").cast("string").alias("__k"))
        out = rows.join(members(spec_graph, self.primary), "__k").select("_row", "group")
        return out if groups is None else out.where(F.col("group").isin(groups.split(",")))

    def strings(self) -> DataFrame:
        return self.df.select(*[printed(column(F.col(f"`{c}`"), self.df.schema[c].dataType)).alias(c) for c in self.columns])

    def write_csv(self, path: str) -> None:
        """Header of labels; cells in printed form."""
        self.strings().toDF(*[f"{x}" if self.labels.count(x) == 1 else f"{x} {i}" for i, x in enumerate(self.labels)]).write.csv(path, header=True)

    def text(self, stable: bool = False) -> str:
        """Header lines and one line a row; for small results."""
        rows = [tuple("<not set>" if x == NIL else x for x in r) for r in self.strings().collect()]
        if stable:
            rows.sort(key="".join)
        head = [f"Labels: {', '.join(self.labels)}", f"Format: {', '.join(self.formats)}", f"Data: {', '.join(self.data)}"]
        return "\n".join(head + [", ".join(r) for r in rows]) + "\n"

    def select(self, rows: str | list[int]) -> None:
        """Row selections: all, none, invert, or toggled numbers; kept as exceptions from none or all, whatever the number of rows."""
        if rows in ("all", "none"):
            self.toggled, self.inverted = frozenset(), rows == "all"
        elif rows == "invert":
            self.inverted = not self.inverted
        else:
            self.toggled = self.toggled ^ frozenset(rows)

    def selected(self) -> DataFrame:
        """The rows selected, with ``_row``."""
        hit = F.col("_row").isin(sorted(self.toggled)) if self.toggled else F.lit(False)
        return self.numbered().where(~hit if self.inverted else hit)

    def selected_nodes(self) -> DataFrame:
        """(kind, key) of the primary nodes of the rows selected."""
        i = self.primary_column()
        return self.selected().select(F.lit(self.primary).alias("kind"), F.col(f"s{self.steps[i][0]}_n_key").cast("string").alias("key"))

    def selection_state(self, graph) -> DataFrame:
        """(group, keys, kinds) of the rows selected, by group; a list holds a group's selected members."""
        nodes = self.selected_nodes().select("kind", F.col("key").alias("__k"))
        both = nodes.join(members(graph, self.primary), "__k")
        entry = F.sort_array(F.collect_list(F.struct(F.col("__k").alias("key"), "kind")))
        return both.groupBy("group").agg(entry.alias("x")).select("group", F.col("x.key").alias("keys"), F.col("x.kind").alias("kinds")).orderBy("group")

    def add_to_group(self, graph, group: str):
        """The graph in which the selected rows' nodes belong to ``group``."""
        rows = self.selected_nodes().distinct().select(F.md5(F.concat_ws("#", "key", "kind", F.lit(group))).alias("key"), F.lit(group).alias("end1key"), F.col("key").alias("end2key"))
        if group not in [r.key for r in graph.nodes["group"].where(F.col("key") == group).collect()] if "group" in graph.nodes else True:
            raise ValueError(f"Can't find edge endpoint: {group} (group)")
        return upsert_edges(graph, Edges("Containment", "group", "Container", self.primary, "ContainedItem", settle(rows, "members")))

    def remove_from_group(self, graph, group: str):
        """The graph without any edge between ``group`` and the selected rows' nodes."""
        nodes = settle(self.selected_nodes().select(F.col("key").alias("__k")).distinct(), "members")
        edges = []
        for e in graph.edges:
            ends = {(e.kind1, e.kind2): (0, 1), (e.kind2, e.kind1): (1, 0)}.get(("group", self.primary))
            if ends is not None:
                at, other = ENDS[ends[0]], ENDS[ends[1]]
                mine = e.df.where(F.col(at).cast("string") == group).join(nodes, F.col(other).cast("string") == F.col("__k"), "left_semi").select("key")
                e = replace(e, df=e.df.join(mine.select(F.col("key").alias("__gone")), F.col("key") == F.col("__gone"), "left_anti"))
            edges.append(e)
        return graph.with_(edges=tuple(edges))


def members(graph, kind: str) -> DataFrame:
    """(__k, group): which nodes of a kind belong to which groups, an edge a row."""
    parts = []
    for e, i in graph.match([kind], ":::group"):
        parts.append(e.df.select(F.col(ENDS[i - 1]).cast("string").alias("__k"), F.col(ENDS[2 - i]).cast("string").alias("group")))
    if not parts:
        return graph.spark.createDataFrame([], "__k string, group string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
