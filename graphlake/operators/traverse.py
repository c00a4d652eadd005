"""Traversal steps: neighbours as one join, siblings aligned instead of multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import ENDS, Edges, Graph


def neighbours(graph: Graph, found: list[tuple[Edges, int]], node_attrs: set[str], edge_attrs: set[str], tag: str, kinds: bool) -> DataFrame:
    """All edges that fit, with what is needed of edge and target: ``{tag}_src``, ``{tag}_spec``, ``{tag}_e_*``, ``{tag}_n_*``.

    The target's attributes come from the edge's own row where that is the target's table (a foreign key), from no
    table at all where none is needed, else from a join with its nodes.  With several specs the parts are united before
    the one join with the frontier; keys are then strings.
    """
    parts = []
    mixed = len({(str(e.df.schema[ENDS[0]].dataType), str(e.df.schema[ENDS[1]].dataType), e.kind1, e.kind2) for e, _ in found}) > 1 or len({e.spec(i) for e, i in found}) > 1
    as_key = (lambda c: c.cast("string")) if mixed else (lambda c: c)
    for e, i in found:
        for side in (1, 2) if e.symmetric else (i,):
            target = e.kind2 if side == 1 else e.kind1
            src, dst = F.col(ENDS[side - 1]), F.col(ENDS[2 - side])
            df = e.df.where(src.cast("string") != dst.cast("string")) if e.symmetric and side == 2 else e.df
            have = {f.name for f in graph.nodes[target].schema.fields} if target in graph.nodes else set()
            want = sorted(a for a in node_attrs if a not in ("key", "kind"))
            edge = [as_key(src).alias(f"{tag}_src"), F.lit(e.kind1 if side == 1 else e.kind2).alias(f"{tag}_srckind"), F.lit(":".join(e.spec(side))).alias(f"{tag}_spec"), F.col("key").cast("string").alias(f"{tag}_e_key"), F.lit(e.kind).alias(f"{tag}_e_kind")]
            edge += [(F.col(f"`{a}`") if a in e.attrs else F.lit(None).cast("string")).alias(f"{tag}_e_{a}") for a in sorted(edge_attrs) if a not in ("key", "kind")]
            head = [as_key(dst).alias(f"{tag}_n_key"), F.lit(target).alias(f"{tag}_n_kind")]
            if e.owner and (2 if side == 1 else 1) == e.owner:
                attrs = [(F.col(f"`n_{a}`") if f"n_{a}" in df.columns else F.lit(None).cast("string")).alias(f"{tag}_n_{a}") for a in want]
                parts.append(df.select(*edge, *head, *attrs))
            elif not [a for a in want if a in have]:
                parts.append(df.select(*edge, *head, *[F.lit(None).cast("string").alias(f"{tag}_n_{a}") for a in want]))
            else:
                node = graph.nodes[target].select(as_key(F.col("key")).alias("__k"), *[(F.col(f"`{a}`") if a in have else F.lit(None).cast("string")).alias(f"{tag}_n_{a}") for a in want])
                d = df.select(*edge, *head)
                parts.append(d.join(node, F.col(f"{tag}_n_key") == F.col("__k"), "left").drop("__k"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(_alike(p, out))
    return out if kinds else out.drop(f"{tag}_srckind")


def oriented(graph: Graph, kind: str, key: str, spec: str) -> DataFrame:
    """Edges of one node that fit a spec, with all their data, turned so that the node is their first end; keys are text.

    The flags of the ends turn with them.
    """
    out = None
    for e, i in graph.match([kind], spec):
        for side in (1, 2) if e.symmetric else (i,):
            ends = (e.kind1, e.role1, e.cascading[0], e.cascadinglast[0]), (e.kind2, e.role2, e.cascading[1], e.cascadinglast[1])
            df = e.df.where(F.col(ENDS[0]).cast("string") != F.col(ENDS[1]).cast("string")) if e.symmetric and side == 2 else e.df
            cols = [F.lit(e.kind).alias("kind"), *[F.col(f"`{a}`").cast("string") if a == "key" else F.col(f"`{a}`") for a in e.attrs]]
            for n, at in ((1, side - 1), (2, 2 - side)):
                values = {"key": F.col(ENDS[at]).cast("string")} | {w: F.lit(v) for w, v in zip(("kind", "role", "cascading", "cascadinglast"), ends[at])}
                cols += [v.alias(f"end{n}{w}") for w, v in values.items()]
            d = df.where(F.col(ENDS[side - 1]).cast("string") == key).select(*cols)
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return graph.spark.createDataFrame([], "kind string, key string") if out is None else out


def _alike(p: DataFrame, out: DataFrame) -> DataFrame:
    """``p`` with the columns' types of ``out`` where a null stands for an attribute that a kind lacks."""
    types = {f.name: f.dataType for f in out.schema.fields}
    return p.select(*[F.col(f"`{f.name}`") if f.dataType == types[f.name] else F.col(f"`{f.name}`").try_cast(types[f.name]).alias(f.name) for f in p.schema.fields])


def zigzag(parent: DataFrame, row: str, siblings: list[DataFrame], orders: list[list[Column]], outer: bool) -> DataFrame:
    """Rows of sibling traversals of one parent: the first sibling advances to its end, then the next, and so on.

    ``parent`` has the row id ``row``; each sibling has it too, next to its own columns.  With lists of n_1..n_k rows there
    are sum(n) - (k - 1) rows; row p takes entry clamp(p - off_j, 0, n_j - 1) of list j, off_j being the sum of n_i - 1
    over earlier lists.  Lists are numbered within their parent (a window on the key both joins use), and joined
    by number: nothing is collected.
    """
    numbered, counts = [], parent.select(F.col(row).alias("__r"))
    for j, (s, order) in enumerate(zip(siblings, orders)):
        w = Window.partitionBy(row).orderBy(*order)
        n = s.withColumn(f"__i{j}", F.row_number().over(w) - 1).withColumnRenamed(row, f"__r{j}")
        numbered.append(n)
        c = s.groupBy(F.col(row).alias(f"__c{j}")).agg(F.count("*").alias(f"__n{j}"))
        counts = counts.join(c, F.col("__r") == F.col(f"__c{j}"), "left" if outer else "inner").drop(f"__c{j}")
    k = len(siblings)
    for j in range(k):
        counts = counts.withColumn(f"__m{j}", F.greatest(F.coalesce(f"__n{j}", F.lit(0)), F.lit(1)))
    total = sum((F.col(f"__m{j}") for j in range(1, k)), F.col("__m0")) - (k - 1)
    rows = counts.withColumn("__p", F.explode(F.sequence(F.lit(0), (total - 1).cast("int"))))
    off = F.lit(0)
    for j in range(k):
        rows = rows.withColumn(f"__x{j}", F.least(F.greatest(F.col("__p") - off, F.lit(0)), F.col(f"__m{j}") - 1))
        off = off + F.col(f"__m{j}") - 1
    for j, n in enumerate(numbered):
        rows = rows.join(n, (F.col("__r") == F.col(f"__r{j}")) & (F.col(f"__x{j}") == F.col(f"__i{j}")), "left")
    drop = [c for c in rows.columns if c.startswith("__") and c not in ("__r", "__p")]
    rows = rows.drop(*drop)
    return parent.join(rows, F.col(row) == F.col("__r"), "inner").drop("__r").withColumnRenamed("__p", f"{row}_p")
