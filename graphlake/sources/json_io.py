"""Import and export of whole graphs as JSON.

A document ``{"nodes": [...], "edges": [...]}`` is for graphs that fit in a text.  The distributed form is a folder of JSON lines by
section, kind and, for edges, ends, written and read by executors; a zip archive holds one such document a partition.
"""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import ENDS, Edges, Graph, flat_edges, from_rows


def import_document(spark: SparkSession, text: str, partition: str = "main") -> Graph:
    doc = json.loads(text)
    return from_rows(spark, doc.get("nodes", []), doc.get("edges", []), partition)


def export_rows(graph: Graph) -> DataFrame:
    """(section, kind, key, json): every node with all attributes and every edge once, in the order of kind and key."""
    parts = []
    for kind, d in graph.nodes.items():
        d = d.withColumn("kind", F.lit(kind)) if "kind" not in d.columns else d
        parts.append(d.select(F.lit("nodes").alias("section"), F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), F.to_json(F.struct("*")).alias("json")))
    for e in graph.edges:
        d = flat_edges(e)
        parts.append(d.select(F.lit("edges").alias("section"), F.lit(e.kind).alias("kind"), F.col("key").cast("string").alias("key"), F.to_json(F.struct("*")).alias("json")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_document(graph: Graph) -> str:
    """One document; for graphs that fit in a text."""
    rows = sorted_dump(graph).collect()
    out = {"nodes": [], "edges": []}
    for r in rows:
        out[r.section].append(json.loads(r.json))
    return json.dumps(out, ensure_ascii=False)


def write_export(graph: Graph, path: str) -> None:
    """JSON lines under ``nodes/kind=...`` and ``edges/set=<kind1.role1.kind.role2.kind2.flags>``; nothing passes the driver."""
    for kind, d in graph.nodes.items():
        d.select(F.to_json(F.struct(*[c for c in d.columns if c != "kind"])).alias("value")).write.text(f"{path}/nodes/kind={kind}")
    for e in graph.edges:
        flags = "".join("t" if x else "f" for x in (*e.cascading, *e.cascadinglast))
        rows = e.df.select(*[F.col(f"`{a}`").cast("string") if a == "key" else F.col(f"`{a}`") for a in e.attrs], *[F.col(x).cast("string").alias(x) for x in ENDS])
        rows.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/edges/set={'.'.join((e.kind1, e.role1, e.kind, e.role2, e.kind2, flags))}")


def read_export(spark: SparkSession, path: str, partition: str = "main") -> Graph:
    """A folder that ``write_export`` wrote: a scan of each part finds its schema, rows are read where they are used."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(section: str) -> list[str]:
        at = fs_path(f"{path}/{section}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    nodes, edges = {}, []
    for name in parts("nodes"):
        d = spark.read.json(f"{path}/nodes/{name}")
        nodes[name.removeprefix("kind=")] = d if "key" in d.columns else spark.createDataFrame([], "key string")
    for name in parts("edges"):
        kind1, role1, kind, role2, kind2, flags = name.removeprefix("set=").split(".")
        d = spark.read.json(f"{path}/edges/{name}")
        d = d if "key" in d.columns else spark.createDataFrame([], "key string, end1key string, end2key string")
        on = [c == "t" for c in flags]
        edges.append(Edges(kind, kind1, role1, kind2, role2, d, cascading=(on[0], on[1]), cascadinglast=(on[2], on[3])))
    return Graph(spark, nodes, tuple(edges), partition)


def sorted_dump(graph: Graph) -> DataFrame:
    """``export_rows`` in canonical order: nodes first, each by kind and key."""
    return export_rows(graph).orderBy(F.desc("section"), "kind", "key")


def write_zip(graphs: list[Graph], path: str) -> None:
    """One archive, a document a partition; for graphs that fit in a text."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for g in graphs:
            z.writestr(f"{g.partition}.json", export_document(g))


def read_zip(spark: SparkSession, path: str) -> dict[str, Graph]:
    with zipfile.ZipFile(path) as z:
        return {n.removesuffix(".json"): import_document(spark, z.read(n).decode(), n.removesuffix(".json")) for n in sorted(z.namelist())}
