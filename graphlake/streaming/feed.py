"""Change feeds: a stream of node changes is applied batch by batch and drives handlers and subscriptions.

State is files in a folder: a base table of the kind, one table of changes an epoch, and a new base every ``compact`` epochs.
The graph is read from these files, so plans stay as short as the list of changes since the last base, nothing refers to a
micro-batch that is over, and a feed opened on a folder goes on after the last epoch written there.  An epoch's changes
are written aside and renamed, so an epoch is there whole or not at all; a replayed one changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import _without, remove_edges, removed_edges, upsert_nodes
from ..plans.graphql import Executor
from ..sources.graph import Graph
from ..sources.store import settle, shared_dir


class EventBridge:
    """Handlers by event name; ``*`` at the end stands for any rest."""

    def __init__(self) -> None:
        self.handlers: list[tuple[str, Callable]] = []

    def on(self, name: str, handler: Callable) -> None:
        self.handlers.append((name, handler))

    def emit(self, name: str, batch: DataFrame) -> None:
        for pattern, h in self.handlers:
            if pattern == name or pattern.endswith("*") and name.startswith(pattern[:-1]):
                h(name, batch)


class Subscription:
    """A query that is run again when a change may matter; its result is published if it differs from the last."""

    def __init__(self, request: dict, publish: Callable[[dict], None]):
        self.request, self.publish, self.last, self.kinds = request, publish, None, set()

    def refresh(self, graph: Graph, changed: set[str] | None = None, updated_only: bool = False) -> bool:
        if updated_only and self.last is not None and changed is not None and not changed & self.kinds:
            return False
        run = Executor(graph, self.request)
        data = run.data()
        self.kinds = run.touched
        digest = hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()
        if digest == self.last:
            return False
        self.last = digest
        self.publish(data)
        return True


class Feed:
    """Applies batches of (op, key, attributes...) to one kind: op is created, updated or deleted.

    Within a batch the last change to a key should be the only one; of several, a deletion wins.  Events: ``node.<op>`` with
    the batch's rows, and ``edge.deleted`` with (kind, key) of the edges that went with their nodes.
    """

    def __init__(self, graph: Graph, kind: str, folder: str | None = None, compact: int = 20):
        self.graph, self.kind, self.compact = graph, kind, compact
        self.spark = graph.spark
        self.folder = (folder or f"{shared_dir(self.spark)}/feed-{uuid.uuid4().hex}").rstrip("/")
        self.bridge, self.subscriptions, self.epoch = EventBridge(), [], -1
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.start_graph = graph
        if done := self._epochs("changes"):
            self.epoch = done[-1]
            self._load()

    def _epochs(self, what: str) -> list[int]:
        at = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.rsplit("=", 1)[1]) for n in names if n.startswith(f"{what}="))

    def _write(self, df: DataFrame, what: str, epoch: int) -> None:
        aside, to = f"{self.folder}/_aside-{uuid.uuid4().hex}", f"{self.folder}/{what}={epoch}"
        df.write.parquet(aside)
        self._fs.delete(self._path(to), True)
        self._fs.rename(self._path(aside), self._path(to))

    def _load(self) -> None:
        """The graph as the files tell it."""
        bases = self._epochs("base")
        first = bases[-1] if bases else -1
        nodes = self.spark.read.parquet(f"{self.folder}/base={first}") if bases else self.start_graph.nodes[self.kind]
        g = self.start_graph.with_(nodes=self.start_graph.nodes | {self.kind: nodes})
        told = [e for e in self._epochs("changes") if e > first]
        if told:
            parts = [self.spark.read.parquet(f"{self.folder}/changes={e}").withColumn("__epoch", F.lit(e)) for e in told]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p, allowMissingColumns=True)
            names = [c for c in every.columns if c not in ("op", "__epoch")]
            order = F.struct("__epoch", (F.col("op") == "deleted").cast("int"))
            last = every.groupBy("key").agg(F.max_by(F.struct("op", *[c for c in names if c != "key"]), order).alias("x"))
            g = upsert_nodes(g, self.kind, last.where("x.op <> 'deleted'").select("key", *[F.col(f"x.`{c}`").alias(c) for c in names if c != "key"]))
            g = g.with_(nodes=g.nodes | {self.kind: _without(g.nodes[self.kind], last.where("x.op = 'deleted'").select("key"))})
        gone = [e for e in self._epochs("gone")]
        if gone:
            away = self.spark.read.parquet(*[f"{self.folder}/gone={e}" for e in gone])
            for kind in sorted({e.kind for e in g.edges if self.kind in (e.kind1, e.kind2)}):
                g = remove_edges(g, kind, away.where(F.col("kind") == kind).select("key"))
        self.graph = g

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch; an epoch seen before is left out, so that replays change nothing."""
        if epoch <= self.epoch:
            return
        batch = settle(batch, "batch")
        ops = {r.op for r in batch.select("op").distinct().collect()}
        edges = None
        if "deleted" in ops:
            near = self.graph.with_(edges=tuple(e for e in self.graph.edges if self.kind in (e.kind1, e.kind2)))
            edges = removed_edges(near, batch.where("op = 'deleted'").select(F.lit(self.kind).alias("kind"), F.col("key").cast("string").alias("key")))
            if edges is not None:
                self._write(edges, "gone", epoch)
                edges = self.spark.read.parquet(f"{self.folder}/gone={epoch}")
        self._write(batch, "changes", epoch)
        self.epoch = epoch
        self._load()
        if len([e for e in self._epochs("changes") if e > max(self._epochs("base"), default=-1)]) >= self.compact:
            self._write(self.graph.nodes[self.kind], "base", epoch)
            self._load()
        for op in sorted(ops):
            self.bridge.emit(f"node.{op}", batch.where(F.col("op") == op))
        if edges is not None and not edges.isEmpty():
            self.bridge.emit("edge.deleted", edges)
        for s in self.subscriptions:
            s.refresh(self.graph, {self.kind}, ops == {"updated"})

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
