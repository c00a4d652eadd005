"""One object with everything: queries, text search, GraphQL, changes."""

from __future__ import annotations

import re
import time
from collections import OrderedDict

from pyspark.sql import DataFrame

from .operators import fulltext
from .operators.mutate import Transaction
from .operators.nodes import NodeInfo
from .operators.results import Result
from .plans.graphql import introspect, run_graphql
from .plans.planner import run_query
from .sources.graph import Graph


class Session:
    """Results asked for by id are kept in Spark's cache: the last ``keep`` of them, for ``seconds`` since their last use."""

    def __init__(self, graph: Graph, info: NodeInfo | None = None, keep: int = 16, seconds: float = 300.0):
        self.graph, self.info, self.keep, self.seconds = graph, info, keep, seconds
        self._cache: OrderedDict[str, tuple[float, Result]] = OrderedDict()

    def query(self, text: str, result_id: str | None = None) -> Result:
        out = run_query(self.graph, text, self.info)
        if result_id:
            self.forget(result_id)
            out.df = out.df.persist()
            self._cache[result_id] = (time.monotonic(), out)
            self._clear()
        return out

    def result(self, result_id: str) -> Result:
        self._clear()
        if result_id not in self._cache:
            raise ValueError("Unknown query result")
        _, out = self._cache.pop(result_id)
        self._cache[result_id] = (time.monotonic(), out)
        return out

    def forget(self, result_id: str) -> None:
        if result_id in self._cache:
            self._cache.pop(result_id)[1].df.unpersist()

    def _clear(self) -> None:
        now = time.monotonic()
        for k in [k for i, (k, (at, _)) in enumerate(self._cache.items()) if now - at > self.seconds or i < len(self._cache) - self.keep]:
            self.forget(k)

    def graphql(self, query: str, variables: dict | None = None, operation: str = "") -> dict:
        return introspect(self.graph) if re.match(r"\s*(query\s*\w*\s*)?\{\s*__schema\b", query) else run_graphql(self.graph, query, variables, operation)

    def find(self, text: str, value: bool = False) -> DataFrame:
        return fulltext.find(self.graph, text, value)

    def transaction(self, **options) -> Transaction:
        return Transaction(self.graph, **options)

    def commit(self, t: Transaction) -> None:
        self.graph = t.commit()
