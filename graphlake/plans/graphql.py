"""A GraphQL surface: queries become nested arrays of structs, built bottom-up by joins and grouped lists.

Supported: operations by name, variables with defaults, aliases, arguments ``key``, ``matches``, ``traverse``,
``ascending``, ``descending``, ``last``, ``from``, ``items``, fragments and inline fragments by kind, ``@skip`` and
``@include``, and the mutations ``storeNode``, ``storeEdge``, ``removeNode``, ``removeEdge``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import NIL, column, printed
from ..operators.mutate import Transaction
from ..operators.traverse import neighbours
from ..sources.graph import Graph

_TOKEN = re.compile(r'\s+|,|#[^\n]*|(\.\.\.|[{}()\[\]:!=@$|]|"(?:\\.|[^"\\])*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z_]\w*)')


class GraphQLError(ValueError):
    pass


@dataclass
class Var:
    name: str


@dataclass
class Field:
    name: str
    alias: str
    args: dict[str, Any] = field(default_factory=dict)
    directives: dict[str, dict] = field(default_factory=dict)
    sub: list | None = None


@dataclass
class Spread:
    fragment: str | None
    kind: str | None
    directives: dict[str, dict]
    sub: list | None = None


class _Reader:
    def __init__(self, text: str):
        self.t, i = [], 0
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m:
                raise GraphQLError(f"Syntax error at {text[i : i + 10]!r}")
            if m.group(1):
                self.t.append(m.group(1))
            i = m.end()
        self.i = 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str = "") -> str:
        t = self.peek()
        if not t or want and t != want:
            raise GraphQLError(f"Expected {want or 'more'}, found {t or 'end'}")
        self.i += 1
        return t

    def document(self):
        operations, fragments = [], {}
        while self.peek():
            if self.peek() == "fragment":
                self.take()
                name = self.take()
                self.take("on")
                kind = self.take()
                fragments[name] = (kind, self.selection())
            else:
                kind, name, defaults = "query", "", {}
                if self.peek() != "{":
                    kind = self.take()
                    if self.peek() not in ("{", "("):
                        name = self.take()
                    if self.peek() == "(":
                        self.take()
                        while self.peek() != ")":
                            self.take("$")
                            v = self.take()
                            self.take(":")
                            while self.peek() in ("[", "]", "!") or re.match(r"\w", self.peek()):
                                self.take()
                            defaults[v] = None
                            if self.peek() == "=":
                                self.take()
                                defaults[v] = self.value()
                        self.take(")")
                operations.append((kind, name, defaults, self.selection()))
        return operations, fragments

    def directives(self) -> dict[str, dict]:
        out = {}
        while self.peek() == "@":
            self.take()
            name = self.take()
            out[name] = self.arguments()
        return out

    def arguments(self) -> dict[str, Any]:
        out = {}
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                name = self.take()
                self.take(":")
                out[name] = self.value()
            self.take(")")
        return out

    def value(self) -> Any:
        t = self.take()
        if t == "$":
            return Var(self.take())
        if t == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
            self.take("]")
            return out
        if t == "{":
            out = {}
            while self.peek() != "}":
                k = self.take()
                self.take(":")
                out[json.loads(k) if k[0] == '"' else k] = self.value()
            self.take("}")
            return out
        if t[0] == '"':
            return json.loads(t)
        if re.match(r"-?\d", t):
            return float(t) if re.search("[.eE]", t) else int(t)
        return {"true": True, "false": False, "null": None}.get(t, t)

    def selection(self) -> list:
        self.take("{")
        out = []
        while self.peek() != "}":
            if self.peek() == "...":
                self.take()
                if self.peek() == "on":
                    self.take()
                    kind = self.take()
                    d = self.directives()
                    out.append(Spread(None, kind, d, self.selection()))
                elif self.peek() in ("{", "@"):
                    d = self.directives()
                    out.append(Spread(None, None, d, self.selection()))
                else:
                    name = self.take()
                    out.append(Spread(name, None, self.directives()))
                continue
            name = alias = self.take()
            if self.peek() == ":":
                self.take()
                name = self.take()
            f = Field(name, alias, self.arguments(), self.directives())
            if self.peek() == "{":
                f.sub = self.selection()
            out.append(f)
        self.take("}")
        return out


class Executor:
    def __init__(self, graph: Graph, request: dict, read_only: bool = False):
        for k in ("operationName", "query", "variables"):
            if k not in request:
                raise GraphQLError(f"Mandatory field '{k}' missing from query object")
        self.graph, self.read_only, self.errors = graph, read_only, []
        operations, self.fragments = _Reader(request["query"]).document()
        name = request["operationName"]
        chosen = [o for o in operations if not name or o[1] == name]
        if not chosen:
            raise GraphQLError(f"Operation {name} not found")
        self.kind, _, defaults, self.root = chosen[0]
        self.variables = defaults | (request["variables"] or {})
        self.touched: set[str] = set()

    def resolve(self, v: Any) -> Any:
        if isinstance(v, Var):
            return self.variables.get(v.name)
        if isinstance(v, list):
            return [self.resolve(x) for x in v]
        return {k: self.resolve(x) for k, x in v.items()} if isinstance(v, dict) else v

    def error(self, text: str) -> None:
        if text not in self.errors:
            self.errors.append(text)

    def wanted(self, directives: dict[str, dict]) -> bool:
        skip, include = (self.resolve(directives.get(d, {}).get("if", default)) for d, default in (("skip", False), ("include", True)))
        return not skip and bool(include)

    def fields(self, selection: list, kind: str) -> list[Field]:
        out: dict[str, Field] = {}
        for x in selection:
            if not self.wanted(x.directives):
                continue
            if isinstance(x, Spread):
                on, sub = self.fragments[x.fragment] if x.fragment else (x.kind, x.sub)
                if on is None or on == kind:
                    for f in self.fields(sub, kind):
                        out.setdefault(f.alias, f)
            elif x.alias in out:
                self.error(f"Field identifier {x.alias} used multiple times")
            else:
                out[x.alias] = x
        return list(out.values())

    def run(self) -> dict[str, DataFrame]:
        """One DataFrame per root field, a row per item, columns by alias."""
        out = {}
        for f in self.root:
            if isinstance(f, Field) and self.wanted(f.directives):
                self.mutate(f)
                if f.name not in self.graph.nodes:
                    out[f.alias] = None
                    continue
                out[f.alias] = self.items(f)
        return out

    def data(self) -> dict:
        """The response; for small results."""
        data = {k: [] if d is None else [json.loads(r[0]) for r in d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()] for k, d in self.run().items()}
        return {"data": data} | ({"errors": [{"message": e} for e in self.errors]} if self.errors else {})

    def mutate(self, f: Field) -> None:
        acts = {"storeNode", "storeEdge", "removeNode", "removeEdge"} & set(f.args)
        if not acts:
            return
        if self.kind != "mutation":
            raise GraphQLError("Operation must be a mutation to modify data")
        if self.read_only:
            raise GraphQLError("Can only perform read operations")
        t = Transaction(self.graph)
        for a in sorted(acts):
            v = {"kind": f.name} | self.resolve(f.args[a])
            if a == "storeNode":
                t.store_node(v)
            elif a == "storeEdge":
                t.store_edge(v)
            elif a == "removeEdge":
                t.remove_edge(v["kind"], v["key"])
            elif v.get("key"):
                t.remove_node(v["kind"], v["key"])
            else:
                from ..operators.mutate import remove_nodes

                t.graph = remove_nodes(t.graph, t.graph.nodes[f.name].select(F.lit(f.name).alias("kind"), "key"))
        self.graph = t.commit()

    def items(self, f: Field) -> DataFrame:
        self.touched.add(f.name)
        df = self.graph.nodes[f.name]
        key = self.resolve(f.args.get("key"))
        if key is not None:
            df = df.where(F.col("key").cast("string") == str(key))
        cell = lambda a: column(F.col(f"`{a}`"), df.schema[a].dataType) if a in df.columns else None
        df = self.matching(df, f, cell)
        df, names = self.nested(df, f, f.name, "key")
        return self.limited(df.select(*[F.col(f"__{n}").alias(n) for n in names], F.col("key").cast("string").alias("__key")), f, names)

    def matching(self, df: DataFrame, f: Field, cell) -> DataFrame:
        for name, want in (self.resolve(f.args.get("matches")) or {}).items():
            negate = name.startswith("not_")
            v = cell(name[4:] if negate else name)
            if v is None:
                return df.limit(0)
            if isinstance(want, list):
                hit = printed(v).isin([str(w) for w in want])
            else:
                try:
                    re.compile(str(want))
                except re.error as e:
                    self.error(f"Regex {want} did not compile: {e}")
                    return df.limit(0)
                hit = printed(v).rlike(str(want))
            df = df.where(v.col.isNotNull() & (~hit if negate else hit))
        known = {"key", "matches", "traverse", "ascending", "descending", "last", "from", "items", "storeNode", "storeEdge", "removeNode", "removeEdge"}
        for a in sorted(set(f.args) - known):
            self.error(f"Unknown argument: {a}")
        return df

    def nested(self, df: DataFrame, f: Field, kind: str, key: str) -> tuple[DataFrame, list[str]]:
        """``df`` with ``__<alias>`` for each selected field."""
        names = []
        for x in self.fields(f.sub or [], kind):
            names.append(x.alias)
            if x.sub is None and "traverse" not in x.args:
                df = df.withColumn(f"__{x.alias}", F.lit(kind) if x.name == "kind" else F.col(f"`{x.name}`") if x.name in df.columns else F.lit(None).cast("string"))
                continue
            spec = self.resolve(x.args.get("traverse")) or f":::{x.name}"
            lists = self.lists(kind, spec, x)
            if lists is None:
                df = df.withColumn(f"__{x.alias}", F.array())
                continue
            joined = df.join(lists, F.col(key).cast("string") == F.col("__0owner").cast("string"), "left").drop("__0owner")
            df = joined.withColumn(f"__{x.alias}", F.coalesce("__0list", F.array().cast(joined.schema["__0list"].dataType))).drop("__0list")
        return df, names

    def lists(self, kind: str, spec: str, x: Field) -> DataFrame | None:
        """(__owner, __list) for all nodes of a kind: targets sorted by kind and key, repeated per edge."""
        found = self.graph.match([kind], spec)
        parts = []
        for target in sorted({e.spec(i)[3] for e, i in found} | {e.spec(2)[3] for e, i in found if e.symmetric}):
            self.touched.add(target)
            some = [(e, i) for e, i in found if e.spec(i)[3] == target]
            near = neighbours(self.graph, some, set(self.graph.attrs(target)), set(), "t", False)
            near = near.select(F.col("t_src").cast("string").alias("__src"), *[F.col("t_n_key" if a == "key" else f"`t_n_{a}`").alias(a) for a in self.graph.attrs(target)])
            near = self.matching(near, x, lambda a, d=near: column(F.col(f"`{a}`"), d.schema[a].dataType) if a in d.columns else None)
            near, names = self.nested(near, x, target, "key")
            parts.append((target, near.select("__src", F.lit(target).alias("__src_kind"), F.col("key").cast("string").alias("__src_key"), *[F.col(f"__{n}").alias(f"__{n}") for n in names]), names))
        if not parts:
            return None
        names = list(dict.fromkeys(n for _, _, ns in parts for n in ns))
        rows = parts[0][1]
        for _, p, _ in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        down, up = (self.resolve(x.args.get(k)) for k in ("descending", "ascending"))
        if down and up:
            raise GraphQLError("Cannot specify ascending and descending sorting")
        item = F.struct(*[F.col(f"__{n}").alias(n) for n in names])
        by = self.order_keys(F.col(f"__{up or down}")) if (up or down) in names else []
        entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(by)], F.col("__src_kind").alias("kind"), F.col("__src_key").alias("key"), item.alias("item"))
        last, start, count = (self.resolve(x.args.get(k)) for k in ("last", "from", "items"))
        most = int(last) if last is not None else int(start or 0) + int(count) if count else None
        if most:
            # Rows beyond those asked for are cut off before any list is built (by a partial limit before the shuffle, too).
            rows = rows.withColumn("__entry", entry)
            up_first = (last is not None) != (not down)
            w = Window.partitionBy("__src").orderBy(F.col("__entry").asc() if up_first else F.col("__entry").desc())
            rows = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")
            entry = F.col("__entry")
        got = F.sort_array(F.collect_list(entry), asc=not down)
        arr = F.transform(got, lambda e: e["item"])
        out = rows.groupBy(F.col("__src").alias("__0owner")).agg(arr.alias("__0list"))
        if last is not None:
            out = out.withColumn("__0list", F.slice("__0list", F.greatest(F.size("__0list") - last + 1, F.lit(1)), last))
        if start is not None or count is not None:
            begin = F.when(F.size("__0list") <= (start or 0), F.lit(0)).otherwise(F.lit(start or 0))
            out = out.withColumn("__0list", F.slice("__0list", begin + 1, F.lit(count or 0)))
        return out

    @staticmethod
    def order_keys(c: Column) -> list[Column]:
        s = F.coalesce(c.cast("string"), F.lit(NIL))
        n = F.when(s.rlike(r"^[+-]?\d{1,18}$"), s.try_cast("bigint"))
        return [n.isNull(), n, s]

    def limited(self, df: DataFrame, f: Field, names: list[str]) -> DataFrame:
        up, down, last, start, count = (self.resolve(f.args.get(k)) for k in ("ascending", "descending", "last", "from", "items"))
        if up and down:
            raise GraphQLError("Cannot specify ascending and descending sorting")
        keys = self.order_keys(F.col(f"`{up or down}`")) if (up or down) in names else []
        if last is None and start is None and count is None:
            return df.orderBy(*[k.desc() if down else k.asc() for k in keys]).drop("__key") if keys else df.drop("__key")
        # What is cut needs an order: the one asked for, and keys (as text) where that leaves ties or none is asked for.
        ascending = [*[k.desc() if down else k.asc() for k in keys], F.col("__key").asc()]
        descending = [*[k.asc() if down else k.desc() for k in keys], F.col("__key").desc()]
        if last is not None:
            df = df.orderBy(*descending).limit(last)
        df = df.orderBy(*ascending)
        if start is not None or count is not None:
            # From beyond the end starts over: the row number tells within the plan, on the rows that the limit leaves.
            start, count = start or 0, count or 0
            w = Window.orderBy(F.lit(0))
            head = df.limit(start + count).withColumn("__k", F.monotonically_increasing_id())
            head = head.withColumn("__k", F.row_number().over(w.orderBy("__k"))).withColumn("__n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            at = F.when(F.col("__n") > start, F.col("__k") - start).otherwise(F.col("__k"))
            df = head.where((at > 0) & (at <= count)).orderBy("__k").drop("__k", "__n")
        return df.drop("__key")


def run_graphql(graph: Graph, query: str, variables: dict | None = None, operation: str = "") -> dict:
    return Executor(graph, {"operationName": operation, "query": query, "variables": variables or {}}).data()


def introspect(graph: Graph) -> dict:
    """The catalogue in the shape of a schema."""
    fields = lambda k: [{"name": a} for a in graph.attrs(k)] + [{"name": s.split(":")[3], "spec": s} for s in graph.specs(k)]
    return {"__schema": {"queryType": {"name": "Query"}, "mutationType": {"name": "Mutation"}, "types": [{"kind": "OBJECT", "name": k, "fields": fields(k)} for k in graph.node_kinds()]}}
