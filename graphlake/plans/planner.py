"""From a parsed query to a DataFrame: names are bound on the catalogue, steps become joins, clauses columns.

Steps are numbered in the order of their ``traverse`` keywords, the root being 1.  Only attributes a query names are
carried.  ``@count`` becomes one aggregate over all sources, joined once.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.dates import RFC3339, parse_date
from ..operators.nodes import NodeInfo
from ..operators.results import Result, unique
from ..operators.traverse import neighbours, zigzag
from ..sources.graph import ENDS, Edges, Graph
from .syntax import Node, QueryError, parse, pretty


@dataclass
class Step:
    number: int
    spec: str = ""
    where: list[Node] = field(default_factory=list)
    children: list[Step] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    edge_kinds: list[str] = field(default_factory=list)
    node_attrs: set[str] = field(default_factory=set)
    edge_attrs: set[str] = field(default_factory=set)
    types: dict[str, T.DataType] = field(default_factory=dict)
    token: object = None
    held: Edges | None = None  # the one edge set that fits, if the parent's rows hold its foreign key

    @property
    def kind(self) -> str:
        """The one kind the spec names, else empty."""
        return self.spec.split(":")[3] if self.spec else self.kinds[0]

    def col(self, side: str, attr: str) -> str:
        return f"s{self.number}_{side}_{attr}"


@dataclass(frozen=True)
class Shown:
    step: Step
    side: str
    attr: str
    label: str
    format: str = "auto"
    func: Node | None = None

    @property
    def data(self) -> str:
        return f"{self.step.number}:func:{self.func.value}()" if self.func else f"{self.step.number}:{self.side}:{self.attr}"


class Planner:
    def __init__(self, graph: Graph, tree: Node, info: NodeInfo | None = None):
        self.graph, self.tree = graph, tree
        self.info = info or NodeInfo(graph)
        self.all_attrs = graph.all_attrs()
        self.steps: list[Step] = []
        self.outer = False

    # --- reading the tree ---

    def read(self) -> None:
        kind = self.tree.children[0]
        if kind.value not in self.graph.nodes:
            raise QueryError("Unknown node kind", kind.value, kind.token)
        root = Step(1, "", kinds=[kind.value])
        self.steps.append(root)
        self.group = self.primary = None
        self.show: list[Node] | None = None
        self.directives: list[Node] = []
        for c in self.tree.children[1:]:
            if c.name == "where":
                if root.children or self.show is not None:
                    raise QueryError("Invalid construct", "condition must be before show clause and traversals", c.token)
                root.where.append(c.children[0])
            elif c.name == "traverse":
                if self.show is not None:
                    raise QueryError("Invalid construct", "traversals must be before show clause", c.token)
                root.children.append(self.step(c, root))
            elif c.name == "from":
                self.group = c.value
            elif c.name == "primary":
                self.primary = c.value
            elif c.name == "show":
                self.show = c.children
            elif c.name == "with":
                self.directives += c.children
        self.outer = any(d.name == "nulltraversal" and d.value == "true" for d in self.directives)

    def step(self, n: Node, parent: Step) -> Step:
        if n.value.count(":") != 3:
            raise QueryError("Invalid traversal spec", n.value, n.token)
        s = Step(len(self.steps) + 1, n.value, token=n.token)
        self.steps.append(s)
        found = self.graph.match(parent.kinds, n.value)
        s.kinds = sorted({e.spec(i)[3] for e, i in found} | {e.spec(2)[3] for e, i in found if e.symmetric})
        s.edge_kinds = sorted({e.kind for e, _ in found})
        if len(parent.kinds) == 1 and len(found) == 1 and found[0][0].owner == found[0][1] and found[0][0].fk and not found[0][0].symmetric:
            s.held = found[0][0]
            parent.node_attrs.add(s.held.fk)
        for c in n.children:
            if c.name == "where":
                if s.children:
                    raise QueryError("Invalid construct", "condition must be before show clause and traversals", c.token)
                s.where.append(c.children[0])
            else:
                s.children.append(self.step(c, s))
        return s

    # --- columns shown ---

    def shown(self) -> list[Shown]:
        out = []
        if not self.show:
            for s in self.steps:
                attrs = self.info.summary_attributes(s.kind)
                out += [Shown(s, "n", a, self.label(s.kind, a)) for a in attrs]
            return out
        for t in self.show:
            extra = {c.name: c.value for c in t.children if c.name in ("as", "format")}
            if t.name == "func":
                args = [c.value for c in t.children if c.name == "value"]
                if t.value not in ("count", "objget"):
                    raise QueryError("Invalid construct", f"Unknown function: {t.value}", t.token)
                if len(args) < 2:
                    raise QueryError("Invalid construct", f"{t.value} function requires at least 2 parameters", t.token)
                s = self.numbered(args[0], t)
                label = "Count" if t.value == "count" else V.display_name(f"{args[1]}.{args[2]}")
                out.append(Shown(s, "n", args[1], extra.get("as", label), extra.get("format", "auto"), t))
                continue
            s, side, attr = self.place(t)
            out.append(Shown(s, side, attr, extra.get("as", self.label(s.kind if side == "n" else s.spec.split(":")[1], attr)), extra.get("format", "auto")))
        return out

    def numbered(self, text: str, t: Node) -> Step:
        if not re.fullmatch(r"[+-]?\d+", text):
            raise QueryError("Invalid construct", f"Invalid data index: {t.value} ({text})", t.token)
        if int(text) < 1:
            raise QueryError("Invalid construct", f"Invalid data index: {t.value} (index must be greater than 0)", t.token)
        if int(text) > len(self.steps):
            raise QueryError("Invalid construct", f"Data index out of range: {text}", t.token)
        return self.steps[int(text) - 1]

    def place(self, t: Node) -> tuple[Step, str, str]:
        parts = t.value.split(":")
        if len(parts) == 1:
            return self.steps[0], "n", parts[0]
        if len(parts) == 2:
            for s in self.steps:
                if s.kind == parts[0]:
                    return s, "n", parts[1]
            for s in self.steps[1:]:
                if s.spec.split(":")[1] == parts[0]:
                    return s, "e", parts[1]
            raise QueryError("Invalid construct", f"Cannot determine column for summary: {t.value}", t.token)
        s = self.numbered(parts[0], t)
        if parts[1] not in ("n", "e"):
            raise QueryError("Invalid construct", f"Invalid data source '{parts[1]}' (either n - Node or e - Edge)", t.token)
        if parts[1] == "e" and s.number == 1:
            raise QueryError("Invalid construct", "No edge data available at this level", t.token)
        return s, parts[1], ":".join(parts[2:])

    def label(self, kind: str, attr: str) -> str:
        return self.info.attribute_display(kind, attr)

    # --- attributes needed ---

    def need(self, s: Step, n: Node) -> None:
        if n.name == "func":
            if n.value == "parseDate":
                for c in n.children:
                    self.need(s, c)
            return
        if n.name == "value":
            side, attr = self.bind(s, n)
            if side == "n":
                s.node_attrs.add(attr.split(".")[0] if not self.is_node_attr(s, attr) else attr)
            elif side == "e":
                s.edge_attrs.add(attr)
        for c in n.children:
            self.need(s, c)

    def is_node_attr(self, s: Step, attr: str) -> bool:
        return any(k in self.graph.nodes and attr in self.graph.nodes[k].columns for k in s.kinds) or attr in ("key", "kind")

    def bind(self, s: Step, n: Node) -> tuple[str, str]:
        """Node attribute (n), edge attribute (e) or literal (empty)."""
        low = n.value.lower()
        if low.startswith("attr:"):
            return "n", n.value[5:]
        if low.startswith("eattr:"):
            if s.number == 1:
                raise QueryError("Invalid construct", "No edge data available at this level", n.token)
            return "e", n.value[6:]
        if low.startswith("val:"):
            return "", n.value[4:]
        if n.value in self.all_attrs or "." in n.value and n.value.split(".")[0] in self.all_attrs and n.value.split(".")[0]:
            return "n", n.value
        return "", n.value

    # --- values ---

    def cell(self, s: Step, side: str, attr: str) -> V.Value:
        """An attribute of a step, null where its kind has none; dotted paths reach into structs."""
        name = s.col(side, attr)
        if name in s.types:
            return V.column(F.col(f"`{name}`"), s.types[name])
        head, *path = attr.split(".")
        v = s.types.get(s.col(side, head))
        if v is None or not path:
            return V.constant(None)
        c = F.col(f"`{s.col(side, head)}`")
        for p in path:
            if not isinstance(v, T.StructType) or p not in v.names:
                return V.constant(None)
            c, v = c.getField(p), v[p].dataType
        return V.column(c, v)

    def value(self, s: Step, n: Node) -> V.Value:
        if n.name == "value":
            side, attr = self.bind(s, n)
            return self.cell(s, side, attr) if side else V.constant(attr)
        if n.name in ("true", "false", "null"):
            return V.constant({"true": True, "false": False, "null": None}[n.name])
        if n.name == "list":
            return V.Value(None, None, None, tuple(self.value(s, c) for c in n.children))
        if n.name == "func":
            return self.function(s, n)
        if n.name in ("un+", "un-"):
            c = V.strict_number(self.value(s, n.children[0]), pretty(n.children[0]))
            return V.computed(-c if n.name == "un-" else c, T.DoubleType())
        if n.name in ("+", "-", "*", "/", "%", "//"):
            # Each operand is written once (the dividend of / twice), so that plans grow with the text of the query.
            a, b = (V.strict_number(self.value(s, c), pretty(c)) for c in n.children)
            if n.name in ("%", "//"):
                by_zero = F.raise_error(F.lit("integer divide by zero")).cast("bigint")
                return V.computed(F.coalesce(F.call_function("try_mod", a.cast("bigint"), b.cast("bigint")) if n.name == "%" else _div(a.cast("bigint"), b.cast("bigint")), by_zero), T.LongType())
            if n.name == "/":
                return V.computed(F.coalesce(F.try_divide(a, b), a * F.lit(float("inf"))), T.DoubleType())
            return V.computed({"+": a + b, "-": a - b, "*": a * b}[n.name], T.DoubleType())
        return V.column(self.test(s, n).sure, T.BooleanType())

    def function(self, s: Step, n: Node) -> V.Value:
        if n.value == "parseDate":
            text = V.printed(self.value(s, n.children[0]))
            layout = n.children[1].value if len(n.children) > 1 else RFC3339
            return V.column(parse_date(text, layout), T.LongType())
        if n.value == "count":
            return V.column(F.coalesce(F.col(self.count_column(s, n)), F.lit(0)), T.LongType())
        raise QueryError("Invalid construct", f"Unknown function: {n.value}", n.token)

    def test(self, s: Step, n: Node) -> V.Test:
        if n.name in ("and", "or"):
            a, b = self.test(s, n.children[0]), self.test(s, n.children[1])
            if _fallible(n.children[1]):
                x = F.when(a.sure, b.sure).otherwise(False) if n.name == "and" else F.when(a.sure, True).otherwise(b.sure)
                return V.Test(x)
            return V.Test(a.raw & b.raw if n.name == "and" else a.raw | b.raw, a.total and b.total)
        if n.name == "not":
            return V.Test(~self.test(s, n.children[0]).sure)
        if n.name in ("=", "!=", "<", "<=", ">", ">="):
            return V.compare(n.name, self.value(s, n.children[0]), self.value(s, n.children[1]))
        if n.name in ("in", "notin"):
            a, b = self.value(s, n.children[0]), self.value(s, n.children[1])
            if b.items is not None:
                tests = [V.compare("=", a, x) for x in b.items]
                hit = V.Test(F.lit(False))
                for t in tests:
                    hit = V.Test(hit.raw | t.raw, hit.total and t.total)
            elif b.col is not None and isinstance(b.type, T.ArrayType):
                hit = V.Test(F.coalesce(F.exists(b.col, lambda x: V.compare("=", a, V.column(x, b.type.elementType)).sure), F.lit(False)))
            else:
                raise QueryError("Value of operand is not a list", f"{pretty(n.children[1])}", n.token)
            return hit if n.name == "in" else V.Test(~hit.sure)
        if n.name in ("like", "contains", "containsnot", "beginswith", "endswith"):
            a, b = self.value(s, n.children[0]), self.value(s, n.children[1])
            if n.name == "like":
                if b.is_const:
                    regex = check_regex(V.show(b.const), n)
                    return V.Test(a.col.rlike(regex), total=False) if a.text and not re.search(regex, V.NIL) else V.Test(V.printed(a).rlike(regex))
                return V.Test(F.regexp_like(V.printed(a), V.printed(b)))
            fn = {"contains": "contains", "containsnot": "contains", "beginswith": "startswith", "endswith": "endswith"}[n.name]
            if a.text and b.is_const and n.name != "containsnot":
                k = V.show(b.const)
                if not {"contains": k in V.NIL, "beginswith": V.NIL.startswith(k), "endswith": V.NIL.endswith(k)}[n.name]:
                    return V.Test(getattr(a.col, fn)(F.lit(k)), total=False)
            hit = getattr(V.printed(a), fn)(V.printed(b))
            return V.Test(~hit if n.name == "containsnot" else hit)
        return V.truth(self.value(s, n))

    # --- @count: one aggregate for all sources ---

    def counts_in(self, n: Node) -> list[Node]:
        own = [n] if n.name == "func" and n.value == "count" else []
        return own + [x for c in n.children for x in self.counts_in(c)]

    def count_column(self, s: Step, n: Node) -> str:
        return f"s{s.number}_count_" + str(zlib.crc32(pretty(n).encode()))

    def add_count(self, df: DataFrame, s: Step, n: Node, args: list[str]) -> DataFrame:
        name = self.count_column(s, n)
        if name in df.columns:
            return df
        if args[0].count(":") != 3:
            raise QueryError("Invalid construct", f"Invalid spec: {args[0]}", n.token)
        found = self.graph.match(s.kinds, args[0])
        if not found:
            return df.withColumn(name, F.lit(0).cast("bigint"))
        t = Step(900 + s.number, args[0], kinds=sorted({e.spec(i)[3] for e, i in found} | {e.spec(2)[3] for e, i in found if e.symmetric}))
        cond = parse(f"get _ where {args[1]}").children[1].children[0] if len(args) > 1 and args[1] else None
        if cond is not None:
            self.need(t, cond)
        several = len(s.kinds) > 1
        near = neighbours(self.graph, found, t.node_attrs, t.edge_attrs, f"s{t.number}", several)
        t.types = {f.name: f.dataType for f in near.schema.fields}
        if cond is not None:
            near = near.where(self.test(t, cond).raw)
        keys = [f"s{t.number}_src", *([f"s{t.number}_srckind"] if several else [])]
        totals = near.groupBy(*keys).agg(F.count("*").alias(name))
        return df.join(totals, self.on(df, s, totals, t, several), "left").drop(*keys)

    def on(self, df: DataFrame, s: Step, right: DataFrame, t: Step, several: bool) -> Column:
        a, b = F.col(s.col("n", "key")), F.col(f"s{t.number}_src")
        if df.schema[s.col("n", "key")].dataType != right.schema[f"s{t.number}_src"].dataType:
            a, b = a.cast("string"), b.cast("string")
        return (a == b) & (F.col(s.col("n", "kind")) == F.col(f"s{t.number}_srckind")) if several else a == b

    # --- plan ---

    def run(self) -> Result:
        self.read()
        shown = self.shown()
        for x in shown:
            attr = x.attr if not x.func or x.func.value == "objget" else "key"
            target = x.step.node_attrs if x.side == "n" else x.step.edge_attrs
            target.add(attr if x.side == "e" or self.is_node_attr(x.step, attr) else attr.split(".")[0])
        for s in self.steps:
            for w in s.where:
                self.need(s, w)
        root = self.steps[0]
        df = self.filtered(self.root(root), root)
        df = self.expand(df, root)
        cols, sources = [], {}
        for i, x in enumerate(shown):
            v = self.shown_value(x)
            if x.func is not None and x.func.value == "count":
                args = [c.value for c in x.func.children if c.name == "value"]
                df = self.add_count(df, x.step, x.func, args[1:])
                v = V.column(F.coalesce(F.col(self.count_column(x.step, x.func)), F.lit(0)), T.LongType())
            cols.append((f"c{i + 1}", v))
        order = [F.col(f"`{s.col('n', 'key')}`").cast("string") for s in self.steps]
        keep = [F.col(f"`{s.col(side, a)}`") for s in self.steps for side, a in (("n", "key"), ("n", "kind"), *((("e", "key"), ("e", "kind")) if s.number > 1 else ()))]
        df = df.select(*[(v.col if v.col is not None else F.lit(V.show(v.const) if v.const is not None else None).cast("string")).alias(c) for c, v in cols], *keep)
        for (c, _), x in zip(cols, shown):
            if x.func is not None and x.func.value == "count":
                said = "q:lookup " + x.step.kinds[0] if len(x.step.kinds) == 1 else "q:lookup"
                sources[c] = F.concat(F.lit(said + ' "'), F.col(x.step.col("n", "key")).cast("string"), F.lit(f'" traverse {x.attr} end show 2:n:key'))
            else:
                sources[c] = F.concat_ws(":", F.lit(x.side), F.col(x.step.col(x.side, "kind")), F.col(x.step.col(x.side, "key")).cast("string"))
        names = [c for c, _ in cols]
        df = self.finish(df, shown, names, order)
        primary = self.primary or self.steps[0].kinds[0]
        return Result(df, names, [x.label for x in shown], [x.format for x in shown], [x.data for x in shown], primary, self.graph.partition, sources, [(x.step.number, x.step.kind if x.side == "n" else "") for x in shown])

    def shown_value(self, x: Shown) -> V.Value:
        if x.func is not None and x.func.value == "objget":
            args = [c.value for c in x.func.children if c.name == "value"]
            whole = self.cell(x.step, "n", args[1])
            return self.cell(x.step, "n", f"{args[1]}.{args[2]}") if isinstance(whole.type, T.StructType) else whole
        return self.cell(x.step, x.side, x.attr)

    def root(self, s: Step) -> DataFrame:
        kind = s.kinds[0]
        nodes = self.graph.nodes[kind]
        if self.tree.name == "lookup":
            keys = [c.value for c in self.tree.children[1:] if c.name == "value"]
            if len(set(keys)) == len(keys):
                nodes = nodes.where(_key_in(nodes, keys))
            else:
                table = self.graph.spark.createDataFrame([(k,) for k in keys], "__key string")
                nodes = nodes.join(F.broadcast(table), F.col("key").cast("string") == F.col("__key")).drop("__key")  # as many rows as the query has keys
        if self.group is not None:
            parts = []
            for e, i in self.graph.match(["group"], f":::{kind}"):
                parts.append(e.df.where(F.col(ENDS[i - 1]).cast("string") == self.group).select(F.col(ENDS[2 - i]).cast("string").alias("__member")))
            if not parts:
                nodes = nodes.limit(0)
            else:
                members = parts[0]
                for p in parts[1:]:
                    members = members.unionByName(p)
                how = "left_semi" if self.tree.name == "lookup" else "inner"
                nodes = nodes.join(members, F.col("key").cast("string") == F.col("__member"), how).drop("__member")
        attrs = sorted(a for a in s.node_attrs if a in nodes.columns and a not in ("key", "kind"))
        df = nodes.select(F.col("key").alias(s.col("n", "key")), F.lit(kind).alias(s.col("n", "kind")), *[F.col(f"`{a}`").alias(s.col("n", a)) for a in attrs])
        s.types = {f.name: f.dataType for f in df.schema.fields}
        return df

    def filtered(self, df: DataFrame, s: Step) -> DataFrame:
        for w in s.where:
            for n in self.counts_in(w):
                semi = self.semi(df, s, w, n)
                if semi is not None:
                    return self.filtered_rest(semi, s, w)
                df = self.add_count(df, s, n, [c.value for c in n.children])
            df = df.where(self.test(s, w).raw)
        return df

    def filtered_rest(self, df: DataFrame, s: Step, done: Node) -> DataFrame:
        for w in s.where:
            if w is not done:
                for n in self.counts_in(w):
                    df = self.add_count(df, s, n, [c.value for c in n.children])
                df = df.where(self.test(s, w).raw)
        return df

    def semi(self, df: DataFrame, s: Step, w: Node, n: Node) -> DataFrame | None:
        """``@count(spec) > 0`` and ``= 0`` as semi and anti join."""
        if w.name not in (">", "=") or w.children[0] is not n or w.children[1].name != "value" or w.children[1].value != "0" or len(n.children) != 1 or len(s.kinds) > 1:
            return None
        found = self.graph.match(s.kinds, n.children[0].value) if n.children[0].value.count(":") == 3 else []
        if not found:
            return None
        t = Step(900 + s.number, n.children[0].value)
        near = neighbours(self.graph, found, set(), set(), f"s{t.number}", False).select(f"s{t.number}_src")
        return df.join(near, self.on(df, s, near, t, False), "left_semi" if w.name == ">" else "left_anti")

    def expand(self, df: DataFrame, s: Step) -> DataFrame:
        if not s.children:
            return df
        if len(s.children) == 1:
            return self.joined(df, s, s.children[0], self.outer)
        row = f"__row{s.number}"
        df = df.withColumn(row, self.row_id(df))
        siblings, orders = [], []
        ends = [s.col("n", "key"), s.col("n", "kind"), *dict.fromkeys(s.col("n", c.held.fk) for c in s.children if c.held and c.held.fk != "key")]
        keys = df.select(row, *[F.col(f"`{c}`") for c in ends])
        for c in s.children:
            sub = self.joined(keys, s, c, False)
            sub = sub.drop(*ends)
            below = self.below(c)
            orders.append([F.col(f"`{x}`") for b in below for x in (f"s{b.number}_spec", f"s{b.number}_e_key") if x in sub.columns])
            siblings.append(sub)
        return zigzag(df, row, siblings, orders, self.outer)

    def row_id(self, df: DataFrame) -> Column:
        """A row is known by the keys of its steps and edges and its sibling position, whatever the partitioning."""
        parts = [c for c in df.columns if c.endswith(("_n_key", "_e_key", "_spec")) or c.startswith("__row")]
        return F.concat_ws("\x01", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x02")) for c in parts])

    def below(self, s: Step) -> list[Step]:
        return [s, *(x for c in s.children for x in self.below(c))]

    def joined(self, df: DataFrame, s: Step, c: Step, outer: bool) -> DataFrame:
        found = self.graph.match(s.kinds, c.spec)
        several = len(s.kinds) > 1
        tag = f"s{c.number}"
        if not found:
            c.types = {c.col("n", a): T.StringType() for a in ("key", "kind", *c.node_attrs)} | {c.col("e", a): T.StringType() for a in ("key", "kind", *c.edge_attrs)}
            out = df.select("*", *[F.lit(None).cast("string").alias(n) for n in [*c.types, f"{tag}_spec"]])
            out = out if outer else out.limit(0)
            for x in c.children:
                out = self.joined(out, c, x, outer)
            return out
        if c.held is not None and not (outer and c.where):
            return self.expand(self.followed(df, s, c, outer), c)
        near = neighbours(self.graph, found, c.node_attrs, c.edge_attrs, tag, several)
        c.types = {f.name: f.dataType for f in near.schema.fields}
        near = self.filtered(near, c)
        gone = [f"{tag}_src", *([f"{tag}_srckind"] if several else [])]
        out = df.join(near, self.on(df, s, near, c, several), "left" if outer else "inner").drop(*gone)
        return self.expand(out, c)

    def followed(self, df: DataFrame, s: Step, c: Step, outer: bool) -> DataFrame:
        """A step along a foreign key that the frontier's own rows hold: one join with the targets, or none."""
        e, tag, target = c.held, f"s{c.number}", c.kinds[0]
        fk = F.col(f"`{s.col('n', e.fk)}`")
        df = df if outer else df.where(fk.isNotNull())
        have = {f.name for f in self.graph.nodes[target].schema.fields} if target in self.graph.nodes else set()
        want = sorted(a for a in c.node_attrs if a not in ("key", "kind"))
        there = [a for a in want if a in have]
        known = lambda x, t="string": F.when(fk.isNotNull(), x).otherwise(F.lit(None).cast(t)) if outer else x
        own = F.concat(F.lit(e.prefix), F.col(f"`{s.col('n', 'key')}`").cast("string"))
        edge = {"spec": F.lit(":".join(e.spec(e.owner))), "e_key": own, "e_kind": F.lit(e.kind), "n_kind": F.lit(target)}
        out = df.withColumns({f"{tag}_{k}": known(v) for k, v in edge.items()} | {f"{tag}_n_key": fk} | {f"{tag}_e_{a}": F.lit(None).cast("string") for a in c.edge_attrs if a not in ("key", "kind")})
        if there:
            node = self.graph.nodes[target].select(F.col("key").alias("__k"), *[F.col(f"`{a}`").alias(f"{tag}_n_{a}") for a in there])
            same = fk == F.col("__k") if df.schema[s.col("n", e.fk)].dataType == node.schema["__k"].dataType else fk.cast("string") == F.col("__k").cast("string")
            out = out.join(node, same, "left").drop("__k")
        out = out.withColumns({f"{tag}_n_{a}": F.lit(None).cast("string") for a in want if a not in have})
        c.types = {f.name: f.dataType for f in out.schema.fields if f.name.startswith(f"{tag}_")}
        return self.filtered(out, c)

    # --- with ---

    def finish(self, df: DataFrame, shown: list[Shown], names: list[str], order: list[Column]) -> DataFrame:
        cell = lambda c: V.column(F.col(f"`{c}`"), df.schema[c].dataType)
        filters = [x for d in self.directives if d.name == "filtering" for x in d.children]
        for x in (f for f in filters if f.name == "isnotnull"):
            df = df.where(F.col(self.with_column(x, shown, names)).isNotNull())
        for x in (f for f in filters if f.name in ("unique", "uniquecount")):
            c = self.with_column(x, shown, names)
            df = unique(df, cell(c), order, "__n" if x.name == "uniquecount" else None)
            if x.name == "uniquecount":
                counted = F.concat(V.printed(cell(c)), F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))
                df = df.withColumn(c, counted).drop("__n")
        keys: list[Column] = []
        for x in reversed([x for d in self.directives if d.name == "ordering" for x in d.children]):
            keys += V.sort_keys(cell(self.with_column(x, shown, names)), x.name == "descending")
        return df.orderBy(*keys) if keys else df

    def with_column(self, x: Node, shown: list[Shown], names: list[str]) -> str:
        parts, hit = x.value.split(":"), None
        for c, s in zip(names, shown):
            if s.func is not None:
                if x.value == s.label:
                    hit = c
                continue
            kind = s.step.kind if s.side == "n" else s.step.spec.split(":")[1]
            if parts == [s.attr] or parts == [kind, s.attr] or parts[:2] == [str(s.step.number), s.side] and ":".join(parts[2:]) == s.attr:
                hit = c
        if hit is None:
            raise QueryError("Invalid construct", f"Cannot determine column for with term: {x.value}", x.token)
        return hit


def _div(x: Column, y: Column) -> Column:
    """Whole quotient towards zero, null where ``y`` is 0."""
    return F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint")))


def _key_in(nodes: DataFrame, keys: list[str]) -> Column:
    """Pushed down where keys are numbers and the literals are written as such numbers."""
    if isinstance(nodes.schema["key"].dataType, T.IntegralType):
        return F.col("key").isin([int(k) for k in keys if re.fullmatch(r"-?(0|[1-9]\d{0,17})", k) and k != "-0"])
    return F.col("key").cast("string").isin(keys)


def _fallible(n: Node) -> bool:
    if n.name in ("+", "-", "*", "/", "//", "%", "un+", "un-", "func"):
        return True
    if n.name == "like" and n.children[1].name == "value":
        return True
    return any(_fallible(c) for c in n.children)


def check_regex(s: str, n: Node) -> str:
    """The subset both regex dialects share: no look-around, no back-references."""
    if re.search(r"\\[1-9]|\(\?[=!<]", s):
        raise QueryError("Value of operand is not a valid regex", s, n.token)
    try:
        re.compile(s)
    except re.error as e:
        raise QueryError("Value of operand is not a valid regex", f"{s} - {e}", n.token) from None
    return s


def run_query(graph: Graph, text: str, info: NodeInfo | None = None) -> Result:
    return Planner(graph, parse(text), info).run()
