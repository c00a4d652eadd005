"""Dynamic typing on typed columns: printed form, number test, comparison, truth.

A value is a number if its printed form parses as one; two values compare as numbers if both do, else as printed
strings; a missing value prints ``<nil>``.  Where a column's type settles the question the plain Spark comparison is
used, so that filters reach the scan.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NIL = "<nil>"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = {"inf": math.inf, "+inf": math.inf, "-inf": -math.inf, "infinity": math.inf, "+infinity": math.inf, "-infinity": -math.inf, "nan": math.nan}


def parse_number(s: str) -> float | None:
    if re.match(_NUMBER, s):
        return float(s)
    if s.lower() in _SPECIAL:
        return _SPECIAL[s.lower()]
    if re.match(r"^[+-]?0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?[0-9]+$", s):
        return float.fromhex(s)
    return None


def print_float(x: float) -> str:
    """Shortest form; exponents below -4 or from 21 on in scientific notation with two digits at least."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    digits, _, exp = f"{x:.17e}".partition("e")
    for p in range(17):
        if float(f"{x:.{p}e}") == x:
            digits, _, exp = f"{x:.{p}e}".partition("e")
            break
    e = int(exp)
    if -5 < e < 21:
        out = f"{x:.{max(0, len(digits.lstrip('-')) - 2 - e)}f}" if "." in digits else f"{x:.{max(0, -e)}f}"
        return out.rstrip("0").rstrip(".") if "." in out else out
    return f"{digits}e{'-' if e < 0 else '+'}{abs(e):02d}"


def show(v: Any) -> str:
    """Printed form of a plain value."""
    if v is None:
        return NIL
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return print_float(v)
    if isinstance(v, (list, tuple)):
        return "[" + " ".join(show(x) for x in v) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{show(x)}" for k, x in sorted(v.items())) + "]"
    return str(v)


@dataclass(frozen=True)
class Value:
    """A constant (``const`` set) or a column with its Spark type."""

    col: Column | None
    type: T.DataType | None
    const: Any = None
    items: tuple[Value, ...] | None = None
    never_null: bool = False

    @property
    def is_const(self) -> bool:
        return self.col is None

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def text(self) -> bool:
        return isinstance(self.type, (T.StringType, T.VarcharType, T.CharType))


def constant(v: Any) -> Value:
    return Value(None, None, v)


def column(c: Column, t: T.DataType) -> Value:
    return Value(c, t)


def printed(v: Value) -> Column:
    """Printed form as a column, never null."""
    if v.items is not None:
        return F.concat(F.lit("["), F.concat_ws(" ", *[printed(x) for x in v.items]), F.lit("]"))
    if v.is_const:
        return F.lit(show(v.const))
    return F.coalesce(_printed(v.col, v.type), F.lit(NIL))


def _printed(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return c
    if isinstance(t, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        plain = (F.abs(d) >= 1e-3) & (F.abs(d) < 1e7)
        exact = d.cast("decimal(38,18)").cast("string")
        trimmed = F.regexp_replace(F.regexp_replace(exact, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.when(whole, d.cast("bigint").cast("string")).when(plain, d.cast("string")).when(F.isnan(d), "NaN").when(F.abs(d) == math.inf, F.when(d > 0, "+Inf").otherwise("-Inf")).when(
            (F.abs(d) >= 1e-5) & (F.abs(d) < 1e20), trimmed
        ).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "e"), "E", "e"), r"e(-?)([0-9]+)", "e$1$2"))
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(_printed(x, t.elementType), F.lit(NIL))), " "), F.lit("]"))
    if isinstance(t, T.StructType):
        parts = [F.concat(F.lit(f.name + ":"), F.coalesce(_printed(c.getField(f.name), f.dataType), F.lit(NIL))) for f in sorted(t.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.concat(F.lit("map["), F.concat_ws(" ", *parts), F.lit("]")))
    return c.cast("string")


def number(v: Value) -> Column | None:
    """The value as a double, null where it isn't a number; None if it can't be one."""
    if v.items is not None:
        return None
    if v.is_const:
        n = None if v.const is None else parse_number(show(v.const))
        return None if n is None else F.lit(n)
    if v.numeric:
        return v.col if isinstance(v.type, T.IntegralType) else v.col.cast("double")
    if v.text:
        return F.when(v.col.rlike(_NUMBER), v.col.try_cast("double"))
    return None


def strict_number(v: Value, where: str) -> Column:
    """For arithmetic: what isn't a number is an error.

    The operand stands once in the plan wherever it may be nested: a result of arithmetic is a number as it is, and of
    numeric columns only null fails, whose printed form is known.
    """
    n = number(v)
    if n is not None and (v.is_const or v.never_null):
        return n.cast("double")
    shown = F.lit(NIL) if v.numeric else printed(v)
    error = F.raise_error(F.concat(F.lit(f"Value of operand is not a number ({where}="), shown, F.lit(")"))).cast("double")
    return error if n is None else F.coalesce(n.cast("double"), error)


def computed(c: Column, t: T.DataType) -> Value:
    """A result of arithmetic, which is never null."""
    return Value(c, t, never_null=True)


@dataclass(frozen=True)
class Test:
    """A predicate; ``raw`` may be null for false, which filters can push down."""

    raw: Column
    total: bool = True

    @property
    def sure(self) -> Column:
        return self.raw if self.total else F.coalesce(self.raw, F.lit(False))


_PY = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _op(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def compare(op: str, a: Value, b: Value) -> Test:
    if op == "!=":
        return Test(~compare("=", a, b).sure)
    na, nb = number(a), number(b)
    if a.is_const and b.is_const and a.items is None and b.items is None:
        x, y = (None if v.const is None else parse_number(show(v.const)) for v in (a, b))
        return Test(F.lit(_PY[op](x, y) if x is not None and y is not None else _PY[op](show(a.const), show(b.const))))
    if op == "=" and any(v.is_const and v.items is None and v.const is None for v in (a, b)):
        v = b if a.is_const else a
        return Test(v.col.isNull() if not v.text else v.col.isNull() | (v.col == NIL)) if v.col is not None else Test(F.lit(False))
    strings = lambda: _op(op, printed(a), printed(b))
    if na is None or nb is None:
        # One of them is never a number: strings.
        for v, w, flip in ((a, b, False), (b, a, True)):
            if w.is_const and w.items is None and v.text:
                c, k = v.col, F.lit(show(w.const))
                if not (_PY[op](show(w.const), NIL) if flip else _PY[op](NIL, show(w.const))):
                    return Test(_op(op, k, c) if flip else _op(op, c, k), total=False)
            if w.is_const and w.items is None and v.numeric and op == "=" and show(w.const) != NIL:
                return Test(F.lit(False))
        return Test(strings())
    sure_a = a.is_const or a.numeric
    sure_b = b.is_const or b.numeric
    if sure_a and sure_b:
        if a.is_const or b.is_const:
            nil = _PY[op](show(a.const), NIL) if a.is_const else _PY[op](NIL, show(b.const))
            # Written so that the scan takes all of it: no function around the column, NaN (the greatest to Spark) cut off by a bound.
            raw = _op(op, na, nb)
            other = b if a.is_const else a
            if isinstance(other.type, (T.DoubleType, T.FloatType)) and op in (("<", "<=") if a.is_const else (">", ">=")):
                raw = raw & (other.col <= F.lit(math.inf).cast(other.type))
            k = parse_number(show(a.const if a.is_const else b.const))
            if k is not None and math.isnan(k):
                raw = F.lit(False)
            if other.never_null:
                return Test(raw)
            return Test(raw | other.col.isNull()) if nil else Test(raw, total=False)
        if op == "=":
            return Test(na.eqNullSafe(nb))
    return Test(F.coalesce(_op(op, na, nb), strings()))


def truth(v: Value) -> Test:
    """bool: itself; float: above 0; string: number above 0 or not empty; missing: false; anything else: true."""
    if v.items is not None:
        return Test(F.lit(True))
    if v.is_const:
        c = v.const
        if isinstance(c, str):
            n = parse_number(c)
            return Test(F.lit(n > 0 if n is not None else bool(c)))
        if isinstance(c, float):
            return Test(F.lit(c > 0))
        return Test(F.lit(bool(c) if isinstance(c, bool) else c is not None))
    if isinstance(v.type, T.BooleanType):
        return Test(v.col, total=False)
    if isinstance(v.type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return Test(v.col > 0, total=False)
    if v.text:
        return Test(F.coalesce(number(v) > 0, v.col != ""), total=False)
    return Test(v.col.isNotNull())


def sort_keys(v: Value, descending: bool) -> list[Column]:
    """Numbers first and by value, then strings; missing sorts as its printed form does: after numbers."""
    n = number(v)
    cols: list[Column] = []
    if v.numeric:
        cols = [v.col.isNull(), v.col]
    elif n is None:
        cols = [printed(v)]
    else:
        cols = [n.isNull(), n, F.when(n.isNull(), printed(v))]
    return [c.desc() if descending else c.asc() for c in cols]


def display_name(s: str) -> str:
    """``RFC3339_value`` to ``Rfc3339 Value``: parts at underscores and dots, capitals first."""
    out = " ".join(w[:1].upper() + w[1:].lower() for w in s.split("_") if w)
    return re.sub(r"\.([a-z])", lambda m: "." + m.group(1).upper(), out)
