"""The functions that give one value: math, statistics, logic, lookup, text, dates, information."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.ranges import HOW, NARROW, below, below_both, folded
from ..sources.rows import asof, numbered, running
from . import syntax as S
from .compile import Cell, Compiler, Fn, Grid, Row, Unsupported, Vec, compared, criterion, fresh, function, join_key, lit
from .moving import Criterion, Moving, asking, comparable, criterion_of, criterion_of_literals, moving_states, pattern_matches
from .values import date, number, parsed, serial, stamp, text, truth, whole, wildcard


def simple(*names, kind="number", of=(), least=0):
    """A function of plain values; ``of`` converts the arguments, the last converter serves the rest."""

    def put(f):
        def run(c: Compiler, args, env):
            if len(args) < least:
                raise S.FormulaError("G-PARSE", f"{names[0]} needs {least} arguments")
            cells = [c.scalar(a, env) for a in args]
            values = [of[min(k, len(of) - 1)](x) for k, x in enumerate(cells)] if of else cells
            return Cell(f(*values), kind, const=all(x.const for x in cells))

        function(*names)(run)
        return f

    return put


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- math

simple("ABS", of=[number], least=1)(F.abs)
simple("SIGN", of=[number], least=1)(F.signum)
simple("SQRT", of=[number], least=1)(lambda x: F.when(x >= 0, F.sqrt(x)))
simple("LN", of=[number], least=1)(lambda x: F.when(x > 0, F.ln(x)))
simple("LOG10", of=[number], least=1)(lambda x: F.when(x > 0, F.log10(x)))
simple("LOG", of=[number], least=1)(lambda x, b=10.0: F.when((x > 0) & (_lit(b) > 0), F.log10(x) / F.log10(_lit(b))))
simple("PI")(lambda: F.pi())
simple("INT", of=[number], least=1)(lambda x: F.floor(x).cast("double"))
simple("MOD", of=[number], least=2)(lambda x, y: F.when(y != 0, x - y * F.floor(x / y)))
simple("POWER", of=[number], least=2)(F.pow)
simple("QUOTIENT", of=[number], least=2)(lambda x, y: F.when(y != 0, _trunc(x / y)))
simple("ROUNDDOWN", "TRUNC", of=[number], least=1)(lambda x, n=0.0: _trunc(_scaled(x, n)) / F.pow(F.lit(10.0), _lit(n)))
simple("ROUNDUP", of=[number], least=1)(lambda x, n=0.0: F.signum(x) * F.ceil(F.abs(_scaled(x, n))) / F.pow(F.lit(10.0), _lit(n)))
simple("MROUND", of=[number], least=2)(lambda x, m: F.when(m == 0, F.lit(0.0)).when(F.signum(x) * F.signum(m) >= 0, F.signum(x) * F.floor(F.abs(x / m) + 0.5) * F.abs(m)))


def _exp_of(x: float | None) -> float | None:
    try:
        return None if x is None else math.exp(x)
    except OverflowError:
        return math.inf


@F.arrow_udf(DoubleType())
def exponential(x: pa.Array) -> pa.Array:
    """As the C library has it, on which worksheets and databases agree to the last bit; the JVM's is off by one in a tenth of the cells."""
    return pa.array([_exp_of(v) for v in x.to_pylist()], pa.float64())


@function("EXP")
def _exp(c, args, env):
    if not args:
        raise S.FormulaError("G-PARSE", "EXP needs 1 arguments")
    cell = c.scalar(args[0], env)
    x = number(cell)
    return Cell(F.exp(x) if c.stepping else exponential(x), "number", const=cell.const)


def _trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


def _scaled(x: Column, n) -> Column:
    """Rounded where only the binary form of a decimal number is off."""
    return F.round(x * F.pow(F.lit(10.0), _lit(n)), 9)


@simple("ROUND", of=[number], least=1)
def _round(x, n=0.0):
    y = _scaled(x, n)
    return F.signum(y) * F.floor(F.abs(y) + 0.5) / F.pow(F.lit(10.0), _lit(n))


@simple("CEILING.MATH", of=[number], least=1)
def _ceiling(x, s=1.0, mode=0.0):
    s = F.abs(_lit(s))
    return F.when(s == 0, F.lit(0.0)).when((x < 0) & (_lit(mode) != 0), F.floor(x / s) * s).otherwise(F.ceil(x / s) * s)


@simple("FLOOR.MATH", of=[number], least=1)
def _floor(x, s=1.0, mode=0.0):
    s = F.abs(_lit(s))
    return F.when(s == 0, F.lit(0.0)).when((x < 0) & (_lit(mode) != 0), F.ceil(x / s) * s).otherwise(F.floor(x / s) * s)


# ---------------------------------------------------------------- aggregates


def _numbers(cells) -> list[Column]:
    """What an aggregate of numbers sees of some cells: numbers and dates; text, truth values and blanks aren't counted."""
    return [serial(c.col) if c.kind == "date" else c.col.cast("double") for c in cells if c.kind in ("number", "date")]


def aggregate(name: str, over, rows, combine, empty, kind="number"):
    """over: aggregate of an array's number columns; rows: of one row's columns; combine: of several arguments' results; empty: without numbers."""

    @function(name, whole=True)
    def run(c: Compiler, args, env):
        parts, const = [], True
        for a in args:
            if (m := c.moving(a, env)) is not None:
                const = False
                cols = _numbers(m.cells())
                how = {"MAX": "max", "MIN": "min", "PRODUCT": "product"}.get(name, "sum")
                parts.append(moving_states(c, m, {"s": (_together(name, cols), how)})["s"] if cols else F.lit(None).cast("double"))
                continue
            got = c.array(a, env)
            if got is None:
                x = c.scalar(a, env)
                const &= x.const
                parts.append(rows([number(x)]))
            elif isinstance(got, Row):
                const = False
                parts.append(rows(_numbers(got.cells)))
            else:
                cols = _numbers(got[1])
                parts.append(got[0].agg(over(cols)).scalar() if cols else F.lit(None).cast("double"))
        x = parts[0] if len(parts) == 1 else combine(parts)
        return Cell(x if empty is None else F.coalesce(x, F.lit(empty)), kind, const=const)


def _plus(cols):
    out = F.coalesce(cols[0], F.lit(0.0))
    for x in cols[1:]:
        out = out + F.coalesce(x, F.lit(0.0))
    return out


def _of(agg, join):
    """An aggregate over several columns from those of each."""
    return lambda cols: agg(cols[0]) if len(cols) == 1 else join([agg(x) for x in cols])


def _times(cols):
    out = F.coalesce(cols[0], F.lit(1.0))
    for x in cols[1:]:
        out = out * F.coalesce(x, F.lit(1.0))
    return out


def _most(cols):
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def _least(cols):
    return F.least(*cols) if len(cols) > 1 else cols[0]


def _count(cols):
    return _plus([x.isNotNull().cast("double") for x in cols])


def _together(name: str, cols) -> Column:
    """What one row of a range adds to an aggregate of numbers; null if it has none."""
    some = cols[0].isNotNull()
    for x in cols[1:]:
        some = some | x.isNotNull()
    return F.when(some, {"SUM": _plus, "PRODUCT": _times, "MAX": _most, "MIN": _least, "COUNT": _count}[name](cols))


aggregate("SUM", _of(F.sum, _plus), _plus, _plus, 0.0)
aggregate("PRODUCT", _of(F.product, _times), _times, _times, 0.0)
aggregate("MAX", _of(F.max, _most), _most, _most, 0.0)
aggregate("MIN", _of(F.min, _least), _least, _least, 0.0)
aggregate("COUNT", _of(lambda x: F.count(x).cast("double"), _plus), _count, _plus, 0.0)


def pooled(name: str, over, kind="number"):
    """An aggregate of all an argument's numbers together: several columns are stacked."""

    @function(name, whole=True)
    def run(c: Compiler, args, env):
        moving = [m for a in args if (m := c.moving(a, env)) is not None]
        if moving:
            if name != "AVERAGE" or len(args) > 1:
                raise Unsupported(f"{name} of a range that moves with the row")
            cols = _numbers(moving[0].cells())
            if not cols:
                return Cell(F.lit(None).cast("double"), kind)
            got = moving_states(c, moving[0], {"s": (_together("SUM", cols), "sum"), "n": (_count(cols), "sum")})
            return Cell(F.when(got["n"] > 0, got["s"] / got["n"]), kind)
        if len(args) > 1 or isinstance(got := c.array(args[0], env), Row):
            cells = got.cells if len(args) == 1 else [c.scalar(a, env) for a in args]
            cols = F.filter(F.array(*(number(x) for x in cells)), lambda v: v.isNotNull())
            if name == "AVERAGE":
                return Cell(F.when(F.size(cols) > 0, F.aggregate(cols, F.lit(0.0), lambda a, b: a + b) / F.size(cols)), kind)
            n = F.size(cols)
            if name == "MEDIAN":
                ordered = F.array_sort(cols)
                return Cell(F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2), kind)
            mean = F.aggregate(cols, F.lit(0.0), lambda a, b: a + b) / n
            spread = F.aggregate(F.transform(cols, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, b: a + b)
            less = 1 if name.endswith(".S") else 0
            var = F.when(n > less, spread / (n - less))
            return Cell(F.sqrt(var) if name.startswith("STDEV") else var, kind)
        if got is None:
            return c.scalar(args[0], env) if name in ("AVERAGE", "MEDIAN") else Cell(F.lit(None).cast("double"), kind, const=True)
        df, cells, _ = got
        cols = _numbers(cells)
        if not cols:
            return Cell(F.lit(None).cast("double"), kind, const=True)
        v = fresh("x")
        flat = df.select(cols[0].alias(v)) if len(cols) == 1 else df.select(F.explode(F.array(*cols)).alias(v))
        if name == "MEDIAN":
            return Cell(_quantile(flat.where(F.col(v).isNotNull()), v, F.lit(0.5)), kind, const=True)
        return Cell(flat.agg(over(F.col(v))).scalar(), kind, const=True)


#: Rows up to which one task merges a column's distinct values for a percentile; of more, the rows are numbered by a range sort.
MERGED_ROWS = 1_000_000


def _at_rank(placed, v: str, at):
    """The value at a place from 0 of numbered rows (_n); between two places, what lies between their values."""
    low = F.floor(at)
    near = placed.where(F.col("_n").between(low, F.ceil(at))).agg(F.min(v).alias("a"), F.max(v).alias("b"))
    return near.select(F.col("a") + (F.col("b") - F.col("a")) * (at - low)).scalar()


def _quantile(df, v: str, p):
    """p: a column, the same for all rows."""
    if df.limit(MERGED_ROWS + 1).count() <= MERGED_ROWS:
        n = df.agg(F.count("*")).scalar()
        ordered = df.agg(F.array_sort(F.collect_list(v)).alias("x"))  # at most MERGED_ROWS numbers
        at = p * (n - 1)
        value = lambda k: F.get("x", k.cast("int"))
        return ordered.select(F.when((p >= 0) & (p <= 1) & (n > 0), value(F.floor(at)) + (value(F.ceil(at)) - value(F.floor(at))) * (at - F.floor(at)))).scalar()
    placed = numbered(df.select(v), v, name="_n")
    return _at_rank(placed, v, F.when((p >= 0) & (p <= 1), p * placed.agg(F.max("_n")).scalar()))


pooled("AVERAGE", F.avg)
pooled("MEDIAN", None)
pooled("STDEV.S", F.stddev_samp)
pooled("STDEV.P", F.stddev_pop)
pooled("VAR.S", F.var_samp)
pooled("VAR.P", F.var_pop)


@function("COUNTA", whole=True)
def _counta(c, args, env):
    return _blank_count(c, args, env, lambda x: F.when(F.coalesce(x.cast("string"), F.lit("")) != "", 1), skip=False)


@function("COUNTBLANK", whole=True)
def _countblank(c, args, env):
    return _blank_count(c, args, env, lambda x: F.when(F.coalesce(x.cast("string"), F.lit("")) == "", 1), skip=True)


def _blank_count(c, args, env, test, skip):
    parts, own = [], False
    for a in args:
        if (m := c.moving(a, env)) is not None:
            own = True
            filled = moving_states(c, m, {"n": (_plus([F.when(F.coalesce(x.col.cast("string"), F.lit("")) != "", 1.0) for x in m.cells()]), "sum")})["n"]
            lo, hi = (F.lit(v) if k == "fixed" else F.col("_row") + v if k == "row" else v for k, v in (m.lo, m.hi))
            heads = F.when(F.least(lo, hi) < 0, len(m.columns)).otherwise(0)  # the header's cells
            filled = F.coalesce(filled, F.lit(0.0)) + heads
            parts.append((F.abs(hi - lo) + 1) * len(m.columns) - filled if skip else filled)
            continue
        got = c.array(a, env)
        if got is None:
            parts.append(F.coalesce(test(c.scalar(a, env).col), F.lit(0)).cast("double"))
        elif isinstance(got, Row):
            parts.append(_plus([F.coalesce(test(x.col), F.lit(0)).cast("double") for x in got.cells]))
        else:
            parts.append(got[0].agg(_plus([F.count(test(x.col)).cast("double") for x in got[1]])).scalar())
    return Cell(_plus(parts), "number", const=not own and not any(isinstance(c.array(a, env), Row) for a in args))


_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "<>": "<>"}


def _factors(node) -> list:
    """Of a product; two signs before a condition only make it a number."""
    if isinstance(node, S.Binary) and node.op == "*":
        return [*_factors(node.left), *_factors(node.right)]
    if isinstance(node, S.Unary) and node.op == "-" and isinstance(node.operand, S.Unary) and node.operand.op == "-":
        return _factors(node.operand.operand)
    return [node]


def _asks(c, node, env) -> bool:
    """Whether an expression has a cell of the fill row in it."""
    return c.filling and not c.scope.lifted and any(isinstance(n, S.Ref) and n.area.top is not None and not n.fixed[0] or isinstance(n, S.Struct) and n.part == "row" for n in S.walk(node))


def _product_by_row(c, args, env):
    """A product of conditions on ranges, some with a value of the row, and of ranges: a sum over the rows that meet them."""
    conditions, rest = [], None
    for f in [x for a in args for x in _factors(a)]:
        if isinstance(f, S.Binary) and f.op in _FLIPPED and _asks(c, f, env):
            left = not _asks(c, f.left, env)
            conditions.append((f.left, f.op, f.right) if left else (f.right, _FLIPPED[f.op], f.left))
        else:
            rest = f if rest is None else S.Binary("*", rest, f)
    vecs = [c.whole(r, env) for r, _, _ in conditions]
    if not all(isinstance(v, Vec) and len(v.columns) == 1 for v in vecs) or len({(id(v.sheet), v.lo, v.hi) for v in vecs}) > 1:
        raise Unsupported("conditions on ranges of different rows")
    v = vecs[0]
    inner = c.lifted(v.sheet, v.lo, v.hi)
    x = number(inner.scalar(rest, env)) if rest is not None else F.lit(1.0)
    points = inner.scope.build().withColumn("_x", x)
    asked = [(y.cells()[0], Criterion(op, c.scalar(node, env))) for y, (_, op, node) in zip(vecs, conditions, strict=True)]
    return _asked(c, points, asked, F.col("_x"), "SUM")


@function("SUMPRODUCT", whole=True)
def _sumproduct(c, args, env):
    if any(_asks(c, f, env) for a in args for f in _factors(a)):
        return _product_by_row(c, args, env)
    vecs = [c.eval(a, env) if isinstance(a, (S.Ref, S.Struct, S.Name)) else None for a in args]
    if len(args) == 1 or (all(isinstance(v, Vec) for v in vecs) and len({(id(v.sheet), v.lo, v.hi) for v in vecs}) == 1):
        if len(args) == 1:
            df, cells, _ = c.array(args[0], env)
            return Cell(F.coalesce(df.agg(_plus([F.sum(number(x)) for x in cells if x.kind in ("number", "date")])).scalar(), F.lit(0.0)), "number", const=True)
        cols = [v.cells()[0] for v in vecs]
        x = F.lit(1.0)
        for v in cols:
            x = x * (F.coalesce(v.col.cast("double"), F.lit(0.0)) if v.kind == "number" else F.lit(0.0))
        return Cell(F.coalesce(vecs[0].frame().agg(F.sum(x)).scalar(), F.lit(0.0)), "number", const=True)
    product = args[0]
    for a in args[1:]:
        product = S.Binary("*", product, a)
    return _sumproduct(c, [product], env)


# ---------------------------------------------------------------- conditional aggregates


#: Aggregate -> its states, each a column of the value (or of 1) and how it is summed up.
_PARTS = {"SUM": {"s": "sum"}, "AVERAGE": {"s": "sum", "n": "sum"}, "MAX": {"s": "max"}, "MIN": {"s": "min"}, "COUNT": {"n": "sum"}}


def _finished(what: str, got: dict[str, Column]) -> Column:
    if what == "AVERAGE":
        return F.when(got["n"] > 0, got["s"] / got["n"])
    return F.coalesce(got["n" if what == "COUNT" else "s"], F.lit(0.0))


def _resolved(c: Compiler, q: Criterion) -> Criterion:
    """A criterion that is the same for all rows but no literal, with its value: it may hold operators and wildcards."""
    if q.value.const and q.value.value is None and q.value.kind == "text":
        (v,) = c.book.spark.range(1).select(text(q.value)).first()
        return Criterion(q.op, lit(v or ""))
    return q


def _met(target: Cell, q: Criterion) -> Column:
    """Whether a cell meets a criterion that is the same for all rows."""
    v = q.value
    if isinstance(v.value, str):
        return criterion(target, lit(("" if q.op == "=" and not v.value else q.op) + v.value))
    if q.op == "=":
        return criterion(target, v)
    pair = comparable(target, v)
    if pair is None:
        return F.lit(q.op == "<>")
    x, y = pair
    return F.coalesce({"<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[q.op], F.lit(q.op == "<>"))


def conditional(c: Compiler, env, value, pairs, what: str):
    """An aggregate of the value column over the rows that meet all (range, criterion) pairs."""
    get = lambda node: c.moving(node, env) or c.whole(node, env)
    ranges = [get(r) for r, _ in pairs]
    target = ranges[0]
    values = get(value) if value is not None else target
    if not isinstance(target, (Vec, Grid, Moving)):
        raise Unsupported("criteria need a range")
    for r in [*ranges, values]:
        differs = not target.same_rows(r) if isinstance(target, Moving) else isinstance(r, Moving) or (isinstance(target, Vec) and isinstance(r, Vec) and (r.sheet is not target.sheet or (r.lo, r.hi) != (target.lo, target.hi)))
        if differs:
            raise S.FormulaError("C-SHAPE", "ranges of criteria differ")
    asked = [_resolved(c, criterion_of(c, x, env)) for _, x in pairs]
    cells = [r.cells()[0] for r in ranges]
    of = values.cells()[0]
    x = of.col.cast("double") if of.kind == "number" else serial(of.col) if of.kind == "date" else F.lit(None).cast("double")
    moving = target if isinstance(target, Moving) else None
    points = moving.sheet.rows() if moving else target.frame()
    fixed = [_met(cell, q) for cell, q in zip(cells, asked, strict=True) if q.value.const]
    if moving and len(fixed) == len(asked):  # only the range moves: what doesn't meet the criteria adds nothing
        for y in fixed:
            x = F.when(y, F.lit(1.0) if what == "COUNT" else x) if y is fixed[0] else F.when(y, x)
        numbers = {"s": x, "n": x if what == "COUNT" else F.when(x.isNotNull(), 1.0)}
        return Cell(_finished(what, moving_states(c, moving, {n: (numbers[n], h) for n, h in _PARTS[what].items()})), "number")
    for y in fixed:
        points = points.where(y)
    return _asked(c, points, [(cell, q) for cell, q in zip(cells, asked, strict=True) if not q.value.const], x, what, moving)


def _asked(c: Compiler, points, conditions: list[tuple[Cell, Criterion]], x: Column, what: str, moving: Moving | None = None) -> Cell:
    """The aggregate of x over the points that meet each row's conditions."""
    numbers = {"s": x, "n": F.lit(1.0) if what == "COUNT" else F.when(x.isNotNull(), 1.0)}
    how = {n: h for n, h in _PARTS[what].items()}
    if moving and moving.lo[0] == moving.hi[0] == "row" and abs(moving.hi[1] - moving.lo[1]) < NARROW and not any(q.pattern for _, q in conditions):
        return Cell(_finished(what, _near(c, points, conditions, {n: (numbers[n], h) for n, h in how.items()}, moving)), "number")
    equal, order, differ, pattern = [], [], [], []
    for cell, q in conditions:
        if q.op == "=" and not q.pattern:
            q = _with_signs(c, cell, q)
        if q.pattern:
            if cell.kind != "text":
                raise Unsupported("a pattern over cells that are no text")
            (differ if q.op == "<>" else pattern).append((cell, q))
        elif q.op in ("=", "<>"):
            if cell.kind != q.value.kind and {cell.kind, q.value.kind} != {"number", "date"}:
                raise Unsupported("criteria of another type than their range")
            (equal if q.op == "=" else differ).append((cell, q))
        else:
            pair = comparable(cell, q.value)
            if pair is None:
                raise Unsupported("an order between cells of two types")
            order.append((*pair, q.op))
    if moving:
        (lo_kind, lo), (hi_kind, hi) = moving.lo, moving.hi
        a, b = (F.lit(v) if k == "fixed" else F.col("_row") + v if k == "row" else v for k, v in (moving.lo, moving.hi))
        at = F.col("_row").cast("double")
        if lo_kind == "fixed" and hi_kind == "row" and lo <= hi:
            points = points.where(F.col("_row") >= lo)
            order.append((at, b.cast("double"), "<="))
        else:
            order += [(at, F.least(a, b).cast("double"), ">="), (at, F.greatest(a, b).cast("double"), "<=")]
    return Cell(_finished(what, _states(c, points, {n: (numbers[n], h) for n, h in how.items()}, equal, order, pattern, differ)), "number")


def _near(c: Compiler, points, conditions, values, moving: Moving) -> dict[str, Column]:
    """Of a narrow window: each row meets its few positions by an equi-join, and the conditions are tried there."""
    name = fresh()
    states = {f"{name}{n}": h for n, (_, h) in values.items()}
    lo, hi = sorted((moving.lo[1], moving.hi[1]))
    tests, wants, theirs = [], [], []
    for k, (cell, q) in enumerate(conditions):
        pair = (join_key(cell), join_key(q.value)) if q.op in ("=", "<>") and cell.kind == q.value.kind else comparable(cell, q.value)
        if pair is None:
            raise Unsupported("criteria of another type than their range")
        theirs.append(pair[0].alias(f"{name}p{k}"))
        wants.append(pair[1].alias(f"{name}q{k}"))
        a, b = F.col(f"{name}p{k}"), F.col(f"{name}q{k}")
        met = {"=": a == b, "<>": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[q.op]
        tests.append(~F.coalesce(met, F.lit(False)) if q.op == "<>" else F.coalesce(met, F.lit(False)))
    given = points.select(F.col("_row").alias(f"{name}at"), *theirs, *(v.alias(f"{name}{n}") for n, (v, _) in values.items()))

    def join(df):
        asked = asking(c, df, F.col("_row").alias("_id"), *wants, F.explode(F.sequence(F.col("_row") + lo, F.col("_row") + hi)).alias(f"{name}at"))
        met = asked.join(given, f"{name}at")
        for t in tests:
            met = met.where(t)
        return df.join(folded(met, ["_id"], states).withColumnRenamed("_id", "_row"), "_row", "left")

    c.scope.joins.append(join)
    return {n: F.col(f"{name}{n}") for n in values}


def _with_signs(c: Compiler, cell: Cell, q: Criterion) -> Criterion:
    """A text cell as a criterion may itself hold wildcards; operators in cells are refused rather than read as text."""
    if cell.kind != "text" or q.value.kind != "text" or not q.value.plain or c.scope.frame is None or c.scope.joins:
        return q
    odd = c.scope.frame.where(q.value.col.rlike(r"[*?~]|^[<>=]")).select(q.value.col.rlike("^[<>=]")).limit(1).first()
    if odd is not None and c.scope.frame.where(q.value.col.rlike("^[<>=]")).limit(1).count():
        raise Unsupported("criteria cells that begin with an operator")
    return q if odd is None else Criterion(q.op, q.value, True)


def _states(c: Compiler, points, values: dict[str, tuple[Column, str]], equal, order, pattern, differ) -> dict[str, Column]:
    """Columns of the fill row with each state of the points that meet its conditions."""
    if differ:  # all, less those that are equal
        (cell, q), rest = differ[0], differ[1:]
        if all(h == "sum" for _, h in values.values()):
            all_ = _states(c, points, values, equal, order, pattern, rest)
            same = _states(c, points, values, equal if q.pattern else [*equal, (cell, q)], order, [*pattern, (cell, q)] if q.pattern else pattern, rest)
            return {n: F.coalesce(all_[n], F.lit(0.0)) - F.coalesce(same[n], F.lit(0.0)) for n in values}
        if rest or order or pattern or q.pattern:
            raise Unsupported("the greatest or least of what differs, with further conditions")
        return _of_others(c, points, values, equal, cell, q)
    name = fresh()
    states = {f"{name}{n}": h for n, (_, h) in values.items()}
    out = {n: F.col(f"{name}{n}") for n in values}
    mine = [v.alias(f"{name}{n}") for n, (v, _) in values.items()]
    keys = [f"{name}k{k}" for k in range(len(equal))]
    theirs = [join_key(cell).alias(k) for (cell, _), k in zip(equal, keys, strict=True)]
    asks_ = [join_key(q.value) if q.value.kind == cell.kind else number(q.value) for cell, q in equal]
    asks = [a.alias(k) for a, k in zip(asks_, keys, strict=True)]
    if pattern:
        if len(pattern) > 1 or order:
            raise Unsupported("a pattern of the row with further conditions of order")
        cell, q = pattern[0]
        texts = points.select(*theirs, cell.col.alias("_text"), *mine)

        def join(df):
            own = df.withColumns({**{k: a for k, a in zip(keys, asks, strict=True)}, "_pattern": F.lower(text(q.value))})
            distinct = asking(c, df, *(a.alias(k) for k, a in zip(keys, asks_, strict=True)), F.lower(text(q.value)).alias("_pattern")).distinct()
            got = pattern_matches(texts, distinct, "_text", states, keys)
            return own.join(got, [*keys, "_pattern"], "left").drop(*keys, "_pattern")

        c.scope.joins.append(join)
    elif order:
        if len(order) > 2:
            raise Unsupported("more than two conditions of order from the row")
        given = points.select(*theirs, *(p.alias(f"{name}o{k}") for k, (p, _, _) in enumerate(order)), *mine)
        wants = [a.alias(f"{name}o{k}") for k, (_, a, _) in enumerate(order)]

        def join(df):
            asked = asking(c, df, F.col("_row").alias("_id"), *asks, *wants)
            if len(order) == 1:
                got = below(given, asked, keys, f"{name}o0", order[0][2], states)
            else:
                got = below_both(given, asked, keys, (f"{name}o0", order[0][2]), (f"{name}o1", order[1][2]), states)
            return df.join(got.withColumnRenamed("_id", "_row"), "_row", "left")

        c.scope.joins.append(join)
    elif equal:  # one grouped aggregate for all rows, joined
        grouped = folded(points.select(*theirs, *mine), keys, states)
        c.scope.joins.append(lambda df: df.withColumns(dict(zip(keys, asks, strict=True))).join(grouped, keys, "left").drop(*keys))
    else:
        total = points.agg(*(HOW[h](v).alias(f"{name}{n}") for n, (v, h) in values.items()))
        return {n: total.select(f"{name}{n}").scalar() for n in values}
    return out


def _of_others(c: Compiler, points, values, equal, cell, q) -> dict[str, Column]:
    """The greatest or least over the rows that differ from the row's value: of each key the best, and the best of its other values."""
    name = fresh()
    (n, (v, how)), *_ = values.items()
    keys = [f"{name}k{k}" for k in range(len(equal))] or [f"{name}k"]
    theirs = [join_key(cell_).alias(k) for (cell_, _), k in zip(equal, keys, strict=True)] if equal else [F.lit(0).alias(keys[0])]
    asks = [join_key(q_.value) for _, q_ in equal] or [F.lit(0)]
    best = folded(points.select(*theirs, join_key(cell).alias("_of"), v.alias("_v")), [*keys, "_of"], {"_v": how}).where("_v IS NOT NULL")
    top = best.groupBy(*keys).agg((F.max_by if how == "max" else F.min_by)(F.struct("_of", "_v"), "_v").alias("_top"))
    second = best.join(top, keys).where(~F.col("_of").eqNullSafe(F.col("_top._of"))).groupBy(*keys).agg(HOW[how]("_v").alias(f"{name}b"))
    both = top.join(second, keys, "left").select(*keys, F.col("_top._of").alias(f"{name}of"), F.col("_top._v").alias(f"{name}a"), f"{name}b")
    own = join_key(q.value)
    c.scope.joins.append(lambda df: df.withColumns(dict(zip(keys, asks, strict=True))).join(both, keys, "left").withColumn(f"{name}v", F.when(F.col(f"{name}of").eqNullSafe(own), F.col(f"{name}b")).otherwise(F.col(f"{name}a"))).drop(*keys, f"{name}of", f"{name}a", f"{name}b"))
    return {n: F.col(f"{name}v")}


def _pairs(args):
    if not args or len(args) % 2:
        raise S.FormulaError("G-PARSE", "criteria come in pairs")
    return list(zip(args[::2], args[1::2], strict=True))


for _name, _what in (("SUMIFS", "SUM"), ("AVERAGEIFS", "AVERAGE"), ("MAXIFS", "MAX"), ("MINIFS", "MIN")):
    function(_name, whole=True)(lambda c, args, env, w=_what: conditional(c, env, args[0], _pairs(args[1:]), w))
function("COUNTIFS", whole=True)(lambda c, args, env: conditional(c, env, None, _pairs(args), "COUNT"))
function("COUNTIF", whole=True)(lambda c, args, env: conditional(c, env, None, _pairs(args[:2]), "COUNT"))
function("SUMIF", whole=True)(lambda c, args, env: conditional(c, env, args[2] if len(args) > 2 else args[0], _pairs(args[:2]), "SUM"))
function("AVERAGEIF", whole=True)(lambda c, args, env: conditional(c, env, args[2] if len(args) > 2 else args[0], _pairs(args[:2]), "AVERAGE"))


# ---------------------------------------------------------------- statistics


def _flat(c, node, env, positioned=False):
    """(frame, column of numbers, row order) of an argument."""
    df, cells, key = c.array(node, env, positioned)
    v = fresh("x")
    cols = _numbers(cells)
    if len(cols) == 1:
        return df.select(cols[0].alias(v), key.alias(v + "k")).where(F.col(v).isNotNull()), v
    return df.select(F.explode(F.array(*cols)).alias(v), key.alias(v + "k")).where(F.col(v).isNotNull()), v


@function("MODE.SNGL", whole=True)
def _mode(c, args, env):
    df, v = _flat(c, args[0], env)
    counted = df.groupBy(v).agg(F.count("*").alias("n"), F.min(v + "k").alias("first")).where("n > 1")
    most = counted.agg(F.max("n")).scalar()
    return Cell(counted.where(F.col("n") == most).agg(F.min_by(v, "first")).scalar(), "number", const=True)


def _nth(largest):
    def run(c, args, env):
        df, v = _flat(c, args[0], env)
        k = c.scalar(args[1], env)
        if not isinstance(k.value, (int, float)):
            if not k.const:
                raise Unsupported("LARGE and SMALL take one k for all rows")
            placed = numbered(df.select(v), F.desc(v) if largest else F.asc(v), name="_n")
            return Cell(_at_rank(placed, v, F.floor(number(k)) - 1), "number", const=True)
        n = int(k.value)
        top = df.orderBy(F.desc(v) if largest else F.asc(v)).limit(n)
        got = top.agg(F.when(F.count("*") == n, F.min(v) if largest else F.max(v))).scalar()
        return Cell(got, "number", const=True)

    return run


function("LARGE", whole=True)(_nth(True))
function("SMALL", whole=True)(_nth(False))


def _percentile(c, args, env, scale):
    df, v = _flat(c, args[0], env)
    p = c.scalar(args[1], env)
    if not isinstance(p.value, (int, float)) and not p.const:
        raise Unsupported("a percentile takes one share for all rows")
    return Cell(_quantile(df, v, (F.lit(float(p.value)) if isinstance(p.value, (int, float)) else number(p)) / scale), "number", const=True)


function("PERCENTILE.INC", whole=True)(lambda c, args, env: _percentile(c, args, env, 1))
function("QUARTILE.INC", whole=True)(lambda c, args, env: _percentile(c, args, env, 4))


@function("CORREL", whole=True)
def _correl(c, args, env):
    a, b = (c.eval(x, env) for x in args[:2])
    if not (isinstance(a, (Vec, Grid)) and isinstance(b, (Vec, Grid)) and len(a.cells()) == len(b.cells()) == 1):
        raise Unsupported("CORREL takes two ranges of one column")
    if not (isinstance(a, Vec) and isinstance(b, Vec) and a.sheet is b.sheet and (a.lo, a.hi) == (b.lo, b.hi)):
        name = fresh()
        x, y = (F.when(F.lit(v.cells()[0].kind == "number"), v.cells()[0].col.cast("double")) for v in (a, b))
        left, right = a.placed().select("_row", x.alias(name + "x"), F.lit(1).alias("_a")), b.placed().select("_row", y.alias(name + "y"), F.lit(1).alias("_b"))
        both = left.join(right, "_row", "full")  # place by place; ranges of two lengths are an error
        return Cell(both.agg(F.when(F.count("_a") == F.count("_b"), F.corr(name + "x", name + "y"))).scalar(), "number", const=True)
    return Cell(a.frame().agg(F.corr(a.cells()[0].col.cast("double"), b.cells()[0].col.cast("double"))).scalar(), "number", const=True)


def _rank(average):
    def run(c, args, env):
        x = c.scalar(args[0], env)
        df, v = _flat(c, args[1], env)
        up = len(args) > 2 and bool(c.scalar(args[2], env).value)
        name = fresh()
        # ranks of distinct values: counts before them, by a range sort rather than one sorted partition
        counts = df.groupBy(v).agg(F.count("*").alias("n"))
        ranked = running(counts, F.col("n"), "upto", F.asc(v) if up else F.desc(v))
        first = F.col("upto") - F.col("n") + 1
        rank = ranked.select(F.col(v).alias(name + "v"), (first + (F.col("n") - 1) / 2 if average else first).cast("double").alias(name))
        if x.const:
            return Cell(rank.where(F.col(name + "v") == number(x)).agg(F.max(name)).scalar(), "number", const=True)
        c.scope.joins.append(lambda d: d.withColumn(name + "m", number(x)).join(rank, F.col(name + "m") == F.col(name + "v"), "left").drop(name + "v", name + "m"))
        return Cell(F.col(name), "number")

    return run


function("RANK.EQ", whole=True)(_rank(False))
function("RANK.AVG", whole=True)(_rank(True))


# ---------------------------------------------------------------- logic


def _same(cells):
    kinds = {x.kind for x in cells}
    kind = cells[0].kind if len(kinds) == 1 else "text" if "text" in kinds else "number"
    conv = {"text": text, "number": number, "date": lambda x: x.col, "bool": lambda x: x.col}[kind]
    return kind, [conv(x) for x in cells]


@function("IF")
def _if(c, args, env):
    t = c.scalar(args[0], env)
    a = c.scalar(args[1], env)
    b = c.scalar(args[2], env) if len(args) > 2 else lit(False)
    kind, (x, y) = _same([a, b])
    q = truth(t)
    return Cell(F.when(q, x).when(~q, y), kind, const=t.const and a.const and b.const)


@function("IFS")
def _ifs(c, args, env):
    tests, values = [c.scalar(a, env) for a in args[::2]], [c.scalar(a, env) for a in args[1::2]]
    kind, cols = _same(values)
    out = F.when(truth(tests[0]), cols[0])
    for t, x in zip(tests[1:], cols[1:], strict=True):
        out = out.when(truth(t), x)
    return Cell(out, kind, const=all(x.const for x in [*tests, *values]))


@function("SWITCH")
def _switch(c, args, env):
    x = c.scalar(args[0], env)
    rest = [c.scalar(a, env) for a in args[1:]]
    other = rest.pop() if len(rest) % 2 else None
    kind, cols = _same([*rest[1::2], *([other] if other else [])])
    out = None
    for k, v in enumerate(rest[::2]):
        hit = compared("=", x, v)
        out = F.when(hit, cols[k]) if out is None else out.when(hit, cols[k])
    return Cell(out.otherwise(cols[-1]) if other else out, kind, const=x.const and all(v.const for v in rest))


@function("IFERROR", "IFNA")
def _iferror(c, args, env):
    a, b = c.scalar(args[0], env), c.scalar(args[1], env)
    if a.plain:
        return a
    kind, (x, y) = _same([a, b])
    return Cell(F.coalesce(x, y), kind, const=a.const and b.const)


def _truths(c, args, env, over, rows):
    parts, const = [], True
    for a in args:
        got = c.array(a, env)
        if got is None:
            x = c.scalar(a, env)
            const &= x.const
            parts.append(truth(x))
        elif isinstance(got, Row):
            const = False
            parts += [truth(x) for x in got.cells]
        else:
            parts += [got[0].agg(over(truth(Cell(x.col, x.kind)))).scalar() for x in got[1] if x.kind != "text"]
    return Cell(rows(parts), "bool", const=const)


def _fold(op):
    def run(parts):
        out = parts[0]
        for x in parts[1:]:
            out = op(out, x)
        return out

    return run


function("AND", whole=True)(lambda c, a, e: _truths(c, a, e, F.bool_and, _fold(lambda x, y: x & y)) if c.scope.lifted is False else _and_lifted(c, a, e, True))
function("OR", whole=True)(lambda c, a, e: _truths(c, a, e, F.bool_or, _fold(lambda x, y: x | y)) if c.scope.lifted is False else _and_lifted(c, a, e, False))
function("XOR", whole=True)(lambda c, a, e: _truths(c, a, e, lambda x: F.count_if(x) % 2 == 1, _fold(lambda x, y: x != y)))


def _and_lifted(c, args, env, all_):
    cells = [c.scalar(a, env) for a in args]
    return Cell(_fold((lambda x, y: x & y) if all_ else (lambda x, y: x | y))([truth(x) for x in cells]), "bool", const=all(x.const for x in cells))


simple("NOT", kind="bool", of=[truth], least=1)(lambda x: ~x)
function("TRUE")(lambda c, a, e: lit(True))
function("FALSE")(lambda c, a, e: lit(False))


@function("LET")
def _let(c, args, env):
    env = dict(env)
    for name, value in zip(args[:-1:2], args[1:-1:2], strict=True):
        env[name.name.casefold()] = c.eval(value, env) if c.scope.lifted or not _lifts(c, value, env) else c.grid(value, env)
    return c.eval(args[-1], env)


def _lifts(c, node, env):
    return not isinstance(node, (S.Ref, S.Struct, S.Name)) and not (isinstance(node, S.Call) and node.name in ("LAMBDA",)) and c.has_range(node, env) is not None


@function("LAMBDA")
def _lambda(c, args, env):
    return Fn([a.name.casefold() for a in args[:-1]], args[-1], env)


# ---------------------------------------------------------------- lookup


def _range(c, node, env) -> Vec:
    v = c.whole(node, env)
    if not isinstance(v, Vec):
        raise Unsupported("a lookup needs a range")
    return v


def find(c: Compiler, x: Cell, keys: Vec, value: Column, kind: str, mode: int, last: bool, frame=None) -> Cell:
    """The value of the first (or last) row whose key equals x, or, by mode, of the next smaller or larger key."""
    df, key = (keys.frame() if frame is None else frame), keys.cells()[0]
    order = keys.key() if frame is None else F.col("_row")
    pick = F.max_by if last else F.min_by
    name = fresh()
    if mode == 2:
        if not isinstance(x.value, str):
            if key.kind != "text" or c.scope.frame is None:
                raise Unsupported("a pattern over cells that are no text")
            texts = df.select(key.col.alias("_text"), F.struct(order.alias("o"), value.alias("v")).alias(name))

            def join(d):
                own = d.withColumn("_pattern", F.lower(text(x)))
                distinct = asking(c, d, F.lower(text(x)).alias("_pattern")).distinct()
                got = pattern_matches(texts, distinct, "_text", {name: "max" if last else "min"}, [])
                return own.join(got, "_pattern", "left").drop("_pattern")

            c.scope.joins.append(join)
            return Cell(F.col(f"{name}.v"), kind)
        return Cell(df.where(key.col.rlike(wildcard(x.value))).agg(pick(value, order)).scalar(), kind, const=True)
    first = df.where(key.col.isNotNull()).groupBy(join_key(Cell(key.col, key.kind)).alias(name + "k")).agg(pick(value, order).alias(name))
    if x.const:
        k = F.col(name + "k")
        if mode == 0:
            return Cell(first.where(k == join_key(x)).agg(F.max(name)).scalar(), kind, const=True)
        side = first.where(k <= join_key(x)) if mode < 0 else first.where(k >= join_key(x))
        return Cell(side.agg((F.max_by if mode < 0 else F.min_by)(name, k)).scalar(), kind, const=True)
    mine = join_key(x)
    if mode == 0:
        c.scope.joins.append(lambda d: d.withColumn(name + "m", mine).join(first, F.col(name + "m") == F.col(name + "k"), "left").drop(name + "m", name + "k"))
    else:
        c.scope.joins.append(lambda d: asof(d.withColumn(name + "m", mine), name + "m", first, name + "k", name, out=name, larger=mode > 0).drop(name + "m"))
    return Cell(F.col(name), kind)


def _mode_of(c, args, k, env, default):
    if len(args) <= k or args[k] is None:
        return default
    v = c.scalar(args[k], env).value
    if v is None:
        raise Unsupported("a match mode must be a constant")
    return int(v)


@function("XLOOKUP", whole=True)
def _xlookup(c, args, env):
    x, keys, out = c.scalar(args[0], env), _range(c, args[1], env), _range(c, args[2], env)
    if keys.sheet is not out.sheet or (keys.lo, keys.hi) != (out.lo, out.hi):
        raise S.FormulaError("C-SHAPE", "lookup and result ranges differ")
    o = out.cells()[0]
    got = find(c, x, keys, o.col, o.kind, _mode_of(c, args, 4, env, 0), _mode_of(c, args, 5, env, 1) in (-1,))
    if len(args) > 3 and args[3] is not None:
        other = c.scalar(args[3], env)
        kind, (a, b) = _same([got, other])
        return Cell(F.coalesce(a, b), kind, const=got.const and other.const)
    return got


def _position(c, x, keys: Vec, mode, last):
    got = find(c, x, keys, F.col("_row") + 1, "number", mode, last, frame=keys.placed())
    return Cell(got.col.cast("double"), "number", const=got.const)


@function("XMATCH", whole=True)
def _xmatch(c, args, env):
    return _position(c, c.scalar(args[0], env), _range(c, args[1], env), _mode_of(c, args, 2, env, 0), _mode_of(c, args, 3, env, 1) == -1)


def _wild(node) -> bool:
    """Whether a text joined to a value of the row has wildcards, as in B2&"*"."""
    return isinstance(node, S.Binary) and criterion_of_literals(node)


@function("MATCH", whole=True)
def _match(c, args, env):
    mode = _mode_of(c, args, 2, env, 1)
    x = c.scalar(args[0], env)
    if mode == 0 and (_wild(args[0]) or (isinstance(x.value, str) and any(ch in x.value for ch in "*?"))):
        mode = 2
        return _position(c, x, _range(c, args[1], env), 2, False)
    return _position(c, x, _range(c, args[1], env), -mode, mode == 1)  # on sorted keys, the last of equals


@function("VLOOKUP", whole=True)
def _vlookup(c, args, env):
    x, v = c.scalar(args[0], env), _range(c, args[1], env)
    k = _mode_of(c, args, 2, env, 1)
    near = True if len(args) < 4 else bool(c.scalar(args[3], env).value)
    o = v.cells()[k - 1]
    mode = -1 if near else 2 if _wild(args[0]) else 0
    return find(c, x, Vec(v.sheet, v.columns[:1], v.lo, v.hi), o.col, o.kind, mode, near)


def _of_header(x: Cell, of: dict[str, Column]) -> Column:
    """The value under the header that equals a text of the row; the first of equal headers counts."""
    out, asked = None, F.lower(text(x))
    for name, value in of.items():
        hit = asked == name.lower()
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


@function("HLOOKUP", whole=True)
def _hlookup(c, args, env):
    """Over the header row: the header that equals the text, and a row below it."""
    x, v, row = c.scalar(args[0], env), _range(c, args[1], env), _mode_of(c, args, 2, env, 1)
    if not isinstance(x.value, str):
        if row == 1:
            return Cell(_of_header(x, {n: F.lit(n) for n in v.columns}), "text", const=x.const)
        below = [c.at(Vec(v.sheet, [n], row - 2, row - 2)) for n in v.columns]
        kind, cols = _same(below)
        return Cell(_of_header(x, dict(zip(v.columns, cols, strict=True))), kind, const=x.const)
    name = next((n for n in v.columns if n.casefold() == x.value.casefold()), None)
    if name is None:
        return Cell(F.lit(None).cast("double"), "number", const=True)
    if row == 1:
        return lit(name)
    return c.at(Vec(v.sheet, [name], row - 2, row - 2))


@function("INDEX", whole=True)
def _index(c, args, env):
    v = c.eval(args[0], env)
    if isinstance(v, Row):
        return v.cells[_mode_of(c, args, 1, env, 1) - 1]
    n, k = c.scalar(args[1], env), _mode_of(c, args, 2, env, 1) if len(args) > 2 else 1
    if k == 0:
        return Grid(v.placed().where(F.col("_row") == number(n) - 1).select("_row", *(x.col.alias(f"c{i + 1}") for i, x in enumerate(v.cells()))), [f"c{i + 1}" for i in range(len(v.cells()))], dense=False)
    o = v.cells()[k - 1]
    if n.value == 0:
        return Vec(v.sheet, v.columns[k - 1 : k], v.lo, v.hi) if isinstance(v, Vec) else Grid(v.df.select("_row", o.col.alias("c1")), ["c1"], v.dense)
    if n.const:
        return Cell(v.placed().where(F.col("_row") == number(n) - 1).agg(F.max(o.col)).scalar(), o.kind, const=True)
    name = fresh()
    rows = v.placed().select((F.col("_row") + 1).cast("double").alias(name + "k"), o.col.alias(name))
    mine = number(n)
    c.scope.joins.append(lambda d: d.withColumn(name + "m", mine).join(rows, F.col(name + "m") == F.col(name + "k"), "left").drop(name + "m", name + "k"))
    return Cell(F.col(name), o.kind)


@function("CHOOSE")
def _choose(c, args, env):
    n = c.scalar(args[0], env)
    if isinstance(n.value, (int, float)):
        return c.eval(args[int(n.value)], env)
    cells = [c.scalar(a, env) for a in args[1:]]
    kind, cols = _same(cells)
    out = F.when(whole(n) == 1, cols[0])
    for k, x in enumerate(cols[1:], 2):
        out = out.when(whole(n) == k, x)
    return Cell(out, kind, const=n.const and all(x.const for x in cells))


@function("ROW")
def _row(c, args, env):
    if args:
        node = args[0]
        if isinstance(node, S.Ref) and node.area.top is not None:
            if c.scope.lifted:
                return Cell((F.col("_row") + 2).cast("double"), "number")
            if c.scope.frame is not None and not node.fixed[0] and node.area.top == node.area.bottom:
                return Cell((F.col("_row") + node.area.top + 1).cast("double"), "number")
            return lit(node.area.top + 1)
    if c.scope.frame is None:
        raise Unsupported("ROW() of a single cell")
    return Cell((F.col("_row") + 2).cast("double"), "number")


@function("ROWS", whole=True)
def _rows(c, args, env):
    node = args[0]
    if isinstance(node, S.Ref) and node.area.top is not None:
        return lit(node.area.bottom - node.area.top + 1)
    v = c.eval(node, env)
    return Cell(v.frame().agg(F.count(F.lit(1)).cast("double")).scalar(), "number", const=True)


@function("COLUMN")
def _column(c, args, env):
    node = args[0]
    if isinstance(node, S.Ref):
        return lit(node.area.left + 1)
    v = c.struct(node)
    if isinstance(v, Vec):
        return lit(v.sheet.columns.index(v.columns[0]) + 1)
    return lit(c.scope.sheet.columns.index(c.scope.sheet.column(node.columns[0])) + 1)


@function("COLUMNS", whole=True)
def _columns(c, args, env):
    v = c.eval(args[0], env)
    return lit(len(v.cells if isinstance(v, Row) else v.cells()))


# ---------------------------------------------------------------- text

simple("LEN", of=[text], least=1)(lambda x: F.char_length(x).cast("double"))
simple("UPPER", kind="text", of=[text], least=1)(F.upper)
simple("LOWER", kind="text", of=[text], least=1)(F.lower)
simple("TRIM", kind="text", of=[text], least=1)(lambda x: F.trim(F.regexp_replace(x, " +", " ")))
simple("CLEAN", kind="text", of=[text], least=1)(lambda x: F.regexp_replace(x, r"[\x00-\x1f]", ""))
simple("LEFT", kind="text", of=[text, whole], least=1)(lambda x, n=1: F.when(_lit(n) >= 0, F.left(x, _lit(n))))
simple("RIGHT", kind="text", of=[text, whole], least=1)(lambda x, n=1: F.when(_lit(n) == 0, "").when(_lit(n) > 0, F.right(x, _lit(n))))
simple("MID", kind="text", of=[text, whole], least=3)(lambda x, a, n: F.when((a >= 1) & (n >= 0), F.substring(x, a, n)))
simple("REPT", kind="text", of=[text, whole], least=2)(lambda x, n: F.when(n >= 0, F.repeat(x, n)))
simple("EXACT", kind="bool", of=[text], least=2)(lambda x, y: x == y)
simple("REPLACE", kind="text", of=[text, whole, whole, text], least=4)(lambda x, a, n, y: F.concat(F.substring(x, F.lit(1), a - 1), y, F.substring(x, a + n, F.char_length(x))))
simple("FIND", of=[text, text, whole], least=2)(lambda a, x, n=1: F.when(_located(a, x, n) > 0, _located(a, x, n).cast("double")))
simple("VALUE", of=[lambda c: c], least=1)(lambda c: parsed(c.col) if c.kind == "text" else number(c))


def _located(a, x, n):
    return F.call_function("locate", a, x, _lit(n).cast("int"))


@function("SEARCH")
def _search(c, args, env):
    a, x = c.scalar(args[0], env), c.scalar(args[1], env)
    n = whole(c.scalar(args[2], env)) if len(args) > 2 else F.lit(1)
    if isinstance(a.value, str) and any(ch in a.value for ch in "*?~"):
        pattern = wildcard(a.value).replace("^", "", 1).removesuffix("$")
        at = F.call_function("regexp_instr", F.substring(text(x), n, F.char_length(text(x))), F.lit(pattern))
        return Cell(F.when(at > 0, (at + n - 1).cast("double")), "number", const=x.const)
    at = _located(F.lower(text(a)), F.lower(text(x)), n)
    return Cell(F.when(at > 0, at.cast("double")), "number", const=a.const and x.const)


@simple("SUBSTITUTE", kind="text", of=[text, text, text, whole], least=3)
def _substitute(x, old, new, nth=None):
    if nth is None:
        return F.when(old == "", x).otherwise(F.replace(x, old, new))
    parts = F.call_function("split", x, F.concat(F.lit(r"\Q"), old, F.lit(r"\E")))
    # split by the text, and join with the new text only at its nth place
    head, tail = F.array_join(F.slice(parts, F.lit(1), nth), "\u0000"), F.slice(parts, nth + 1, F.greatest(F.size(parts) - nth, F.lit(0)))
    return F.when((old == "") | (F.size(parts) <= nth), x).otherwise(F.concat(F.replace(head, F.lit("\u0000"), old), new, F.replace(F.array_join(tail, "\u0000"), F.lit("\u0000"), old)))


@simple("PROPER", kind="text", of=[text], least=1)
def _proper(x):
    """A capital after everything that is no letter."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))), "")


def _texts(c, args, env):
    """(frame or None, cells, order) of each argument."""
    return [(got if (got := c.array(a, env)) is not None else c.scalar(a, env)) for a in args]


def _joined(got, skip: Column | bool):
    """An argument's texts in row order, as one array; ``skip`` leaves empty ones out."""
    kept = lambda x: x if skip is False else F.filter(x, lambda v: (v != "") | ~F.lit(skip))
    if isinstance(got, Cell):
        return kept(F.array(text(got)))
    if isinstance(got, Row):
        return kept(F.array(*(text(x) for x in got.cells)))
    df, cells, key = got
    rows = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.array(*(text(x) for x in cells)).alias("v")))), lambda s: s["v"])
    return df.agg(kept(F.flatten(rows)).alias("x")).scalar()


@function("CONCAT", whole=True)
def _concat(c, args, env):
    parts = _texts(c, args, env)
    return Cell(F.array_join(F.concat(*(_joined(p, False) for p in parts)), ""), "text", const=all(isinstance(p, Cell) and p.const or isinstance(p, tuple) for p in parts))


@function("TEXTJOIN", whole=True)
def _textjoin(c, args, env):
    sep, skip = c.scalar(args[0], env), c.scalar(args[1], env)
    if skip.value is None:
        raise Unsupported("whether empty texts are left out must be a constant")
    parts = _texts(c, args[2:], env)
    every = F.concat(*(_joined(p, bool(skip.value)) for p in parts))
    const = sep.const and all(isinstance(p, Cell) and p.const or isinstance(p, tuple) for p in parts)
    return Cell(F.call_function("array_join", every, text(sep)), "text", const=const)


#: The date letters of format codes, as Spark writes them.
_DATE_CODES = [("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("hh", "HH"), ("h", "H"), ("ss", "ss"), ("s", "s"), ("am/pm", "a")]


#: What a number format is made of: text before, digits, decimals, a percent sign, text behind.
_NUMBER_CODE = r"^([^#0.,%]*)([#,]*0*)(?:\.(0+))?(%)?([^#0.,%]*)$"


def _shown(n: Column, code: Column) -> Column:
    """A number by the format in its row; null where that is none."""
    head, digits, decimals, percent, tail = (F.regexp_extract(code, _NUMBER_CODE, k) for k in range(1, 6))
    places = F.length(decimals)
    n = n * F.when(percent != "", 100).otherwise(1)
    by = F.pow(F.lit(10.0), places)
    rounded = F.signum(n) * F.floor(F.round(F.abs(n) * by, 9) + 0.5) / by
    body = F.call_function("format_number", rounded, places)
    bare = F.replace(body, F.lit(","), F.lit(""))
    zeros = F.length(F.regexp_replace(digits, "[^0]", ""))
    whole_ = F.replace(bare, F.lit("-"), F.lit(""))
    padded = F.concat(F.when(rounded < 0, "-").otherwise(""), F.call_function("lpad", whole_, F.greatest(F.length(whole_), zeros + F.when(places > 0, places + 1).otherwise(0)), F.lit("0")))
    body = F.when(zeros > 1, padded).when(digits.contains(","), body).otherwise(bare)
    return F.when(code.rlike(_NUMBER_CODE), F.concat(head, body, percent, tail))


def _dated(at: Column, code: Column) -> Column:
    """A date by the format in its row; null where that has runs of letters that mean nothing."""
    x = F.regexp_replace(F.lower(code), "am/pm", "\x01")
    ok = ~x.rlike("y{5,}|(?<!y)y(?:yy)?(?!y)|m{5,}|d{5,}|h{3,}|s{3,}")
    half = x.contains("\x01")
    x = F.regexp_replace(F.replace(x, F.lit("'"), F.lit("''")), "([^ymdhs\x01]+)", "'$1'")
    for a, b in (("(?<!m)(?<=h[^dy]{0,60})mm(?!m)", "\x02\x02"), ("(?<!m)(?<=h[^dy]{0,60})m(?!m)", "\x02"), ("dddd", "EEEE"), ("ddd", "EEE")):
        x = F.regexp_replace(x, a, b)
    x = F.translate(x, "m\x02\x01", "Mma")
    x = F.when(half, x).otherwise(F.translate(x, "h", "H"))
    return F.call_function("date_format", at, F.when(ok, x))


@function("TEXT")
def _text(c, args, env):
    x, f = c.scalar(args[0], env), c.scalar(args[1], env)
    if not isinstance(f.value, str):
        code = text(f)
        return Cell(F.when(code.rlike("(?i)[ymdhs]"), _dated(stamp(x), code)).otherwise(_shown(number(x), code)), "text", const=x.const and f.const)
    code = f.value
    if re.search(r"[ymdhs]", code, re.IGNORECASE):
        out, rest, hours = "", code.lower(), False
        while rest:
            pick = next(((a, b) for a, b in _DATE_CODES if rest.startswith(a)), None)
            if pick is None:
                out += "'" + rest[0] + "'" if rest[0].isalpha() else rest[0]
                rest = rest[1:]
                continue
            a, b = pick
            if a in ("m", "mm") and hours:
                b = b.lower()
            hours = a in ("h", "hh") or (hours and a not in ("d", "dd", "yyyy", "yy"))
            out += b
            rest = rest[len(a) :]
        if "am/pm" in code.lower():
            out = out.replace("HH", "hh").replace("H", "h")
        return Cell(F.date_format(stamp(x), out), "text", const=x.const)
    m = re.fullmatch(r"([^#0.,%]*)([#,]*0*)(?:\.(0+))?(%)?([^#0.,%]*)", code)
    if not m:
        raise Unsupported("this number format")
    n = number(x) * (100 if m[4] else 1)
    places = len(m[3] or "")
    rounded = F.signum(n) * F.floor(F.round(F.abs(n) * 10**places, 9) + 0.5) / 10**places
    body = F.format_number(rounded, places)
    if "," not in m[2]:
        body = F.replace(body, F.lit(","), F.lit(""))
    zeros = m[2].count("0")
    if zeros > 1:
        body = F.concat(F.when(rounded < 0, "-").otherwise(""), F.regexp_replace(F.format_string(f"%0{zeros + (places + 1 if places else 0)}.{places}f", F.abs(rounded)), ",", ""))
    return Cell(F.concat(F.lit(m[1]), body, F.lit((m[4] or "") + m[5])), "text", const=x.const)


@simple("NUMBERVALUE", of=[text], least=1)
def _numbervalue(x, dec=".", grp=","):
    bare = F.replace(F.replace(x, _lit(grp) if isinstance(grp, Column) else F.lit(grp), F.lit("")), _lit(dec) if isinstance(dec, Column) else F.lit(dec), F.lit("."))
    return parsed(bare)


def _around(before):
    def run(c, args, env):
        x, d = c.scalar(args[0], env), c.scalar(args[1], env)
        n = whole(c.scalar(args[2], env)) if len(args) > 2 and args[2] is not None else F.lit(1)
        t, sep = text(x), text(d)
        parts = F.call_function("split", t, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")))
        size = F.size(parts)
        nth = F.when(n > 0, n).otherwise(size + n)
        head = F.call_function("array_join", F.slice(parts, F.lit(1), F.greatest(nth, F.lit(0))), sep)
        tail = F.call_function("array_join", F.slice(parts, F.greatest(nth + 1, F.lit(1)), F.greatest(size - nth, F.lit(0))), sep)
        got = F.when((nth >= 1) & (nth < size), head if before else tail)
        if len(args) > 5 and args[5] is not None:
            got = F.coalesce(got, text(c.scalar(args[5], env)))
        return Cell(got, "text", const=x.const and d.const)

    return run


function("TEXTBEFORE")(_around(True))
function("TEXTAFTER")(_around(False))
simple("REGEXTEST", kind="bool", of=[text], least=2)(lambda x, p: F.rlike(x, p))


@function("REGEXEXTRACT")
def _regexextract(c, args, env):
    x, p = c.scalar(args[0], env), c.scalar(args[1], env)
    got = F.call_function("regexp_substr", text(x), text(p))
    return Cell(got, "text", const=x.const and p.const)


simple("REGEXREPLACE", kind="text", of=[text], least=3)(lambda x, p, r: F.regexp_replace(x, p, r))


# ---------------------------------------------------------------- dates


@simple("DATE", kind="date", of=[whole], least=3)
def _date(y, m, d):
    """Months and days run over into the next."""
    first = F.add_months(F.make_date(F.when(y < 1900, y + 1900).otherwise(y), F.lit(1), F.lit(1)), m - 1)
    return F.date_add(first, d - 1)


simple("DATEVALUE", of=[text], least=1)(lambda x: serial(date(Cell(x, "text"))))
simple("DAY", of=[date], least=1)(lambda d: F.day(d).cast("double"))
simple("MONTH", of=[date], least=1)(lambda d: F.month(d).cast("double"))
simple("YEAR", of=[date], least=1)(lambda d: F.year(d).cast("double"))
simple("HOUR", of=[stamp], least=1)(lambda t: F.hour(t).cast("double"))
simple("MINUTE", of=[stamp], least=1)(lambda t: F.minute(t).cast("double"))
simple("SECOND", of=[stamp], least=1)(lambda t: F.second(t).cast("double"))
simple("TIME", of=[whole], least=3)(lambda h, m, s: F.pmod((h * 3600 + m * 60 + s).cast("double"), F.lit(86400.0)) / 86400)
simple("TODAY", kind="date")(lambda: F.current_date())
simple("NOW", kind="date")(lambda: F.current_timestamp())
simple("EDATE", kind="date", of=[date, whole], least=2)(F.add_months)
simple("EOMONTH", kind="date", of=[date, whole], least=2)(lambda d, n: F.last_day(F.add_months(d, n)))
simple("DAYS", of=[date], least=2)(lambda a, b: F.datediff(a, b).cast("double"))
simple("ISOWEEKNUM", of=[date], least=1)(lambda d: F.weekofyear(d).cast("double"))


@simple("WEEKDAY", of=[date, whole], least=1)
def _weekday(d, kind=1):
    n = F.dayofweek(d)  # Sunday is 1
    kind = _lit(kind)
    first = F.when(kind.isin(1, 17), 1).when(kind.isin(2, 11), 2).when(kind.between(12, 16), kind - 9)
    return F.when(kind == 3, F.pmod(n - 2, F.lit(7)).cast("double")).otherwise((F.pmod(n - first, F.lit(7)) + 1).cast("double"))


@simple("WEEKNUM", of=[date, whole], least=1)
def _weeknum(d, kind=1):
    kind = _lit(kind)
    first = F.when(kind.isin(1, 17), 1).when(kind.isin(2, 11), 2).when(kind.between(12, 16), kind - 9)
    jan = F.trunc(d, "year")
    lead = F.pmod(F.dayofweek(jan) - first, F.lit(7))
    return F.when(kind == 21, F.weekofyear(d)).otherwise(F.floor((F.dayofyear(d) - 1 + lead) / 7) + 1).cast("double")


@simple("DATEDIF", of=[date, date, text], least=3)
def _datedif(a, b, unit):
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.day(b) < F.day(a)).cast("int")
    u = F.upper(unit)
    same_year = F.add_months(a, F.floor(months / 12).cast("int") * 12)
    md = F.datediff(b, F.add_months(a, months))
    got = F.when(u == "Y", F.floor(months / 12)).when(u == "M", months).when(u == "D", F.datediff(b, a)).when(u == "YM", months % 12).when(u == "YD", F.datediff(b, same_year)).when(u == "MD", md)
    return F.when(a <= b, got.cast("double"))


def _thirty(a, b, european):
    d1, d2 = F.day(a), F.day(b)
    if european:
        d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        feb = lambda x: (F.month(x) == 2) & (x == F.last_day(x))
        d2 = F.when(feb(a) & feb(b), 30).when((d2 == 31) & (F.least(d1, F.lit(30)) == 30), 30).otherwise(d2)
        d1 = F.when(feb(a) | (d1 == 31), 30).otherwise(d1)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + (d2 - d1)


@simple("YEARFRAC", of=[date, date, whole], least=2)
def _yearfrac(a, b, basis=0):
    a, b = F.least(a, b), F.greatest(a, b)
    basis = _lit(basis)
    days = F.datediff(b, a).cast("double")
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    y1, y2 = F.year(a), F.year(b)
    within = (y1 == y2) | ((y2 == y1 + 1) & ((F.month(a) > F.month(b)) | ((F.month(a) == F.month(b)) & (F.day(a) >= F.day(b)))))
    feb29 = lambda y: F.make_date(y, F.lit(2), F.lit(28))
    short = F.when((y1 == y2) & leap(y1), 366).when(leap(y1) & (a <= F.date_add(feb29(y1), 1)), 366).when(leap(y2) & (b >= F.date_add(feb29(y2), 1)), 366).otherwise(365)
    mean = F.datediff(F.make_date(y2 + 1, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(1), F.lit(1))) / (y2 - y1 + 1)
    actual = days / F.when(within, short).otherwise(mean)
    return F.when(basis == 0, _thirty(a, b, False) / 360).when(basis == 1, actual).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, _thirty(a, b, True) / 360)


def _weekend(c, node, env) -> list[int]:
    """Days off as 0 (Monday) to 6."""
    if node is None:
        return [5, 6]
    v = c.scalar(node, env).value
    if isinstance(v, str):
        return [k for k, ch in enumerate(v) if ch == "1"]
    n = int(v)
    return [(n + 4) % 7, (n + 5) % 7] if n <= 7 else [(n - 12) % 7]


#: Days off up to which they are read once and are part of the expression; of more, days are counted by as-of joins.
MOST_HOLIDAYS = 4_000
#: The calendar of worksheets.
FIRST_DAY, LAST_DAY = "1900-01-01", "9999-12-31"


def _holidays(c, node, env) -> Column | DataFrame:
    if node is None:
        return F.array().cast("array<date>")
    got = c.array(node, env)
    if got is None:
        return F.array(date(c.scalar(node, env)))
    if isinstance(got, Row):
        return F.array(*(date(x) for x in got.cells))
    free = got[0].select(date(Cell(got[1][0].col, got[1][0].kind)).alias("d")).where("d is not null").distinct()
    days = free.limit(MOST_HOLIDAYS + 1).collect()
    if len(days) > MOST_HOLIDAYS:
        return free
    return F.array(*(F.lit(r["d"]) for r in days)).cast("array<date>")


def _worked(day: Column, off, holidays) -> Column:
    return ~F.weekday(day).isin(*off) & ~F.array_contains(holidays, day)


def _day(x: Column) -> Column:
    return F.datediff(x, F.lit(FIRST_DAY).cast("date"))


def _ranked(days: DataFrame, name: str) -> DataFrame:
    """name+k: a day's number; name: how many of the days are not after it."""
    return numbered(days.select(_day(F.col("d")).alias(name + "k")), name + "k", name="_n").select(name + "k", (F.col("_n") + 1).alias(name))


def _up_to(c, x: Column, ranked: DataFrame, name: str, exact: bool = True) -> Column:
    """How many of the ranked days are not after (or, not ``exact``, before) each row's date."""
    out = fresh()
    c.scope.joins.append(lambda df: asof(df.withColumn(out + "d", _day(x)), out + "d", ranked, name + "k", name, out=out, exact=exact).drop(out + "d"))
    return F.coalesce(F.col(out), F.lit(0))


def _networkdays(c, args, env, weekend, free):
    a, b = date(c.scalar(args[0], env)), date(c.scalar(args[1], env))
    off, days = _weekend(c, weekend, env), _holidays(c, free, env)
    lo, hi = F.least(a, b), F.greatest(a, b)
    if isinstance(days, DataFrame):
        name = fresh()
        ranked = _ranked(days.where(~F.weekday("d").isin(*off)), name)
        n = F.size(F.filter(F.sequence(lo, hi), lambda d: ~F.weekday(d).isin(*off))) - _up_to(c, hi, ranked, name) + _up_to(c, lo, ranked, name, exact=False)
        return Cell(F.when(a <= b, n).otherwise(-n).cast("double"), "number")
    n = F.size(F.filter(F.sequence(lo, hi), lambda d: _worked(d, off, days)))
    return Cell(F.when(a <= b, n).otherwise(-n).cast("double"), "number")


function("NETWORKDAYS", whole=True)(lambda c, a, e: _networkdays(c, a, e, None, a[2] if len(a) > 2 else None))
function("NETWORKDAYS.INTL", whole=True)(lambda c, a, e: _networkdays(c, a, e, a[2] if len(a) > 2 else None, a[3] if len(a) > 3 else None))


def _workday(c, args, env, weekend, free):
    """The nth day of work after (or before) a date: among so many days there are enough."""
    a, n = date(c.scalar(args[0], env)), whole(c.scalar(args[1], env))
    off, days = _weekend(c, weekend, env), _holidays(c, free, env)
    if isinstance(days, DataFrame):
        name = fresh()
        calendar = c.book.spark.range(1).select(F.explode(F.sequence(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))).alias("d"))
        ranked = _ranked(calendar.where(~F.weekday("d").isin(*off)).join(days, "d", "left_anti"), name)
        place = F.when(n > 0, _up_to(c, a, ranked, name) + n).otherwise(_up_to(c, a, ranked, name, exact=False) + n + 1)
        at = ranked.select(F.col(name).alias(name + "i"), F.date_add(F.lit(FIRST_DAY).cast("date"), F.col(name + "k")).alias(name + "v"))
        c.scope.joins.append(lambda df: df.withColumn(name + "p", place).join(at, F.col(name + "p") == F.col(name + "i"), "left").drop(name + "p", name + "i"))
        return Cell(F.when(n == 0, a).otherwise(F.col(name + "v")), "date")
    reach = F.abs(n) * 7 + F.size(days) * 7 + 14
    step = F.when(n < 0, -1).otherwise(1)
    ahead = F.filter(F.transform(F.sequence(F.lit(1), reach), lambda k: F.date_add(a, k * step)), lambda d: _worked(d, off, days))
    return Cell(F.when(n == 0, a).otherwise(F.try_element_at(ahead, F.greatest(F.abs(n), F.lit(1)))), "date")


function("WORKDAY", whole=True)(lambda c, a, e: _workday(c, a, e, None, a[2] if len(a) > 2 else None))
function("WORKDAY.INTL", whole=True)(lambda c, a, e: _workday(c, a, e, a[2] if len(a) > 2 else None, a[3] if len(a) > 3 else None))


# ---------------------------------------------------------------- information


def _is(name, test):
    @function(name)
    def run(c, args, env):
        x = c.scalar(args[0], env)
        return Cell(test(x), "bool", const=x.const)


_is("ISBLANK", lambda x: x.col.isNull() if x.plain else F.lit(False))
_is("ISNUMBER", lambda x: x.col.isNotNull() if x.kind in ("number", "date") else F.lit(False))
_is("ISTEXT", lambda x: x.col.isNotNull() if x.kind == "text" else F.lit(False))
_is("ISLOGICAL", lambda x: x.col.isNotNull() if x.kind == "bool" else F.lit(False))
_is("ISERROR", lambda x: F.lit(False) if x.plain else x.col.isNull())
_is("ISNA", lambda x: F.lit(False) if x.plain else x.col.isNull())
function("NA")(lambda c, a, e: Cell(F.lit(None).cast("double"), "number", const=True))
simple("N", of=[lambda c: c], least=1)(lambda x: F.lit(0.0) if x.kind == "text" else number(x))
