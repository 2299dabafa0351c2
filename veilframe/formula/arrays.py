"""The functions that give arrays: filters, sorts, reshaping, grouping, and those that take a LAMBDA."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folds import _steps, passed
from ..sources.rows import numbered, running, written
from . import syntax as S
from .compile import Cell, Compiler, Fn, Grid, Row, Scope, Unsupported, Vec, fresh, function, lit
from .values import number, text, truth


def named(df: DataFrame, cols, row=None) -> Grid:
    """A grid of columns c1..cn; ``row`` orders it (dense only if told so by the caller)."""
    names = [f"c{k + 1}" for k in range(len(cols))]
    return Grid(df.select((F.col("_row") if row is None else row).alias("_row"), *(c.alias(n) for c, n in zip(cols, names, strict=True))), names, dense=False)


def placed(g: Grid) -> Grid:
    return Grid(g.placed(), g.columns, True)


def _int(c: Compiler, args, k, env, default=None):
    if len(args) <= k or args[k] is None:
        return default
    v = c.scalar(args[k], env).value
    if v is None:
        raise Unsupported("this argument must be a constant")
    return int(v)


def _count(g: Grid) -> int:
    return g.df.count()


# ---------------------------------------------------------------- rows and columns


@function("FILTER", whole=True)
def _filter(c, args, env):
    source = c.eval(args[0], env)
    if not isinstance(source, (Vec, Grid)):
        raise Unsupported("FILTER takes a range or an array")
    name = fresh("keep")
    if isinstance(source, Vec):
        inner = c.lifted(source.sheet, source.lo, source.hi, source.frame())
        keep = inner.scalar(args[1], {k: (v.cells()[0] if isinstance(v, Vec) and v.sheet is source.sheet and len(v.columns) == 1 else v) for k, v in env.items()})
        df = inner.scope.build().withColumn(name, truth(keep)).where(F.col(name))
        out = named(df, [x.col for x in source.cells()], source.key())
    else:
        # an array of the same rows: columns are meant by position, through INDEX or CHOOSECOLS of the same array
        mask = c.grid(args[1], env)
        m = mask.placed().select(F.col("_row").alias(name + "r"), truth(mask.cells()[0]).alias(name))
        df = source.placed()
        df = df.join(m, df["_row"] == F.col(name + "r")).where(F.col(name))
        out = named(df, [x.col for x in source.cells()])
    if len(args) > 2 and args[2] is not None:
        other = c.scalar(args[2], env)
        if len(out.columns) != 1:
            raise Unsupported("a value for no rows beside several columns")
        empty = c.book.spark.range(1).select(F.lit(None).cast(dict(out.df.dtypes)["_row"]).alias("_row"), other.col.cast(dict(out.df.dtypes)["c1"]).alias("c1")).where(out.df.agg(F.count(F.lit(1))).scalar() == 0)
        out = Grid(out.df.union(empty), out.columns, False)
    return out


def _order_key(cell: Cell):
    return F.lower(cell.col) if cell.kind == "text" else cell.col


@function("SORT", whole=True)
def _sort(c, args, env):
    g, k, way = c.grid(args[0], env), _int(c, args, 1, env, 1), _int(c, args, 2, env, 1)
    cell = g.cells()[k - 1]
    key = _order_key(cell)
    df = numbered(g.df.withColumnRenamed("_row", "_was"), (key.desc_nulls_last() if way < 0 else key.asc_nulls_last()), "_was")
    return Grid(written(df.select("_row", *g.columns), "sorted"), g.columns)


@function("SORTBY", whole=True)
def _sortby(c, args, env):
    source = c.eval(args[0], env)
    keys, names = [], []
    if isinstance(source, Vec):
        inner = c.lifted(source.sheet, source.lo, source.hi, source.frame())
        df_names = {}
        for k in range(1, len(args), 2):
            cell = inner.scalar(args[k], env)
            n = fresh("by")
            df_names[n] = _order_key(cell)
            way = _int(c, args, k + 1, env, 1)
            keys.append(F.col(n).desc_nulls_last() if way < 0 else F.col(n).asc_nulls_last())
        df = inner.scope.build().withColumns(df_names)
        names = [f"c{k + 1}" for k in range(len(source.columns))]
        df = df.select(source.key().alias("_was"), *df_names, *(F.col(a).alias(b) for a, b in zip(source.columns, names, strict=True)))
    else:
        raise Unsupported("SORTBY takes a range")
    return Grid(written(numbered(df, *keys, "_was").select("_row", *names), "sorted"), names)


@function("UNIQUE", whole=True)
def _unique(c, args, env):
    g = c.grid(args[0], env)
    once = len(args) > 2 and bool(c.scalar(args[2], env).value)
    if len(args) > 1 and args[1] is not None and c.scalar(args[1], env).value:
        # columns are alike when two sums of hashes of their cells and places are; one pass, a value a column
        sums = [F.sum(F.xxhash64(F.lit(seed), "_row", _order_key(x)).cast("decimal(38,0)")) for x in g.cells() for seed in (1, 2)]
        got = tuple(g.df.agg(*(x.alias(f"s{k}") for k, x in enumerate(sums))).first())
        marks = [got[2 * k : 2 * k + 2] for k in range(len(g.columns))]
        kept = [n for k, n in enumerate(g.columns) if (marks.count(marks[k]) == 1 if once else marks.index(marks[k]) == k)]
        return named(g.df, [F.col(n) for n in kept], F.col("_row"))
    keys = {fresh("u"): _order_key(x) for x in g.cells()}
    df = g.df.withColumns(keys).groupBy(*keys).agg(F.min("_row").alias("_row"), F.count("*").alias("_n"), *(F.min_by(x, "_row").alias(x) for x in g.columns))
    return Grid((df.where("_n = 1") if once else df).select("_row", *g.columns), g.columns, False)


def _cut(take):
    def run(c, args, env):
        g = placed(c.grid(args[0], env))
        rows, cols = _int(c, args, 1, env), _int(c, args, 2, env)
        df, names, at = g.df, g.columns, F.col("_row")
        if rows is not None:
            n = df.agg(F.count(F.lit(1))).scalar()
            if take:
                df = df.where(at < rows) if rows >= 0 else df.where(at >= n + rows)
            else:
                df = df.where(at >= rows) if rows >= 0 else df.where(at < n + rows)
        if cols is not None:
            names = (names[:cols] if cols >= 0 else names[cols:]) if take else (names[cols:] if cols >= 0 else names[:cols])
        return named(df, [F.col(x) for x in names])

    return run


function("TAKE", whole=True)(_cut(True))
function("DROP", whole=True)(_cut(False))


@function("CHOOSECOLS", whole=True)
def _choosecols(c, args, env):
    g = c.grid(args[0], env)
    picks = [_int(c, args, k, env) for k in range(1, len(args))]
    out = named(g.df, [F.col(g.columns[k - 1 if k > 0 else k]) for k in picks])
    out.dense = g.dense
    return out


@function("CHOOSEROWS", whole=True)
def _chooserows(c, args, env):
    g = placed(c.grid(args[0], env))
    picks = [_int(c, args, k, env) for k in range(1, len(args))]
    n = g.df.agg(F.count(F.lit(1))).scalar()
    wanted = c.book.spark.createDataFrame([(k, p) for k, p in enumerate(picks)], "_to long, _pick long").withColumn("_from", F.when(F.col("_pick") > 0, F.col("_pick") - 1).otherwise(n + F.col("_pick")))
    df = g.df.join(F.broadcast(wanted), F.col("_row") == F.col("_from"))  # as many rows as the formula has arguments
    return Grid(df.select(F.col("_to").alias("_row"), *g.columns), g.columns, True)


@function("EXPAND", whole=True)
def _expand(c, args, env):
    g = placed(c.grid(args[0], env))
    rows, cols = _int(c, args, 1, env), _int(c, args, 2, env, len(g.columns))
    pad = c.scalar(args[3], env).col if len(args) > 3 and args[3] is not None else F.lit(None)
    kinds = dict(g.df.dtypes)
    names = [f"c{k + 1}" for k in range(cols)]
    have = g.df.select(F.col("_row").alias("_at"), *(F.col(x).alias(n) for x, n in zip(g.columns, names, strict=False)))
    n = rows if rows is not None else _count(g)
    df = c.book.spark.range(n).join(have, F.col("id") == F.col("_at"), "left")
    cols_out = [F.when(F.col("_at").isNull(), pad.cast(kinds[g.columns[k]])).otherwise(F.col(x)) if k < len(g.columns) else pad for k, x in enumerate(names)]
    return Grid(df.select(F.col("id").alias("_row"), *(x.alias(m) for x, m in zip(cols_out, names, strict=True))), names, True)


def _aligned(grids: list[Grid]) -> list[Grid]:
    """The same types by position: numbers become text where another array has text."""
    width = max(len(g.columns) for g in grids)
    out = []
    for k in range(width):
        kinds = {g.cells()[k].kind for g in grids if k < len(g.columns)}
        out.append(next(iter(kinds)) if len(kinds) == 1 else "text")
    done = []
    for g in grids:
        cells = g.cells()
        cols = []
        for k in range(width):
            if k >= len(cells):
                cols.append(F.lit(None).cast({"text": "string", "number": "double", "bool": "boolean", "date": "timestamp"}[out[k]]))
            else:
                cols.append(text(Cell(cells[k].col, cells[k].kind)) if out[k] == "text" else cells[k].col.cast("double") if out[k] == "number" else cells[k].col.cast("timestamp") if out[k] == "date" else cells[k].col)
        names = [f"c{k + 1}" for k in range(width)]
        done.append(Grid(g.df.select("_row", *(x.alias(n) for x, n in zip(cols, names, strict=True))), names, g.dense))
    return done


@function("VSTACK", whole=True)
def _vstack(c, args, env):
    grids = _aligned([c.grid(a, env) for a in args])
    parts = [g.df.select(F.struct(F.lit(k).alias("part"), F.col("_row").alias("row")).alias("_row"), *g.columns) if g.dense else placed(g).df.select(F.struct(F.lit(k).alias("part"), F.col("_row").alias("row")).alias("_row"), *g.columns) for k, g in enumerate(grids)]
    return Grid(reduce(DataFrame.union, parts), grids[0].columns, False)


@function("HSTACK", whole=True)
def _hstack(c, args, env):
    out, names = None, []
    for a in args:
        g = placed(c.grid(a, env))
        own = [f"c{len(names) + k + 1}" for k in range(len(g.columns))]
        df = g.df.select("_row", *(F.col(x).alias(n) for x, n in zip(g.columns, own, strict=True)))
        out = df if out is None else out.join(df, "_row", "full_outer")
        names += own
    return Grid(out.select("_row", *names), names, True)


def _flat(c, args, env) -> DataFrame:
    """All cells of an array with their place in row-major (or column-major) order: _row, c1."""
    g = placed(c.grid(args[0], env))
    ignore = _int(c, args, 1, env, 0)
    by_column = len(args) > 2 and bool(c.scalar(args[2], env).value)
    one = _aligned([Grid(g.df.select("_row", F.col(x).alias("c1")), ["c1"]) for x in g.columns])
    k = len(g.columns)
    items = F.array(*(F.struct(F.lit(i).alias("i"), x.alias("v")) for i, x in enumerate(_same_type(g, one))))
    df = g.df.select("_row", F.explode(items).alias("x"))
    place = F.struct(F.col("x.i"), F.col("_row")) if by_column else F.struct((F.col("_row") * k + F.col("x.i")).alias("p"), F.lit(0).alias("q"))
    df = df.select(place.alias("_row"), F.col("x.v").alias("c1"))
    if ignore in (1, 3):
        df = df.where(F.col("c1").isNotNull())
    return df


def _same_type(g, one):
    kind = dict(one[0].df.dtypes)["c1"]
    return [text(Cell(F.col(x), cell.kind)) if kind == "string" else F.col(x).cast(kind) for x, cell in zip(g.columns, g.cells(), strict=True)]


@function("TOCOL", whole=True)
def _tocol(c, args, env):
    return Grid(_flat(c, args, env), ["c1"], False)


@function("TOROW", whole=True)
def _torow(c, args, env):
    """A row: its cells become columns, so the driver must know how many there are."""
    g = placed(Grid(_flat(c, args, env), ["c1"], False))
    n = _count(g)
    if n > 16_384:
        raise Unsupported("a row of more cells than a sheet has columns")
    row = g.df.agg(*(F.max(F.when(F.col("_row") == k, F.col("c1"))).alias(f"c{k + 1}") for k in range(n)))
    return Grid(row.select(F.lit(0).cast("long").alias("_row"), "*"), [f"c{k + 1}" for k in range(n)], True)


def _wrap(by_rows):
    def run(c, args, env):
        g = placed(Grid(_flat(c, [args[0]], env), ["c1"], False))
        n = _int(c, args, 1, env)
        if by_rows:
            line, place, width = F.floor(F.col("_row") / n), F.col("_row") % n, n
        else:
            line, place = F.col("_row") % n, F.floor(F.col("_row") / n)
            width = -(-_count(g) // n)
        pad = c.scalar(args[2], env).col if len(args) > 2 and args[2] is not None else F.lit(None)
        if width > 16_384:
            raise Unsupported("more columns than a sheet has")
        kind = dict(g.df.dtypes)["c1"]
        df = g.df.withColumns({"_line": line.cast("long"), "_place": place.cast("int")}).groupBy("_line").agg(*(F.max(F.when(F.col("_place") == k, F.struct("c1"))).alias(f"s{k}") for k in range(width)))
        names = [f"c{k + 1}" for k in range(width)]
        return Grid(df.select(F.col("_line").alias("_row"), *(F.when(F.col(f"s{k}").isNull(), pad.cast(kind)).otherwise(F.col(f"s{k}.c1")).alias(n) for k, n in enumerate(names))), names, True)

    return run


function("WRAPROWS", whole=True)(_wrap(True))
function("WRAPCOLS", whole=True)(_wrap(False))


@function("SEQUENCE")
def _sequence(c, args, env):
    rows, cols = _int(c, args, 0, env), _int(c, args, 1, env, 1)
    start = number(c.scalar(args[2], env)) if len(args) > 2 and args[2] is not None else F.lit(1.0)
    step = number(c.scalar(args[3], env)) if len(args) > 3 and args[3] is not None else F.lit(1.0)
    names = [f"c{k + 1}" for k in range(cols)]
    return Grid(c.book.spark.range(rows).select(F.col("id").alias("_row"), *((start + (F.col("id") * cols + k) * step).alias(n) for k, n in enumerate(names))), names, True)


@function("MAKEARRAY")
def _makearray(c, args, env):
    rows, cols, f = _int(c, args, 0, env), _int(c, args, 1, env), c.function_of(args[2], env)
    names = [f"c{k + 1}" for k in range(cols)]
    inner = c.inner(Scope(c.book.spark.range(rows), None, True))
    cells = [inner.apply(f, [Cell((F.col("id") + 1).cast("double"), "number"), lit(k + 1)]) for k in range(cols)]
    return Grid(inner.scope.build().select(F.col("id").alias("_row"), *(x.col.alias(n) for x, n in zip(cells, names, strict=True))), names, True)


@function("TEXTSPLIT")
def _textsplit(c, args, env):
    """One text into a row (first delimiter) or rows (second)."""
    x, col = c.scalar(args[0], env), c.scalar(args[1], env) if args[1] is not None else None
    rows = c.scalar(args[2], env) if len(args) > 2 and args[2] is not None else None
    quote = lambda d: F.concat(F.lit(r"\Q"), text(d), F.lit(r"\E"))
    one = c.book.spark.range(1).select(text(x).alias("t"))
    if col is None:
        df = one.select(F.posexplode(F.call_function("split", F.col("t"), quote(rows))).alias("_row", "c1"))
        return Grid(df.select(F.col("_row").cast("long").alias("_row"), "c1"), ["c1"], True)
    df = one.select(F.posexplode(F.call_function("split", F.col("t"), quote(rows)) if rows else F.array("t")).alias("_row", "l")).withColumn("p", F.call_function("split", F.col("l"), quote(col)))
    width = df.agg(F.max(F.size("p"))).first()[0]
    names = [f"c{k + 1}" for k in range(width)]
    return Grid(df.select(F.col("_row").cast("long").alias("_row"), *(F.get("p", F.lit(k)).alias(n) for k, n in enumerate(names))), names, True)


# ---------------------------------------------------------------- grouping

#: Aggregates that may be named for GROUPBY and PIVOTBY.
NAMED = {"SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "COUNTA": F.count, "MAX": F.max, "MIN": F.min, "MEDIAN": F.median, "STDEV.S": F.stddev_samp, "STDEV.P": F.stddev_pop, "VAR.S": F.var_samp, "VAR.P": F.var_pop, "PRODUCT": F.product}


def _aggregate_of(c, node, env):
    f = c.eval(node, env)
    if isinstance(f, str) and f in NAMED:
        return NAMED[f]
    if isinstance(f, Fn) and isinstance(f.body, S.Call) and f.body.name in NAMED and len(f.body.args) == 1:
        return NAMED[f.body.name]
    raise Unsupported("this aggregate")


def _same_rows(*vecs):
    if any(not isinstance(v, Vec) or v.sheet is not vecs[0].sheet or (v.lo, v.hi) != (vecs[0].lo, vecs[0].hi) for v in vecs):
        raise S.FormulaError("C-SHAPE", "fields and values differ in rows")


@function("GROUPBY", whole=True)
def _groupby(c, args, env):
    """Groups in ascending order of their fields, then the grand total (totals 1, the default; 0 for none)."""
    fields, values = c.eval(args[0], env), c.eval(args[1], env)
    agg = _aggregate_of(c, args[2], env)
    totals = _int(c, args, 4, env, 1)
    sort = _int(c, args, 5, env, None)
    _same_rows(fields, values)
    rows = fields.frame()
    if len(args) > 6 and args[6] is not None:
        keep, name = c.lifted(fields.sheet, fields.lo, fields.hi, rows), fresh("keep")
        test = truth(keep.scalar(args[6], env))
        rows = keep.scope.build().withColumn(name, test).where(F.col(name))
    n, k = len(fields.columns), len(values.columns)
    keys = {f"c{i + 1}": x.col for i, x in enumerate(fields.cells())}
    vals = {f"c{n + i + 1}": (x.col.cast("double") if x.kind == "number" else x.col) for i, x in enumerate(values.cells())}
    df = rows.select(*(x.alias(a) for a, x in keys.items()), *(x.alias(a) for a, x in vals.items()))
    if totals:
        total = df.agg(*(agg(a).alias(a) for a in vals)).select(F.lit(None).cast(dict(df.dtypes)["c1"]).alias("c1"), *vals)
    out = df.groupBy(*keys).agg(*(agg(a).alias(a) for a in vals))
    names = [f"c{i + 1}" for i in range(n + k)]
    order = [F.col(x).asc_nulls_last() for x in keys] if sort is None else [(F.col(names[abs(sort) - 1]).desc() if sort < 0 else F.col(names[sort - 1]).asc()), *(F.col(x) for x in keys)]
    out = numbered(out, *order)
    if totals:
        label = [F.lit("Total").alias("c1") if dict(df.dtypes)["c1"] == "string" else F.col("c1"), *(F.lit(None).cast(dict(df.dtypes)[x]).alias(x) for x in list(keys)[1:])]
        last = total.select(F.lit(1 << 62).alias("_row"), *label, *vals)
        out = out.select("_row", *names).union(last)
    return Grid(out.select("_row", *names), names, False)


#: Parts the fields of a column head, where they are one text.
_PART = "\u0001"


def _pivoted(df: DataFrame, keys: list[str], fields: list[str], vals: list[str], heads: list[tuple], agg, totals: bool, names: list[str]) -> DataFrame:
    """keys, and a column for each head and value, then totals: aggregated by key and head first, then laid out in a row of each key."""
    own = [agg(F.col(v)).alias(v) for v in vals]
    wide = df.withColumn("_head", F.concat_ws(_PART, *fields)).groupBy(*keys).pivot("_head", [_PART.join(h) for h in heads]).agg(*own) if heads else df.select(*keys).distinct()
    wide = wide.toDF(*keys, *names[: len(heads) * len(vals)])
    if totals:
        wide = wide.join(df.groupBy(*keys).agg(*(agg(F.col(v)).alias(m) for v, m in zip(vals, names[len(heads) * len(vals) :], strict=True))), keys)
    return wide


@function("PIVOTBY", whole=True)
def _pivotby(c, args, env):
    """Rows by the first fields, columns by the second; the first row heads the columns; totals on both sides unless told 0."""
    rows, cols, values = c.eval(args[0], env), c.eval(args[1], env), c.eval(args[2], env)
    agg = _aggregate_of(c, args[3], env)
    row_totals, col_totals = _int(c, args, 5, env, 1), _int(c, args, 7, env, 1)
    _same_rows(rows, cols, values)
    n, over = len(rows.columns), len(cols.columns)
    keys, fields, vals = [f"k{i}" for i in range(n)], [f"p{i}" for i in range(over)], [f"v{i}" for i in range(len(values.columns))]
    shown = lambda v, names: [text(Cell(x.col, x.kind)).alias(a) for a, x in zip(names, v.cells(), strict=True)]
    df = rows.frame().select(*shown(rows, keys), *shown(cols, fields), *((x.col.cast("double") if x.kind == "number" else x.col).alias(a) for a, x in zip(vals, values.cells(), strict=True)))
    heads = [tuple(r) for r in df.select(*fields).distinct().orderBy(*fields).limit(16_385).collect()]
    if len(heads) * len(vals) > 16_384:
        raise Unsupported("more columns than a sheet has")
    names = [f"c{i + 1}" for i in range(n + len(heads) * len(vals) + (len(vals) if col_totals else 0))]
    body = numbered(_pivoted(df, keys, fields, vals, heads, agg, bool(col_totals), names[n:]), *keys)
    body = body.select((F.col("_row") + over).alias("_row"), *(F.col(k).alias(m) for k, m in zip(keys, names, strict=False)), *(F.col(m).cast("string").alias(m) for m in names[n:]))
    # a row of heads for each column field
    tops = [[h[i] for h in heads for _ in vals] + (["Total" if i == 0 else ""] * len(vals) if col_totals else []) for i in range(over)]
    out = body
    for i, top in reversed(list(enumerate(tops))):
        out = c.book.spark.range(1).select(F.lit(i).cast("long").alias("_row"), *(F.lit("").alias(m) for m in names[:n]), *(F.lit(h).cast("string").alias(m) for h, m in zip(top, names[n:], strict=True))).union(out)
    if row_totals:
        total = _pivoted(df.withColumn("_all", F.lit(0)), ["_all"], fields, vals, heads, agg, bool(col_totals), names[n:])
        out = out.union(total.select(F.lit(1 << 62).alias("_row"), *(F.lit("Total" if i == 0 else "").alias(m) for i, m in enumerate(names[:n])), *(F.col(m).cast("string").alias(m) for m in names[n:])))
    return Grid(out, names, False)


# ---------------------------------------------------------------- LAMBDA helpers


@function("MAP", whole=True)
def _map(c, args, env):
    f = c.function_of(args[-1], env)
    vecs = [c.eval(a, env) for a in args[:-1]]
    if all(isinstance(v, Vec) and v.sheet is vecs[0].sheet and (v.lo, v.hi) == (vecs[0].lo, vecs[0].hi) for v in vecs):
        inner = c.lifted(vecs[0].sheet, vecs[0].lo, vecs[0].hi, vecs[0].frame())
        cells = [inner.apply(f, [v.cells()[k] for v in vecs]) for k in range(len(vecs[0].columns))]
        return named(inner.scope.build(), [x.col for x in cells], vecs[0].key())
    if len(vecs) == 1 and isinstance(vecs[0], Grid):
        inner = c.inner(Scope(vecs[0].df, None, True))
        cells = [inner.apply(f, [x]) for x in vecs[0].cells()]
        out = named(inner.scope.build(), [x.col for x in cells])
        out.dense = vecs[0].dense
        return out
    return _map_places(c, f, [placed(c.grid(a, env)) for a in args[:-1]])


def _map_places(c, f, grids: list[Grid]) -> Grid:
    """Arrays of several sheets or computations, place by place: a join on positions; where one has no row the result is an error."""
    width = len(grids[0].columns)
    if any(len(g.columns) != width for g in grids):
        raise Unsupported("MAP over arrays of different widths")
    rows, own = None, []
    for k, g in enumerate(grids):
        own.append([f"m{k}_{i}" for i in range(width)])
        df = g.df.select("_row", *(F.col(x).alias(n) for x, n in zip(g.columns, own[-1], strict=True)), F.lit(True).alias(f"in_{k}"))
        rows = df if rows is None else rows.join(df, "_row", "full_outer")
    cells = [Grid(rows, names).cells() for names in own]
    inner = c.inner(Scope(rows, None, True))
    got = [inner.apply(f, [x[i] for x in cells]) for i in range(width)]
    there = reduce(Column.__and__, (F.col(f"in_{k}").isNotNull() for k in range(len(grids))))
    out = named(inner.scope.build(), [F.when(there, x.col) for x in got])
    out.dense = True
    return out


@function("BYROW", whole=True)
def _byrow(c, args, env):
    v, f = c.eval(args[0], env), c.function_of(args[1], env)
    inner = c.lifted(v.sheet, v.lo, v.hi, v.frame()) if isinstance(v, Vec) else c.inner(Scope(v.df, None, True))
    cell = inner.apply(f, [Row(v.cells())])
    return named(inner.scope.build(), [cell.col], v.key())


@function("BYCOL", whole=True)
def _bycol(c, args, env):
    v, f = c.eval(args[0], env), c.function_of(args[1], env)
    parts = [Vec(v.sheet, [x], v.lo, v.hi) if isinstance(v, Vec) else Grid(v.df.select("_row", F.col(x).alias("c1")), ["c1"], v.dense) for x in (v.columns)]
    cells = [c.apply(f, [p]) for p in parts]
    names = [f"c{k + 1}" for k in range(len(cells))]
    return Grid(c.book.spark.range(1).select(F.lit(0).cast("long").alias("_row"), *(x.col.alias(n) for x, n in zip(cells, names, strict=True))), names, True)


def _folding(f: Fn):
    """("+", expression of the item) and the like, where the order of a fold doesn't matter; else None."""
    if len(f.params) != 2:
        return None
    acc, body = f.params[0], f.body
    uses = lambda node: any(isinstance(n, S.Name) and n.name.casefold() == acc for n in S.walk(node))
    mine = lambda node: isinstance(node, S.Name) and node.name.casefold() == acc
    if isinstance(body, S.Binary) and body.op in "+*":
        for a, b in ((body.left, body.right), (body.right, body.left)):
            if mine(a) and not uses(b):
                return body.op, b
    if isinstance(body, S.Call) and body.name in ("MAX", "MIN") and len(body.args) == 2:
        for a, b in (body.args, body.args[::-1]):
            if mine(a) and not uses(b):
                return body.name, b
    return None


def _items(c, node, env, f: Fn, body):
    """A frame with the item's expression as column, and the row order."""
    v = c.eval(node, env)
    if len(v.columns) != 1:
        raise Unsupported("a fold over several columns")
    inner = c.lifted(v.sheet, v.lo, v.hi, v.frame()) if isinstance(v, Vec) else c.inner(Scope(v.df, None, True))
    cell = inner.eval(body, {**f.env, f.params[1]: v.cells()[0]})
    return inner.scope.build().select(v.key().alias("_row"), number(cell).alias("x"))


#: Cells up to which a fold whose steps depend on each other is one array in a task; beyond, a state is passed from group to group.
FEW = 5_000


def _ordered(c, node, env, init: Cell, f: Fn, keep: bool) -> DataFrame:
    """The fold's last state (x), or each (_row, x), of all items in row order."""
    v = c.eval(node, env)
    if isinstance(v, Vec) and v.lo is not None and v.lo == v.hi or len(v.columns) != 1:
        raise Unsupported("a fold over several columns")
    cell = v.cells()[0]
    value = number(cell) if cell.kind == "number" else cell.col

    def step(a, x):
        c.stepping = True
        try:
            return c.apply(f, [Cell(a, init.kind), Cell(x, cell.kind)]).col
        finally:
            c.stepping = False

    if v.frame().limit(FEW + 1).count() > FEW:
        return passed(v.placed(), value, init.col, step, keep)
    items = F.transform(F.array_sort(F.collect_list(F.struct(v.key().alias("k"), value.alias("v")))), lambda s: s["v"])
    if not keep:
        return v.frame().agg(F.aggregate(items, init.col, step).alias("x"))
    rows = v.frame().agg(_steps(items, init.col, step).alias("x")).select(F.posexplode("x").alias("_row", "x"))
    return rows.select(F.col("_row").cast("long").alias("_row"), "x")


@function("REDUCE", whole=True)
def _reduce(c, args, env):
    init, f = c.scalar(args[0], env), c.function_of(args[2], env)
    if isinstance(one := c.eval(args[1], env), Cell):
        return c.apply(f, [init, one])
    if shape := _folding(f):
        op, body = shape
        df = _items(c, args[1], env, f, body)
        agg = {"+": F.sum, "*": F.product, "MAX": F.max, "MIN": F.min}[op]("x")
        got = df.agg(agg).scalar()
        x = number(init)
        out = {"+": lambda: x + F.coalesce(got, F.lit(0.0)), "*": lambda: x * F.coalesce(got, F.lit(1.0)), "MAX": lambda: F.greatest(x, got), "MIN": lambda: F.least(x, got)}[op]()
        return Cell(out, "number", const=True)
    return Cell(_ordered(c, args[1], env, init, f, False).scalar(), init.kind, const=True)


@function("SCAN", whole=True)
def _scan(c, args, env):
    init, f = c.scalar(args[0], env), c.function_of(args[2], env)
    shape = _folding(f)
    if shape:
        none, fold, join = {"+": (0.0, "sum", lambda a, b: a + b), "*": (1.0, "product", lambda a, b: a * b), "MAX": (None, "max", F.greatest), "MIN": (None, "min", F.least)}[shape[0]]
        item = F.col("x") if none is None else F.coalesce(F.col("x"), F.lit(none))
        df = running(_items(c, args[1], env, f, shape[1]), item, "so_far", "_row", fold=fold)
        return named(df, [join(number(init), F.col("so_far"))])
    return Grid(_ordered(c, args[1], env, init, f, True).withColumnRenamed("x", "c1"), ["c1"], True)

