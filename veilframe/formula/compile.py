"""Formulas to Catalyst: a fill-down formula becomes a column, a range aggregate a scalar subquery, a spill a DataFrame.

Criteria that vary by row (SUMIFS over a key of the row) become one grouped aggregate and an equi-join; lookups
become an equi-join with the first match by row order, or an as-of join; nothing loops over rows.
"""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import syntax as S
from .moving import Moving, moves, of_reference, row_of
from .values import Cell, Fn, Grid, Row, Scope, Sheet, Vec, kind_of, number, text, truth, wildcard

_ids = itertools.count()


def fresh(prefix: str = "j") -> str:
    return f"__{prefix}{next(_ids)}"


class Unsupported(S.FormulaError):
    def __init__(self, detail: str):
        super().__init__("C-UNSUPPORTED", detail)


#: name -> function(compiler, args (nodes), env); filled by functions.py and arrays.py.
FUNCTIONS: dict = {}
#: Functions whose range arguments are consumed whole.
WHOLE: set[str] = set()


def function(*names: str, whole: bool = False):
    def put(f):
        for n in names:
            FUNCTIONS[n] = f
            if whole:
                WHOLE.add(n)
        return f

    return put


def lit(value) -> Cell:
    if isinstance(value, bool):
        return Cell(F.lit(value), "bool", const=True, value=value)
    if isinstance(value, (int, float)):
        return Cell(F.lit(float(value)), "number", const=True, value=value)
    return Cell(F.lit(value), "text", const=True, value=value)


class Workbook:
    def __init__(self, spark: SparkSession):
        self.spark, self.sheets = spark, {}

    def add(self, name: str, df: DataFrame, order: list[str], columns: list[str] | None = None) -> Sheet:
        """A sheet, also a table of that name; rows stand in the order of the key columns."""
        self.sheets[name.casefold()] = s = Sheet(name, df if columns is None else df.select(*dict.fromkeys([*columns, *order])), order, columns)
        return s

    def sheet(self, name: str) -> Sheet:
        if name.casefold() not in self.sheets:
            raise S.FormulaError("G-EXT", name)
        return self.sheets[name.casefold()]

    # ------------------------------------------------------------ the three ways to use a formula

    def cell(self, formula: str, home: str, name: str = "value") -> DataFrame:
        """One value, as a one-row DataFrame."""
        c = Compiler(self, self.sheet(home), Scope(None))
        v = c.scalar(S.parse(formula), {})
        return self.spark.range(1).select(v.col.alias(name))

    def cells(self, formulas: dict[str, str], home: str) -> DataFrame:
        """Several one-value formulas in one row."""
        c = Compiler(self, self.sheet(home), Scope(None))
        return self.spark.range(1).select(*(c.scalar(S.parse(f), {}).col.alias(n) for n, f in formulas.items()))

    def fill(self, formulas: dict[str, str], home: str, keep: list[str] | None = None) -> DataFrame:
        """The sheet with a column for each formula, written for its first data row (row 2) and filled down."""
        sheet = self.sheet(home)
        nodes = {n: S.parse(f) for n, f in formulas.items()}
        clash = [n for n in nodes if n.casefold() in {c.casefold() for c in sheet.columns}]
        if clash:
            raise S.FormulaError("C-PLACE", clash[0])
        scope = Scope(sheet.rows() if any(needs_rows(x) for x in nodes.values()) else sheet.df, sheet)
        c = Compiler(self, sheet, scope, filling=True)
        out = {n: c.scalar(x, {}) for n, x in nodes.items()}
        return scope.build().select(*(keep if keep is not None else sheet.columns), *(v.col.alias(n) for n, v in out.items()))

    def spill(self, formula: str, home: str, names: list[str] | None = None, order: bool = False) -> DataFrame:
        """An array's rows; ``order`` keeps their place in ``_row``."""
        c = Compiler(self, self.sheet(home), Scope(None))
        g = c.grid(S.parse(formula), {})
        names = names or g.columns
        df = g.placed() if order else g.df
        return df.select(*([F.col("_row").cast("long").alias("_row")] if order else []), *(F.col(a).alias(b) for a, b in zip(g.columns, names, strict=True)))


def needs_rows(node) -> bool:
    """Whether a filled-down formula looks at positions, or asks each row's question of other rows."""
    for n in S.walk(node):
        if isinstance(n, S.Ref) and n.area.top is not None:
            if moves(n) and not (n.area.top == n.area.bottom == 1 and not any(n.fixed[::2]) and not n.area.sheet):
                return True  # but for cells of the row itself
            if n.area.top == n.area.bottom and n.fixed[0]:
                return True
        if isinstance(n, S.Call) and n.name in CONDITIONAL and any(isinstance(x, S.Binary) and x.op in ("&", "<", ">", "<=", ">=") for a in n.args for x in S.walk(a)):
            return True
        if isinstance(n, S.Call) and n.name == "ROW" or isinstance(n, S.Binary) and n.op == ":":
            return True
    return False


#: Functions whose criteria may ask each row's question of other rows.
CONDITIONAL = ("SUMIFS", "SUMIF", "COUNTIFS", "COUNTIF", "AVERAGEIFS", "AVERAGEIF", "MAXIFS", "MINIFS", "SUMPRODUCT")


class Compiler:
    """filling: references without $ move with the row that the formula is filled down to, also inside arrays."""

    def __init__(self, book: Workbook, home: Sheet, scope: Scope, filling: bool = False):
        self.book, self.home, self.scope, self.filling = book, home, scope, filling
        self.stepping = False  # inside a fold's step, where Spark takes no Python function

    def inner(self, scope: Scope) -> Compiler:
        return Compiler(self.book, self.home, scope, self.filling)

    # ------------------------------------------------------------ references

    def vec(self, ref: S.Ref):
        sheet = self.book.sheet(ref.area.sheet) if ref.area.sheet else self.home
        a = ref.area
        if a.left is None:
            raise Unsupported("whole rows")
        if a.right >= len(sheet.columns):
            raise S.FormulaError("G-REF", ref.text)
        columns = sheet.columns[a.left : a.right + 1]
        if a.top is None or (a.top <= 1 and a.bottom >= S.MAX_ROW - 1):
            return Vec(sheet, columns)
        return Vec(sheet, columns, max(0, a.top - 1), a.bottom - 1)

    def moving(self, node, env) -> Moving | None:
        """The range that a node is in each fill row, if that differs from row to row."""
        if isinstance(node, S.Name):
            v = env.get(node.name.casefold())
            return v if isinstance(v, Moving) else None
        if isinstance(node, S.Binary) and node.op == ":":
            return self.computed(node, env)
        if not (self.filling and isinstance(node, S.Ref) and moves(node)) or node.spill:
            return None
        if node.area.top == node.area.bottom and node.fixed[0] == node.fixed[2]:
            return None  # one row: its cells
        if self.scope.lifted:
            raise Unsupported("a range that moves with the row, inside an array")
        sheet = self.book.sheet(node.area.sheet) if node.area.sheet else self.home
        if node.area.right >= len(sheet.columns):
            raise S.FormulaError("G-REF", node.text)
        return of_reference(sheet, sheet.columns[node.area.left : node.area.right + 1], node)

    def corner(self, node, env) -> tuple[Sheet, int, int, tuple]:
        """(sheet, first column, last column, position) of one end of a computed range."""
        if isinstance(node, S.Ref) and node.area.top is not None and node.area.left is not None and node.area.top == node.area.bottom:
            sheet = self.book.sheet(node.area.sheet) if node.area.sheet else self.home
            kind = "row" if self.filling and not node.fixed[0] else "fixed"
            return sheet, node.area.left, node.area.right, (kind, node.area.top - 1)
        if isinstance(node, S.Call) and node.name == "INDEX" and isinstance(node.args[0], (S.Ref, S.Struct, S.Name)):
            v = self.whole(node.args[0], env)
            if isinstance(v, Vec):
                k = self.scalar(node.args[2], env).value if len(node.args) > 2 else 1
                n = self.scalar(node.args[1], env) if node.args[1] is not None else None
                if isinstance(k, (int, float)) and n is not None and n.value != 0:
                    column = v.sheet.columns.index(v.columns[int(k) - 1])
                    place = ("fixed", int(n.value) - 1 + (v.lo or 0)) if isinstance(n.value, (int, float)) else ("computed", F.when(number(n) >= 1, number(n) - 1 + (v.lo or 0)))
                    return v.sheet, column, column, place
        raise Unsupported("a computed range whose ends are no cells and no INDEX")

    def computed(self, node: S.Binary, env):
        if self.scope.lifted or not self.filling:
            raise Unsupported("a computed range outside a filled-down column")
        a, b = self.corner(node.left, env), self.corner(node.right, env)
        if a[0] is not b[0]:
            raise S.FormulaError("G-REF", "ends on two sheets")
        left, right = min(a[1], b[1]), max(a[2], b[2])
        if right >= len(a[0].columns):
            raise S.FormulaError("G-REF", "a column that isn't there")
        return Moving(a[0], a[0].columns[left : right + 1], a[3], b[3])

    def at(self, vec: Vec) -> Cell:
        """A single cell."""
        return Cell(vec.frame().agg(F.max(vec.columns[0])).scalar(), vec.sheet.kinds[vec.columns[0]], plain=True, const=True)

    def reference(self, ref: S.Ref):
        if (m := self.moving(ref, {})) is not None:
            return m
        s = self.scope
        if self.filling and moves(ref) and not ref.spill:
            if s.lifted:
                raise Unsupported("a cell that moves with the row, inside an array")
            if ref.area.right > ref.area.left:
                return row_of(self, ref)
        vec = self.vec(ref)
        if s.lifted and s.sheet is vec.sheet and len(vec.columns) == 1 and (vec.lo is None or vec.lo != vec.hi):
            return Cell(F.col(vec.columns[0]), vec.sheet.kinds[vec.columns[0]], plain=True)
        above = self.filling and moves(ref) and ref.area.top == ref.area.bottom == 0  # the header, over the first row
        if not above and (vec.lo is None or vec.lo != vec.hi or len(vec.columns) > 1):
            return vec
        if s.frame is None or s.lifted or ref.fixed[0] or not self.filling:
            return self.at(vec)
        column, kind = vec.columns[0], vec.sheet.kinds[vec.columns[0]]
        offset = ref.area.top - 1  # the header is at -1
        if offset == 0 and vec.sheet is s.sheet:
            return Cell(F.col(column), kind, plain=True)
        name, other = fresh(), vec.sheet.rows()
        shifted = other.select((F.col("_row") - offset).alias(name + "r"), F.col(column).alias(name))
        s.joins.append(lambda df: df.join(shifted, df["_row"] == shifted[name + "r"], "left").drop(name + "r"))
        if offset < 0:  # the first row's cell is the header: no number, so an error there
            blank = {"text": F.lit(""), "number": F.lit(0.0)}.get(kind)
            return Cell(F.when(F.col("_row") + offset >= 0, F.col(name) if blank is None else F.coalesce(F.col(name).cast("double") if kind == "number" else F.col(name), blank)), kind)
        return Cell(F.col(name), kind, plain=True)

    def struct(self, node: S.Struct):
        sheet = self.book.sheet(node.table)
        columns = sheet.columns
        if node.columns:
            names = [sheet.column(c) for c in node.columns]
            columns = columns[columns.index(names[0]) : columns.index(names[-1]) + 1] if len(names) > 1 else names
        if node.part == "headers":
            return Row([lit(c) for c in columns])
        if node.part == "totals":
            raise Unsupported("a totals row")
        vec = Vec(sheet, columns)
        if node.part == "row" or (self.scope.lifted and self.scope.sheet is sheet and len(columns) == 1):
            if self.scope.sheet is not sheet:
                raise S.FormulaError("G-REF", "this row of another table")
            cells = vec.cells()
            return cells[0] if len(cells) == 1 else Row(cells)
        return vec

    # ------------------------------------------------------------ evaluation

    def eval(self, node, env):
        if node is None:
            return Cell(F.lit(None).cast("double"), "number", plain=True, const=True)
        if isinstance(node, S.Literal):
            return Cell(F.lit(None).cast("double"), "number", const=True) if node.kind == "error" else lit(node.value)
        if isinstance(node, S.Ref):
            return self.reference(node)
        if isinstance(node, S.Struct):
            return self.struct(node)
        if isinstance(node, S.Name):
            if node.name.casefold() in env:
                return env[node.name.casefold()]
            if node.name.casefold() in self.book.sheets:
                return Vec(self.book.sheet(node.name), self.book.sheet(node.name).columns)
            if S.plain_name(node.name) in FUNCTIONS:
                return S.plain_name(node.name)
            raise S.FormulaError("G-NAME", node.name)
        if isinstance(node, S.Percent):
            c = self.scalar(node.operand, env)
            return Cell(number(c) / 100, "number", const=c.const)
        if isinstance(node, S.Unary):
            if node.op in ("@", "+"):
                return self.eval(node.operand, env)
            c = self.scalar(node.operand, env)
            return Cell(-number(c), "number", const=c.const, value=-c.value if isinstance(c.value, (int, float)) else None)
        if isinstance(node, S.Binary):
            return self.computed(node, env) if node.op == ":" else self.binary(node, env)
        if isinstance(node, S.Array):
            return self.constants([[v.value if v.kind != "error" else None for v in r] for r in node.rows])
        if isinstance(node, S.Apply):
            f = self.eval(node.target, env)
            if not isinstance(f, Fn):
                raise Unsupported("calling what is no function")
            return self.apply(f, [self.eval(a, env) for a in node.args])
        if isinstance(node, S.Call):
            if (f := env.get(node.name.casefold())) is not None and isinstance(f, Fn):
                return self.apply(f, [self.eval(a, env) for a in node.args])
            if node.name not in FUNCTIONS:
                raise S.FormulaError("G-FUNC", node.name)
            return FUNCTIONS[node.name](self, node.args, env)
        raise Unsupported(type(node).__name__)

    def apply(self, f: Fn, values: list):
        if len(values) > len(f.params):
            raise S.FormulaError("G-PARSE", "too many arguments of a LAMBDA")
        inner = dict(f.env)
        for k, p in enumerate(f.params):
            inner[p] = values[k] if k < len(values) else self.eval(None, {})
        return self.eval(f.body, inner)

    def function_of(self, node, env) -> Fn:
        f = self.eval(node, env)
        if isinstance(f, str):
            return Fn(["x"], S.Call(f, [S.Name("x")]), {})
        if not isinstance(f, Fn):
            raise Unsupported("a LAMBDA is needed")
        return f

    def scalar(self, node, env) -> Cell:
        v = self.eval(node, env)
        if isinstance(v, Cell):
            return v
        if isinstance(v, Row) and len(v.cells) == 1:
            return v.cells[0]
        if isinstance(v, (Vec, Grid)) and len(v.cells()) == 1:
            g = v  # the first value of a one-column array
            c = g.cells()[0]
            return Cell(g.frame().agg(F.min_by(c.col, g.key())).scalar(), c.kind, const=True)
        raise Unsupported("an array where one value is needed")

    def constants(self, rows: list[list]) -> Grid:
        n = len(rows[0])
        kinds = ["string" if any(isinstance(r[k], str) for r in rows) else "boolean" if all(isinstance(r[k], bool) for r in rows) else "double" for k in range(n)]
        cast = {"string": lambda v: None if v is None else str(v), "boolean": lambda v: v, "double": lambda v: None if v is None else float(v)}
        data = [(i, *(cast[k](v) for v, k in zip(r, kinds, strict=True))) for i, r in enumerate(rows)]
        return Grid(self.book.spark.createDataFrame(data, "_row long, " + ", ".join(f"c{k + 1} {t}" for k, t in enumerate(kinds))), [f"c{k + 1}" for k in range(n)])

    def binary(self, node: S.Binary, env) -> Cell:
        if node.op == " ":
            raise Unsupported("an intersection")
        a, b = self.scalar(node.left, env), self.scalar(node.right, env)
        const = a.const and b.const
        op = node.op
        if op == "&":
            return Cell(F.concat(text(a), text(b)), "text", const=const)
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return Cell(compared(op, a, b), "bool", const=const)
        if op in "+-" and "date" in (a.kind, b.kind) and a.kind != b.kind and (op == "+" or a.kind == "date"):
            d, n = (a, b) if a.kind == "date" else (b, a)
            days = F.floor(number(n)).cast("int")
            return Cell(F.date_add(d.col.cast("date"), days if op == "+" else -days), "date", const=const)
        x, y = number(a), number(b)
        col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, x / y), "^": lambda: F.pow(x, y)}[op]()
        return Cell(col, "number", const=const)

    # ------------------------------------------------------------ ranges and arrays

    def has_range(self, node, env) -> Sheet | None:
        """The sheet whose ranges the expression is an array over, if any."""
        if node is None or isinstance(node, (S.Literal, S.Array)):
            return None
        if isinstance(node, S.Ref):
            if self.moving(node, env) is not None:
                raise Unsupported("a range that moves with the row, inside an array")
            v = self.vec(node)
            one = v.lo is not None and v.lo == v.hi
            return None if one or len(v.columns) > 1 else v.sheet
        if isinstance(node, S.Struct):
            return self.book.sheet(node.table) if node.part == "data" and len(node.columns) == 1 else None
        if isinstance(node, S.Name):
            v = env.get(node.name.casefold())
            return v.sheet if isinstance(v, Vec) and len(v.columns) == 1 else None
        if isinstance(node, S.Call) and node.name in WHOLE:
            return next((s for k, a in enumerate(node.args) if (s := self.has_range(a, env)) and k not in whole_places(node.name, len(node.args))), None)
        children = [node.left, node.right] if isinstance(node, S.Binary) else [node.operand] if isinstance(node, (S.Unary, S.Percent)) else node.args if isinstance(node, S.Call) else []
        return next((s for a in children if (s := self.has_range(a, env))), None)

    def whole(self, node, env):
        """A reference as the range it is, also where ranges stand for their cell in the row."""
        if isinstance(node, S.Ref):
            if self.filling and moves(node):
                return self.reference(node)
            v = self.vec(node)
            return v if v.lo is None or v.lo != v.hi or len(v.columns) > 1 else self.reference(node)
        if isinstance(node, S.Struct) and node.part == "data" and self.scope.lifted:
            return Compiler(self.book, self.home, Scope(None)).struct(node)
        return self.eval(node, env)

    def lifted(self, sheet: Sheet, lo=None, hi=None, frame: DataFrame | None = None) -> Compiler:
        if frame is None:
            frame = sheet.df if lo is None else sheet.rows().where(F.col("_row").between(lo, hi))
        return self.inner(Scope(frame, sheet, True, lo, hi))

    def bounds(self, node, env) -> tuple:
        """The positions of the first bounded range in an expression."""
        for n in S.walk(node):
            v = self.vec(n) if isinstance(n, S.Ref) and not (self.filling and moves(n)) else env.get(n.name.casefold()) if isinstance(n, S.Name) else None
            if isinstance(v, Vec) and v.lo is not None and v.lo != v.hi:
                return v.lo, v.hi
        return None, None

    def array(self, node, env, positioned: bool = False):
        """A frame and its cells, and the row order: of a range, an array, or an expression over a range; None for one value."""
        if isinstance(node, (S.Ref, S.Struct)):
            v = self.whole(node, env)
            if isinstance(v, (Vec, Row)):
                return v if isinstance(v, Row) else ((v.placed() if positioned else v.frame()), v.cells(), v.key() if not positioned else F.col("_row"))
            return None
        direct = isinstance(node, (S.Name, S.Array)) or (isinstance(node, S.Call) and node.name in ARRAYS)
        if direct:
            v = self.eval(node, env)
            if isinstance(v, (Vec, Grid)):
                return (v.placed() if positioned else v.frame()), v.cells(), v.key() if not positioned else F.col("_row")
            if isinstance(v, Row):
                return v
            return None
        sheet = self.has_range(node, env)
        if sheet is None:
            v = self.eval(node, env)
            if isinstance(v, (Vec, Grid)):
                return (v.placed() if positioned else v.frame()), v.cells(), v.key() if not positioned else F.col("_row")
            return v if isinstance(v, Row) else None
        lo, hi = self.bounds(node, env)
        frame = None
        if positioned:
            frame = Vec(sheet, sheet.columns, lo, hi).placed()
        c = self.lifted(sheet, lo, hi, frame)
        cell = c.scalar(node, lift_env(env, sheet))
        name = fresh("v")
        df = c.scope.build().withColumn(name, cell.col)
        return df, [Cell(F.col(name), cell.kind)], F.col("_row") if positioned else sheet.key()

    def grid(self, node, env) -> Grid:
        """Any result as an array with row order."""
        got = self.array(node, env)
        if got is None:
            c = self.scalar(node, env)
            return Grid(self.book.spark.range(1).select(F.lit(0).cast("long").alias("_row"), c.col.alias("c1")), ["c1"])
        if isinstance(got, Row):
            df = self.book.spark.range(1).select(F.lit(0).cast("long").alias("_row"), *(c.col.alias(f"c{k + 1}") for k, c in enumerate(got.cells)))
            return Grid(df, [f"c{k + 1}" for k in range(len(got.cells))])
        df, cells, key = got
        out = df.select(key.alias("_row"), *(c.col.alias(f"c{k + 1}") for k, c in enumerate(cells)))
        return Grid(out, [f"c{k + 1}" for k in range(len(cells))], dense=False)

    def aggregate(self, node, env, of) -> Column:
        """of(cells) aggregated over an argument; ``of`` gets all the argument's columns."""
        df, cells, _ = self.array(node, env)
        return df.agg(of(cells)).scalar()


def whole_places(name: str, n: int) -> set[int]:
    """Which arguments of a range function are ranges; the others may be arrays of criteria or keys."""
    if name in ("SUMIFS", "AVERAGEIFS", "MAXIFS", "MINIFS"):
        return {0, *range(1, n, 2)}
    if name == "COUNTIFS":
        return set(range(0, n, 2))
    if name in ("SUMIF", "AVERAGEIF"):
        return {0, 2}
    if name == "COUNTIF":
        return {0}
    if name in ("XLOOKUP",):
        return {1, 2}
    if name in ("VLOOKUP", "HLOOKUP", "MATCH", "XMATCH"):
        return {1}
    if name in ("RANK.EQ", "RANK.AVG"):
        return {1}
    return set(range(n))


def lift_env(env: dict, sheet: Sheet) -> dict:
    """Inside a lifted expression a name for a column of the sheet is that column's cell."""
    return {k: v.cells()[0] if isinstance(v, Vec) and v.sheet is sheet and len(v.columns) == 1 else v for k, v in env.items()}


#: Functions that give arrays.
ARRAYS: set[str] = {"FILTER", "SORT", "SORTBY", "UNIQUE", "SEQUENCE", "GROUPBY", "PIVOTBY", "MAP", "SCAN", "BYROW", "BYCOL", "MAKEARRAY", "TAKE", "DROP", "EXPAND", "VSTACK", "HSTACK", "TOCOL", "TOROW", "WRAPROWS", "WRAPCOLS", "CHOOSECOLS", "CHOOSEROWS", "TEXTSPLIT"}


def compared(op: str, a: Cell, b: Cell) -> Column:
    """Text ignores case; numbers come before text."""
    if a.kind == "text" and b.kind == "text":
        x, y = F.lower(text(a)), F.lower(text(b))
    elif "text" in (a.kind, b.kind):
        if a.value == "" or b.value == "":  # "" equals a blank cell
            x, y = text(a), text(b)
        else:
            x, y = F.lit(int(a.kind == "text")), F.lit(int(b.kind == "text"))
    else:
        x, y = number(a), number(b)
    return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def criterion(target: Cell, given: Cell) -> Column:
    """Whether a cell meets a criterion: an operator and a value in a text, a pattern, or a value."""
    if isinstance(given.value, str):
        rest = given.value
        op = next((o for o in ("<=", ">=", "<>", "<", ">", "=") if rest.startswith(o)), "")
        rest = rest[len(op) :]
        op = op or "="
        try:
            value = float(rest)
        except ValueError:
            value = None
        if rest == "":
            return F.coalesce(target.col.cast("string"), F.lit("")) == "" if op == "=" and given.value else (F.coalesce(target.col.cast("string"), F.lit("")) != "" if op == "<>" else F.coalesce(target.col.cast("string"), F.lit("")) == "")
        if value is not None:
            if target.kind == "text":
                return F.coalesce(target.col == rest, F.lit(False)) if op == "=" else F.coalesce(target.col != rest, F.lit(True)) if op == "<>" else F.lit(False)
            x = number(replace(target, plain=False))
            return F.coalesce({"=": x == value, "<>": x != value, "<": x < value, ">": x > value, "<=": x <= value, ">=": x >= value}[op], F.lit(op == "<>"))
        if target.kind == "date":
            d = F.to_date(F.lit(rest))
            x = target.col.cast("date")
            return F.coalesce({"=": x == d, "<>": x != d, "<": x < d, ">": x > d, "<=": x <= d, ">=": x >= d}[op], F.lit(op == "<>"))
        if target.kind == "bool":
            return F.coalesce(F.lower(target.col.cast("string")) == rest.lower(), F.lit(False))
        if target.kind != "text":
            return F.lit(op == "<>")
        if op in ("=", "<>"):
            hit = F.coalesce(target.col.rlike(wildcard(rest)), F.lit(False)) if any(ch in rest for ch in "*?~") else F.coalesce(F.lower(target.col) == rest.lower(), F.lit(False))
            return hit if op == "=" else ~hit
        x, y = F.lower(target.col), rest.lower()
        return F.coalesce({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], F.lit(False))
    return F.coalesce(compared("=", target, given), F.lit(False))


def join_key(c: Cell) -> Column:
    """What equal cells have in common."""
    return F.lower(text(c)) if c.kind == "text" else truth(c) if c.kind == "bool" else number(c)


__all__ = ["ARRAYS", "FUNCTIONS", "Cell", "Compiler", "Fn", "Grid", "Row", "Scope", "Sheet", "Unsupported", "Vec", "Workbook", "compared", "criterion", "fresh", "function", "join_key", "kind_of", "lit"]
