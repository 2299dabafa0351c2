"""The gate: which formulas may run, and over which cells."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import syntax as S

#: The functions of the language, by kind.
ALLOWED = frozenset(
    """
    ABS CEILING.MATH FLOOR.MATH INT MOD POWER PRODUCT QUOTIENT ROUND ROUNDDOWN ROUNDUP MROUND SIGN SQRT
    SUM SUMIF SUMIFS SUMPRODUCT TRUNC EXP LN LOG LOG10 PI
    AVERAGE AVERAGEIF AVERAGEIFS COUNT COUNTA COUNTBLANK COUNTIF COUNTIFS MAX MAXIFS MIN MINIFS MEDIAN
    MODE.SNGL STDEV.S STDEV.P VAR.S VAR.P LARGE SMALL RANK.EQ RANK.AVG PERCENTILE.INC QUARTILE.INC CORREL
    IF IFS IFERROR IFNA AND OR NOT XOR SWITCH TRUE FALSE
    XLOOKUP XMATCH VLOOKUP HLOOKUP INDEX MATCH CHOOSE CHOOSECOLS CHOOSEROWS ROW ROWS COLUMN COLUMNS
    TAKE DROP EXPAND VSTACK HSTACK TOCOL TOROW WRAPROWS WRAPCOLS
    FILTER SORT SORTBY UNIQUE SEQUENCE GROUPBY PIVOTBY LET LAMBDA MAP REDUCE SCAN BYROW BYCOL MAKEARRAY
    LEFT RIGHT MID LEN FIND SEARCH SUBSTITUTE REPLACE TRIM CLEAN UPPER LOWER PROPER CONCAT TEXTJOIN TEXT
    VALUE NUMBERVALUE TEXTBEFORE TEXTAFTER TEXTSPLIT EXACT REPT REGEXTEST REGEXEXTRACT REGEXREPLACE
    DATE DATEVALUE DAY MONTH YEAR TODAY NOW EDATE EOMONTH NETWORKDAYS NETWORKDAYS.INTL WORKDAY WORKDAY.INTL
    WEEKDAY WEEKNUM ISOWEEKNUM DAYS DATEDIF YEARFRAC TIME HOUR MINUTE SECOND
    ISBLANK ISNUMBER ISTEXT ISERROR ISNA ISLOGICAL NA N
    """.split()
)
#: Functions that are refused by name, by what they would do.
REFUSED = {
    "reach the network": "WEBSERVICE FILTERXML ENCODEURL IMAGE HYPERLINK STOCKHISTORY".split(),
    "connect to another program or data source": "RTD CUBEVALUE CUBEMEMBER CUBESET CUBESETCOUNT CUBERANKEDMEMBER CUBEMEMBERPROPERTY CUBEKPIMEMBER".split(),
    "send data to a service": "PY COPILOT TRANSLATE DETECTLANGUAGE".split(),
    "escape the permitted cells": "INDIRECT OFFSET GETPIVOTDATA".split(),
    "read the environment or run code": "CELL INFO CALL REGISTER.ID".split(),
}
WHY = {name: why for why, names in REFUSED.items() for name in names}
_URL = re.compile(r"(?i)\b(?:https?|ftp|file)://|\bmailto:|\bwww\.|\\\\[\w.-]+\\")


@dataclass
class Context:
    """What a formula may see. home: the sheet of unqualified references."""

    home: str
    allowed: list[S.Area]
    sheets: list[str] = field(default_factory=list)
    tables: dict[str, S.Area] = field(default_factory=dict)
    #: Defined names that shadow functions; None if they couldn't be read (then every call by name is doubtful).
    names: list[str] | None = field(default_factory=list)


@dataclass(frozen=True)
class Verdict:
    ok: bool
    reasons: tuple[tuple[str, str], ...] = ()


def covered(area: S.Area, allowed: list[S.Area]) -> bool:
    """Whether the union of the allowed areas of its sheet holds the area; whole rows never are."""
    if area.left is None:
        return False
    own = [a for a in allowed if a.sheet is not None and area.sheet is not None and a.sheet.casefold() == area.sheet.casefold()]
    if area.top is None:
        # a whole column is read to its last used cell, which lies in the allowed areas of that column
        return all(any(a.left <= c <= a.right for a in own) for c in range(area.left, area.right + 1))
    # compress the coordinates and test one cell of each box
    rows = sorted({area.top, *(x for a in own if a.top is not None for x in (a.top, a.bottom + 1) if area.top < x <= area.bottom)})
    cols = sorted({area.left, *(x for a in own for x in (a.left, a.right + 1) if area.left < x <= area.right)})
    return all(any((a.top is None or a.top <= r <= a.bottom) and a.left <= c <= a.right for a in own) for r in rows for c in cols)


class _Check:
    def __init__(self, ctx: Context, shift: int):
        self.ctx, self.shift, self.found = ctx, shift, []
        self.sheets = {s.casefold() for s in [ctx.home, *ctx.sheets, *(a.sheet for a in ctx.allowed if a.sheet)]}
        self.tables = {t.casefold(): t for t in ctx.tables}

    def add(self, code: str, detail: str) -> None:
        if (code, detail[:60]) not in self.found:
            self.found.append((code, detail[:60]))

    def area(self, ref: S.Ref) -> None:
        a = ref.area
        sheet = a.sheet or self.ctx.home
        if sheet.casefold() not in self.sheets:
            self.add("G-EXT", sheet)
            return
        if ref.spill:
            self.add("G-REF", f"{ref.text}#")
            return
        boxes = {(a.top, a.bottom)}
        if self.shift and a.top is not None:  # filled down: relative ends move, and only the edges matter
            top = a.top if ref.fixed[0] else a.top + self.shift
            bottom = a.bottom if ref.fixed[2] else a.bottom + self.shift
            boxes |= {(min(top, bottom), max(top, bottom)), (min(a.top, top), max(a.bottom, bottom))}
        for top, bottom in boxes:
            if not covered(S.Area(sheet, top, a.left, bottom, a.right), self.ctx.allowed):
                self.add("G-REF", ref.text)

    def visit(self, node, scope: frozenset[str]) -> None:
        if node is None:
            return
        if isinstance(node, S.Literal):
            if node.kind == "text" and _URL.search(node.value):
                self.add("G-URL", "a web address in a text")
        elif isinstance(node, S.Ref):
            self.area(node)
        elif isinstance(node, S.Struct):
            if node.table.casefold() not in self.tables:
                self.add("G-EXT", node.table)
            else:
                area = self.ctx.tables[self.tables[node.table.casefold()]]
                if not covered(area, self.ctx.allowed):
                    self.add("G-REF", node.table)
        elif isinstance(node, S.Name):
            if node.name.casefold() not in scope and node.name.casefold() not in self.tables and not (S.plain_name(node.name) in ALLOWED and self.known(node.name)):
                self.add("G-NAME", node.name)
        elif isinstance(node, S.Call):
            self.call(node, scope)
        elif isinstance(node, S.Apply):
            self.visit(node.target, scope)
            for a in node.args:
                self.visit(a, scope)
        elif isinstance(node, S.Binary):
            if node.op == ":":
                self.add("G-REF", "a computed range")
            self.visit(node.left, scope)
            self.visit(node.right, scope)
        elif isinstance(node, (S.Unary, S.Percent)):
            self.visit(node.operand, scope)
        elif isinstance(node, S.Array):
            for row in node.rows:
                for v in row:
                    self.visit(v, scope)

    def known(self, name: str) -> bool:
        return self.ctx.names is not None and name.casefold() not in {n.casefold() for n in self.ctx.names}

    def call(self, node: S.Call, scope: frozenset[str]) -> None:
        if node.name == "LET":
            if len(node.args) < 3 or len(node.args) % 2 == 0:
                self.add("G-PARSE", "LET takes pairs and a result")
                return
            for name, value in zip(node.args[:-1:2], node.args[1:-1:2], strict=True):
                self.visit(value, scope)
                if not isinstance(name, S.Name):
                    self.add("G-NAME", "a LET name")
                else:
                    scope |= {name.name.casefold()}
            self.visit(node.args[-1], scope)
            return
        if node.name == "LAMBDA":
            if not node.args:
                self.add("G-PARSE", "LAMBDA needs a body")
                return
            inner = set()
            for name in node.args[:-1]:
                if not isinstance(name, S.Name) or name.name.casefold() in inner:
                    self.add("G-NAME", "a LAMBDA name")
                else:
                    inner.add(name.name.casefold())
            self.visit(node.args[-1], scope | inner)
            return
        if node.name.casefold() not in scope and node.name not in ALLOWED:
            self.add("G-FUNC", f"{node.name} can {WHY[node.name]}" if node.name in WHY else node.name)
        for a in node.args:
            self.visit(a, scope)


def check(formula: str, ctx: Context, shift: int = 0) -> Verdict:
    """Never raises: what can't be parsed or checked is refused. shift: rows that the formula is filled down."""
    try:
        node = S.parse(formula)
        c = _Check(ctx, shift)
        c.visit(node, frozenset())
        return Verdict(not c.found, tuple(c.found))
    except S.FormulaError as e:
        found = [(e.code, e.detail)]
        if isinstance(formula, str):
            found += [("G-FUNC", f"{n} can {WHY[n]}") for n in sorted({S.plain_name(m) for m in re.findall(r"[^\W\d][\w.]*(?=\s*\()", formula)} & set(WHY)) if e.code != "G-FUNC"]
        return Verdict(False, tuple(found))
    except (RecursionError, TypeError, ValueError, AttributeError) as e:
        return Verdict(False, (("G-PARSE", type(e).__name__),))


def combined(*verdicts: Verdict) -> Verdict:
    """Before and after stand-ins are restored: all must pass; reasons once each."""
    found = tuple(dict.fromkeys(r for v in verdicts for r in v.reasons))
    return Verdict(all(v.ok for v in verdicts), found)


def whole_columns(formula: str) -> list[str]:
    return [n.text for n in S.walk(S.parse(formula)) if isinstance(n, S.Ref) and n.area.top is None]


def qualified(formula: str, sheet: str) -> str:
    """The formula with unqualified references put on a sheet."""
    out, at = ["="], 1
    for t in S.tokenize(formula):
        out.append(formula[at : t.at])
        out.append(f"{S.quoted(sheet)}!{t.text}" if t.kind in ("cell", "column", "row") and t.sheet is None and not formula[: t.at].endswith(":") else t.text)
        at = t.at + len(t.text)
    return "".join(out)


def lineage(formula: str, home: str) -> list[S.Area]:
    """Every area a formula reads."""
    return [S.Area(n.area.sheet or home, n.area.top, n.area.left, n.area.bottom, n.area.right) for n in S.walk(S.parse(formula)) if isinstance(n, S.Ref)]


def placement(ctx: Context, selection: S.Area, cell: str | None = None, fill_down: bool = False) -> tuple[S.Area | None, str | None]:
    """(target, problem): where a formula goes; the first column right of the selection by default.

    A target lies outside all read ranges, and a formula fills down only from the first data row.
    """
    if cell is None:
        target = S.Area(selection.sheet, selection.top + 1, selection.right + 1, selection.top + 1, selection.right + 1)
    else:
        try:
            target = S.parse_address(cell)
        except S.FormulaError:
            return None, "no cell"
        target = S.Area(target.sheet or selection.sheet, target.top, target.left, target.bottom, target.right)
    if None in (target.top, target.left) or (target.top, target.left) != (target.bottom, target.right):
        return None, "no single cell"
    bottom = selection.bottom if fill_down else target.bottom
    if any(a.sheet == target.sheet and a.left <= target.left <= a.right and (a.top is None or (a.top <= bottom and target.top <= a.bottom)) for a in ctx.allowed):
        return None, "inside a range that is read"
    if fill_down and target.top != selection.top + 1:
        return None, "not the first data row"
    return target, None
