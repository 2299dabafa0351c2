"""Lexer and parser of worksheet formulas.  Driver-side: formulas are short."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_LENGTH, MAX_DEPTH = 2_000, 100
MAX_COLUMN, MAX_ROW = 16_384, 1_048_576


class FormulaError(ValueError):
    """The text is no formula of the language; ``code`` names the rule."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail[:60]


# ---------------------------------------------------------------- addresses


def letters_to_index(letters: str) -> int:
    """A -> 0, Z -> 25, AA -> 26."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def index_to_letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def quoted(sheet: str) -> str:
    return sheet if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", sheet) else "'" + sheet.replace("'", "''") + "'"


@dataclass(frozen=True)
class Area:
    """Rows and columns from 0, ends included; None is a whole column's or row's open side."""

    sheet: str | None
    top: int | None
    left: int | None
    bottom: int | None
    right: int | None

    def text(self) -> str:
        body = f"{index_to_letters(self.left) if self.left is not None else ''}{'' if self.top is None else self.top + 1}"
        end = f"{index_to_letters(self.right) if self.right is not None else ''}{'' if self.bottom is None else self.bottom + 1}"
        return (f"{quoted(self.sheet)}!" if self.sheet else "") + (body if body == end and self.top is not None and self.left is not None else f"{body}:{end}")


_ADDRESS = re.compile(r"(?:(?P<sheet>'(?:[^']|'')+'|[^!']+)!)?\$?(?P<c1>[A-Za-z]{1,3})?\$?(?P<r1>\d+)?(?::\$?(?P<c2>[A-Za-z]{1,3})?\$?(?P<r2>\d+)?)?$")


def parse_address(text: str) -> Area:
    m = _ADDRESS.match(text.strip())
    if not m or not (m["c1"] or m["r1"]):
        raise FormulaError("G-REF", text)
    sheet = m["sheet"]
    sheet = sheet[1:-1].replace("''", "'") if sheet and sheet[0] == "'" else sheet
    one = ":" not in text.rpartition("!")[2]
    c1 = letters_to_index(m["c1"]) if m["c1"] else None
    r1 = int(m["r1"]) - 1 if m["r1"] else None
    c2 = c1 if one else letters_to_index(m["c2"]) if m["c2"] else None
    r2 = r1 if one else int(m["r2"]) - 1 if m["r2"] else None
    low = lambda a, b: a if b is None else b if a is None else min(a, b)
    high = lambda a, b: a if b is None else b if a is None else max(a, b)
    return Area(sheet, low(r1, r2), low(c1, c2), high(r1, r2), high(c1, c2))


# ---------------------------------------------------------------- tokens


@dataclass(frozen=True)
class Token:
    kind: str  # number text error cell column row name struct op space external
    text: str
    at: int
    sheet: str | None = None


_SHEET = r"(?:(?P<qs>'(?:[^']|'')+')|(?P<us>[^\W\d][\w.]*(?::[^\W\d][\w.]*)?))!"
_PARTS = [
    ("space", r"\s+"),
    ("text", r'"(?:[^"]|"")*"'),
    ("external", r"(?:'[^']*\[[^\]]*\][^']*'|\[[^\]]*\][\w.]*)!(?:\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?|[\w.]+)?"),
    ("struct", r"[^\W\d][\w.]*\[(?:[^\[\]]|\[[^\[\]]*\])*\]"),
    ("error", r"#(?:N/A|NAME\?|VALUE!|REF!|DIV/0!|NUM!|NULL!|SPILL!|CALC!)"),
    ("cell", rf"(?:{_SHEET})?\$?[A-Za-z]{{1,3}}\$?[1-9]\d{{0,6}}(?![\w.(])"),
    ("column", rf"(?:{_SHEET.replace('qs', 'qs2').replace('us>', 'us2>')})?\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}(?![\w.(])"),
    ("row", rf"(?:{_SHEET.replace('qs', 'qs3').replace('us>', 'us3>')})?\$?[1-9]\d{{0,6}}:\$?[1-9]\d{{0,6}}(?![\w.])"),
    ("number", r"(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"),
    ("sheetname", rf"(?:{_SHEET.replace('qs', 'qs4').replace('us>', 'us4>')})[^\W\d][\w.]*"),
    ("name", r"[^\W\d][\w.?]*"),
    ("op", r"<>|<=|>=|[-+*/^&=<>%:@#(){},;]"),
]
_LEXER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PARTS))


def tokenize(text: str) -> list[Token]:
    """Tokens that cover the text after its first ``=`` exactly."""
    out, at = [], 1
    while at < len(text):
        m = _LEXER.match(text, at)
        if not m or m.end() == at:
            raise FormulaError("G-PARSE", f"at {at + 1}")
        kind = m.lastgroup if m.lastgroup in dict(_PARTS) else next(k for k, _ in _PARTS if m.group(k) is not None)
        q = next((m[k] for k in ("qs", "qs2", "qs3", "qs4") if m[k]), None)
        u = next((m[k] for k in ("us", "us2", "us3", "us4") if m[k]), None)
        sheet = q[1:-1].replace("''", "'") if q else u
        out.append(Token(kind, m[0], at, sheet))
        at = m.end()
    return out


# ---------------------------------------------------------------- tree


@dataclass
class Node:
    at: int = field(default=0, kw_only=True)


@dataclass
class Literal(Node):
    value: object
    kind: str  # number text bool error


@dataclass
class Ref(Node):
    area: Area
    fixed: tuple[bool, bool, bool, bool]  # whether top, left, bottom, right are absolute
    text: str
    spill: bool = False


@dataclass
class Struct(Node):
    table: str
    columns: list[str]
    part: str  # data row all headers totals


@dataclass
class Name(Node):
    name: str


@dataclass
class Call(Node):
    name: str
    args: list  # None for an omitted argument


@dataclass
class Apply(Node):
    """A computed function called at once, such as LAMBDA(x, x)(1)."""

    target: Node
    args: list


@dataclass
class Unary(Node):
    op: str
    operand: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Percent(Node):
    operand: Node


@dataclass
class Array(Node):
    rows: list


_PREFIX = re.compile(r"^(?:_xl(?:fn|ws|pm)\.)+", re.IGNORECASE)


def plain_name(name: str) -> str:
    """Without future-function prefixes, ASCII letters in upper case and others as they are."""
    return re.sub(r"[a-z]+", lambda m: m[0].upper(), _PREFIX.sub("", name))


class Parser:
    """Recursive descent; from loosest: comparison, &, + -, * /, ^, %, sign, intersection, range."""

    POWERS = {op: k for k, ops in enumerate([("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",)]) for op in ops}

    def __init__(self, text: str):
        if not text.startswith("="):
            raise FormulaError("G-START", "a formula starts with =")
        if len(text) > MAX_LENGTH:
            raise FormulaError("G-LEN", f"{len(text)} characters")
        self.tokens, self.at, self.depth = tokenize(text), 0, 0
        self.spaced = set()
        kept = []
        for t in self.tokens:
            if t.kind == "space":
                self.spaced.add(len(kept))
            else:
                kept.append(t)
        self.tokens = kept

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].kind == "op" and self.tokens[self.at].text in texts

    def take(self) -> Token:
        if self.at >= len(self.tokens):
            raise FormulaError("G-PARSE", "it ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, text: str) -> None:
        if not self.peek(text):
            raise FormulaError("G-PARSE", f"{text} is missing")
        self.at += 1

    def parse(self) -> Node:
        node = self.level(0)
        if self.at < len(self.tokens):
            raise FormulaError("G-PARSE", self.tokens[self.at].text)
        return node

    def level(self, least: int) -> Node:
        """Operators that bind at least so tightly; all are left-associative."""
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise FormulaError("G-DEPTH", "it is nested too deeply")
        node = self.percent()
        while self.at < len(self.tokens) and (t := self.tokens[self.at]).kind == "op" and self.POWERS.get(t.text, -1) >= least:
            self.at += 1
            node = Binary(t.text, node, self.level(self.POWERS[t.text] + 1), at=t.at)
        self.depth -= 1
        return node

    def percent(self) -> Node:
        node = self.sign()
        while self.peek("%"):
            node = Percent(node, at=self.take().at)
        return node

    def sign(self) -> Node:
        if self.peek("+", "-", "@"):
            op = self.take()
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise FormulaError("G-DEPTH", "it is nested too deeply")
            node = Unary(op.text, self.sign(), at=op.at)
            self.depth -= 1
            return node
        return self.intersection()

    def intersection(self) -> Node:
        node = self.range()
        while self.at < len(self.tokens) and self.at in self.spaced and isinstance(node, (Ref, Binary, Struct)) and self.tokens[self.at].kind in ("cell", "column", "row", "struct"):
            node = Binary(" ", node, self.range(), at=self.tokens[self.at - 1].at)
        return node

    def range(self) -> Node:
        node = self.postfix()
        while self.peek(":"):
            op = self.take()
            right = self.postfix()
            if isinstance(node, Ref) and isinstance(right, Ref) and right.area.sheet is None and None not in (node.area.top, right.area.top, node.area.left, right.area.left):
                a, b = node.area, right.area
                rows = [(a.top, node.fixed[0]), (a.bottom, node.fixed[2]), (b.top, right.fixed[0]), (b.bottom, right.fixed[2])]
                cols = [(a.left, node.fixed[1]), (a.right, node.fixed[3]), (b.left, right.fixed[1]), (b.right, right.fixed[3])]
                (top, ft), (bottom, fb), (left, fl), (right_, fr) = min(rows), max(rows), min(cols), max(cols)
                node = Ref(Area(a.sheet, top, left, bottom, right_), (ft, fl, fb, fr), f"{node.text}:{right.text}", at=node.at)
            else:
                node = Binary(":", node, right, at=op.at)
        return node

    def postfix(self) -> Node:
        node = self.primary()
        while True:
            if self.peek("#") and isinstance(node, Ref):
                self.take()
                node.spill = True
            elif self.peek("(") and isinstance(node, (Call, Apply, Name)) and self.at not in self.spaced:
                self.take()
                node = Apply(node, self.arguments(), at=node.at)
            else:
                return node

    def arguments(self) -> list:
        args: list = []
        if self.peek(")"):
            self.take()
            return args
        while True:
            args.append(None if self.peek(",", ")") else self.level(0))
            if self.peek(")"):
                self.take()
                return args
            self.expect(",")

    def primary(self) -> Node:
        t = self.take()
        if t.kind == "number":
            return Literal(float(t.text), "number", at=t.at)
        if t.kind == "text":
            return Literal(t.text[1:-1].replace('""', '"'), "text", at=t.at)
        if t.kind == "error":
            return Literal(t.text, "error", at=t.at)
        if t.kind in ("cell", "column", "row"):
            return self.reference(t)
        if t.kind == "external":
            raise FormulaError("G-EXT", t.text)
        if t.kind == "sheetname":
            raise FormulaError("G-NAME", t.text)
        if t.kind == "struct":
            return self.structured(t)
        if t.kind == "name":
            if self.peek("("):
                self.take()
                return Call(plain_name(t.text), self.arguments(), at=t.at)
            if t.text.upper() in ("TRUE", "FALSE"):
                return Literal(t.text.upper() == "TRUE", "bool", at=t.at)
            return Name(t.text, at=t.at)
        if t.kind == "op" and t.text == "(":
            node = self.level(0)
            if self.peek(","):
                raise FormulaError("G-PARSE", "a union of references isn't supported")
            self.expect(")")
            return node
        if t.kind == "op" and t.text == "{":
            return self.array(t)
        raise FormulaError("G-PARSE", t.text)

    def reference(self, t: Token) -> Ref:
        body = t.text.rpartition("!")[2]
        area = parse_address(body)
        if t.sheet and ":" in t.sheet and not t.text.startswith("'"):
            raise FormulaError("G-EXT", t.text)
        if (area.right or 0) >= MAX_COLUMN or (area.bottom or 0) >= MAX_ROW:
            raise FormulaError("G-REF", t.text)
        ends = body.split(":")
        row = [bool(re.search(r"\$\d", e)) for e in ends]
        col = [bool(re.match(r"\$[A-Za-z]", e)) for e in ends]
        return Ref(Area(t.sheet, area.top, area.left, area.bottom, area.right), (row[0], col[0], row[-1], col[-1]), body, at=t.at)

    def structured(self, t: Token) -> Struct:
        table, _, inner = t.text.partition("[")
        inner = inner[:-1].strip()
        part = "data"
        if inner.startswith("@"):
            part, inner = "row", inner[1:].strip()
            if inner.startswith("[") and inner.endswith("]"):
                inner = inner[1:-1]
            return Struct(table, [inner] if inner else [], part, at=t.at)
        if not inner.startswith("["):
            pieces = [inner] if inner else []
        else:
            pieces = re.findall(r"\[([^\[\]]*)\]", inner)
        columns = []
        for p in pieces:
            word = p.strip().lower()
            if word in ("#all", "#data", "#headers", "#totals", "#this row"):
                part = {"#this row": "row"}.get(word, word[1:])
            else:
                columns.append(p.strip())
        return Struct(table, columns, part, at=t.at)

    def array(self, t: Token) -> Array:
        rows: list = [[]]
        while True:
            minus = False
            if self.peek("-", "+"):
                minus = self.take().text == "-"
            v = self.primary()
            if not isinstance(v, Literal):
                raise FormulaError("G-PARSE", "an array holds constants")
            rows[-1].append(Literal(-v.value, "number", at=v.at) if minus else v)
            if self.peek("}"):
                self.take()
                if len({len(r) for r in rows}) > 1:
                    raise FormulaError("G-PARSE", "rows of an array differ")
                return Array(rows, at=t.at)
            if self.peek(";"):
                self.take()
                rows.append([])
            else:
                self.expect(",")


def parse(text: str) -> Node:
    return Parser(text).parse()


def walk(node):
    """The node and all below it."""
    if node is None:
        return
    yield node
    if isinstance(node, (Call, Apply)):
        if isinstance(node, Apply):
            yield from walk(node.target)
        for a in node.args:
            yield from walk(a)
    elif isinstance(node, Binary):
        yield from walk(node.left)
        yield from walk(node.right)
    elif isinstance(node, (Unary, Percent)):
        yield from walk(node.operand)
    elif isinstance(node, Array):
        for r in node.rows:
            for v in r:
                yield from walk(v)
