"""Folding of text for comparison: case, accents, look-alikes, digits of other scripts, invisible characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that look like another, and that one.
ALIKE = {
    "'": "‘’‚‛ʼʹ′´`＇ʻʽ׳",
    '"': "“”„‟″＂״",
    "-": "‐‑‒–—―−﹘﹣－⁃",
    "/": "∕⁄／", "\\": "﹨⧵＼",
    "o": "ø", "l": "ł", "d": "đ", "h": "ħ", "t": "ŧ", "i": "ı", "σ": "ς",
}
_MAP = {ord(x): k for k, v in ALIKE.items() for x in v}


def invisible(ch: str) -> bool:
    """Format characters, variation selectors and fillers: dropped for matching."""
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D)


@lru_cache(65_536)
def _unit(ch: str) -> str:
    if ch < "\x80":
        return ch.lower()
    if invisible(ch):
        return ""
    if ch.isspace() or unicodedata.category(ch) == "Zs":
        return " "
    if unicodedata.category(ch) == "Nd":
        return str(unicodedata.digit(ch))
    out = ""
    for x in unicodedata.normalize("NFKD", ch):
        if not 0x300 <= ord(x) <= 0x36F:
            out += x.casefold().translate(_MAP)
    return "".join(x for x in unicodedata.normalize("NFKD", out) if not 0x300 <= ord(x) <= 0x36F)


def fold(text: str) -> str:
    """Styled letters count as the plain ones (both sides of a comparison are folded alike)."""
    return text.lower() if text.isascii() else "".join(map(_unit, text))


#: What each character becomes, where that is one character; 0 for those not met yet.
_ONE, _OTHER = np.zeros(0x110000, np.uint32), 0xFFFFFFFF


def fold_map(text: str) -> tuple[str, list[int], list[bool]]:
    """The folded text, the place in ``text`` of each of its characters, and whether something invisible was dropped before it."""
    low, at, unseen = fold_at(text)
    gaps = [False] * len(low)
    for k in unseen:
        if k < len(low):
            gaps[k] = True
    return low, list(at), gaps


def fold_at(text: str) -> tuple[str, Sequence[int], list[int]]:
    """The same without lists where each character stays one: the places as a range, and where something was dropped."""
    n = len(text)
    if text.isascii():  # a character each, and none that can't be seen
        return text.lower(), range(n + 1), []
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    f = _ONE[c]
    if (new := c[f == 0]).size:
        for x in np.unique(new).tolist():
            u = _unit(chr(x))
            _ONE[x] = ord(u) if len(u) == 1 else _OTHER
        f = _ONE[c]
    other = np.flatnonzero(f == _OTHER)
    if not other.size:
        return f.tobytes().decode("utf-32-le", "surrogatepass"), range(n + 1), []
    f[other] = 32
    plain, out, last, size, unseen = f.tobytes().decode("utf-32-le", "surrogatepass"), [], 0, np.ones(n, np.int64), []
    for k in other.tolist():
        u = _unit(text[k])
        size[k] = len(u)
        out += [plain[last:k], u]
        last = k + 1
        if not u and invisible(text[k]):
            unseen.append(k)
    return "".join([*out, plain[last:]]), [*np.repeat(np.arange(n), size).tolist(), n], np.cumsum(size)[unseen].tolist() if unseen else []


#: Latin letters with marks, and without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžčřďěňťůąółż"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszcrdentuaolz"


def folded(c: Column) -> Column:
    """The cheap subset inside the JVM: case and Latin accents."""
    return F.translate(F.lower(c), MARKED, PLAIN)
