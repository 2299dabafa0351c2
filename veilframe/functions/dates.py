"""Dates in text, in every way they may be read."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import fold, fold_map, invisible

#: Month names (folded) from January on; abbreviations are their first letters.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split(),
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split(),
    "de": "januar februar marz april mai juni juli august september oktober november dezember".split(),
    "nl": "januari februari maart april mei juni juli augustus september oktober november december".split(),
}
#: Weekday names (folded).
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miercoles jueves viernes sabado domingo montag dienstag mittwoch donnerstag freitag samstag sonntag".split()
NAMES = {name: k for names in MONTHS.values() for k, name in enumerate(names, 1)}
NAMES |= {name[:3]: k for name, k in list(NAMES.items()) if name[:3] not in ("jui",)}
#: Further spellings of months.
NAMES |= {"sept": 9, "setiembre": 9, "juin": 6, "juil": 7, "mrz": 3, "mrt": 3, "maerz": 3, "set": 9, "janner": 1, "janv": 1, "fevr": 2}

# The parts that date phrases are made of, over folded text.  Phrases are looked for at every place, as they may overlap.
_NAME = rf"({'|'.join(sorted(NAMES, key=len, reverse=True))})(?![^\W\d_])"
_ANY = r"[\s./\\_,-]"  # what may stand beside a month's name
_WORD = rf"(?:(?:of|de|del|the){_ANY}+)?"
_ORDINAL = r"(?:st|nd|rd|th|er)"
_YEAR = r"('?\d{2}|\d{4})(?!\d)(?!\.\d)"
_BETWEEN = r"(\s*(?:\\+|[/._,-])\s*|\s+)"  # what may stand between numbers
_at = lambda before, phrase: re.compile(rf"{before}(?=({phrase}))")
_PATTERNS = {
    "numbers": _at(r"(?<!\d)", rf"(\d{{4}}|\d{{1,2}}){_BETWEEN}(\d{{1,2}}){_BETWEEN}(\d{{4}}|\d{{1,2}})(?!\d)(?!\.\d)"),
    "compact": _at(r"(?<!\d)(?<!\d[.,])", r"(\d{4})(\d\d)(\d\d)(?!\d)(?![.,]\d)"),
    "signs": _at(r"(?<!\d)", rf"(\d{{4}})\s*(?:年|{fold('년')})\s*(\d{{1,2}})\s*(?:月|{fold('월')})\s*(\d{{1,2}})\s*(?:日|{fold('일')})"),
    "day, month": _at(r"(?<!\d)", rf"(\d{{1,2}})(?!\d){_ORDINAL}?{_ANY}*{_WORD}{_NAME}{_ANY}*{_WORD}{_YEAR}"),
    "month, day": _at(r"(?<![^\W\d_])", rf"{_NAME}{_ANY}*{_WORD}(\d{{1,2}})(?!\d)(?:{_ORDINAL}(?![^\W\d_]){_ANY}*|{_ANY}+){_WORD}{_YEAR}"),
    "year, month": _at(r"(?<!\d)", rf"(\d{{4}}){_ANY}*{_NAME}{_ANY}*(\d{{1,2}})(?!\d)(?!\.\d)(?:{_ORDINAL}(?![^\W\d_]))?"),
}


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    dates: tuple[str, ...]
    weak: bool = False


def valid(y: int, m: int, d: int) -> str | None:
    if 1000 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
        return f"{y:04d}-{m:02d}-{d:02d}"
    return None


def years(text: str) -> list[int]:
    """A two-digit year is of this century and of the last."""
    n = int(text.removeprefix("'"))
    return [n] if len(text.removeprefix("'")) == 4 else [1900 + n, 2000 + n]


def _kind_of(between: str) -> str:
    """One of / . - _ , or a blank; a backslash counts as a slash."""
    return between.strip().replace("\\", "/")[:1] or " "


def _numbers(low: str, m: re.Match) -> tuple[list[str | None], bool]:
    """Readings of three numbers, and whether they are as often something else.

    Both separators are alike; with a year of four digits they may also differ, unless the numbers go on, or a comma or
    a blank may stand before the year.
    """
    a, first, b, second, c = m.groups()[1:]
    s, t, start, end = _kind_of(first), _kind_of(second), m.start(1), m.end(1)
    joined = re.search(r"\d\s*(?:\\+|[/._,-])\s*$", low[max(0, start - 8) : start]), re.match(r"\s*(?:\\+|[/._,-])\s*\d", low[end : end + 8])
    mixed = s in "/.-_" and t in "/.-_" and 4 in (len(a), len(c)) and not any(joined)
    late_year = s == "/" and t in ", " and len(c) == 4 and len(a) <= 2
    if s == "," or not (s == t or mixed or late_year):
        return [], False
    chained = len(a) <= 2 and len(c) <= 2 and (low[start - 1 : start] == first and low[start - 2 : start - 1].isdigit() or low[end : end + 1] == second and low[end + 1 : end + 2].isdigit())
    x, y, z = int(a), int(b), int(c)
    if len(a) == 4:
        return [valid(x, y, z)] if len(c) <= 2 else [], s == " "
    out = [valid(n, *md) for n in years(c) for md in ((x, y), (y, x))] if len(c) in (2, 4) else []
    out += [valid(n, y, z) for n in years(a)] if len(a) == 2 and len(c) <= 2 else []
    return out, s == " " or chained


def _scan(low: str, compact: bool) -> list[tuple[int, int, tuple[str, ...], bool]]:
    out = []
    for kind, pattern in _PATTERNS.items():
        if kind == "compact" and not compact:
            continue
        for m in pattern.finditer(low):
            g, weak = m.groups()[1:], kind == "compact"
            if kind == "numbers":
                got, weak = _numbers(low, m)
            elif kind == "day, month":
                got = [valid(y, NAMES[g[1]], int(g[0])) for y in years(g[2])]
            elif kind == "month, day":
                got = [valid(y, NAMES[g[0]], int(g[1])) for y in years(g[2])]
            elif kind == "year, month":
                got = [valid(int(g[0]), NAMES[g[1]], int(g[2]))]
            else:
                got = [valid(*map(int, g))]
            if dates := tuple(dict.fromkeys(d for d in got if d)):
                out.append((m.start(1), m.end(1), dates, weak))
    return out


#: Characters on either side of a number that a date phrase with it stays within, and texts that are looked through whole.
REACH, SHORT = 120, 600
_WIDE = re.compile(r"\s{12}")


@cache
def _unseen() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x110000)) if invisible(c) or (c.isdigit() and not c.isdecimal())) + "]")


def _stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that can hold dates: around its numbers, up to white space.  Gaps of blanks, or of what can't be seen, could make a phrase longer, and some signs become digits, so texts with them stay whole."""
    if len(text) <= SHORT or _WIDE.search(text) or not (text.isascii() or not _unseen().search(text)):
        return [(0, len(text))]
    out: list[list[int]] = []
    for m in re.finditer(r"\d+", text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    ends = []
    for lo, hi in out:
        while lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if ends and lo <= ends[-1][1]:
            ends[-1] = (ends[-1][0], hi)
        else:
            ends.append((lo, hi))
    return ends


def find_dates(text: str, compact: bool = True) -> list[Found]:
    """Every date phrase with all its readings, by place; phrases may overlap.

    Spans are of ``text``.  Characters that can't be seen are skipped, and read as blanks too.  compact: also eight digits in
    a row.  Weak ones are as often something else: eight digits, numbers with blanks alone, and parts of longer runs of numbers.
    """
    if not any(ch.isdigit() for ch in text) if not text.isascii() else not re.search("[0-9]", text):
        return []
    stretches = _stretches(text)
    if stretches != [(0, len(text))]:
        return [replace(f, start=f.start + lo, end=f.end + lo) for lo, hi in stretches for f in _find(text[lo:hi], compact)]
    return _find(text, compact)


def _find(text: str, compact: bool) -> list[Found]:
    got: dict[tuple[int, int], Found] = {}
    low, at, gaps = fold_map(text)
    for shown, places in ((low, at), *([fold_map("".join(" " if invisible(ch) else ch for ch in text))[:2]] if any(gaps) else [])):
        fresh: dict[tuple[int, int], Found] = {}
        for s, e, dates, weak in _scan(shown, compact):
            span = places[s], places[e - 1] + 1
            if span not in got:
                old = fresh.get(span)
                fresh[span] = Found(*span, tuple(dict.fromkeys((old.dates if old else ()) + dates)), weak and (old is None or old.weak))
        got |= fresh
    return sorted(got.values(), key=lambda f: (f.start, -f.end))


_TAIL = re.compile(r"^(?:\s*(?:,|t|at|um|a|:)?\s*\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?\s*(?:z|utc|gmt|[a-z]{2,4}|[+-]\d{2}:?\d{2})?|\.)?\s*$")
_HEAD = re.compile(rf"^\s*(?:(?:{'|'.join(sorted(WEEKDAYS, key=len, reverse=True))})\b\.?,?\s*)?$")


def text_dates(text: str) -> tuple[str, ...]:
    """The readings of a text that is one date, with a weekday, a time or a zone around it at most."""
    whole = [f for f in find_dates(text, compact=False) if _HEAD.match(fold_map(text[: f.start])[0]) and _TAIL.match(fold_map(text[f.end :])[0])]
    return tuple(dict.fromkeys(d for f in whole for d in f.dates))


def eight_digits(text: str) -> Iterator[str]:
    """Dates that eight digits may be: year, month or day first, 1900 to 2100."""
    t = text.strip()
    if re.fullmatch(r"\d{8}", t) and len(set(t)) > 1:
        for y, m, d in ((t[:4], t[4:6], t[6:]), (t[4:], t[:2], t[2:4]), (t[4:], t[2:4], t[:2])):
            if 1900 <= int(y) <= 2100 and (v := valid(int(y), int(m), int(d))):
                yield v


# ---------------------------------------------------------------- as columns


def serial_date(s: Column) -> Column:
    """The date of a worksheet serial: 60 is no day, and those below it count from one day later."""
    whole = F.floor(s).cast("int")
    d = F.date_add(F.lit("1899-12-30").cast("date"), whole + F.when(whole < 60, 1).otherwise(0))
    return F.when((s >= 1) & (s < 2958466) & (whole != 60), d)


def serial_month(s: Column) -> Column:
    return F.when((s >= 0) & (s < 1), "1900-01").when(F.floor(s) == 60, "1900-02").otherwise(F.date_format(serial_date(s), "yyyy-MM"))


def text_month(c: Column) -> Column:
    """YYYY-MM of a text that is one date in one reading; ambiguous and invalid ones give null."""
    t = F.trim(F.regexp_replace(c, r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\.?,?\s+", ""))
    iso = F.regexp_extract(t, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 0)
    parts = F.split(F.regexp_extract(t, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", 0), r"[-/.]")
    a, b, y = (F.try_element_at(parts, F.lit(k)).try_cast("int") for k in (1, 2, 3))
    made = lambda y, m, d: F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"), "yyyy-MM")
    ip = F.split(iso, r"[-/.]")
    named = F.coalesce(*(F.date_format(F.try_to_date(F.initcap(t), f), "yyyy-MM") for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d-MMM-yyyy")))
    return (
        F.when(iso != "", made(*(F.try_element_at(ip, F.lit(k)).try_cast("int") for k in (1, 2, 3))))
        .when((a > 12) & (b <= 12), made(y, b, a))
        .when((b > 12) & (a <= 12), made(y, a, b))
        .when((a == b) & (a <= 12), made(y, a, b))
        .otherwise(named)
    )
