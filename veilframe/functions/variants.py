"""The spellings under which a private value may show."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

from .folding import fold
from .numbers import forms, typed_numbers

LEAST, LEAST_DIGITS, LEAST_CODE, LEAST_CANARY = 4, 7, 6, 6
_LETTER = r"[^\W\d_]"


@dataclass(frozen=True)
class Form:
    text: str  # folded
    kind: str  # exact json json2 word normalized digits number canary
    rule: str  # any word digits code number


def plain_letters(text: str) -> list[str]:
    """Without marks, and with the usual spellings of German and Nordic letters."""
    out = ["".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))]
    swap = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "å": "aa", "ø": "oe", "æ": "ae", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "Å": "Aa", "Ø": "Oe", "Æ": "Ae"})
    out.append(text.translate(swap))
    return [x for x in dict.fromkeys(out) if x != text]


def variants(value: str, canary: bool = False) -> list[Form]:
    """All forms of a value, the widest rule of each text first; texts are folded."""
    out: dict[tuple[str, str], Form] = {}

    def add(text: str, kind: str, rule: str, least: int = LEAST) -> None:
        f = fold(text)
        if len(text) < least or len(f) < least:
            return
        if rule != "any" and (f, "any") in out:
            return
        out.setdefault((f, rule), Form(f, kind, rule))

    if canary:
        add(value, "canary", "any", LEAST_CANARY)
        return list(out.values())
    whole = "word" if re.fullmatch(r"[\d.,\s]+", value.strip()) else "any"
    add(value, "exact", whole)
    spaced = re.sub(r"\s+", " ", value.strip())
    add(spaced, "normalized", whole)
    once = json.dumps(value, ensure_ascii=False)[1:-1]
    add(once, "json", whole)
    add(json.dumps(once, ensure_ascii=False)[1:-1], "json2", whole)
    for form in ("NFC", "NFD", "NFKD"):
        add(unicodedata.normalize(form, spaced), "normalized", whole)
    for x in plain_letters(spaced):
        add(x, "normalized", whole)
    words = re.findall(rf"{_LETTER}+(?:['’-]{_LETTER}+)*", spaced)
    words += [p for w in words if re.search(r"['’-]", w) for p in re.split(r"['’-]", w)]
    for w in words:
        add(w, "word", "word")
        for x in plain_letters(w):
            add(x, "word", "word")
        if re.search(r"['’-]", w):
            add(re.sub(r"['’-]", "", w), "word", "word")
    words = re.findall(rf"{_LETTER}+(?:['’-]{_LETTER}+)*", spaced)
    if len(words) > 1:
        for sep in ("", "_", ".", "-"):
            add(sep.join(words), "normalized", "any")
    if "@" in spaced:
        add(spaced.partition("@")[0], "word", "word")
    digits = re.sub(r"\D", "", spaced)
    if len(digits) >= LEAST_DIGITS:
        add(digits, "digits", "digits")
        for code in ("1", "44", "33", "49", "39", "34", "31"):
            if spaced.startswith("+") and digits.startswith(code) and len(digits) - len(code) >= LEAST_DIGITS:
                add(digits[len(code) :], "digits", "digits")
    code = re.sub(r"[\s\-_./#]", "", spaced)
    if len(code) >= LEAST_CODE and re.search(r"\d", code) and re.fullmatch(r"[^\W_]+", code):
        add(code, "normalized", "code", LEAST_CODE)
    for n in typed_numbers(spaced):
        if len(n.replace(".", "")) < LEAST_DIGITS and not re.fullmatch(r"(19|20)\d\d|2100", n):  # years aren't amounts
            for f in forms(n):
                add(f, "number", "number")
    return list(out.values())


def accept(text: str, start: int, end: int, rule: str) -> bool:
    """Whether a match of a folded text counts, by what stands around it."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if rule == "any":
        return True
    if rule == "word":
        letter = lambda ch: bool(ch) and (ch.isalnum() or ch == "_") and not "぀" <= ch <= "鿿"
        head, tail = text[start : start + 1], text[end - 1 : end]
        if letter(head) and letter(before) or letter(tail) and letter(after):
            return False
        number = head.isdigit() and tail.isdigit()
        return not (number and (re.search(r"\d[.,]$", text[max(0, start - 2) : start]) or re.match(r"[.,]\d", text[end : end + 2])))
    # numbers: nothing may continue them
    if before.isdigit() or after.isdigit() or before.isalpha():
        return False
    return not (re.search(r"\d[.,'  ]$", text[max(0, start - 2) : start]) or re.match(r"[.,'  ]\d{3}(?!\d)|[.,]\d", text[end : end + 4]))


def digit_projection(text: str) -> tuple[str, list[int]]:
    """The digits with their separators taken out and | for anything else, and where each stands."""
    out, at, gap = [], [], False
    for k, ch in enumerate(text):
        if ch.isdigit():
            if gap and out:
                out.append("|")
                at.append(k)
            gap = False
            out.append(ch)
            at.append(k)
        elif ch not in " -.()/+_   ":
            gap = True
    return "".join(out), at


def code_projection(text: str) -> tuple[str, list[int]]:
    """Letters and digits with single separators inside codes taken out and | for anything else."""
    out, at, gap = [], [], False
    for k, ch in enumerate(text):
        if ch.isalnum():
            if gap and out:
                out.append("|")
                at.append(k)
            gap = False
            out.append(ch)
            at.append(k)
        elif ch not in " -_./#":
            gap = True
    return "".join(out), at
