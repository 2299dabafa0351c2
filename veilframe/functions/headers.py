"""Headers of many sheets' columns as column expressions: their words, what they say, and what kind of stand-in they ask for.

The same rules as in ``operators.classify``, which reads the few headers of one table; here a table holds a header in each row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import folded

_LOWER = r"[\p{L}&&[^\p{Lu}]]"
#: Where words part: at what is no letter or digit, at changes of case, and between letters and digits.
_PARTS = rf"[^\p{{L}}\p{{N}}]+|(?<={_LOWER})(?=\p{{Lu}})|(?<=\p{{Lu}})(?=\p{{Lu}}\p{{Ll}})|(?<=\p{{N}})(?=\p{{L}})|(?<=\p{{L}})(?=\p{{N}})"


def words(header: Column) -> Column:
    """Lower-case words, and ``email`` for each e-mail among them; none of a null."""
    w = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), _PARTS), F.lower), lambda x: x != "")
    # bound once, as a lambda's variable
    mails = lambda w: F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.coalesce((F.get(w, i) == "e") & (F.get(w, i + 1) == "mail"), F.lit(False)))
    with_mail = lambda w: F.concat(w, F.transform(mails(w), lambda _: F.lit("email")))
    return F.get(F.transform(F.array(w), with_mail), F.lit(0))


def _any(w: Column, known) -> Column:
    return F.arrays_overlap(w, F.array(*map(F.lit, known)))


def keywords(header: Column, private, together: dict[str, str]) -> Column:
    """The words that make a column private, each once, in their order; words written together count as what they stand for."""
    stands_for = F.create_map(*(F.lit(x) for pair in ({w: w for w in private if w.isalpha()} | {k: v for k, v in together.items() if k not in private}).items() for x in pair))
    return F.array_distinct(F.array_compact(F.transform(words(header), lambda w: F.try_element_at(stands_for, w))))


def kind(header: Column, type_: Column, id_share: Column, email_share: Column, known: dict[str, list[str]], precedence: list[tuple[str, str]]) -> Column:
    """The first sign of ``precedence`` that the header's words or the values show; TEXT where none does."""

    def of(w):
        shows = {k: _any(w, v) for k, v in known.items()}
        shows["name"] = shows["name"] & ~shows["thing"]
        shows["alone"] = shows["alone"] & (F.size(w) == 1)
        shows["email values"] = F.coalesce(email_share, F.lit(0.0)) > 0.5
        shows["id values"] = (F.coalesce(id_share, F.lit(0.0)) > 0.5) & ~F.coalesce(type_, F.lit("")).isin("number", "date")
        return F.coalesce(*(F.when(shows[sign], F.lit(is_)) for sign, is_ in precedence), F.lit("TEXT"))

    return F.get(F.transform(F.array(words(header)), of), F.lit(0))


def alias(header: Column, letter: Column, revealing) -> Column:
    """A neutral header where the header itself reveals something, else null."""
    return F.when(_any(words(header), revealing), F.concat(F.lit("Field "), letter))


def reveals(alias: Column, header: Column) -> Column:
    """Whether the header occurs in its alias as whole words, whatever the case and Latin accents; false where either is null or the header is blank."""
    h = F.trim(folded(header))
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(h, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.coalesce((h != "") & F.regexp_like(folded(alias), quoted), F.lit(False))
