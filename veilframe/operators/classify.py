"""Which columns are private, and how they are treated.  Missing knowledge means private."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..formula import gate
from ..formula.syntax import Area, index_to_letters
from ..functions import headers as header_columns
from ..functions import shapes
from ..functions.folding import fold
from .profile import SAMPLE_CELLS, ColumnInfo, infos, sample, value_patterns

#: Header words that make a column private.
PRIVATE_WORDS = """
name first last surname email e-mail phone mobile cell ssn social dob birth birthday address street city zip
postal id student employee emplid salary wage pay income gpa grade score diagnosis medical health gender sex
race ethnicity religion disability notes comment reason customer client patient instructor teacher contact
member applicant person tenant donor guardian parent recipient
""".split()
#: Header words that reveal something by themselves.
REVEALING_WORDS = "diagnosis medical health disability religion race ethnicity gender sex".split()
#: Words written together, and what they stand for.
TOGETHER = {"firstname": "first", "lastname": "last", "fullname": "name", "username": "name", "fname": "first", "lname": "last", "emailaddress": "email", "phonenumber": "phone", "cellphone": "phone", "telephone": "phone", "zipcode": "zip", "postcode": "postal", "postalcode": "postal", "dateofbirth": "dob", "birthdate": "birth", "studentid": "student", "employeeid": "employee"}
#: Header words that decide the kind of a stand-in.
KIND_WORDS = {
    "email": "email emails mail".split(),
    "strong id": "id ids ssn emplid uid uuid guid studentid employeeid".split(),
    "weak id": "phone mobile cell tel telephone fax phonenumber cellphone number num no code zip zipcode postal postcode social".split(),
    "name": "name names surname firstname lastname fullname forename fname lname".split(),
    "person": "customer client patient person contact instructor teacher professor employee student member owner manager applicant recipient sender author guardian parent spouse driver buyer tenant doctor physician nurse advisor rep".split(),
    "thing": "product item company business brand store shop course project file sheet table team department dept event place location city street school organization organisation org account domain host server app model category vendor supplier program plan campaign region country state".split(),
    "alone": "first last middle".split(),
}
#: What a column's stand-ins are, by the first of these signs that it shows; fixed order.
PRECEDENCE = [("email", "EMAIL"), ("email values", "EMAIL"), ("strong id", "ID"), ("name", "PERSON"), ("weak id", "ID"), ("person", "PERSON"), ("alone", "PERSON"), ("id values", "ID")]
TREATMENTS = {True: ("stand_in", "range", "month", "exclude"), False: ("as_is", "exclude")}


@dataclass(frozen=True)
class Policy:
    letter: str
    private: bool = True
    treatment: str = "stand_in"
    alias: str | None = None
    note: str | None = None
    reasons: tuple[str, ...] = field(default=())

    def effective(self) -> str:
        """Never a plain value from a private column."""
        legal = TREATMENTS[self.private]
        return self.treatment if self.treatment in legal else legal[0]


def header_words(header: str) -> list[str]:
    """Lower-case words: split at what is no letter or digit, at changes of case, and between letters and digits."""
    words, run, last = [], "", ""
    for k, ch in enumerate(header):
        kind = "d" if ch.isnumeric() else "u" if ch.isupper() else "l" if ch.isalpha() else ""
        after = header[k + 1 : k + 2]
        turn = (last == "l" and kind == "u") or (last == "u" and kind == "u" and after.islower()) or (bool(last) and bool(kind) and (last == "d") != (kind == "d"))
        if (not kind or turn) and run:
            words.append(run.lower())
            run = ""
        run += ch if kind else ""
        last = kind
    if run:
        words.append(run.lower())
    return words + ["email" for a, b in zip(words, words[1:], strict=False) if (a, b) == ("e", "mail")]


def header_keywords(header: str) -> list[str]:
    known = set(PRIVATE_WORDS) - {"e-mail"}
    return list(dict.fromkeys(w if w in known else TOGETHER[w] for w in header_words(header) if w in known or w in TOGETHER))


def default_treatment(kind: str) -> str:
    return {"number": "range", "date": "month"}.get(kind, "stand_in")


def token_kind(header: str, kind: str, id_share: float = 0.0, email_share: float = 0.0) -> str:
    """PERSON, EMAIL, ID or TEXT, by PRECEDENCE: the header's words, and what most sampled values are.

    A thing's name is no person's, a lone word of a name needs to be alone, and numbers and dates are no ids by being so shaped.
    """
    words = header_words(header)
    shows = {k for k, known in KIND_WORDS.items() if not set(known).isdisjoint(words)}
    shows -= {"name"} if "thing" in shows else set()
    shows -= {"alone"} if len(words) > 1 else set()
    shows |= {"email values"} if email_share > 0.5 else set()
    shows |= {"id values"} if id_share > 0.5 and kind not in ("number", "date") else set()
    return next((is_ for sign, is_ in PRECEDENCE if sign in shows), "TEXT")


def shares(df: DataFrame, column: str, order: list[str]) -> tuple[float, float]:
    """(id-like, e-mail) shares of the first cells."""
    t = F.col("text")
    r = sample(df, column, order, SAMPLE_CELLS).agg(F.avg((shapes.is_id(t) | shapes.is_phone(t) | shapes.is_ssn(t)).cast("int")).alias("i"), F.avg(shapes.is_email(t).cast("int")).alias("e")).first()
    return r["i"] or 0.0, r["e"] or 0.0


def suggest(df: DataFrame, order: list[str], headers: bool = True, profiles: list[ColumnInfo] | None = None) -> list[Policy]:
    """A policy for each column: header words, then values; without headers all are private."""
    columns = [c for c in df.columns if c != "_row"]
    profiles = profiles or infos(df.select(*columns))
    rows = df.agg(F.count("*")).first()[0]
    found = patterns(df, columns, order, {c: i.type for c, i in zip(columns, profiles, strict=True)}, rows)
    out = []
    for info, column in zip(profiles, columns, strict=True):
        reasons = [f"the header says {k}" for k in header_keywords(info.header)] if headers else ["there is no header"]
        reasons += [f"values look like {w}" for k, w in (("email", "e-mail addresses"), ("phone", "phone numbers"), ("ssn", "social security numbers"), ("id", "identifiers")) if found[column][k]]
        textual = info.type in ("text", "mixed")
        if textual and (info.avg_words or 0) > 6:
            reasons.append("it holds free text")
        filled = rows - info.blank
        if not reasons and textual and filled and info.distinct / filled > 0.5:
            reasons.append("most values differ")
        private, free = bool(reasons), "it holds free text" in reasons
        treatment = ("exclude" if free else default_treatment(info.type)) if private else "as_is"
        out.append(Policy(info.letter, private, treatment, alias_for(info.header, info.letter) if private else None, None, tuple(reasons)))
    return out


#: Rows that are read at once to find each column's first filled cells.
HEAD_ROWS = 1_000


def patterns(df: DataFrame, columns: list[str], order: list[str], kinds: dict[str, str], rows: int) -> dict[str, dict]:
    """Value patterns of every column: one job reads the first rows; of columns with too few filled cells there, another reads the first filled ones."""
    head = df.orderBy(*order).select(*columns).limit(HEAD_ROWS).collect()
    cells, late = [], []
    for c in columns:
        own = [r[c] for r in head if r[c] is not None and str(r[c]) != ""][:SAMPLE_CELLS]
        if len(own) < SAMPLE_CELLS and rows > HEAD_ROWS:
            late.append(c)
        cells += [(c, str(v), float(v) if isinstance(v, (int, float)) else None) for v in own]
    local = df.sparkSession.createDataFrame(cells, "column string, text string, value double")
    out = {c: dict.fromkeys(("email", "phone", "ssn", "id", "free_text"), False) for c in columns}
    for kind in ("text", "number", "other"):
        own = [c for c in columns if (kinds[c] if kinds[c] in ("text", "number") else "other") == kind and c not in late]
        if own:
            for r in value_patterns(local.where(F.col("column").isin(own)).groupBy("column"), kind).collect():
                out[r["column"]] = r.asDict()
    for kind in ("text", "number", "other"):
        own = [c for c in late if (kinds[c] if kinds[c] in ("text", "number") else "other") == kind]
        if own:
            for r in value_patterns(first_cells(df, own, order).groupBy("column"), kind).collect():  # a row a column
                out[r["column"]] = r.asDict()
    return out


def first_cells(df: DataFrame, columns: list[str], order: list[str], most: int = SAMPLE_CELLS) -> DataFrame:
    """column, text, value of each column's first filled cells: one pass, in which every task keeps its own first ones only."""
    number = lambda c: F.col(c).cast("double") if dict(df.dtypes)[c] not in ("string", "date", "timestamp", "boolean") else F.lit(None).cast("double")
    cells = df.select(F.struct(*order).alias("_at"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), number(c).alias("value")) for c in columns)))).where(~shapes.is_blank(F.col("text")))
    w = Window.partitionBy("column").orderBy("_at")  # its row limit is applied before the shuffle too
    return cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("column", "text", "value")


def alias_for(header: str, letter: str) -> str | None:
    """A neutral header where the header itself reveals something."""
    return f"Field {letter}" if set(header_words(header)) & set(REVEALING_WORDS) else None


def reveals(alias: str, header: str) -> bool:
    """Whether the header occurs in its alias as whole words, whatever the case, accents and look-alikes."""
    h = fold(header).strip()
    return bool(h) and re.search(rf"(?<![^\W_]){re.escape(h)}(?![^\W_])", fold(alias)) is not None


def derived(policies: dict[tuple[str, int], bool], formulas: dict[tuple[str, int], list[str]]) -> dict[tuple[str, int], bool]:
    """Columns whose formulas read a private column are private, to a fixpoint.  Keys: (sheet, column index)."""
    reads: dict = {}
    for key, texts in formulas.items():
        areas = set()
        for text in texts:
            try:
                areas |= set(gate.lineage(text, key[0]))
            except ValueError:
                areas.add(Area(None, None, None, None, None))  # what can't be parsed may read anything
        reads[key] = areas
    state = dict(policies)
    while True:
        more = {k for k, areas in reads.items() if not state.get(k, True) and any(private and (a.sheet is None or (a.sheet == s and (a.left is None or a.left <= c <= a.right))) for (s, c), private in state.items() for a in areas)}
        if not more:
            return state
        state |= dict.fromkeys(more, True)


def kept(old: list[tuple[ColumnInfo, Policy]], new: list[tuple[ColumnInfo, Policy]]) -> list[Policy]:
    """After a refresh a choice stays where letter, header and type are the same."""
    known = {(i.letter, i.header, i.type): p for i, p in old}
    return [known.get((i.letter, i.header, i.type), p) for i, p in new]


def set_policy(policy: Policy, private: bool | None = None, treatment: str | None = None, kind: str = "text") -> Policy:
    """A user's change, kept legal: a private column is never sent as it is."""
    private = policy.private if private is None else private
    treatment = treatment or (default_treatment(kind) if private else "as_is") if private != policy.private or treatment else policy.treatment
    return replace(policy, private=private, treatment=Policy(policy.letter, private, treatment).effective())


def policy_frame(spark, policies: list[Policy]) -> DataFrame:
    return spark.createDataFrame([(p.letter, p.private, p.effective(), p.alias, list(p.reasons)) for p in policies], "letter string, private boolean, treatment string, alias string, reasons array<string>")


def lettered(columns: list[str], policies: list[Policy]) -> dict[str, Policy]:
    """By column; a column without a policy is private."""
    by = {p.letter: p for p in policies}
    return {c: by.get(index_to_letters(k), Policy(index_to_letters(k))) for k, c in enumerate(columns)}


# ---------------------------------------------------------------- catalogues: a table of the columns of many sheets


def described(columns: DataFrame) -> DataFrame:
    """Adds keywords, kind and alias to a catalogue (letter, header, type, id_share, email_share), inside the JVM."""
    h = F.col("header")
    return columns.select(
        "*",
        header_columns.keywords(h, PRIVATE_WORDS, TOGETHER).alias("keywords"),
        header_columns.kind(h, F.col("type"), F.col("id_share"), F.col("email_share"), KIND_WORDS, PRECEDENCE).alias("kind"),
        header_columns.alias(h, F.col("letter"), REVEALING_WORDS).alias("alias"),
    )


def effective(private: Column, treatment: Column) -> Column:
    """A legal treatment: a private column (also one of which it isn't known) is never sent as it is."""
    private = F.coalesce(private, F.lit(True))
    return F.when(private, F.when(treatment.isin(*TREATMENTS[True]), treatment).otherwise(TREATMENTS[True][0])).otherwise(F.when(treatment.isin(*TREATMENTS[False]), treatment).otherwise(TREATMENTS[False][0]))


def refreshed(columns: DataFrame, chosen: DataFrame, by: list[str] = ("sheet", "letter", "header", "type")) -> DataFrame:
    """Every column with its policy: a choice stays where sheet, letter, header and type are the same, any other column is private.

    chosen: ``by``, private, treatment, one row a column (of repeated ones a private one).  Null keys match nulls.
    """
    strict = chosen.groupBy(*(F.col(k).alias(f"_{k}") for k in by)).agg(F.max(F.struct(F.coalesce("private", F.lit(True)).alias("private"), "treatment")).alias("_of"))
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    private = F.coalesce("_of.private", F.lit(True))
    own = [c for c in columns.columns if c not in ("private", "treatment")]
    return columns.select(*own).join(strict, same, "left").select(*own, private.alias("private"), effective(private, F.col("_of.treatment")).alias("treatment"))
