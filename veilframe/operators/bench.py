"""Checking answers, running tasks, and summing up."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formula import FormulaError, gate


def matches(expected: Column, actual: Column, tolerance: float = 1e-6) -> Column:
    """Cells as text: numbers within a tolerance, text whatever its case, truth values as TRUE and FALSE, blanks alike."""
    e, a = F.trim(F.coalesce(expected.cast("string"), F.lit(""))), F.trim(F.coalesce(actual.cast("string"), F.lit("")))
    x, y = e.try_cast("double"), a.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance + 1e-12).otherwise(F.lower(e) == F.lower(a))


def value_matches(expected, actual, tolerance: float = 1e-6) -> bool:
    def num(v):
        if isinstance(v, bool) or v is None:
            return None
        try:
            return float(str(v).strip())
        except ValueError:
            return None

    a, b = num(expected), num(actual)
    if a is not None and b is not None:
        return abs(a - b) <= tolerance + 1e-12
    text = lambda v: "" if v is None else str(v).upper() if isinstance(v, bool) else str(v).strip()
    return text(expected).casefold() == text(actual).casefold()


def trim_table(rows: list[list]) -> list[list]:
    """Without empty rows and columns at the end."""
    blank = lambda v: v is None or v == ""
    while rows and all(map(blank, rows[-1])):
        rows = rows[:-1]
    width = max((k + 1 for r in rows for k, v in enumerate(r) if not blank(v)), default=0)
    return [list(r[:width]) for r in rows]


def table_matches(expected: list[list], actual: list[list], tolerance: float = 1e-6) -> bool:
    """Rows in any order, each as often; a header row and total rows more don't matter."""
    left = trim_table(actual)
    wanted = [list(r) for r in expected]
    same = lambda a, b: len(a) == len(b) and all(value_matches(x, y, tolerance) for x, y in zip(a, b, strict=True))
    for w in wanted:
        k = next((k for k, r in enumerate(left) if same(w, r)), None)
        if k is None:
            return False
        left.pop(k)
    header = 1 if left and all(isinstance(v, str) or v is None for v in left[0]) else 0
    return all(any("total" in str(v).lower() for v in r) for r in left[header:])


def frames_match(expected: DataFrame, actual: DataFrame, digits: int = 6) -> DataFrame:
    """One row: whether two frames hold the same rows as often; numbers are rounded, text ignores case."""
    norm = lambda df: df.select(*((F.round(F.col(c).cast("double"), digits) if t in ("int", "bigint", "double", "float") else F.lower(F.trim(F.col(c).cast("string")))).alias(f"c{k}") for k, (c, t) in enumerate(df.dtypes)))
    a, b = norm(expected), norm(actual)
    cols = a.columns
    both = a.groupBy(*cols).agg(F.count("*").alias("n")).withColumn("s", F.col("n")).union(b.groupBy(*cols).agg((-F.count("*")).alias("n")).withColumn("s", F.col("n")))
    left = both.groupBy(*cols).agg(F.sum("s").alias("d")).where("d <> 0")
    return left.agg((F.count("*") == 0).alias("same"))


@dataclass
class Task:
    id: str
    sheet: str
    category: str
    prompt: str
    check: str  # cell, column or table
    formula: str | None = None


def validate(task: dict) -> list[str]:
    bad = [k for k in ("id", "sheet", "category", "prompt", "check") if not isinstance(task.get(k), str) or not task[k]]
    return bad + ([] if task.get("check") in ("cell", "column", "table") else ["check kind"])


@dataclass
class Run:
    task: str
    category: str
    condition: str
    stage: str
    passed: bool
    latency_ms: float = 0.0
    codes: tuple[str, ...] = ()


def run_task(task: Task, condition: str, prepare: Callable, send: Callable, parse: Callable, ctx: gate.Context, restore: Callable, compute: Callable, compare: Callable) -> Run:
    """One task through all its stages: audit, send, parse, clarify, gate, compute, compare."""
    done = lambda stage, ok=False, codes=(): Run(task.id, task.category, condition, stage, ok, 0.0, tuple(codes))
    request = prepare(task, condition)
    if request is None:
        return done("audit")
    ok, raw = send(request)
    if not ok:
        return done("send")
    reply, error = parse(raw)
    if error:
        return done("parse")
    if reply["kind"] != "formula":
        return done("clarify")
    before = gate.check(reply["formula"], ctx)
    formula, unknown = restore(reply["formula"]) if before.ok else (reply["formula"], [])
    verdict = gate.combined(before, gate.check(formula, ctx)) if before.ok else before
    if not verdict.ok or unknown:
        return done("gate", codes=[c for c, _ in verdict.reasons] or ["UNRESOLVED"])
    try:
        result = compute(task, formula)
    except FormulaError as e:
        return done("compute", codes=[e.code])
    return done("ok", True) if compare(task, result) else done("mismatch")


def run_all(tasks: list[Task], conditions: list[str], one: Callable[[Task, str], Run]) -> list[Run]:
    """Conditions take turns, so that none is favoured by when it runs."""
    return [one(t, c) for t in tasks for c in conditions]


def runs_frame(spark, runs: list[Run]) -> DataFrame:
    return spark.createDataFrame([{**asdict(r), "codes": list(r.codes)} for r in runs], "task string, category string, condition string, stage string, passed boolean, latency_ms double, codes array<string>")


def summary(runs: DataFrame) -> DataFrame:
    """category (all: every one), condition, tasks, passed, accuracy, median latency."""
    return runs.rollup("condition", "category").agg(F.count("*").alias("tasks"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("accuracy"), F.median("latency_ms").alias("latency")).where("condition is not null").select(F.coalesce("category", F.lit("all")).alias("category"), "condition", "tasks", "passed", "accuracy", "latency")


def by_condition(runs: DataFrame) -> DataFrame:
    """Accuracy of each category by condition, side by side."""
    return runs.groupBy("category").pivot("condition").agg(F.avg(F.col("passed").cast("int")))


def stages(runs: DataFrame) -> DataFrame:
    return runs.groupBy("condition", "stage").count()


def codes(runs: DataFrame) -> DataFrame:
    return runs.select("condition", F.explode("codes").alias("code")).groupBy("condition", "code").count()


def matched(runs: DataFrame) -> DataFrame:
    """Accuracy by condition over the tasks that every condition ran."""
    n = runs.agg(F.countDistinct("condition")).scalar()
    full = runs.groupBy("task").agg(F.countDistinct("condition").alias("n")).where(F.col("n") == n)
    return runs.join(full.select("task"), "task", "left_semi").groupBy("condition").agg(F.avg(F.col("passed").cast("int")).alias("accuracy"))


def shown(c: Column, fmt: str) -> Column:
    """A cell as its number format shows it."""
    if fmt == "m/d/yyyy":
        return F.date_format(c, "M/d/yyyy")
    if fmt == "h:mm AM/PM":
        return F.date_format(F.timestamp_seconds(F.round(c * 86400)), "h:mm a")
    places = len(fmt.partition(".")[2])
    return F.format_number(F.signum(c) * F.floor(F.round(F.abs(c) * 10**places, 9) + 0.5) / 10**places, places)


def planted(df: DataFrame, column: str, every: int, key: str, prefix: str = "Zq") -> tuple[DataFrame, DataFrame]:
    """A copy with canaries in some rows, and the canaries."""
    name = F.concat(F.lit(prefix), F.md5(F.col(key).cast("string")).substr(1, 10))
    hit = F.pmod(F.xxhash64(key), F.lit(every)) == 0
    return df.withColumn(column, F.when(hit, name).otherwise(F.col(column))), df.where(hit).select(name.alias("value"))


def raw_body(columns: list[str], rows: list[list], task: str) -> str:
    """The unprotected baseline, for comparison in tests only."""
    return json.dumps({"columns": columns, "rows": rows, "task": task}, ensure_ascii=False, default=str)
