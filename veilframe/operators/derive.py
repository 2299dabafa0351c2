"""Which columns are private because their formulas read private ones, over tables of formulas.

Each formula gives the areas it reads.  A round joins the columns that became private in the last one with the areas
that hold them, and ends when none is new, so cycles end as well.  An area is a few blocks of columns, each a power of
two wide, and a column is in one block of each width: a join by block, whatever the width of the areas.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formula import gate
from ..formula.syntax import MAX_COLUMN
from ..sources.rows import written

#: Widths of blocks: 1, 2, 4 ... up to all columns of a sheet.
LEVELS = range(MAX_COLUMN.bit_length())


def _blocks(left: int, right: int) -> list[tuple[int, int]]:
    """(level, block): the fewest blocks that make up the columns left to right."""
    out, level = [], 0
    while left <= right:
        if left % 2:
            out.append((level, left))
            left += 1
        if right % 2 == 0:
            out.append((level, right))
            right -= 1
        left, right, level = left // 2, right // 2, level + 1
    return list(dict.fromkeys(out))


_READS = "sheet string, column int, of string, level int, block int"


def _areas(batches):
    for pdf in batches:
        out = []
        for sheet, column, formula in zip(pdf["sheet"], pdf["column"], pdf["formula"], strict=True):
            try:
                areas = gate.lineage(formula, sheet)
            except ValueError:
                out.append((sheet, column, None, None, None))  # what can't be read may read anything
                continue
            for a in dict.fromkeys(areas):
                left, right = (0, MAX_COLUMN - 1) if a.left is None else (a.left, a.right)
                out += [(sheet, column, a.sheet.casefold(), *x) for x in _blocks(left, right)]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _READS.split(", ")])


def reads(formulas: DataFrame) -> DataFrame:
    """sheet, column, of, level, block: the blocks of columns that a column's formulas read; nulls where a formula can't be parsed."""
    return formulas.select("sheet", "column", "formula").where("formula IS NOT NULL").mapInPandas(_areas, _READS).distinct()


def _inside(column: Column) -> Column:
    """All blocks that a column is in."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(column, k).alias("block")) for k in LEVELS))


def derived(formulas: DataFrame, policies: DataFrame) -> DataFrame:
    """sheet, column, private: the policies, with what derives from private columns made private.

    formulas: sheet, column, formula, any number for a column; policies: sheet, column, private (null: private).
    A formula that can't be parsed makes its column private if any column is.
    """
    known = written(policies.select("sheet", "column", F.coalesce("private", F.lit(True)).alias("private")), "policies")
    areas = written(reads(formulas), "reads")
    new = known.where("private").select("sheet", "column")
    if new.isEmpty():
        return known
    odd = areas.where("block IS NULL").select("sheet", "column").distinct()
    private = written(new.unionByName(odd.join(known.where("NOT private"), ["sheet", "column"], "left_semi")), "private")
    new = private
    while True:
        blocks = new.select(F.lower("sheet").alias("of"), F.inline(_inside(F.col("column")))).distinct()
        met = areas.join(blocks, ["of", "level", "block"], "left_semi").select("sheet", "column").distinct()
        met = met.join(known.where("NOT private"), ["sheet", "column"], "left_semi").join(private, ["sheet", "column"], "left_anti")
        new = written(met, "newly-private")
        if new.isEmpty():
            break
        private = private.unionByName(new)
    marked = private.distinct().withColumn("_private", F.lit(True))
    return known.join(marked, ["sheet", "column"], "left").select("sheet", "column", F.coalesce("_private", F.lit(False)).alias("private"))
