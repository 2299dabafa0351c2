"""Aggregates over other rows: those below a value, those inside two bounds, and those in a window of positions.

All work by range sorts, cuts of two orders, dyadic blocks and equi-joins: no window is unpartitioned over rows, no join is nested, and a
key or a value that very many rows share is a segment of the sort that may go over several partitions.

States are aggregates that can be joined (sum, product, least, greatest): {column: how}.  What no row adds to is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import _ranged, dealt, numbered

HOW = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}


def join2(how: str, a: Column, b: Column) -> Column:
    """Two results of an aggregate in one; null where both are."""
    if how in ("max", "min"):
        return (F.greatest if how == "max" else F.least)(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b if how == "sum" else a * b)


def folded(df: DataFrame, keys: list, states: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(HOW[how](n).alias(n) for n, how in states.items()))


# ---------------------------------------------------------------- running aggregates by key


def running_by(rows: DataFrame, keys: list[str], order: list, states: dict[str, str], count: int = 0) -> DataFrame:
    """``rows`` with each state run up to and with its row, inside its key, in an order; count: how many rows, if that is known.

    One range sort by key and order.  Partitions run by themselves; only the key that a partition begins with goes on
    from those before it, so a row for each partition is carried.
    """
    keys = keys or ["_all"]
    rows = rows if keys != ["_all"] else rows.withColumn("_all", F.lit(0))
    r = _ranged(rows, [*keys, *order], count)
    whole = F.struct(*keys)
    edges = r.groupBy("_part").agg(F.min_by(whole, "_local").alias("_first"), F.max_by(whole, "_local").alias("_last"))  # a row a partition
    tails = r.join(F.broadcast(edges), "_part").where(whole.eqNullSafe(F.col("_last")))
    last = folded(tails.select("_part", *keys, *states), ["_part", *keys], states)
    nothing = [F.lit(None).cast(dict(rows.dtypes)[n]).alias(n) for n in states]
    first = edges.select("_part", *(F.col(f"_first.{k}").alias(k) for k in keys), *nothing, F.lit(0).alias("_at"))
    upto = Window.partitionBy(*keys).orderBy("_part", "_at").rowsBetween(Window.unboundedPreceding, -1)  # over the partitions' edges
    carried = first.unionByName(last.withColumn("_at", F.lit(1))).select("_part", "_at", F.struct(*keys).alias("_key"), *(HOW[how](n).over(upto).alias(f"_c_{n}") for n, how in states.items())).where("_at = 0").drop("_at")
    w = Window.partitionBy("_part", *keys).orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    own = (dealt(r, count, "_part", *keys) if count else r).withColumns({f"_w_{n}": HOW[how](n).over(w) for n, how in states.items()}).withColumn("_whole", whole)
    carried = carried.withColumnRenamed("_part", "_to")
    met = own.join(F.broadcast(carried), (F.col("_part") == F.col("_to")) & F.col("_whole").eqNullSafe(F.col("_key")), "left")
    kept = [c for c in rows.columns if c not in states and c != "_all"]
    return met.select(*kept, *(join2(how, F.col(f"_c_{n}"), F.col(f"_w_{n}")).alias(n) for n, how in states.items()))


# ---------------------------------------------------------------- below a value


def _side(op: str) -> tuple[bool, int]:
    """(descending, whether a query stands after equal points) for points that are ``op`` the query."""
    return op in (">", ">="), 1 if op in ("<=", ">=") else 0


def below(points: DataFrame, queries: DataFrame, keys: list[str], value: str, op: str, states: dict[str, str]) -> DataFrame:
    """The queries' own columns and the states of all points with the query's keys whose value is ``op`` its value.

    points: keys, value, states; queries: keys, value, others.  Points of one key and value are summed up first.
    A query or point without a value meets nothing.
    """
    down, after = _side(op)
    some = folded(points.where(F.col(value).isNotNull()), [*keys, value], states)
    own = [c for c in queries.columns if c not in (*keys, value)]
    kinds = dict(some.dtypes)
    a = some.select(*keys, value, *states, *(F.lit(None).cast(dict(queries.dtypes)[c]).alias(c) for c in own), F.lit(1 - after).alias("_side"), F.lit(True).alias("_point"))
    b = queries.where(F.col(value).isNotNull()).select(*keys, value, *(F.lit(None).cast(kinds[n]).alias(n) for n in states), *own, F.lit(after).alias("_side"), F.lit(False).alias("_point"))
    place = F.col(value).desc() if down else F.col(value).asc()
    return running_by(a.unionByName(b), keys, [place, F.col("_side").asc()], states).where(~F.col("_point")).select(*own, *states)


#: Positions of a cell's side: rows that one task compares by both orders at once.
LEAF = 1 << 16
_JOIN = {"sum": (np.add, 0.0), "product": (np.multiply, 1.0), "max": (np.maximum, -np.inf), "min": (np.minimum, np.inf)}


def below_both(points: DataFrame, queries: DataFrame, keys: list[str], first: tuple[str, str], second: tuple[str, str], states: dict[str, str]) -> DataFrame:
    """As ``below`` with two conditions (value, op); the queries have a column ``_id``, the result _id and states (doubles).

    Points and queries get a common position by the keys and the first value, and one by the keys and the second.  Each is
    cut every LEAF positions.  The points before a query in both are those of its own cut of the first order, those of its
    own cut of the second that are in an earlier one of the first, and whole cells of the grid of both, of which running
    aggregates are a table.  Rows are sorted and dealt out a fixed number of times, however many there are.
    """
    (x, x_op), (y, y_op) = first, second
    (x_down, x_after), (y_down, y_after) = _side(x_op), _side(y_op)
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = points.where(known).select(*keys, x, y, *(F.col(n).cast("double").alias(n) for n in states), F.lit(-1).cast("long").alias("_id"), F.lit(1 - x_after).alias("_s"), F.lit(1 - y_after).alias("_t"), F.lit(True).alias("_point"))
    b = queries.where(known).select(*keys, x, y, *(F.lit(None).cast("double").alias(n) for n in states), F.col("_id").cast("long").alias("_id"), F.lit(x_after).alias("_s"), F.lit(y_after).alias("_t"), F.lit(False).alias("_point"))
    placed = numbered(a.unionByName(b), *keys, F.col(x).desc() if x_down else F.col(x).asc(), F.col("_s").asc(), name="_i").drop(x, "_s")
    placed = numbered(placed, *keys, F.col(y).desc() if y_down else F.col(y).asc(), F.col("_t").asc(), name="_j").drop(y, "_t")
    placed = placed.withColumns({"_bx": F.floor(F.col("_i") / LEAF), "_by": F.floor(F.col("_j") / LEAF)})
    schema = f"_id long, {', '.join(f'{n} double' for n in states)}"

    def within(order: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), int)
            point = pdf["_point"].to_numpy()
            at = np.lexsort((point, pdf[order].to_numpy(), code))  # of one place queries first: its points aren't before them
            got = _before(code[at], pdf["_j"].to_numpy()[at], {n: pdf[n].to_numpy(float)[at] for n in states}, states)
            asks = ~point[at]
            return pd.DataFrame({"_id": pdf["_id"].to_numpy()[at][asks], **{n: v[asks] for n, v in got.items()}})

        return run

    rows = placed.select(*keys, "_id", "_point", "_i", "_j", "_bx", "_by", *states)
    near = rows.groupBy("_bx").applyInPandas(within("_i"), schema).unionByName(rows.groupBy("_by").applyInPandas(within("_bx"), schema))
    # cells that are before in both orders; a key that is in one cut of either has none
    whole = placed.withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    cells = whole.groupBy("_key", "_bx", "_by").agg(*(HOW[how](n).alias(n) for n, how in states.items()))
    sides = cells.groupBy("_key").agg(F.array_sort(F.collect_set("_bx")).alias("_xs"), F.array_sort(F.collect_set("_by")).alias("_ys")).where((F.size("_xs") > 1) & (F.size("_ys") > 1))  # a number for each LEAF rows
    grid = sides.select("_key", F.explode("_xs").alias("_bx"), "_ys").select("_key", "_bx", F.explode("_ys").alias("_by"))
    g, e = grid.alias("g"), cells.alias("e")
    full = g.join(e, F.expr("g._key <=> e._key AND g._bx = e._bx AND g._by = e._by"), "left").select("g.*", *(f"e.{n}" for n in states))
    for along, of in (("_by", "_bx"), ("_bx", "_by")):
        w = Window.partitionBy("_key", of).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        full = full.select("_key", "_bx", "_by", *(HOW[how](n).over(w).alias(n) for n, how in states.items()))
    asked = whole.where(~F.col("_point")).select("_key", "_bx", "_by", "_id").alias("q")
    far = asked.join(full.alias("f"), F.expr("q._key <=> f._key AND q._bx = f._bx AND q._by = f._by")).select("q._id", *(f"f.{n}" for n in states))
    return folded(near.unionByName(far), ["_id"], states)


def _before(code: np.ndarray, order: np.ndarray, values: dict[str, np.ndarray], states: dict[str, str]) -> dict[str, np.ndarray]:
    """For each row, the states of the rows of its code that stand before it and are less in ``order``; NaN is no value.

    Rows stand by their code.  Halves of ever larger blocks meet: sorted by ``order``, the right half's rows take what has
    run up of the left half's.  Only the code that goes over the middle is in both.
    """
    n, size = len(code), 1 << max(1, (len(code) - 1).bit_length())
    fill = lambda v, by: np.concatenate([v, np.full(size - n, by, v.dtype)])
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    rank, code = fill(rank, n), fill(code, -1)
    own, got = {}, {}
    for name, v in values.items():
        join, none = _JOIN[states[name]]
        blank = np.isnan(v)
        own[name] = [(join, fill(np.where(blank, none, v), none), none), (np.add, fill((~blank).astype(float), 0.0), 0.0)]
        got[name] = [np.full(size, none), np.zeros(size)]
    half = 1
    while half < size:
        wide = lambda v: v.reshape(-1, 2 * half)
        at = np.argsort(wide(rank), axis=1, kind="stable")
        left = at < half
        shared = np.take_along_axis(wide(code), at, 1) == wide(code)[:, half - 1 : half]
        gives, takes = left & shared, ~left & shared
        for name in values:
            for (join, v, none), out in zip(own[name], got[name], strict=True):
                run = join.accumulate(np.where(gives, np.take_along_axis(wide(v), at, 1), none), axis=1)
                old = np.take_along_axis(wide(out), at, 1)
                np.put_along_axis(wide(out), at, np.where(takes, join(old, run), old), 1)
        half *= 2
    return {name: np.where(some > 0, v, np.nan)[:n] for name, (v, some) in got.items()}


# ---------------------------------------------------------------- bounds and windows of positions

#: Positions of a block for ranges with bounds of their own.
BLOCK = 128


def inside(points: DataFrame, queries: DataFrame, states: dict[str, str], end: int, asks: int = 0) -> DataFrame:
    """The states of the points with a position (_row, dense from 0 to ``end``) in each query's [_lo, _hi]; queries: _id (distinct), _lo, _hi.

    A range is the end of its first block, the beginning of its last, and whole blocks between, which two entries of a
    table over blocks cover: for each level, blocks are run away from the middle of twice their number.
    ``asks`` is the number of queries, if it may be larger than that of points.

    A query looks its parts up one after another.  All is dealt out by the number of rows, and a task keeps only the rows
    that are looked up, each of which is there once; queries pass by unsorted, however many ask for the same row.
    """
    rows = max(end + 1, asks)
    q = queries.select("_id", F.greatest("_lo", F.lit(0)).alias("_lo"), F.least("_hi", F.lit(end)).alias("_hi")).where("_lo <= _hi")
    q = q.withColumns({"_a": F.floor(F.col("_lo") / BLOCK), "_b": F.floor(F.col("_hi") / BLOCK)})
    blocked = dealt(points.select("_row", *states).withColumn("_block", F.floor(F.col("_row") / BLOCK)), rows, "_block")

    def looked_up(asking: DataFrame, key: str, of: DataFrame) -> DataFrame:
        """``asking`` with its states joined with those of the row of ``of`` with its key."""
        new = of.select(F.col(key), *(F.col(n).alias(f"_n_{n}") for n in states)).hint("shuffle_hash")
        met = dealt(asking, rows, key).join(new, key, "left").drop(key)
        return met.select(*(c for c in met.columns if c.removeprefix("_n_") not in states), *(join2(how, F.col(n), F.col(f"_n_{n}")).alias(n) for n, how in states.items()))

    # both ends in one block: that block's points, at most BLOCK
    lists = blocked.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_row", *states))).alias("_of"))

    def within(n: str, how: str) -> Column:
        some = F.filter("_of", lambda s: (s["_row"] >= F.col("_lo")) & (s["_row"] <= F.col("_hi")) & s[n].isNotNull())
        return F.aggregate(F.transform(some, lambda s: s[n]), F.lit(None).cast(dict(points.dtypes)[n]), lambda u, v: join2(how, u, v)).alias(n)

    same = dealt(q.where("_a = _b"), rows, "_a").join(lists.hint("shuffle_hash"), F.col("_a") == F.col("_block")).select("_id", *(within(n, how) for n, how in states.items()))
    up = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_block").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    begins = blocked.select(F.col("_row").alias("_hi"), *(HOW[how](n).over(up).alias(n) for n, how in states.items()))
    ends = blocked.select(F.col("_row").alias("_lo"), *(HOW[how](n).over(down).alias(n) for n, how in states.items()))
    wide = q.where("_a < _b").withColumns({n: F.lit(None).cast(dict(points.dtypes)[n]) for n in states})
    wide = looked_up(looked_up(wide, "_lo", ends), "_hi", begins)
    most = end // BLOCK
    if most > 1:
        depth = max(0, int(most).bit_length() - 1)
        first, last = F.col("_a") + 1, F.col("_b") - 1
        # the level is the highest bit in which the two blocks differ
        level = F.when(first == last, 0).otherwise(F.length(F.bin(first.bitwiseXOR(last))) - 1)
        place = lambda block, of: block * 64 + of  # noqa: E731  a level and a block in one number; no level is 63, where nothing is found
        wide = wide.withColumns({"_x": place(first, F.when(first <= last, level).otherwise(63)), "_y": place(last, F.when(first < last, level).otherwise(63))})
        sums = folded(blocked, ["_block"], states)
        table = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_level")).withColumn("_half", F.expr("shiftright(_block, _level)"))
        table = table.withColumn("_from", F.when(F.col("_half") % 2 == 1, F.col("_block")).otherwise(-F.col("_block")))
        table = running_by(table, ["_level", "_half"], [F.col("_from").asc()], states, (most + 1) * (depth + 1))
        for x in ("_x", "_y"):
            wide = looked_up(wide, x, table.withColumn(x, place(F.col("_block"), F.col("_level"))))
    return dealt(same.unionByName(wide.select("_id", *states)), rows, "_id")


#: Rows whose windows are computed together, and the widest window that is gone through row by row.
TILE, NARROW = 4_096, 64


def sliding(points: DataFrame, rows: DataFrame, before: int, after: int, states: dict[str, str]) -> DataFrame:
    """For each row (_row), the states of the points at positions _row + before to _row + after.

    A point goes to each tile of rows whose windows hold it, so tiles need nothing of each other.
    """
    tiles = F.explode(F.sequence(F.floor((F.col("_row") - after) / TILE), F.floor((F.col("_row") - before) / TILE))).alias("_tile")
    kinds = dict(points.dtypes)
    a = points.select(F.col("_row").cast("long").alias("_row"), *states, tiles, F.lit(False).alias("_asks"))
    b = rows.select(F.col("_row").cast("long").alias("_row"), *(F.lit(None).cast(kinds[n]).alias(n) for n in states), F.floor(F.col("_row") / TILE).alias("_tile"), F.lit(True).alias("_asks"))
    w = Window.partitionBy("_tile").orderBy("_row").rangeBetween(before, after)
    return a.unionByName(b).select("_row", "_asks", *(HOW[how](n).over(w).alias(n) for n, how in states.items())).where("_asks").drop("_asks")


def upto(points: DataFrame, rows: DataFrame, offset: int, states: dict[str, str], end: int, backward: bool = False) -> DataFrame:
    """For each row (_row), the states of all points at positions up to _row + offset (``backward``: from there on)."""
    order = F.desc("_row") if backward else F.asc("_row")
    run = running_by(points.select("_row", *states), [], [order], states, end + 1).withColumnRenamed("_row", "_pos")
    pos = F.col("_row") + offset
    asked = rows.select("_row", (F.greatest(pos, F.lit(0)) if backward else F.least(pos, F.lit(end))).alias("_pos"))
    return asked.join(run, "_pos").select("_row", *states)
