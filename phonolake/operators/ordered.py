"""Ordered computation that never needs a whole recording in one task.

A recording may hold a third of the archive, so no window here partitions by the recording alone.
The order is cut into slices; each slice is windowed by itself and slices are joined up either by a
halo (a few rows copied over the border) or by a carry (one summary row per slice, scanned once).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 65_536


def slice_no(position: Column | str, size: float) -> Column:
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(size)).cast("long")


def ordinals(
    df: DataFrame,
    keys: Sequence[str],
    slices: dict[str, Column],
    order: Sequence[Column],
    out: str = "n",
) -> DataFrame:
    """Dense 0-based position per key. ``slices`` must rise with ``order``."""
    names = list(slices)
    marked = df.withColumns(slices)
    counts = marked.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, *names, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        marked.join(offsets, [*keys, *names])
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop(*names, "_offset")
    )


def _local(fn: str, column: Column, window) -> Column:
    if fn == "last":
        return F.last(column, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[fn](column).over(window)


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: Column,
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Running sum / max / min / last-non-null along ``order``, exact over slice borders.

    One row per slice is scanned per key; the rows themselves are only ever windowed by (key, slice).
    """
    marked = df.withColumn("_slice", slice_col).withColumns(
        {f"_in_{name}": column for name, (_, column) in specs.items()}
    )
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    ordering = F.struct(*[F.col(c) for c in order])

    def total(name: str, fn: str) -> Column:
        column = F.col(f"_in_{name}")
        if fn == "last":
            pick = F.min_by if reverse else F.max_by
            return pick(column, F.when(column.isNotNull(), ordering))
        return {"sum": F.sum, "max": F.max, "min": F.min}[fn](column)

    totals = marked.groupBy(*keys, "_slice").agg(
        *[total(name, fn).alias(f"_t_{name}") for name, (fn, _) in specs.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(direction("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        "_slice",
        *[_local(fn, F.col(f"_t_{name}"), earlier).alias(f"_c_{name}") for name, (fn, _) in specs.items()],
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    columns = {}
    for name, (fn, _) in specs.items():
        here, past = _local(fn, F.col(f"_in_{name}"), inside), F.col(f"_c_{name}")
        if fn == "sum":
            columns[name] = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        elif fn == "last":
            columns[name] = F.coalesce(here, past)
        else:
            columns[name] = (F.greatest if fn == "max" else F.least)(here, past)
    extra = [c for name in specs for c in (f"_in_{name}", f"_c_{name}")]
    return marked.join(carry, [*keys, "_slice"]).withColumns(columns).drop("_slice", *extra)


def previous_row(
    df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[str], columns: Sequence[str],
    prefix: str = "prev_", reverse: bool = False,
) -> DataFrame:
    """The neighbouring row (``lag`` or, reversed, ``lead``) for sparse orders where no halo width is known."""
    packed = F.struct(*[F.col(c) for c in columns])
    out = running(df, keys, slice_col, order, {"_row": ("last", packed)}, inclusive=False, reverse=reverse)
    return out.withColumns({f"{prefix}{c}": F.col(f"_row.{c}") for c in columns}).drop("_row")


def with_halo(df: DataFrame, n: str, before: int = 0, after: int = 0, size: int = SLICE) -> DataFrame:
    """Copy border rows into the neighbouring slice. Adds ``_slice`` and ``_home``.

    Only rows within the halo of a border are copied, so the table grows by (before+after)/size.
    """
    home = slice_no(n, size)
    if before == 0 and after == 0:
        return df.withColumn("_slice", home).withColumn("_home", F.lit(True))
    low, high = slice_no(F.col(n) - after, size), slice_no(F.col(n) + before, size)
    return df.withColumn("_slice", F.explode(F.sequence(low, high))).withColumn(
        "_home", F.col("_slice") == home
    )


def halo_window(keys: Sequence[str], n: str):
    return Window.partitionBy(*keys, "_slice").orderBy(n)


def over_halo(
    df: DataFrame, keys: Sequence[str], n: str, columns: dict, before: int = 0, after: int = 0,
    size: int = SLICE,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead on a dense ``n``.

    ``columns`` maps a name to a function from the ordered window to a Column.
    """
    window = halo_window(keys, n)
    haloed = with_halo(df, n, before, after, size)
    return (
        haloed.withColumns({name: make(window) for name, make in columns.items()})
        .filter("_home")
        .drop("_slice", "_home")
    )


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "bool_or": F.bool_or, "bool_and": F.bool_and}


def islands(
    df: DataFrame,
    keys: Sequence[str],
    n: str,
    aggs: dict[str, tuple[str, Column]] | None = None,
    gap: int = 0,
    size: int = SLICE,
) -> DataFrame:
    """Runs of consecutive ``n`` (the rows given are the members), bridging at most ``gap`` missing positions.

    Runs are found inside each slice; only runs that reach a slice border are looked at again, at most
    two per slice, to be joined with their continuation.
    """
    aggs = aggs or {}
    local = Window.partitionBy(*keys, "_slice").orderBy(n)
    marked = df.withColumn("_slice", slice_no(n, size)).withColumns(
        {f"_a_{name}": column for name, (_, column) in aggs.items()}
    )
    broken = marked.withColumn(
        "_new", F.when(F.col(n) - F.lag(n).over(local) <= gap + 1, F.lit(0)).otherwise(F.lit(1))
    )
    numbered = broken.withColumn(
        "_run", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = numbered.groupBy(*keys, "_slice", "_run").agg(
        F.min(n).alias("start"),
        F.max(n).alias("last"),
        *[_MERGE[fn](f"_a_{name}").alias(name) for name, (fn, _) in aggs.items()],
    )
    edge = (F.col("start") - F.col("_slice") * size <= gap) | (
        (F.col("_slice") + 1) * size - 1 - F.col("last") <= gap
    )
    across = Window.partitionBy(*keys).orderBy("start")
    borders = (
        parts.filter(edge)
        .withColumn(
            "_new",
            F.when(F.col("start") - F.lag("last").over(across) <= gap + 1, F.lit(0)).otherwise(F.lit(1)),
        )
        .withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(
            F.min("start").alias("start"),
            F.max("last").alias("last"),
            *[_MERGE[fn](name).alias(name) for name, (fn, _) in aggs.items()],
        )
    )
    columns = [*keys, "start", "last", *aggs]
    return parts.filter(~edge).select(*columns).unionByName(borders.select(*columns))


def _chain(pos: np.ndarray, low: np.ndarray, high: np.ndarray, span: int, skip: int):
    """Of every point as the first of a group: index of its last member, borders, index of the next first (-1: none
    that hangs on this group), and whether the point begins a group whatever came before."""
    last = np.searchsorted(pos, pos + span, "left") - 1
    start = np.maximum(low, pos[last] + 1 - span)
    end = np.minimum(high[last] + 1, start + span)
    following = np.searchsorted(pos, end + skip, "left")
    root = np.diff(pos, prepend=pos[0] - span - skip - 1) > span + skip
    inside = following < len(pos)
    following = np.where(inside & ~root[np.minimum(following, len(pos) - 1)], following, -1)
    return last, start, end, following, root


def greedy_groups(
    points: DataFrame, keys: Sequence[str], n: str, span: int, skip: int = 0,
    low: str | None = None, high: str | None = None, size: int = SLICE,
) -> DataFrame:
    """Groups whose extent hangs on their own first point: (*keys, n, first, last, start, end) per member.

    The first point of a key opens a group that takes all points less than ``span`` after it. ``low`` and ``high`` name
    how far a point may be widened (default: not at all); a group is widened to the left first and never beyond
    ``span``. The next group opens at the first point at least ``skip`` after that end; points between are in none.

    A point with no other in the ``span + skip`` before it opens a group whatever came earlier, so slices are solved on
    their own. Only a slice without such a point asks where the chain enters it: it answers with a table from its
    first points to the exit, and those tables, one row a slice, are put together over runs of such slices. Positions
    are distinct; points with a null key or position are passed over.
    """
    reach = span + skip
    if size <= 3 * reach:
        raise ValueError("a slice must be longer than three groups with their gaps")
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in points.select(*keys).schema}
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    shaped = points.dropna(subset=[*keys, n]).select(
        *keys, F.col(n).cast("long").alias("_n"), F.col(low or n).cast("long").alias("_low"),
        F.col(high or n).cast("long").alias("_high"))
    sliced = with_halo(shaped, "_n", before=reach, after=2 * reach, size=size)

    def solved(pdf: pd.DataFrame):
        pdf = pdf.sort_values("_n", ignore_index=True)
        home = np.flatnonzero(pdf["_home"].to_numpy())
        chain = _chain(*(pdf[c].to_numpy(np.int64) for c in ("_n", "_low", "_high")), span, skip)
        return pdf, pdf["_n"].to_numpy(np.int64), home, chain

    def doors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pos, home, (_, _, _, following, root) = solved(pdf)
        if not len(home):
            return pd.DataFrame(columns=[*keys, "_slice", "_rooted", "_doors", "_exits"])
        leave = np.full(len(pos), -1, np.int64)
        for i in home[::-1]:
            to = following[i]
            if to >= 0:
                leave[i] = pos[to] if to > home[-1] else leave[to]
        rooted = home[root[home]]
        row = pdf.loc[[home[0]], [*keys, "_slice"]].reset_index(drop=True)
        row["_rooted"] = bool(len(rooted))
        near = home[pos[home] < pos[home[0]] // size * size + 2 * reach]
        row["_doors"] = [[] if len(rooted) else pos[near].tolist()]
        row["_exits"] = [[int(leave[rooted[-1]])] if len(rooted) else leave[near].tolist()]
        return row

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice", ignore_index=True)
        found, at = [], -1
        for rooted, inside, outside in zip(pdf["_rooted"], pdf["_doors"], pdf["_exits"]):
            at = outside[0] if rooted else dict(zip(inside, outside)).get(at, -1)
            found.append(at)
        out = pdf[keys].assign(_entry=np.array(found, np.int64))
        return out[out["_entry"] >= 0]

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pos, home, (last, start, end, following, root) = solved(pdf)
        firsts = []
        if len(home):
            begins = home[root[home]].tolist()
            entry = pdf["_entry"].iloc[home[0]]
            if entry == entry and entry >= 0:
                begins.append(int(np.searchsorted(pos, int(entry))))
            for i in begins:
                while 0 <= i <= home[-1]:
                    firsts.append(i)
                    i = following[i]
        firsts = np.array(sorted(firsts), np.int64)
        sizes = last[firsts] - firsts + 1
        group = np.repeat(firsts, sizes)
        member = group + np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = pdf.loc[group, keys].reset_index(drop=True)
        return out.assign(n=pos[member], first=pos[group], last=pos[last[group]], start=start[group], end=end[group])

    tables = sliced.groupBy(*keys, "_slice").applyInPandas(
        doors, f"{key_schema}, _slice long, _rooted boolean, _doors array<long>, _exits array<long>")
    order = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    runs = tables.withColumn("_run", F.sum(F.col("_rooted").cast("long")).over(order))
    entry = runs.groupBy(*keys, "_run").applyInPandas(exits, f"{key_schema}, _entry long").select(
        *keys, slice_no("_entry", size).alias("_slice"), "_entry")
    return sliced.join(entry, [*keys, "_slice"], "left").groupBy(*keys, "_slice").applyInPandas(
        marked, f"{key_schema}, n long, first long, last long, start long, end long")
