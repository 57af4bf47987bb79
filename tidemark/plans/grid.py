"""The snapshot grid as arithmetic on dates, so that no event is joined to the grid.

Dates in uneven distances are looked up in a table with one number per day, which is part
of the plan as a constant: a place in it is still worked out, never searched or joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import day, index_range
from ..params import Params


@dataclass(frozen=True)
class Grid:
    """First date, last index and first wanted index (``low``) of the grid, from a one-row aggregate.

    Days that matter to earlier dates only through what has happened so far enter at ``low``.
    """

    bounds: DataFrame
    step: int

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_grid", self.bounds.select(F.struct("start", "last", "low")).scalar())

    @property
    def start(self) -> Column:
        return F.col("_grid.start")

    @property
    def last(self) -> Column:
        return F.col("_grid.last")

    @property
    def low(self) -> Column:
        return F.col("_grid.low")

    def first_after(self, d: Column) -> Column:
        """Index of the first grid date later than day ``d``, at least ``low``; that for NULL too."""
        ahead = F.datediff(d, self.start) + 1
        return F.greatest(self.low, F.ceil(ahead / F.lit(self.step)))

    def at_or_after(self, d: Column) -> Column:
        ahead = F.datediff(d, self.start)
        return F.greatest(self.low, F.ceil(ahead / F.lit(self.step)))

    def at_or_before(self, d: Column) -> Column:
        return F.least(self.last, F.floor(F.datediff(d, self.start) / F.lit(self.step)))

    def date(self, idx: Column) -> Column:
        return F.date_add(self.start, (idx * self.step).cast("int"))


@dataclass(frozen=True)
class ListedGrid(Grid):
    """The same over listed dates (sorted, each once), whatever lies between them.

    An index counts along the whole list; ``low`` and ``last`` bound those that are used.
    """

    dates: tuple[date, ...] = ()

    def up_to(self, d: Column) -> Column:
        """Number of listed dates not later than day ``d``; NULL for NULL."""
        first = self.dates[0]
        places, seen = [], 0
        for offset in range((self.dates[-1] - first).days + 1):
            seen += (self.dates[seen] - first).days == offset
            places.append(seen)
        offset = F.datediff(d, F.lit(first))
        found = F.get(F.expr(f"array({', '.join(map(str, places))})"), offset)
        return F.when(offset < 0, 0).when(offset >= len(places), len(self.dates)).otherwise(found).cast("bigint")

    def first_after(self, d: Column) -> Column:
        return F.greatest(self.low, self.up_to(d))

    def at_or_after(self, d: Column) -> Column:
        return F.greatest(self.low, self.up_to(F.date_sub(d, 1)))

    def at_or_before(self, d: Column) -> Column:
        return F.least(self.last, self.up_to(d) - 1)

    def date(self, idx: Column) -> Column:
        listed = ", ".join(f"DATE '{d}'" for d in self.dates)
        return F.get(F.expr(f"array({listed})"), idx.cast("int"))


def snapshot_grid(bounds: DataFrame, p: Params, since: date | None = None) -> Grid:
    """Grid for a log whose first and last event times are ``bounds (lo, hi)``.

    With ``since`` only dates from that day on are wanted. Where the parameters list
    snapshot days, these take the place of the regular dates; what lies outside lead and
    trail is left out there as well, as its features or labels would be cut off.
    """
    edges = bounds.select(
        F.date_add(day("lo"), p.grid_lead_days).alias("start"),
        F.date_sub(day("hi"), p.grid_trail_days).alias("end"),
    )
    if p.snapshot_days:
        return _listed(edges, tuple(sorted(set(p.snapshot_days))), since)
    last = F.floor(F.datediff("end", "start") / F.lit(p.grid_step_days))
    low = F.lit(0) if since is None else F.greatest(F.lit(0), F.ceil(F.datediff(F.lit(since), "start") / F.lit(p.grid_step_days)))
    return Grid(
        edges.select(
            "start",
            F.when(F.col("end") >= F.col("start"), last).otherwise(F.lit(-1)).cast("bigint").alias("last"),
            low.cast("bigint").alias("low"),
        ),
        p.grid_step_days,
    )


def _listed(edges: DataFrame, dates: tuple[date, ...], since: date | None) -> ListedGrid:
    find = ListedGrid(edges, 0, dates).up_to
    begin = F.col("start") if since is None else F.greatest(F.col("start"), F.lit(since))
    fits = F.col("end") >= F.col("start")
    bounds = edges.select(
        "start",
        F.when(fits, find(F.col("end")) - 1).otherwise(F.lit(-1)).cast("bigint").alias("last"),
        F.coalesce(find(F.date_sub(begin, 1)), F.lit(0)).cast("bigint").alias("low"),
    )
    return ListedGrid(bounds, 0, dates)


def snapshot_dates(bounds: DataFrame, p: Params) -> DataFrame:
    """One row per snapshot date; none when the log is shorter than lead + trail."""
    g = snapshot_grid(bounds, p)
    return (
        g.bounds.select(F.struct("start", "last", "low").alias("_grid"))
        .select("_grid", F.explode(index_range(g.low, g.last)).alias("idx"))
        .select(g.date(F.col("idx")).alias("snapshot_date"))
    )
