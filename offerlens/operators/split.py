"""Time: history cuts, the weekly grid, candidate windows, chronological splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.constants import DAY_US, WEEK_DAYS
from offerlens.functions.exprs import micros, ts_lit
from offerlens.operators.numbering import day_histogram, times_at_positions

WEEK_US = WEEK_DAYS * DAY_US


def history_before(facts: DataFrame, cutoff_us: int, ts: str = "ts") -> DataFrame:
    """Facts strictly before the cut-off; a plain predicate, so it reaches the scan."""
    return facts.filter(F.col(ts) < ts_lit(cutoff_us))


def history_through(facts: DataFrame, purchases: DataFrame, ts: str = "ts") -> DataFrame:
    """Facts up to and including the last purchase (the cut of a final refit)."""
    last = purchases.agg(F.max(ts).alias("last")).scalar()
    return facts.filter(F.col(ts) <= last)


def global_bounds(facts: DataFrame, ts: str = "ts") -> DataFrame:
    return facts.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


@dataclass(frozen=True)
class WeekGrid:
    """Week boundaries in epoch microseconds: training weeks, then one validation week, then the final cut-off."""

    first_start: int
    val_start: int
    final_cutoff: int

    @property
    def train_starts(self) -> list[int]:
        return list(range(self.first_start, self.val_start, WEEK_US))

    @property
    def train_weeks(self) -> int:
        return (self.val_start - self.first_start) // WEEK_US

    def week_of(self, ts: Column) -> Column:
        """Index of the week holding an instant; 0 is the first training week, earlier instants are negative."""
        return F.floor((micros(ts) - F.lit(self.first_start)) / F.lit(WEEK_US)).cast("bigint")

    def start_of(self, week: Column) -> Column:
        return F.timestamp_micros(F.lit(self.first_start) + week * F.lit(WEEK_US))


def week_grid(purchases: DataFrame) -> WeekGrid:
    """The grid of a purchase table: one small aggregate, three numbers on the driver; raises below two whole weeks."""
    row = purchases.agg(F.min(micros("ts")).alias("lo"), F.max(micros("ts")).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no purchases: at least two whole weeks are needed")
    first_day = row["lo"] // DAY_US * DAY_US
    final = row["hi"] // DAY_US * DAY_US + DAY_US
    val = final - WEEK_US
    first = first_day + (val - first_day) // DAY_US % WEEK_DAYS * DAY_US
    grid = WeekGrid(first, val, final)
    require_enough_weeks(grid)
    return grid


def require_enough_weeks(grid: WeekGrid) -> WeekGrid:
    if not grid.train_starts:
        raise ValueError("the purchases cover less than two whole weeks, so no week can be held out")
    return grid


def weekly_grid(purchases: DataFrame) -> DataFrame:
    """The grid as rows: week, week_start, role (train / validation)."""
    grid = week_grid(purchases)
    one = purchases.sparkSession.range(1)
    weeks = one.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid.train_weeks).cast("bigint"))).alias("week"))
    return weeks.select("week", grid.start_of(F.col("week")).alias("week_start"),
                        F.when(F.col("week") < grid.train_weeks, "train").otherwise("validation").alias("role"))


def candidates_in_window(items: DataFrame, start_us: int, days: int = WEEK_DAYS) -> DataFrame:
    """Items on display at some time in [start, start + days); items without both display dates are left out."""
    return items.filter((F.col("disp_from") < ts_lit(start_us + days * DAY_US)) & (F.col("disp_end") >= ts_lit(start_us)))


def weekly_candidates(items: DataFrame, grid: WeekGrid, include_validation: bool = False) -> DataFrame:
    """(week, item_id) for every week of the grid: each item is exploded over the weeks it overlaps, without a join."""
    last = grid.train_weeks - (0 if include_validation else 1)
    # A display that starts at a week's end belongs to the next week only; one that ends at its start still counts.
    low = F.greatest(grid.week_of(F.col("disp_from")), F.lit(0).cast("bigint"))
    high = F.least(grid.week_of(F.col("disp_end")), F.lit(last).cast("bigint"))
    valid = F.col("disp_from").isNotNull() & F.col("disp_end").isNotNull()
    return (items.filter(valid).select("item_id", low.alias("_lo"), high.alias("_hi")).filter("_lo <= _hi")
            .select(F.explode(F.sequence("_lo", "_hi")).alias("week"), "item_id"))


def active_items(items: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Items on display at some time in [low, high]; an unknown end of the display is open."""
    return items.filter((F.col("disp_from").isNull() | (F.col("disp_from") <= ts_lit(high_us)))
                        & (F.col("disp_end").isNull() | (F.col("disp_end") >= ts_lit(low_us))))


def pool_with_truth(items: DataFrame, truth: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Active items plus every item of the truth, each once."""
    bought = truth.select("item_id").distinct().withColumn("_bought", F.lit(True))
    active = ((F.col("disp_from").isNull() | (F.col("disp_from") <= ts_lit(high_us)))
              & (F.col("disp_end").isNull() | (F.col("disp_end") >= ts_lit(low_us))))
    return items.join(bought, "item_id", "left").filter(active | F.col("_bought")).drop("_bought")


def training_pool(items: DataFrame, cutoff_us: int) -> DataFrame:
    """Items already shown, or of unknown start, before the cut-off."""
    return items.filter(F.col("disp_from").isNull() | (F.col("disp_from") < ts_lit(cutoff_us)))


def available_at(event_time: Column, disp_from: Column, disp_end: Column) -> Column:
    """Whether an instant lies in a display interval; both ends belong to it, unknown ends are open."""
    return (disp_from.isNull() | (disp_from <= event_time)) & (disp_end.isNull() | (disp_end >= event_time))


def available_events(events: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Events inside the display interval of their own item."""
    shown = items.select("item_id", "disp_from", "disp_end")
    return events.join(shown, "item_id").filter(
        available_at(F.col(ts), F.col("disp_from"), F.col("disp_end"))).drop("disp_from", "disp_end")


@dataclass(frozen=True)
class SplitBounds:
    """The first event, the starts of the tuning and the holdout part and the last event, in epoch microseconds."""

    first: int
    tuning_start: int
    holdout_start: int
    last: int


def split_bounds(events: DataFrame, ratio: float = 0.2, ts: str = "ts") -> SplitBounds:
    """Chronological boundaries: the event times at the sorted positions n(1 - ratio) and n(1 - ratio / 2)."""
    days = day_histogram(events, ts)
    n = sum(rows for _, rows, _, _ in days)
    if n < 3:
        raise ValueError("a three-way split needs at least three events")
    half = ratio / 2
    tuning = min(max(int(n * (1 - half - half)), 1), n - 2)
    holdout = min(max(int(n * (1 - half)), tuning + 1), n - 1)
    lo, hi = times_at_positions(events, ts, [tuning, holdout], days)
    return SplitBounds(days[0][2], lo, hi, days[-1][3])


def tag_split(events: DataFrame, bounds: SplitBounds, ts: str = "ts") -> DataFrame:
    """Add `split`: train, early_stop or holdout; an event at a boundary belongs to the later part,
    one without a time to none."""
    return events.withColumn("split", F.when(F.col(ts) < ts_lit(bounds.tuning_start), "train")
                             .when(F.col(ts) < ts_lit(bounds.holdout_start), "early_stop")
                             .when(F.col(ts) >= ts_lit(bounds.holdout_start), "holdout"))


def temporal_three_way_split(events: DataFrame, ratio: float = 0.2, ts: str = "ts") -> tuple[DataFrame, SplitBounds]:
    """Events tagged by part; raises where a part stays empty (all events at one instant, say)."""
    bounds = split_bounds(events, ratio, ts)
    if bounds.first >= bounds.tuning_start or bounds.tuning_start >= bounds.holdout_start:
        raise ValueError("the three-way split left a part empty")
    return tag_split(events, bounds, ts), bounds


def labels_in_window(purchases: DataFrame, start_us: int, days: int = WEEK_DAYS) -> DataFrame:
    """Distinct user-item pairs bought in [start, start + days)."""
    return purchases.filter((F.col("ts") >= ts_lit(start_us)) & (F.col("ts") < ts_lit(start_us + days * DAY_US))).select(
        "user_id", "item_id").distinct()


def weekly_labels(purchases: DataFrame, grid: WeekGrid, include_validation: bool = False) -> DataFrame:
    """Distinct (week, user, item) bought inside the weeks of the grid."""
    last = grid.train_weeks - (0 if include_validation else 1)
    return purchases.select(grid.week_of(F.col("ts")).alias("week"), "user_id", "item_id").filter(
        F.col("week").between(0, last)).distinct()


def limit_users(users: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The first n users, for a sample run."""
    return users.orderBy(*(order or [F.col("user_id")])).limit(n)
