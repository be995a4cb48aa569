"""Labelled training pairs: random negatives per user and week, hard negatives per purchase event."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from offerlens.functions import exprs as X
from offerlens.functions.constants import (
    MISSING_GENRE, NEGATIVES_PER_EVENT, NEGATIVES_PER_USER_WEEK, SOURCE_BAND, SOURCE_GENRE,
    SOURCE_POSITIVE, SOURCE_RANDOM)
from offerlens.operators import split as S
from offerlens.operators.numbering import column_medians, numbered
from offerlens.operators.topk import first_n
from offerlens.session import materialized, spread


def weekly_pairs(users: DataFrame, purchases: DataFrame, items: DataFrame, grid: S.WeekGrid,
                 negatives: int = NEGATIVES_PER_USER_WEEK, seed: int = 42, include_validation: bool = False) -> DataFrame:
    """(week, user_id, item_id, label) for every week of the grid.

    Positives are the week's distinct purchases of known users among the week's candidates.  For each user and week
    2 * negatives candidates are drawn without replacement by position, those bought in that week are dropped and the
    first `negatives` kept.  The draw costs one row per drawn item; no user ever meets the whole candidate list.
    """
    last = grid.train_weeks - (0 if include_validation else 1)
    pool = numbered(S.weekly_candidates(items, grid, include_validation), "_pos", "item_id", ["week"], "_size")
    people = users.select("user_id").distinct()
    positives = (S.weekly_labels(purchases, grid, include_validation)
                 .join(pool.select("week", "item_id"), ["week", "item_id"], "left_semi")
                 .join(people, "user_id", "left_semi"))
    sizes = pool.select("week", "_size").distinct()
    key = X.as_number(F.col("user_id"), dict(users.dtypes)["user_id"])
    asked = people.withColumn("week", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    strata = F.least(F.lit(2 * negatives).cast("bigint"), F.col("_size"))
    drawn = asked.join(sizes, "week").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), strata - 1)))
    # The seed moves with the week, so that a user's draws differ from week to week.
    parts = [key, F.col("week"), F.col("j")]
    drawn = drawn.select("week", "user_id", X.stratum_position(F.col("j"), strata, F.col("_size"), X.draw(parts, seed))
                         .alias("_pos"), X.draw(parts, seed + 1).alias("_ord"))
    # The user's purchases of a week come as one list, so that the draws are dealt by (week, user) once, to be checked and cut.
    bought = positives.groupBy("week", "user_id").agg(F.collect_set("item_id").alias("_bought"))
    picks = drawn.join(pool.select("week", "_pos", "item_id"), ["week", "_pos"]).join(bought, ["week", "user_id"], "left")
    picks = picks.filter(~F.coalesce(F.array_contains("_bought", F.col("item_id")), F.lit(False))).drop("_bought")
    kept = first_n(picks, ["week", "user_id"], [F.col("_ord"), F.col("item_id")], negatives)
    return positives.select("week", "user_id", "item_id", F.lit(1).alias("label")).unionByName(
        kept.select("week", "user_id", "item_id", F.lit(0).alias("label")))


def sampling_index(items: DataFrame) -> DataFrame:
    """Items with the genre marker and the price band; an unknown price counts as the median price."""
    median = column_medians(items, ["log_discount_price"])["log_discount_price"]
    log_price = F.coalesce("log_discount_price", F.lit(median if median is not None else 0.0))
    return items.withColumns({"genre_name": F.coalesce("genre_name", F.lit(MISSING_GENRE)),
                              "price_band": X.price_band(log_price)})


# The attributes two items are compared by.
DISTANCE_COLUMNS = ["log_discount_price", "price_rate", "valid_period"]


def item_distance(a: str, b: str) -> Column:
    """How far two items are apart in price, rate and validity; unknown values count as 0."""
    def value(side: str, c: str) -> Column:
        return F.coalesce(F.col(f"{side}{c}").cast("double"), F.lit(0.0))

    return (F.abs(value(a, "log_discount_price") - value(b, "log_discount_price"))
            + F.abs(value(a, "price_rate") - value(b, "price_rate")) / 100.0
            + 0.25 * F.abs(value(a, "valid_period") - value(b, "valid_period")) / 365.0)


LEVELS = (SOURCE_GENRE, SOURCE_BAND, SOURCE_RANDOM)
BLOCK_ITEMS = 128  # items of a day list in one row, more or less


def _classes(genre: str, band: str) -> Column:
    """The classes a row belongs to, nearest first: its genre, its price band, everything."""
    keys = (F.col(genre), F.col(band).cast("string"), F.lit("all"))
    return F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(keys)])


def _shown(items: DataFrame, first_day: int, last_day: int, *columns: str) -> DataFrame:
    """(level, key, day, item columns): the items of a class on display on a day."""
    first, last = F.lit(first_day).cast("bigint"), F.lit(last_day).cast("bigint")
    low = F.greatest(F.coalesce(X.day_number("disp_from"), first), first)
    high = F.least(F.coalesce(X.day_number("disp_end"), last), last)
    shown = items.select(
        "item_id", "disp_from", "disp_end", *columns, *[F.col(c).cast("double").alias(f"c_{c}") for c in DISTANCE_COLUMNS],
        F.explode(_classes("genre_name", "price_band")).alias("_class"), low.alias("_lo"), high.alias("_hi"))
    return shown.filter("_lo <= _hi").select("*", F.explode(F.sequence("_lo", "_hi")).alias("_day")).select(
        "_class.level", "_class.key", "_day", "item_id", "disp_from", "disp_end", *columns, *[f"c_{c}" for c in DISTANCE_COLUMNS])


def day_lists(items: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """(level, key, day, position, size, item columns): the items of a class on display on a day, numbered."""
    return numbered(_shown(items, first_day, last_day), "_pos", "item_id", ["level", "key", "_day"], "_size")


def hard_negatives(positives: DataFrame, items: DataFrame, bought: DataFrame, n: int = NEGATIVES_PER_EVENT,
                   seed: int = 42) -> DataFrame:
    """n negatives per purchase event while there are eligible items, each event on its own.

    - `positives`: positive_event_id, user_id, item_id, ts; `items`: the result of sampling_index;
      `bought`: user_id, item_id of all time, so that no negative was ever bought by the user.

    Nearest items of the same genre come first, then nearest of the same price band, then random ones, always among all
    items on display at the event that the user may get.  A level is opened only by events the earlier levels left
    short, so that most events meet the items of their genre alone.
    """
    events, lists = _asking(positives, items)
    return _negatives(_by_level(events.withColumn("need", F.lit(n)), lists, bought, dict(items.dtypes)["item_id"], seed, n))


def _asking(positives: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events with the attributes of their own item, and the day lists of the days they cover."""
    span = positives.agg(F.min(X.day_number("ts")).alias("lo"), F.max(X.day_number("ts")).alias("hi")).first()
    first_day, last_day = (span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)
    lists = materialized(day_lists(items, first_day, last_day))
    own = items.select(F.col("item_id").alias("reference_item_id"), "genre_name", "price_band",
                       *[F.col(c).cast("double").alias(f"p_{c}") for c in DISTANCE_COLUMNS])
    events = positives.select("positive_event_id", "user_id", F.col("item_id").alias("reference_item_id"), "ts",
                              X.day_number("ts").alias("_day")).join(own, "reference_item_id", "left")
    return events, lists


def _by_level(events: DataFrame, lists: DataFrame, bought: DataFrame, item_type: str, seed: int, most: int | None = None) -> DataFrame:
    """The `need` best items of each event in order (level, place, item), level by level: a level is opened for the events still
    short.  `most` is a number that no `need` exceeds, where there is a small one: tasks then keep that many rows of an event."""
    chosen = None
    for level, key in enumerate((F.col("genre_name"), F.col("price_band").cast("string"), F.lit("all"))):
        short = events.withColumn("_left", F.col("need"))
        if chosen is not None:
            have = chosen.groupBy("positive_event_id").agg(F.count(F.lit(1)).alias("_have"))
            short = events.join(have, "positive_event_id", "left").withColumn(
                "_left", F.col("need") - F.coalesce("_have", F.lit(0))).filter("_left > 0").drop("_have")
        found = short.withColumns({"level": F.lit(level), "key": key}).join(lists, ["level", "key", "_day"]).filter(
            S.available_at(F.col("ts"), F.col("disp_from"), F.col("disp_end"))).join(
            bought.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        if chosen is not None:
            found = found.join(chosen.select("positive_event_id", "item_id"), ["positive_event_id", "item_id"], "left_anti")
        best = _nearest(found, level, item_type, seed, most)
        chosen = materialized(best if chosen is None else chosen.unionByName(best))
        # Most often the levels below have nothing left to do, which one count of narrow rows tells.
        if level < 2:
            got = chosen.groupBy("positive_event_id").agg(F.count(F.lit(1)).alias("_have"))
            if events.join(got, "positive_event_id", "left").filter(F.col("need") > F.coalesce("_have", F.lit(0))).isEmpty():
                break
    return chosen


def _nearest(allowed: DataFrame, level: int, item_type: str, seed: int, most: int | None) -> DataFrame:
    """The wanted number of candidates per event: the nearest, at the last level random ones."""
    chance = X.draw([F.col("positive_event_id"), X.as_number(F.col("item_id"), item_type)], seed + 7)
    placed = allowed.withColumn("_place", item_distance("c_", "p_") if level < 2 else chance.cast("double"))
    place = F.row_number().over(Window.partitionBy("positive_event_id").orderBy("_place", "item_id"))
    ranked = placed.withColumn("_rank", place)
    ranked = ranked.filter(F.col("_rank") <= most) if most is not None else ranked
    return ranked.filter(F.col("_rank") <= F.col("_left")).select(
        "user_id", "item_id", "positive_event_id", "reference_item_id", "need", F.lit(level).alias("_level"), "_rank")


def _negatives(chosen: DataFrame) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(s) for s in LEVELS]), F.col("_level") + 1)
    return chosen.select("user_id", "item_id", F.lit(0).alias("label"), "positive_event_id", "reference_item_id", source.alias("negative_source"))


def _class_blocks(items: DataFrame, first_day: int, last_day: int) -> tuple[DataFrame, DataFrame]:
    """The day lists as narrow blocks (level, key, day, items), and (level, key, day, size, lasting): how many items a class shows on a
    day, and how many of them all day long."""
    shown = materialized(_shown(items, first_day, last_day, "genre_name", "price_band"))
    all_day = ((F.col("disp_from").isNull() | (X.day_number("disp_from") < F.col("_day")))
               & (F.col("disp_end").isNull() | (X.day_number("disp_end") > F.col("_day"))))
    sizes = materialized(shown.groupBy("level", "key", "_day").agg(F.count(F.lit(1)).alias("_size"), F.count_if(all_day).alias("_lasting")))
    least, most = F.lit(-(1 << 63)).cast("bigint"), F.lit((1 << 63) - 1).cast("bigint")
    offer = F.struct("item_id", X.as_number(F.col("item_id"), dict(items.dtypes)["item_id"]).alias("number"), "genre_name", F.col("price_band").alias("band"),
                     F.coalesce(X.micros("disp_from"), least).alias("lo"), F.coalesce(X.micros("disp_end"), most).alias("hi"),
                     *[F.coalesce(f"c_{c}", F.lit(0.0)).alias(c) for c in DISTANCE_COLUMNS])
    block = F.pmod(F.xxhash64("item_id"), F.ceil(F.col("_size") / BLOCK_ITEMS).cast("bigint"))
    blocks = shown.join(sizes, ["level", "key", "_day"]).groupBy("level", "key", "_day", block.alias("_block")).agg(
        F.collect_list(offer).alias("_items"))
    return materialized(blocks.drop("_block")), sizes


def _placed(asking: DataFrame, item_type: DataType, seed: int) -> DataFrame:
    """(user_id, positive_event_id, reference_item_id, _turn, _list): the `_need` first items of each row's block that are on display at
    the event, as (level, place, item) in order; the place is the distance, at the last level a draw."""
    entry = StructType([StructField("level", IntegerType()), StructField("place", DoubleType()), StructField("item_id", item_type)])
    kept = ["user_id", "positive_event_id", "reference_item_id", "_turn"]
    schema = StructType([*[asking.schema[c] for c in kept], StructField("_list", ArrayType(entry))])
    arrow = to_arrow_schema(schema)
    kind = arrow.field("_list").type

    def listed(b: pa.RecordBatch) -> pa.RecordBatch:
        own = {c: b.column(c) for c in b.schema.names}
        ends = own["_items"].offsets.to_numpy()
        x = dict(zip((f.name for f in own["_items"].type.value_type), own["_items"].flatten().flatten()))
        row = np.repeat(np.arange(len(b)), np.diff(ends))

        def of_event(c: str) -> np.ndarray:
            return own[c].to_numpy(zero_copy_only=False)[row]

        same_genre = pc.fill_null(pc.equal(x["genre_name"], own["genre_name"].take(pa.array(row))), False).to_numpy(zero_copy_only=False)
        level = np.where(same_genre, 0, np.where(x["band"].to_numpy(zero_copy_only=False) == of_event("_band"), 1, 2)).astype(np.int32)
        at, asked = of_event("_us"), of_event("level")
        # Items of the genre come with the list of the genre.
        here = (x["lo"].to_numpy() <= at) & (x["hi"].to_numpy() >= at) & ((asked != 1) | (level == 1))
        log_price, rate, valid = (np.abs(x[c].to_numpy() - of_event(f"p_{c}")) for c in DISTANCE_COLUMNS)
        h = (own["_number"].to_numpy()[row] * X.DRAW_FACTORS[0] + x["number"].to_numpy() * X.DRAW_FACTORS[1] + (seed + 7) * X.DRAW_FACTORS[3]) % X.DRAW_MODULUS
        chance = (h * h + h * X.DRAW_MULTIPLIER + X.DRAW_SHIFT) % X.DRAW_MODULUS
        place = np.where(level < 2, log_price + rate / 100.0 + 0.25 * valid / 365.0, chance)
        item = x["item_id"].to_numpy(zero_copy_only=False)
        item = item if item.dtype.kind in "iu" else np.unique(item, return_inverse=True)[1]
        order = np.flatnonzero(here)
        order = order[np.lexsort((item[order], place[order], level[order], row[order]))]
        first = np.searchsorted(row[order], np.arange(len(b) + 1))
        order = order[np.arange(len(order)) - first[row[order]] < of_event("_need")[order]]
        offsets = np.searchsorted(row[order], np.arange(len(b) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(level[order]), pa.array(place[order]), x["item_id"].take(pa.array(order))], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(offsets), entries).cast(kind)
        return pa.RecordBatch.from_arrays([*[own[c] for c in kept], lists], schema=arrow)

    def listed_all(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                yield listed(pa.RecordBatch.from_struct_array(pa.concat_arrays([b.slice(at, 1024).to_struct_array()])))

    return asking.mapInArrow(listed_all, schema).filter(F.size("_list") > 0)


def _settled(lists: DataFrame, bought: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, positive_event_id, reference_item_id, _level): a user's events in order, each with the first n items of its lists
    that the user never bought and no earlier event took.

    The rows of a user are one sorted run of a task, walked as a stream: first what the user bought, then a row or a few for each event
    with its items.  In memory are the items the user holds and the lists of one event, so that a user with very many events costs
    time along its own rows only.
    """
    def walk(batches):
        user = event = None
        at: list = []  # the lists of the event being read: (turn, levels, places, items)
        reference = None
        owned: set = set()
        held: set = set()  # what the events settled by their first n items hold
        later: set | None = None  # what events after the first short one took
        turns = 0
        out: list = []

        def settle():
            nonlocal later, turns
            _, levels, _, items = at[0]
            if len(at) > 1:
                rows = sorted(row for _, own, places, of_row in at for row in zip(own.tolist(), places.tolist(), of_row))
                levels, items = [r[0] for r in rows], [r[2] for r in rows]
            taken, asked = [], 0
            if later is None:
                for i, item in enumerate(items):
                    if item in owned:
                        continue
                    asked += 1
                    if item not in held:
                        held.add(item)
                        taken.append(i)
                    if asked == n:
                        break
                if len(taken) < n and asked == n and user is not None:
                    # Others left the event short: from here on the p-th event looks at its p * n best items.
                    held.difference_update(items[i] for i in taken)
                    later, taken, asked = set(), [], 0
            if later is not None:
                turns += len({turn for turn, *_ in at})
                for i, item in enumerate(items):
                    if item in owned or item in held:
                        continue
                    asked += 1
                    if item not in later:
                        later.add(item)
                        taken.append(i)
                    if len(taken) == n or asked == turns * n:
                        break
            out.extend((user, items[i], event, reference, int(levels[i])) for i in taken)

        for b in batches:
            users, events, references, turn_of = (b.column(i).to_pylist() for i in range(4))
            lists = b.column(4)
            ends = lists.offsets.to_pylist()
            levels, places = (lists.values.field(i).to_numpy() for i in range(2))
            items = lists.values.field(2)
            items = items.to_numpy().tolist() if pa.types.is_integer(items.type) and not items.null_count else items.to_pylist()
            for r, (u, e) in enumerate(zip(users, events)):
                if at and (u != user or e != event):
                    settle()
                    at = []
                if u != user:
                    owned, held, later, turns = set(), set(), None, 0
                user, event, reference = u, e, references[r]
                own = slice(ends[r], ends[r + 1])
                if turn_of[r] == 0:
                    owned.update(items[own])
                else:
                    at.append((turn_of[r], levels[own], places[own], items[own]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=arrow)
                out.clear()
        if at:
            settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=arrow)

    columns = ["user_id", "positive_event_id", "reference_item_id", "_turn", "_list"]
    kinds = dict(lists.dtypes)
    own = F.array(F.struct(F.lit(0).alias("level"), F.lit(0.0).alias("place"), F.col("item_id"))).cast(kinds["_list"])
    mine = bought.filter("user_id is not null and item_id is not null").join(lists.select("user_id").distinct(), "user_id", "left_semi").select(
        "user_id", F.lit(None).cast(kinds["positive_event_id"]).alias("positive_event_id"),
        F.lit(None).cast(kinds["reference_item_id"]).alias("reference_item_id"), F.lit(0).alias("_turn"), own.alias("_list"))
    rows = lists.select(*columns).unionByName(mine)
    run = rows.repartition("user_id").sortWithinPartitions("user_id", F.col("_turn") > 0, "positive_event_id")
    schema = StructType([run.schema["user_id"], StructField("item_id", run.schema["_list"].dataType.elementType["item_id"].dataType),
                         run.schema["positive_event_id"], run.schema["reference_item_id"], StructField("_level", IntegerType())])
    arrow = to_arrow_schema(schema)
    types = arrow.types
    return run.mapInArrow(walk, schema)


def _settled_rows(lists: DataFrame, n: int) -> DataFrame:
    """The lists with `_kept`: a user's events in order, each with the first n items of its list that no earlier one took.

    The rows of a user are one sorted run of a task and are walked as a stream; what is kept in memory is the set of items the user
    holds, never the run, so that a user with very many events costs time along its own rows only.
    """
    def walk(batches):
        user = event = None
        held: set = set()
        got = 0
        for b in batches:
            kept = []
            for u, e, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if u != user:
                    user, event, held = u, None, set()
                if e != event:
                    event, got = e, 0
                free = got < n and i not in held
                if free:
                    held.add(i)
                    got += 1
                kept.append(free)
            yield b.append_column("_kept", pa.array(kept, pa.bool_()))

    columns = ["user_id", "positive_event_id", "item_id", "reference_item_id", "need", "_level", "_rank"]
    run = lists.select(*columns).repartition("user_id").sortWithinPartitions("user_id", "positive_event_id", "_level", "_rank")
    return run.mapInArrow(walk, StructType([*run.schema, StructField("_kept", BooleanType())]))


def _in_two_rounds(positives: DataFrame, items: DataFrame, bought: DataFrame, n: int, seed: int) -> DataFrame:
    """exclusive_hard_negatives of a table that repeats items, whose rows count one by one: first n rows for each event, then, from a
    user's first short event on, p * n rows for the p-th."""
    events, lists = _asking(positives, items)
    events, item_type = materialized(events), dict(items.dtypes)["item_id"]
    first = materialized(_settled_rows(_by_level(events.withColumn("need", F.lit(n).cast("bigint")), lists, bought, item_type, seed, n), n))
    state = first.groupBy("user_id", "positive_event_id").agg(F.count_if("_kept").alias("got"), F.count(F.lit(1)).alias("asked"))
    # A list shorter than n was all there is.
    open_from = materialized(state.filter((F.col("got") < n) & (F.col("asked") >= n)).groupBy("user_id").agg(
        F.min("positive_event_id").alias("_from")))
    final = first.filter("_kept")
    if open_from.isEmpty():
        return _negatives(final)
    final = materialized(final.join(open_from, "user_id", "left").filter("_from is null or positive_event_id < _from").drop("_from", "_kept"))
    again = events.join(open_from, "user_id").filter("positive_event_id >= _from").drop("_from")
    again = numbered(again, "_turn", "positive_event_id", ["user_id"]).withColumn("need", (F.col("_turn") + 1) * n).drop("_turn")
    taken = bought.select("user_id", "item_id").unionByName(final.join(open_from, "user_id", "left_semi").select("user_id", "item_id"))
    rest = _settled_rows(_by_level(again, lists, taken, item_type, seed), n).filter("_kept").drop("_kept")
    return _negatives(materialized(final.unionByName(rest.select(*final.columns))))


def exclusive_hard_negatives(positives: DataFrame, items: DataFrame, bought: DataFrame, n: int = NEGATIVES_PER_EVENT,
                             seed: int = 42) -> DataFrame:
    """hard_negatives where an item serves a user only once: a user's earlier events (by id) choose first.

    Every event brings its n best items and each user's events are settled in order, until others left one short.  That one and
    those after it look further: the p-th of them at its p * n best items, since the p - 1 before it can take no more than (p - 1) * n.
    So the p-th event of a user needs at most its p * n best items beside those the user bought, and one pass brings them:
    all of its genre where enough of these are on display all day, those of the price band beside them where these are enough, else
    all items on display.  What travels is one row for each event with its list, in order and cut to that number.
    """
    if not items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return _in_two_rounds(positives, items, bought, n, seed)
    span = positives.agg(F.min(X.day_number("ts")).alias("lo"), F.max(X.day_number("ts")).alias("hi")).first()
    blocks, sizes = _class_blocks(items, *((span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)))
    own = items.select(F.col("item_id").alias("reference_item_id"), "genre_name", "price_band",
                       *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"p_{c}") for c in DISTANCE_COLUMNS])
    events = positives.select("positive_event_id", "user_id", F.col("item_id").alias("reference_item_id"), "ts",
                              X.day_number("ts").alias("_day")).join(own, "reference_item_id", "left")
    holds = bought.groupBy("user_id").agg(F.count_distinct("item_id").alias("_bought"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("positive_event_id"))
    need = F.col("_turn") * n + F.coalesce("_bought", F.lit(0))
    events = events.join(holds, "user_id", "left").withColumn("_turn", turn).withColumn("_need", need.cast("int")).drop("_bought")
    keys = (F.col("genre_name"), F.col("price_band").cast("string"), F.lit("all"))
    for level in (0, 1):
        size = sizes.filter(F.col("level") == level).select(F.col("key").alias("_key"), F.col("_day").alias("_on"), F.col("_lasting").alias(f"_lasting{level}"))
        events = events.join(size, (keys[level] == size["_key"]) & (events["_day"] == size["_on"]), "left").drop("_key", "_on")
    genre, band, every = (F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(keys))
    enough = [F.coalesce(f"_lasting{i}", F.lit(0)) >= F.col("_need") for i in (0, 1)]
    asked = F.when(enough[0], F.array(genre)).when(enough[1], F.array(genre, band)).otherwise(F.array(every))
    asking = events.select("*", F.explode(asked).alias("_class")).select("*", "_class.level", "_class.key").drop("_class", "_lasting0", "_lasting1")

    asking = asking.withColumns({"_us": X.micros("ts"), "_number": F.col("positive_event_id").cast("bigint"), "_band": F.coalesce("price_band", F.lit(-1)),
                                 **{f"p_{c}": F.coalesce(f"p_{c}", F.lit(0.0)) for c in DISTANCE_COLUMNS}}).drop("ts", "price_band")
    found = spread(asking, "positive_event_id").join(blocks, ["level", "key", "_day"]).drop("key", "_day")
    lists = materialized(_placed(found, items.schema["item_id"].dataType, seed))
    return _negatives(materialized(_settled(lists, bought.select("user_id", "item_id"), n)))


def positive_pairs(purchases: DataFrame) -> DataFrame:
    """Every purchase event as a positive row."""
    return purchases.select("user_id", "item_id", F.lit(1).alias("label"), "positive_event_id",
                            F.col("item_id").alias("reference_item_id"), F.lit(SOURCE_POSITIVE).alias("negative_source"))


def training_pairs(purchases: DataFrame, negatives: DataFrame) -> DataFrame:
    return positive_pairs(purchases).unionByName(negatives)


def refit_pairs(all_purchases: DataFrame, kept_negatives: DataFrame, new_purchases: DataFrame, items: DataFrame,
                bought: DataFrame, n: int = NEGATIVES_PER_EVENT, seed: int = 52) -> DataFrame:
    """Pairs of a final refit: all positives, the earlier negatives, new negatives only for the added events."""
    added = exclusive_hard_negatives(new_purchases, items, bought, n, seed)
    return training_pairs(all_purchases, kept_negatives.unionByName(added))


def negative_mix(negatives: DataFrame) -> DataFrame:
    """Rows and share of the negatives by source, with the share that is not random."""
    by_source = negatives.groupBy("negative_source").agg(F.count(F.lit(1)).alias("rows"))
    # A handful of counts: what is shared is a window over these, and the negatives are read once.
    all_rows = Window.partitionBy(F.lit(1))
    hard = F.sum(F.when(F.col("negative_source") != SOURCE_RANDOM, F.col("rows")).otherwise(0)).over(all_rows)
    total = F.sum("rows").over(all_rows)
    return by_source.select("negative_source", "rows", (F.col("rows") / total).alias("share"), (hard / total).alias("hard_share"))
