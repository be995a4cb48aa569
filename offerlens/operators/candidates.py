"""Candidate pairs: exact shortlists, evaluation pools and retrieval sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import exprs as X
from offerlens.functions.constants import (
    MAX_CANDIDATES_PER_USER, MIN_ITEMS_PER_GENRE, MISSING_GENRE, POPULAR_CANDIDATES, TOP_K)
from offerlens.operators.numbering import numbered
from offerlens.operators.profile import sample_users
from offerlens.operators.topk import first_n, top_k
from offerlens.session import materialized, spread

ANY, NO_GENRE, NO_PREF, HOMELESS = "\u0000any", "\u0000none", "\u0000none", "\u0000homeless"
BAND_WIDTH, PARTS = 0.25, 16  # bands of log prices, first wide ones, then so many parts of each
SLACK = 1e-5  # more than what rounding scores to six digits can move


def shortlist(owners: DataFrame, owner_genres: DataFrame, items: DataFrame, owner: list[str], k: int = TOP_K,
              price_weight: float = 0.0, region_bonus: float | None = None) -> DataFrame:
    """(owner, item) pairs certain to contain each owner's k best items, without looking at every owner-item pair.

    It serves scores of the form  base(item) - price_weight * |log_price(item) - log_price(owner)| + bonus, where the
    bonus is not negative and depends only on whether the owner knows the item's genre and lives in its region.

    - `owners`: owner, pref_name, log_price; `owner_genres`: owner, genre_name; `items`: item_id, genre_name,
      pref_name, base, log_price.
    - With `region_bonus`, the bonus is that number for the own region plus the column `bonus` of `owner_genres` for a known
      genre.  Scores are then known here, and an owner keeps what reaches the score of its k-th item.

    An item of the answer is among the best k, bonus aside, of one of four cells: (known genre, own region), (known
    genre, any region), (any genre, own region), (any, any); any better item of that cell has at least the same bonus.
    Within a cell and a narrow band of the owner's price an item survives unless k others beat it everywhere between the
    least and the largest price of the band's owners.  What falls out of a wide band falls out of all its parts, so the
    parts see the survivors only.  Owners then meet only the survivors of their cells and part.
    """
    w = float(price_weight)
    # Copies (equal score for every owner) beyond the first k of their class can never be needed.
    base = items.select("item_id", F.coalesce("genre_name", F.lit(NO_GENRE)).alias("g"),
                        F.coalesce("pref_name", F.lit(NO_PREF)).alias("r"), "base", "log_price")
    base = first_n(base, ["g", "r", "base", "log_price"], [F.col("item_id")], k).drop("rank")
    price = F.coalesce(F.nanvl(F.col("log_price").cast("double"), F.lit(0.0)), F.lit(0.0))
    part = F.floor(price / (BAND_WIDTH / PARTS)) if w else F.lit(0)
    people = materialized(spread(owners.select(*owner, F.coalesce("pref_name", F.lit(HOMELESS)).alias("home"), price.alias("price"),
                                               part.cast("bigint").alias("band")), *owner))
    # Bands in use: a few hundred at most, since log prices span a short range.
    spans = people.groupBy("band").agg(F.min("price").alias("low"), F.max("price").alias("high")).select(
        F.floor(F.col("band") / PARTS).cast("bigint").alias("wide"), "band", "low", "high")
    wide_spans = spans.groupBy("wide").agg(F.min("low").alias("low"), F.max("high").alias("high")).select(
        F.col("wide").alias("band"), "low", "high")

    def banded(rows: DataFrame, bands: DataFrame) -> DataFrame:
        """The rows in each of the bands, with the least and the best they are worth to its owners."""
        found = bands.agg(F.array_sort(F.collect_list(F.struct(*bands.columns))).alias("bands")).scalar()
        far = F.greatest(F.abs(F.col("log_price") - F.col("low")), F.abs(F.col("log_price") - F.col("high")))
        near = F.greatest(F.col("low") - F.col("log_price"), F.col("log_price") - F.col("high"), F.lit(0.0))
        if not w:
            far = near = F.lit(0.0)
        out = rows.select("*", F.inline(found)).withColumns({"worst": F.col("base") - w * far, "best": F.col("base") - w * near})
        return out.drop("low", "high")

    rough = _survivors(banded(base, wide_spans), k).drop("bar")
    rough = materialized(rough.select("g", "r", F.col("band").alias("_wide"), "item_id", "base", "log_price"))
    parts = banded(rough, spans).filter(F.col("wide") == F.col("_wide")).drop("wide", "_wide")
    # What falls out of its own class falls out of every wider cell, so the wider cells see the survivors only.
    narrow = materialized(_survivors(parts, k).withColumns({"own_g": F.col("g"), "own_r": F.col("r")}))
    wider = F.array(F.struct("g", F.lit(ANY).alias("r")), F.struct(F.lit(ANY).alias("g"), "r"),
                    F.struct(F.lit(ANY).alias("g"), F.lit(ANY).alias("r")))
    wide = materialized(_survivors(narrow.drop("bar").withColumn("_cell", F.explode(wider)).withColumns(
        {"g": F.col("_cell.g"), "r": F.col("_cell.r")}).drop("_cell"), k))
    cell = ["g", "r", "band"]
    columns = [*cell, "item_id", "base", "log_price", "own_g", "own_r"]
    kept = narrow.select(*columns).unionByName(wide.select(*columns))

    # All owners ask for the (any, any) cell: its few survivors are repeated under several salts and the owners are
    # spread over them, so that no join key holds one row per owner.
    salts = 16
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    bonus = F.lit(0.0) if region_bonus is None else F.coalesce(F.col("bonus"), F.lit(0.0))
    known = owner_genres.filter(F.col("genre_name").isNotNull()).groupBy(*owner, F.col("genre_name").alias("g")).agg(F.max(bonus).alias("bonus"))
    likes = known.groupBy(*owner).agg(F.collect_list(F.struct("g", "bonus")).alias("likes"))
    asking = spread(people, *owner).join(likes, owner, "left").withColumn("salt", F.pmod(F.xxhash64(*owner), F.lit(salts)).cast("int"))
    if region_bonus is not None:
        asking = asking.join(_floors(wide, region_bonus), ["home", "band"], "left")
    every = F.coalesce("likes", F.array().cast(asking.schema["likes"].dataType))
    open_cell = F.struct(F.lit(ANY).alias("g"), F.lit(0.0).alias("bonus"), F.transform(every, lambda x: x["g"]).alias("others"))
    own_cells = F.transform(every, lambda x: F.struct(x["g"].alias("g"), x["bonus"].alias("bonus"), F.array().cast("array<string>").alias("others")))
    wants = asking.select(*[c for c in asking.columns if c != "likes"], F.inline(F.concat(F.array(open_cell), own_cells)))
    wants = spread(wants.withColumn("r", F.explode(F.array("home", F.lit(ANY)))), *owner)
    # A pair comes from the narrowest of its owner's cells alone: what survives in a cell survives in every narrower one.
    met = wants.join(kept, [*cell, "salt"]).filter(
        ~((F.col("g") == ANY) & F.array_contains("others", F.col("own_g"))) & ~((F.col("r") == ANY) & (F.col("own_r") == F.col("home"))))
    if region_bonus is None:
        return spread(met.select(*owner, "item_id"), *owner).distinct()
    score = (F.col("base") - w * F.abs(F.col("log_price") - F.col("price")) + F.col("bonus")
             + F.when(F.col("own_r") == F.col("home"), float(region_bonus)).otherwise(0.0))
    met = met.select(*owner, "item_id", score.alias("score"), "floor").filter("floor is null or score >= floor")
    return _reaching(spread(met.drop("floor"), *owner), owner, k).select(*owner, "item_id").distinct()


def _floors(wide: DataFrame, region_bonus: float) -> DataFrame:
    """(home, band, floor): what the k-th item of every owner of a region and a band is worth at least, less what rounding can move."""
    bars = wide.filter((F.col("g") == ANY) & F.col("bar").isNotNull()).groupBy("r", "band").agg(F.max("bar").alias("bar"))
    every = bars.filter(F.col("r") == ANY).select("band", F.col("bar").alias("_any"))
    own = bars.filter(F.col("r") != ANY).select(F.col("r").alias("home"), "band", (F.col("bar") + region_bonus).alias("_own"))
    homes = wide.filter((F.col("g") == ANY) & (F.col("r") != ANY)).select(F.col("r").alias("home")).distinct().unionByName(
        wide.sparkSession.range(1).select(F.lit(HOMELESS).alias("home")))
    floors = homes.crossJoin(every).unionByName(own.select("home", "band", F.col("_own").alias("_any")))
    return materialized(floors.groupBy("home", "band").agg((F.max("_any") - SLACK).alias("floor")))


def _reaching(scored: DataFrame, owner: list[str], k: int) -> DataFrame:
    """The rows (owner, item_id, score) that reach the score of their owner's k-th item within what rounding can move."""
    falling = Window.partitionBy(*owner).orderBy(F.desc("score"), "item_id")
    placed = scored.withColumn("_place", F.dense_rank().over(falling))
    bar = F.max(F.when(F.col("_place") == k, F.col("score"))).over(Window.partitionBy(*owner))
    return placed.withColumn("_bar", bar).filter(F.col("_bar").isNull() | (F.col("score") >= F.col("_bar") - SLACK)).drop("_place", "_bar")


def _survivors(banded: DataFrame, k: int) -> DataFrame:
    """Rows (g, r, band, item_id, base, log_price, worst, best) not beaten by k others of their cell all over the band; `bar` is what
    the k-th of the cell is worth at least, null where the cell has fewer items."""
    cell = ["g", "r", "band"]
    kth = top_k(banded.select(*cell, "item_id", "worst"), cell, F.col("worst"), k, [F.col("item_id")]).groupBy(*cell).agg(
        F.min("worst").alias("_bar"), F.count(F.lit(1)).alias("_n"))
    kept = banded.join(kth, cell).filter((F.col("_n") < k) | (F.col("best") >= F.col("_bar") - SLACK))
    kept = kept.withColumn("bar", F.when(F.col("_n") >= k, F.col("_bar")))
    return first_n(kept, [*cell, "base", "log_price"], [F.col("item_id")], k).drop("rank", "_bar", "_n")


def product(users: DataFrame, rows: DataFrame, order: str, block_rows: int = 500, salts: int = 16, by: list[str] | None = None) -> DataFrame:
    """Every row of `users` with every row of a pool, numbered by `order` as candidate_pos; the two sides share no column.

    The pool is cut into blocks of `block_rows` rows, each an array; a user meets block after block by an equi-join on (block, salt),
    so neither side is ever copied whole to a task, and what is needed of an item comes with it: nothing is looked up for pairs.
    Salts are dealt by the columns `by` of a user; few blocks go out under more of them, so that no task is left without work.
    """
    placed = numbered(rows, "candidate_pos", order)
    last = placed.agg(F.max("candidate_pos").alias("m")).first()["m"]
    count = 1 + (last or 0) // block_rows
    salts = max(salts, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // count)
    blocks = placed.groupBy(F.floor(F.col("candidate_pos") / block_rows).cast("bigint").alias("_block")).agg(
        F.collect_list(F.struct(*placed.columns)).alias("_rows"))
    blocks = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asking = users.withColumn("_salt", F.pmod(F.xxhash64(*(by or users.columns)), F.lit(salts)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    return spread(asking, "_block", "_salt").join(blocks, ["_block", "_salt"]).select(*users.columns, F.inline("_rows"))


def pool_pairs(users: DataFrame, pool: DataFrame, block_rows: int = 500, salts: int = 16) -> DataFrame:
    """Every user with every item of a candidate pool (the pool is what a week or a request offers), which is the operator's result."""
    key = pool.columns[0]
    return product(users, pool.select(key).distinct(), key, block_rows, salts)


def full_candidate_pairs(truth: DataFrame, pool: DataFrame, max_users: int | None = None, seed: int = 42) -> DataFrame:
    """An evaluation pool: every truth user (a sample of `max_users` where that is asked for) with every item of the pool, labelled by the truth."""
    users = truth.select("user_id").distinct() if max_users is None else sample_users(truth, max_users, seed)
    labels = truth.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1))
    pairs = pool_pairs(users, pool.select("item_id"))
    return pairs.join(labels, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", F.coalesce("_hit", F.lit(0)).alias("label"))


def _random_fill(users: DataFrame, pool: DataFrame, draws: int, seed: int) -> DataFrame:
    """For each user up to `draws` distinct random pool items, in drawing order, as (user_id, item_id, ord)."""
    placed = numbered(pool.select("item_id").distinct(), "_pos", "item_id")
    size = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    key = X.as_number(F.col("user_id"), dict(users.dtypes)["user_id"])
    strata = F.least(F.lit(draws).cast("bigint"), F.col("_size"))
    asked = users.withColumn("_size", size).filter("_size > 0").withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("bigint"), strata - 1)))
    asked = asked.select("user_id", X.stratum_position(F.col("j"), strata, F.col("_size"), X.draw([key, F.col("j")], seed))
                         .alias("_pos"), X.draw([key, F.col("j")], seed + 1).alias("ord"))
    return asked.join(placed, "_pos").select("user_id", "item_id", "ord")


def _filled(chosen: DataFrame, users: DataFrame, pool: DataFrame, limit: int, seed: int) -> DataFrame:
    """Chosen candidates topped up with random pool items to `limit` per user; all of the pool where it is smaller."""
    filler = _random_fill(users, pool, limit, seed).select("user_id", "item_id", F.lit(1).alias("tier"), "ord")
    own = chosen.select("user_id", "item_id").distinct()
    key = X.as_number(F.col("user_id"), dict(users.dtypes)["user_id"])
    item = X.as_number(F.col("item_id"), dict(pool.dtypes)["item_id"])
    own = own.select("user_id", "item_id", F.lit(0).alias("tier"), X.draw([key, item], seed + 2).alias("ord"))
    both = own.unionByName(filler).groupBy("user_id", "item_id").agg(F.min(F.struct("tier", "ord")).alias("o"))
    return first_n(both, ["user_id"], [F.col("o"), F.col("item_id")], limit).select("user_id", "item_id")


def _labelled(candidates: DataFrame, truth: DataFrame, inject: bool) -> DataFrame:
    """label = pair in truth; `retrieved` tells candidates from injected truth."""
    labels = truth.select("user_id", "item_id").distinct().withColumn("label", F.lit(1))
    found = candidates.withColumn("retrieved", F.lit(1))
    out = found.join(labels, ["user_id", "item_id"], "full_outer" if inject else "left")
    return out.select("user_id", "item_id", F.coalesce("label", F.lit(0)).alias("label"),
                      F.coalesce("retrieved", F.lit(0)).alias("retrieved"))


def popular_random_candidates(truth: DataFrame, pool: DataFrame, purchases: DataFrame,
                              max_per_user: int = MAX_CANDIDATES_PER_USER, popular: int = POPULAR_CANDIDATES,
                              seed: int = 42) -> DataFrame:
    """The most bought pool items for everyone, then random pool items up to the limit."""
    users = truth.select("user_id").distinct()
    best = _popular(purchases, pool, popular)
    chosen = pool_pairs(users, best.select("item_id"))
    return _labelled(_filled(chosen, users, pool, max_per_user, seed), truth, inject=False)


def _popular(purchases: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    bought = purchases.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return bought.join(pool.select("item_id"), "item_id", "left_semi").orderBy(F.desc("n"), "item_id").limit(n)


def retrieval_candidates(truth: DataFrame, pool: DataFrame, items: DataFrame, purchases: DataFrame, visits: DataFrame,
                         max_per_user: int = MAX_CANDIDATES_PER_USER, popular: int = POPULAR_CANDIDATES,
                         seed: int = 42) -> DataFrame:
    """Retrieval for truth users: own viewed items first seen first, the best of the bought genres, popular items,
    random items up to the limit, then the truth itself (retrieved = 0 where only the truth brought a row)."""
    users = truth.select("user_id").distinct()
    seen = visits.join(users, "user_id", "left_semi").join(pool.select("item_id"), "item_id", "left_semi").groupBy(
        "user_id", "item_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    viewed = first_n(seen, ["user_id"], [F.col("at"), F.col("item_id")], max_per_user // 3).select("user_id", "item_id")

    bought = purchases.join(users, "user_id", "left_semi").select("user_id", "item_id").distinct().join(
        items.select("item_id", "genre_name"), "item_id")
    genres = bought.filter(F.col("genre_name").isNotNull()).select("user_id", "genre_name").distinct()
    share = genres.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.greatest(F.lit(MIN_ITEMS_PER_GENRE), F.floor(F.lit(max_per_user) / F.col("n"))).cast("int").alias("take"))
    sold = purchases.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    placed = first_n(
        pool.select("item_id", F.coalesce("genre_name", F.lit(MISSING_GENRE)).alias("genre_name")).join(
            sold, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0))),
        ["genre_name"], [F.desc("n"), F.col("item_id")], max_per_user, "place")
    by_genre = genres.join(share, "user_id").join(placed, "genre_name").filter(F.col("place") <= F.col("take")).select(
        "user_id", "item_id")

    best = pool_pairs(users, _popular(purchases, pool, popular).select("item_id")).select("user_id", "item_id")
    chosen = viewed.unionByName(by_genre).unionByName(best)
    return _labelled(_filled(chosen, users, pool, max_per_user, seed), truth, inject=True)


def retrieval_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the truth among the retrieved candidates, injected rows not counted."""
    pairs = truth.select("user_id", "item_id").distinct()
    hits = candidates.filter("retrieved = 1").select("user_id", "item_id").distinct().withColumn("hit", F.lit(1))
    return pairs.join(hits, ["user_id", "item_id"], "left").agg(
        F.count("hit").alias("hits"), F.count(F.lit(1)).alias("truth_size"),
        (F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))


