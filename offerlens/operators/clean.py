"""Cleaning: typed columns, first row per key, referential filters, derived attributes, translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import exprs as X
from offerlens.functions.constants import MISSING
from offerlens.operators.numbering import numbered
from offerlens.sources.tables import first_row_per_key


def parse_time(df: DataFrame, columns: list[str], strict: bool = False, fmt: str | None = None) -> DataFrame:
    """Texts to timestamps; a bad text becomes null, or fails the job where `strict`."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    args = [F.lit(fmt)] if fmt and not strict else ([fmt] if fmt else [])
    return df.withColumns({c: parse(F.col(c), *args) for c in columns if c in df.columns})


def to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles: bad values become null, absent columns are added as null."""
    return df.withColumns({
        c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double") for c in columns})


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def dedupe_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key in source order."""
    return first_row_per_key(df, key, order)


def referential_filter(facts: DataFrame, users: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Facts of known users, and of known items where `items` is given."""
    out = facts.join(users.select("user_id"), "user_id", "left_semi")
    return out.join(items.select("item_id"), "item_id", "left_semi") if items is not None else out


def assign_event_id(df: DataFrame, order: str, name: str = "positive_event_id") -> DataFrame:
    """A 0-based surrogate id in source order; later filters leave gaps in it."""
    return numbered(df, name, order)


def with_age_bucket(users: DataFrame) -> DataFrame:
    return users.withColumn("age_bucket", X.age_bucket(F.col("age")))


def with_price_features(items: DataFrame) -> DataFrame:
    """Discount amount and ratio and the logs of both prices; an unknown price leaves its features null."""
    catalog, discount = F.col("catalog_price"), F.col("discount_price")
    return items.withColumns({
        "discount_amount": X.at_least_zero(catalog - discount),
        "discount_ratio": X.null_if_infinite(X.safe_ratio(discount, F.when(catalog > 0, catalog))),
        "log_catalog_price": F.log1p(X.at_least_zero(catalog)),
        "log_discount_price": F.log1p(X.at_least_zero(discount)),
    })


def with_display_days(items: DataFrame) -> DataFrame:
    return items.withColumn("display_days", X.at_least_zero(X.days_between(F.col("disp_end"), F.col("disp_from"))))


def with_calendar_parts(items: DataFrame) -> DataFrame:
    """Year, month, weekday (Monday = 0) and day of the display start."""
    start = F.col("disp_from")
    return items.withColumns({"disp_year": F.year(start), "disp_month": F.month(start),
                              "disp_weekday": F.weekday(start), "disp_day": F.dayofmonth(start)})


def with_split(items: DataFrame, split: str) -> DataFrame:
    return items.withColumn("item_split", F.lit(split))


def clean_items(items: DataFrame, split: str, order: list[Column] | None = None) -> DataFrame:
    """The whole item preparation: types, prices, display time, calendar, split tag, first row per item."""
    out = to_number(items, ["price_rate", "catalog_price", "discount_price", "disp_period", "valid_period"])
    out = parse_time(out, [c for c, t in out.dtypes if c in ("disp_from", "disp_end", "valid_from", "valid_end")
                           and t == "string"])
    out = with_split(with_calendar_parts(with_display_days(with_price_features(out))), split)
    return dedupe_first(out, ["item_id"], order or [F.col("disp_from").asc_nulls_last(), F.col("catalog_price")])


def clean_users(users: DataFrame, order: list[Column] | None = None) -> DataFrame:
    out = with_age_bucket(to_number(users, ["age"]))
    return dedupe_first(out, ["user_id"], order or [F.col("age"), F.col("sex_id"), F.col("pref_name")])


def missing_marker(df: DataFrame, markers: dict[str, str] | list[str]) -> DataFrame:
    """Null categories replaced by their marker."""
    markers = markers if isinstance(markers, dict) else {c: MISSING for c in markers}
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in markers.items()})


def translate(df: DataFrame, fields: dict[str, str], dictionary: DataFrame) -> DataFrame:
    """For each column a `<column>_en`: the dictionary's value where one exists, else the original.

    `dictionary` holds (kind, src, dst) with unique (kind, src); columns absent from the table and kinds absent from
    the mapping are simply not added.
    """
    out = df
    for column, kind in fields.items():
        if column not in df.columns:
            continue
        words = dictionary.filter(F.col("kind") == kind).select(
            F.col("src").alias("_src"), F.col("dst").alias("_dst"))
        out = (out.join(words, F.col(column) == F.col("_src"), "left")
               .withColumn(f"{column}_en", F.coalesce("_dst", column)).drop("_src", "_dst"))
    return out


def _value_counts(df: DataFrame, column: str, kind: str, dictionary: DataFrame) -> DataFrame:
    """(value, rows, dst) for every distinct non-null value: one small table answers both reports."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows"))
    words = dictionary.filter(F.col("kind") == kind).select(F.col("src").alias("value"), "dst")
    return values.join(words, "value", "left")


def translation_report(tables: dict[str, DataFrame], fields: dict[str, dict[str, str]],
                       dictionary: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """Per translated column: rows translated, rows with a value, distinct values without a translation."""
    parts = []
    for table, columns in fields.items():
        for column, kind in columns.items():
            if table not in tables or column not in tables[table].columns or (kinds is not None and kind not in kinds):
                continue
            counts = _value_counts(tables[table], column, kind, dictionary)
            parts.append(counts.agg(
                F.coalesce(F.sum(F.when(F.col("dst").isNotNull(), F.col("rows"))), F.lit(0)).alias("translated_rows"),
                F.coalesce(F.sum("rows"), F.lit(0)).alias("total_non_null"),
                F.count(F.when(F.col("dst").isNull(), 1)).alias("unmatched_unique"),
            ).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "translated_rows",
                     "total_non_null", "unmatched_unique"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unmatched_values(df: DataFrame, column: str, kind: str, dictionary: DataFrame, n: int = 10) -> DataFrame:
    """The first n distinct values without a translation, in value order."""
    counts = _value_counts(df, column, kind, dictionary)
    return counts.filter(F.col("dst").isNull()).select("value").orderBy("value").limit(n)
