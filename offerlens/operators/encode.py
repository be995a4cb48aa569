"""Ordinal codes, medians and the model matrix."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.constants import EVENT_CATEGORICAL, MISSING, NON_FEATURES
from offerlens.operators.numbering import column_medians, numbered

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def fit_codes(sources: dict[str, list[tuple[DataFrame, str | Column]]]) -> DataFrame:
    """(kind, value, code): the distinct non-null values of each kind in code-point order, numbered from 1."""
    parts = None
    for kind, columns in sources.items():
        for df, column in columns:
            value = (F.col(column) if isinstance(column, str) else column).cast("string")
            part = df.select(F.lit(kind).alias("kind"), value.alias("value")).filter("value is not null").distinct()
            parts = part if parts is None else parts.unionByName(part)
    out = numbered(parts.distinct(), "_pos", "value", ["kind"])
    return out.select("kind", "value", (F.col("_pos") + 1).cast("int").alias("code"))


def entity_codes(users: DataFrame, items: DataFrame) -> DataFrame:
    """The code table of the weekly model; users and items share the region codes."""
    return fit_codes({
        "genre": [(items, "genre_name")],
        "capsule": [(items, "capsule_text")],
        "pref": [(users, "pref_name"), (items, "pref_name")],
        "sex": [(users, "sex_id")],
    })


def apply_codes(df: DataFrame, codes: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Add code columns: `columns` maps the new name to (value column, kind); unknown and null values become 0."""
    out = df
    for name, (column, kind) in columns.items():
        lookup = codes.filter(F.col("kind") == kind).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = (out.join(lookup, F.col(column).cast("string") == F.col("_value"), "left")
               .withColumn(name, F.coalesce("_code", F.lit(0))).drop("_value", "_code"))
    return out


@dataclass(frozen=True)
class Preprocessor:
    """Codes and fill values learnt from a training frame."""

    features: list[str]
    categorical: list[str]
    numeric: list[str]
    fills: dict[str, float]
    codes: DataFrame


def feature_columns(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(features, categorical, numeric) of a frame: every column a model may see."""
    features = [c for c in df.columns if c not in NON_FEATURES]
    categorical = [c for c in EVENT_CATEGORICAL if c in features]
    return features, categorical, [c for c in features if c not in categorical]


def fit_preprocessor(train: DataFrame) -> Preprocessor:
    """Category codes (a missing value is a category) and exact medians; a column without values is filled with 0."""
    features, categorical, numeric = feature_columns(train)
    # One pass over the frame for all category columns: distinct (column, value) cells.
    cells = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value"))
                      for c in categorical])
    values = train.select(F.inline(cells)).distinct()
    codes = numbered(values, "_pos", "value", ["kind"]).select(
        "kind", "value", (F.col("_pos") + 1).cast("int").alias("code"))
    medians = column_medians(train.select(*numeric), numeric)
    return Preprocessor(features, categorical, numeric, {c: medians[c] if medians[c] is not None else 0.0
                                                         for c in numeric}, codes)


def _filled(df: DataFrame, prep: Preprocessor) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double"),
                          F.lit(float(prep.fills[c]))).cast("float") for c in prep.numeric}


def transform_numeric(df: DataFrame, prep: Preprocessor) -> DataFrame:
    """Ids and label as they are, categories as codes (unseen values 0), numbers with medians filled in."""
    kept = [c for c in df.columns if c in NON_FEATURES]
    out = df.withColumns({**_filled(df, prep), **{
        c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in prep.categorical}})
    out = apply_codes(out, prep.codes, {f"_code_{c}": (c, c) for c in prep.categorical})
    return out.select(*kept, *[F.col(f"_code_{c}").alias(c) if c in prep.categorical else F.col(c)
                               for c in prep.features])


def transform_raw_categories(df: DataFrame, prep: Preprocessor) -> DataFrame:
    """As transform_numeric, with the categories left as texts."""
    kept = [c for c in df.columns if c in NON_FEATURES]
    out = df.withColumns({**_filled(df, prep), **{
        c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in prep.categorical}})
    return out.select(*kept, *prep.features)


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="error").transform(df)


def query_key(df: DataFrame, complete: bool | None = None) -> str:
    """The ranking query of a frame: the event where every row has one, else the user."""
    if "positive_event_id" not in df.columns:
        return "user_id"
    if complete is None:
        complete = df.filter(F.col("positive_event_id").isNull()).limit(1).count() == 0
    return "positive_event_id" if complete else "user_id"


def group_sizes(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows per ranking query."""
    key = key or query_key(df)
    return df.groupBy(F.col(key).alias("query_id")).agg(F.count(F.lit(1)).alias("group_size"))


def describe_preprocessor(prep: Preprocessor) -> str:
    """The column lists and fill values as JSON, to be stored beside the code table."""
    return json.dumps({"features": prep.features, "categorical": prep.categorical, "numeric": prep.numeric,
                       "fills": prep.fills}, sort_keys=True)
