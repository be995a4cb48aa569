"""Readers: typed tables, delimited files with an encoding fallback, dictionaries and nested requests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

REPLACEMENT = "�"

# The contract of each table: the columns a job may rely on.
REQUIRED_COLUMNS = {
    "users": {"user_id", "sex_id", "age", "pref_name"},
    "items": {"item_id", "genre_name", "capsule_text", "price_rate", "catalog_price", "discount_price", "disp_from",
              "disp_end", "pref_name"},
    "target_items": {"item_id", "genre_name", "capsule_text", "price_rate", "catalog_price", "discount_price",
                     "disp_from", "disp_end", "pref_name"},
    "purchases": {"user_id", "item_id", "ts"},
    "visits": {"user_id", "item_id", "ts"},
    "template": {"user_id"},
}

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("top_k", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("customer_profile", T.StructType([
        T.StructField("age", T.DoubleType()),
        T.StructField("sex_id", T.StringType()),
        T.StructField("pref_name", T.StringType()),
    ])),
    T.StructField("customer_history", T.StructType([
        T.StructField("purchases", T.ArrayType(T.StructType([
            T.StructField("genre_name", T.StringType()),
            T.StructField("activity_id", T.StringType()),
            T.StructField("coupon_id", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("discount_price", T.DoubleType()),
            T.StructField("date", T.TimestampType()),
        ]))),
        T.StructField("visits", T.ArrayType(T.StructType([
            T.StructField("genre_name", T.StringType()),
            T.StructField("count", T.LongType()),
        ]))),
    ])),
    T.StructField("activities", T.ArrayType(T.StructType([
        T.StructField("activity_id", T.StringType()),
        T.StructField("coupon_id", T.StringType()),
        T.StructField("genre_name", T.StringType()),
        T.StructField("capsule_text", T.StringType()),
        T.StructField("price_rate", T.DoubleType()),
        T.StructField("catalog_price", T.DoubleType()),
        T.StructField("discount_price", T.DoubleType()),
        T.StructField("pref_name", T.StringType()),
        T.StructField("available", T.BooleanType()),
        T.StructField("active_from", T.TimestampType()),
        T.StructField("active_until", T.TimestampType()),
    ]))),
    T.StructField("candidate_ids", T.ArrayType(T.StringType())),
])


def read_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Table `name` below `root`: parquet where present, else CSV with a header; raises where neither exists."""
    try:
        df = spark.read.parquet(f"{root}/{name}.parquet")
    except AnalysisException:
        try:
            reader = spark.read.option("header", True)
            df = (reader.schema(schema) if schema is not None else reader).csv(f"{root}/{name}.csv")
        except AnalysisException as exc:
            raise FileNotFoundError(f"no table {name!r} (.parquet or .csv) below {root}") from exc
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",",
             encodings: tuple[str, ...] = ("UTF-8", "MS932")) -> DataFrame:
    """CSV with a header, in the first encoding that decodes every line.

    Spark replaces undecodable bytes instead of raising, so a line holding the replacement character rejects an
    encoding.  The last encoding is taken without a test, hence clean input of the first one costs one extra scan.
    """
    chosen = encodings[-1]
    for encoding in encodings[:-1]:
        lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\x01").csv(path)
        if lines.filter(F.col(lines.columns[0]).contains(REPLACEMENT)).limit(1).count() == 0:
            chosen = encoding
            break
    reader = spark.read.option("header", True).option("encoding", chosen).option("sep", sep)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def clean_dictionary(df: DataFrame, kind: str | None = None, order: str | Column | None = None) -> DataFrame:
    """(src, dst) pairs stripped of blanks, without nulls; of repeated sources the last in `order` wins."""
    names = {c.strip().lower(): c for c in df.columns}
    if not {"jpn", "en"} <= set(names):
        raise ValueError(f"a dictionary needs the columns jpn and en, found {df.columns}")
    order = F.col(order) if isinstance(order, str) else order
    pairs = df.select(
        F.trim(F.col(names["jpn"])).alias("src"),
        F.trim(F.col(names["en"])).alias("dst"),
        (order if order is not None else F.monotonically_increasing_id()).alias("_order"),
    ).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    out = pairs.groupBy("src").agg(F.max_by("dst", "_order").alias("dst"))
    return out.select(F.lit(kind).alias("kind"), "src", "dst") if kind else out


def read_dictionary(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A two-column dictionary file; the delimiter is the first of ; , tab that yields both columns."""
    for sep in (";", ",", "\t"):
        df = read_csv(spark, path, sep=sep)
        if {"jpn", "en"} <= {c.strip().lower() for c in df.columns}:
            return clean_dictionary(df, kind)
    raise ValueError(f"{path}: a dictionary needs the columns jpn and en")


def require_columns(df: DataFrame, required: set[str], name: str = "table") -> DataFrame:
    """The same frame, or an error naming the missing columns; checked on the plan, before any job."""
    missing = sorted(required - set(df.columns))
    if missing:
        raise ValueError(f"{name} misses the columns {missing}")
    return df


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recommendation requests from JSON lines: (well-formed, rejects with the raw line)."""
    schema = T.StructType(REQUEST_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.text(path).select(
        "value", F.from_json("value", schema, {"mode": "PERMISSIVE",
                                              "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    # from_json yields a null record column set for lines that are no JSON object.
    good = raw.filter(F.col("r._corrupt_record").isNull() & F.col("r").isNotNull())
    bad = raw.filter(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull())
    return (good.select(*[F.col(f"r.{f.name}") for f in REQUEST_SCHEMA.fields]),
            bad.select(F.col("value").alias("line"), F.lit("malformed JSON").alias("error")))


def first_row_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in `order`; Spark keeps one row per key in each task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
