from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from offerlens.functions import exprs as X
from offerlens.functions.constants import TRANSLATION_FIELDS
from offerlens.operators import clean as C
from offerlens.operators import features as FE
from offerlens.operators import profile as P
from offerlens.operators.audit import validated_join
from offerlens.sources import sinks
from offerlens.sources import tables as T


def test_bad_values_become_null_and_absent_columns_appear(make):
    df = make([("2020-01-02", "12"), ("soon", "n/a"), (None, "7.5")], "t string, x string")
    out = C.to_number(C.parse_time(df, ["t"]), ["x", "y"]).collect()
    assert [r["x"] for r in out] == [12.0, None, 7.5]
    assert [r["t"] is None for r in out] == [False, True, True]
    assert all(r["y"] is None for r in out)
    with pytest.raises(Exception):
        C.parse_time(df, ["t"], strict=True).collect()


def test_age_bins_are_right_closed(make):
    df = make([(a,) for a in (19.0, 20.0, 29.0, 30.0, 59.0, 60.0, None)], "age double")
    assert [r["age_bucket"] for r in C.with_age_bucket(df).collect()] == [
        "<20", "20-29", "20-29", "30-39", "50-59", "60+", None]


def test_price_features_keep_unknown_prices_unknown(make):
    df = make([(100.0, 120.0), (None, 5.0), (0.0, 5.0), (-3.0, None)], "catalog_price double, discount_price double")
    rows = C.with_price_features(df).collect()
    assert [r["discount_amount"] for r in rows] == [0.0, None, 0.0, None]
    assert [r["discount_ratio"] for r in rows] == [1.2, None, None, None]
    assert rows[3]["log_catalog_price"] == 0.0 and rows[1]["log_catalog_price"] is None


def test_infinite_values_become_null(make):
    df = make([(float("inf"),), (float("-inf"),), (float("nan"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(X.null_if_infinite(F.col("x"))).collect()] == [None, None, None, 2.0]


def test_first_row_wins_in_source_order(make):
    df = make([(1, "late", 2), (1, "early", 1), (2, "only", 9)], "k int, v string, o int")
    assert rows_of(C.dedupe_first(df, ["k"], [F.col("o")]), "k", "v") == [(1, "early"), (2, "only")]


def test_event_ids_are_given_before_the_filter(make):
    p = make([(10, 1), (11, 99), (12, 1)], "src bigint, user_id bigint")
    kept = C.referential_filter(C.assign_event_id(p, "src"), make([(1,)], "user_id bigint"))
    assert rows_of(kept, "positive_event_id") == [(0,), (2,)]


def test_required_columns():
    class Frame:
        columns = ["a"]
    with pytest.raises(ValueError, match=r"\['b'\]"):
        T.require_columns(Frame(), {"a", "b"}, "t")


def test_joins_refuse_repeated_and_missing_keys(make):
    left, right = make([(1,), (2,)], "k int"), make([(1, "x")], "k int, v string")
    assert validated_join(left, right, ["k"]).count() == 2
    assert rows_of(validated_join(left.filter("k = 1"), right, ["k"], one_to_one=True, complete=True), "k", "v") == [(1, "x")]
    for failing, message in ((lambda: validated_join(left, right, ["k"], complete=True), "find no match"),
                             (lambda: validated_join(left, right.union(right), ["k"]), "right side repeats"),
                             (lambda: validated_join(left.union(left), right, ["k"], one_to_one=True), "left side repeats")):
        joined = failing()  # planning runs no job
        with pytest.raises(Exception, match=message):
            joined.collect()


def test_a_repeated_item_fails_where_features_are_made(make):
    users = make([(1, "f", 30, "N", "30s")], "user_id long, sex_id string, age int, pref_name string, age_bucket string")
    items = make([(7, "g", "c", "N", 1.0, 2.0, 2.0)] * 2, "item_id long, genre_name string, capsule_text string, pref_name string, price_rate double, catalog_price double, discount_price double")
    buys = make([(1, 7, datetime(2024, 1, 2), 0)], "user_id long, item_id long, ts timestamp, positive_event_id long")
    pairs = make([(1, 7, 1, 0)], "user_id long, item_id long, label int, positive_event_id long")
    bad = FE.event_time_features(pairs, users, FE.item_features(items), buys, buys)
    with pytest.raises(Exception, match="repeats"):
        bad.collect()
    good = FE.event_time_features(pairs, users, FE.item_features(items.dropDuplicates()), buys, buys)
    assert good.first()["user_purchase_count"] == 0
    template = make([(1,), (1,)], "user_id long")
    with pytest.raises(Exception, match="left side repeats"):
        sinks.submission(template, make([(1, 7, 1)], "user_id long, item_id long, rank int")).collect()


def test_csv_in_two_encodings(spark, tmp_path):
    for encoding in ("utf-8", "cp932"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes("jpn;en\n 和食 ;Japanese food\n".encode(encoding))
        assert rows_of(T.read_dictionary(spark, str(path)), "src", "dst") == [("和食", "Japanese food")]


def test_dictionary_without_its_columns(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a;b\n1;2\n")
    with pytest.raises(ValueError, match="jpn and en"):
        T.read_dictionary(spark, str(tmp_path / "d.csv"))


def test_read_table_formats(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert T.read_table(spark, str(tmp_path), "a").count() == 3
    assert T.read_table(spark, str(tmp_path), "b", ["y"]).first()["y"] == "2"
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, str(tmp_path), "c")


def test_translation_of_one_row_tables(make):
    item = [("c1", "グルメ", "和食", "東京都", "渋谷", "関東")]
    schema = "item_id string, capsule_text string, genre_name string, pref_name string, small_area_name string, large_area_name string"
    tables = {"items": make(item, schema), "target_items": make(item, schema),
              "purchases": make([("u1", "c1", "渋谷")], "user_id string, item_id string, small_area_name string"),
              "users": make([("u1", "東京都")], "user_id string, pref_name string")}
    words = make([("capsule", "グルメ", "Food"), ("genre", "和食", "Japanese food"), ("pref", "東京都", "Tokyo"),
                  ("small_area", "渋谷", "Shibuya"), ("large_area", "関東", "Kanto")], "kind string, src string, dst string")
    out = C.translate(tables["items"], TRANSLATION_FIELDS["items"], words).first()
    assert (out["capsule_text_en"], out["genre_name_en"], out["genre_name"]) == ("Food", "Japanese food", "和食")
    assert C.translate(tables["users"], TRANSLATION_FIELDS["users"], words).first()["pref_name_en"] == "Tokyo"
    report = C.translation_report(tables, TRANSLATION_FIELDS, words).collect()
    assert len(report) == 12
    assert all((r["translated_rows"], r["total_non_null"], r["unmatched_unique"]) == (1, 1, 0) for r in report)


def test_untranslated_values_stay_and_are_reported(make):
    df = make([("a",), ("b",), ("b",), (None,)], "v string")
    words = make([("k", "a", "A")], "kind string, src string, dst string")
    assert sorted(str(r["v_en"]) for r in C.translate(df, {"v": "k"}, words).collect()) == ["A", "None", "b", "b"]
    assert rows_of(C.unmatched_values(df, "v", "k", words), "value") == [("b",)]


def test_last_dictionary_entry_wins(make):
    raw = make([(1, " x ", "old"), (2, "x", " new "), (3, "y", None)], "o int, Jpn string, EN string")
    assert rows_of(T.clean_dictionary(raw, order="o"), "src", "dst") == [("x", "new")]


def test_null_profile_lists_only_columns_with_nulls(make):
    df = make([(1, None, None), (2, "x", None)], "a int, b string, c string")
    assert [(r["column_name"], r["null_count"]) for r in P.null_counts(df).collect()] == [("c", 2), ("b", 1)]
