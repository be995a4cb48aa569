import types

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from offerlens.functions.constants import PAIR_FEATURES
from offerlens.operators import encode as E
from offerlens.operators import metrics as V
from offerlens.operators import models as M
from offerlens.plans import learning as L
from offerlens.sources import sinks


def test_codes_are_sorted_from_one_and_shared(make):
    users = make([("m", "東京都"), ("f", None)], "sex_id string, pref_name string")
    items = make([("b", "y", "大阪府"), ("a", None, "東京都"), ("b", "x", "京都府")], "genre_name string, capsule_text string, pref_name string")
    codes = E.entity_codes(users, items)
    got = {(r["kind"], r["value"]): r["code"] for r in codes.collect()}
    for kind, values in {"genre": "a b", "capsule": "x y", "pref": "東京都 大阪府 京都府", "sex": "f m"}.items():
        assert {v: got[kind, v] for v in values.split()} == {v: i for i, v in enumerate(sorted(values.split()), 1)}
    out = E.apply_codes(make([("a",), ("zzz",), (None,)], "g string"), codes, {"c": ("g", "genre")})
    assert rows_of(out, "c") == [(0,), (0,), (1,)]


@pytest.fixture(scope="module")
def frame(make):
    rows = [(i % 40, i, int(i % 4 == 0), i // 4, "m" if i % 8 else None, "g1" if i % 4 == 0 else "g2", float(i % 4 == 0) + (i % 5) / 10,
             None if i % 3 else float(i), None) for i in range(400)]
    return make(rows, "user_id long, item_id long, label int, positive_event_id long, sex_id string, genre_name string, "
                      "price_gap double, user_purchase_count double, empty double")


def test_preprocessor(frame):
    prep = E.fit_preprocessor(frame)
    assert prep.categorical == ["sex_id", "genre_name"] and prep.numeric == ["price_gap", "user_purchase_count", "empty"]
    assert prep.fills["empty"] == 0.0 and prep.fills["user_purchase_count"] == 199.5
    assert rows_of(prep.codes, "kind", "value", "code") == [
        ("genre_name", "g1", 1), ("genre_name", "g2", 2), ("sex_id", "__MISSING__", 1), ("sex_id", "m", 2)]
    new = frame.limit(1).withColumn("genre_name", F.lit("unseen")).withColumn("sex_id", F.lit(None).cast("string"))
    row = E.transform_numeric(new, prep).first()
    assert (row["genre_name"], row["sex_id"], row["empty"]) == (0, 1, 0.0)
    assert E.transform_raw_categories(new, prep).first()["sex_id"] == "__MISSING__"
    assert '"fills"' in E.describe_preprocessor(prep)


def test_query_key(frame):
    assert E.query_key(frame) == "positive_event_id"
    assert E.query_key(frame.withColumn("positive_event_id", F.when(F.col("item_id") > 3, F.col("positive_event_id")))) == "user_id"
    assert E.group_sizes(frame).agg(F.sum("group_size")).first()[0] == 400


@pytest.mark.parametrize("kind", M.KINDS)
def test_rankers_learn_the_separating_column(frame, spark, kind):
    ranker = M.fit_ranker(kind, frame, iterations=5, seed=1)
    means = dict(rows_of(M.score_ranker(ranker, frame).groupBy("label").agg(F.avg("score").alias("s")), "label", "s"))
    assert means[1] > means[0]
    importance = M.feature_importance(ranker, spark).collect()
    assert importance[0]["feature"] in ("price_gap", "genre_name")
    assert [r["importance"] for r in importance] == sorted((r["importance"] for r in importance), reverse=True)
    assert M.refit(ranker, frame).iterations == 5


def test_tree_count_is_that_of_a_full_fit(frame):
    truth = frame.filter("label = 1 and item_id % 3 = 0").select("user_id", "item_id")
    full = M.fit_ranker("boosted", frame, iterations=16)
    scored = None
    for n in range(1, 17):
        own = M.score_ranker(M.Ranker(full.kind, full.preprocessor, full.model, n), frame).withColumn("method", F.lit(n))
        scored = own if scored is None else scored.unionByName(own)
    quality = {r.method: round(r.map_at_k, 12) for r in V.mapk(V.evaluate(scored, truth, by=["method"]), ["method"]).orderBy("method").collect()}
    best = 0
    for n, q in quality.items():  # a walk that stops after 4 trees without gain
        best = n if not best or q > quality[best] else best
        if n - best >= 4:
            break
    stopped = M.fit_ranker("boosted", frame, frame, truth, rounds=16, patience=4)
    assert stopped.iterations == best
    for a, b in zip(stopped.model.trees, full.model.trees):
        assert (a.feature == b.feature).all() and (a.value == b.value).all() and (a.left == b.left).all()
    with pytest.raises(ValueError, match="unknown ranker"):
        M.fit_ranker("magic", frame)


def test_queries_train_for_the_rounds_of_a_full_run(frame, monkeypatch):
    asked = []
    monkeypatch.setattr(L, "training_frame", lambda *a: ("w", frame))
    monkeypatch.setattr(L, "evaluation", lambda *a: types.SimpleNamespace(frame="pool", truth="truth"))
    monkeypatch.setattr(L, "weekly_frame", lambda *a: ("w", "grid", frame, "codes"))
    monkeypatch.setattr(M, "fit_ranker", lambda *a, **k: asked.append((a[0], len(a), k)))
    monkeypatch.setattr(M, "fit_binary_gbt", lambda *a, **k: asked.append(("binary", len(a), k)))
    for kind in M.KINDS:
        L.fitted(None, None, kind)
    L.weekly_model(None, None)
    assert asked == [("boosted", 4, {}), ("lambda", 4, {}), ("pairwise", 2, {}), ("forest", 2, {}), ("binary", 2, {})]


def test_binary_trees_survive_saving(make, tmp_path):
    rows = [(i % 2, *[float((i * (j + 3)) % 7) if j else float(i % 2) * 5 for j in range(len(PAIR_FEATURES))]) for i in range(300)]
    df = make(rows, "label int, " + ", ".join(f"{c} double" for c in PAIR_FEATURES))
    codes = make([(k, str(v), v) for k in ("sex", "pref", "genre", "capsule") for v in range(1, 7)], "kind string, value string, code int")
    model = M.fit_binary_gbt(df, codes, iterations=3, min_rows=5)
    sinks.save_model(model, str(tmp_path / "model"))
    loaded = sinks.load_model(str(tmp_path / "model"))
    one, two = rows_of(M.probability(model, df), "age", "score"), rows_of(M.probability(loaded, df), "age", "score")
    assert one == two and max(s for _, s in one) > 0.5 > min(s for _, s in one)


def test_unknown_sides_add_nothing_to_factor_scores(make):
    buys = make([(u, i) for u in range(12) for i in range(8) if (u + i) % 3 == 0 for _ in range(1 + u % 2)], "user_id long, item_id long")
    model = M.fit_factorization(buys, rank=2, epochs=3)
    pairs = make([(0, 0), (0, 999), (999, 0), (999, 999)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in M.factor_scores(pairs, model).collect()}
    ub = dict(rows_of(model.users, "user_id", "user_bias"))
    ib = dict(rows_of(model.items, "item_id", "item_bias"))
    assert got[999, 999] == pytest.approx(model.mean)
    assert got[0, 999] == pytest.approx(model.mean + ub[0]) and got[999, 0] == pytest.approx(model.mean + ib[0])
    assert len(got) == 4


def test_submission_files(make, spark, tmp_path):
    template = make([(u,) for u in (3, 1, 2)], "user_id long")
    ranked = make([(1, 10, 2), (1, 11, 1), (1, 11, 3), (3, 12, 1)], "user_id long, item_id long, rank int")
    out = sinks.submission(template, ranked)
    assert rows_of(out, "user_id", "purchased_items") == [(1, "11 10"), (2, ""), (3, "12")]
    fallback = make([(7, 2), (8, 1)], "item_id long, rank int")
    assert rows_of(sinks.submission_with_fallback(template, ranked, fallback), "user_id", "purchased_items")[1] == (2, "8 7")
    sinks.write_submission(out, str(tmp_path / "s"))
    assert [r["user_id"] for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["1", "2", "3"]
    with pytest.raises(ValueError, match="no ranking"):
        sinks.require_few_missing(template, ranked.filter("user_id = 1"))
    sinks.require_few_missing(template, ranked)
    codes = make([("k", "v", 1)], "kind string, value string, code int")
    sinks.save_codes(codes, str(tmp_path / "c"))
    assert sinks.load_codes(spark, str(tmp_path / "c")).first()["code"] == 1
    sinks.write_report(codes, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
