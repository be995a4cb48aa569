import pytest
from conftest import rows_of

from offerlens.operators import metrics as V

PAIRS = "user_id string, item_id string"
RANKS = "user_id string, item_id string, rank int"


def ap(make, truth, predicted, k=10):
    t = make([("u", i) for i in truth], PAIRS)
    r = make([("u", i, n) for n, i in enumerate(predicted, 1)], RANKS)
    return V.per_user_ap(t, r, k).first()["ap"]


def plain_ap(truth, predicted, k):
    """The mean of the precisions at the hits, repeats left out, over the hits that were possible."""
    seen = list(dict.fromkeys(predicted))[:k]
    hits = [sum(p in truth for p in seen[:n]) / n for n, item in enumerate(seen, 1) if item in truth]
    return sum(hits) / min(len(truth), k)


@pytest.mark.parametrize(("truth", "predicted", "k"), [
    ("pqr", "zpyqxr", 10), ("pqrst", "pq", 4), ("p", "zyxwvp", 5), ("pq", "qqzqp", 3), ("pqr", "xyz", 10), ("pqrs", "srqp", 2)])
def test_ap_equals_a_plain_count(make, truth, predicted, k):
    assert ap(make, list(truth), list(predicted), k) == pytest.approx(plain_ap(truth, predicted, k))


def test_the_two_metrics_differ_on_repeats(make):
    truth = make([("u", "a"), ("u", "b")], PAIRS)
    ranked = make([("u", "a", 1), ("u", "a", 2), ("u", "b", 3)], RANKS)
    users = make([("u",), ("v",)], "user_id string")
    # Repeats keep their rank here, and the user without truth counts in the denominator.
    assert V.map_at_k_all_users(users, truth, ranked).first()["map_at_k"] == pytest.approx((1 + 2 / 3) / 2 / 2)
    # Here the repeat is removed first.
    assert V.per_user_ap(truth, ranked).first()["ap"] == 1.0


def test_cut_happens_before_and_after_repeats(make):
    truth = make([("u", "b")], PAIRS)
    ranked = make([("u", "a", 1), ("u", "a", 2), ("u", "b", 3)], RANKS)
    assert V.map_at_k_all_users(make([("u",)], "user_id string"), truth, ranked, 2).first()["map_at_k"] == 0.0
    assert V.per_user_ap(truth, ranked, 2).first()["ap"] == 0.5


def test_truth_users_without_predictions_score_zero(make):
    truth = make([("u", "a"), ("v", "a")], PAIRS)
    out = V.per_user_ap(truth, make([("u", "a", 1)], RANKS))
    assert rows_of(out, "user_id", "ap") == [("u", 1.0), ("v", 0.0)]
    assert V.mapk(out).first()["map_at_k"] == 0.5


def test_bootstrap_brackets_the_mean_and_is_reproducible(make):
    rows = [("a", f"u{i}", 0.4 if i % 2 else 0.6) for i in range(200)] + [("b", f"u{i}", 0.1) for i in range(200)]
    df = make(rows, "method string, user_id string, ap double")
    one, two = V.paired_bootstrap(df, "a", "b", 500).first(), V.paired_bootstrap(df.repartition(7), "a", "b", 500).first()
    assert one == two
    assert one["mean_ap_delta"] == pytest.approx(0.4)
    assert 0.37 < one["ci_low"] < 0.4 < one["ci_high"] < 0.43
    assert one["conclusion"] == V.BETTER
    same = V.paired_bootstrap(df.replace("b", "c", ["method"]).unionByName(
        df.filter("method = 'a'").replace("a", "b", ["method"])), "a", "b", 100).first()
    assert same["conclusion"] == V.TIED


def test_coverage_counts_truth_rows(make):
    truth = make([("u", "a"), ("v", "a"), ("v", "z")], PAIRS)
    assert V.candidate_coverage(truth, make([("a",)], "item_id string")).first()["coverage"] == pytest.approx(2 / 3)
    assert V.candidate_coverage(truth.limit(0), make([("a",)], "item_id string")).first()["coverage"] == 0.0
