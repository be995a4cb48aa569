"""Both whole runs on the smallest tables."""

from pathlib import Path

import pytest

from offerlens.plans import jobs
from offerlens.sources.views import world

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_weekly_run(spark, tmp_path):
    w = world(spark, FOLDER)
    run = jobs.weekly_run(w, trees=3, factor_epochs=2)
    report = run.report.first()
    assert (report["train_weeks"], report["final_train_weeks"]) == (3, 4)
    assert set(report["map_at_10"]) == {"popularity", "rules", "boosted_trees", "factorization"}
    assert 0 < report["train_positive_rows"] < report["final_positive_rows"]
    jobs.write_weekly_run(run, w.template, str(tmp_path))
    for method in ("popularity", "rules", "boosted_trees"):
        out = spark.read.option("header", True).csv(f"{tmp_path}/submission_{method}").collect()
        assert len(out) == 150 and all(len(r["purchased_items"].split()) == 10 for r in out)


def test_event_run(spark):
    w = world(spark, FOLDER)
    run = jobs.event_run(w, kinds=("pairwise",), repeats=50)
    assert run.best == "pairwise" and run.checks.count() == 10
    maps = [r["map_at_k"] for r in run.comparison.collect()]
    assert len(maps) == 3 and maps == sorted(maps, reverse=True)
    assert [i.first()["reference"] for i in run.intervals] == ["pairwise"] * 2
    assert run.submission.count() == 150
