import pytest
from pyspark.sql import functions as F

from cairnframe.plans.api import Browser, listed, summary_text
from cairnframe.plans.store import Store
from tests.test_compare import BASE_A, BASE_B


@pytest.fixture(scope="module")
def browser(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("api")))
    for machine, rows in (("machine-a", BASE_A), ("machine-b", BASE_B), ("s3", [("identical.txt", 100, "aaa111"), ("different.txt", 999, "zzz"), ("s3-only.txt", 123, "q")])):
        n = store.create_scan(machine, "host-" + machine[-1], "/data/photos")
        df = spark.createDataFrame(rows, "rel_path string, size long, sha256 string").withColumns({"name": F.col("rel_path"), "ext": F.lit(".txt"), "mtime_ns": F.lit(0), "state": F.lit("ok")})
        store.write_entries(n, df)
        store.publish(n)
    return Browser(store)


A, B = ("machine-a", "/data/photos"), ("machine-b", "/data/photos")


def test_by_path(browser):
    j = browser.compare(A, B).to_json()
    assert j["identical_count"] == 3
    assert [x["rel_path"] for x in j["left_only"]] == ["left-only.txt", "sub/only-a.txt"]
    assert [x["rel_path"] for x in j["right_only_compact"]] == ["right-only.txt", "sub/only-b.txt"]
    assert j["different"] == [{"rel_path": "different.txt", "left": {"size": 300, "sha256": "ccc333"}, "right": {"size": 500, "sha256": "eee555"}}]
    assert browser.compare(A, A).to_json()["identical_count"] == 6
    s3 = browser.compare(A, ("s3", "/data/photos")).to_json()
    assert (s3["identical_count"], len(s3["different"]), [x["rel_path"] for x in s3["right_only"]]) == (1, 1, ["s3-only.txt"])


def test_by_content(browser):
    j = browser.compare(A, B, mode="content").to_json()
    assert (j["identical_count"], len(j["left_only"]), len(j["right_only"]), j["different"], j["left_only_compact"]) == (3, 3, 3, [], [])
    j = browser.compare(A, B, "sub", mode="content").to_json()
    assert (j["identical_count"], len(j["left_only"])) == (2, 1)
    with pytest.raises(ValueError):
        browser.compare(A, B, mode="x")


def test_browsing(browser):
    assert [r["dir"] for r in browser.directories(*A).collect()] == ["sub", "sub/deep"]
    assert [r["hostname"] for r in browser.roots()] == ["host-3", "host-a", "host-b"]
    assert browser.summary(*A)["states"] == {"ok": 6} and browser.duplicates(*A).count() == 0
    with pytest.raises(LookupError):
        browser.entries("machine-z", "/data/photos")
    with pytest.raises(ValueError):
        browser.entries("", "/x")
    with pytest.raises(OverflowError):
        listed(browser.entries(*A), 3)
    assert summary_text("scan 3", {"b": 2000, "a": 1}) == "scan 3: a=1, b=2,000"


def test_one_scan_is_pruned(browser):
    plan = browser.entries(*A).where(F.col("rel_path").startswith("sub/"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan and plan.count("scan_id=") >= 1
