from pyspark.sql import functions as F

from cairnframe.functions.exec import once, sized
from cairnframe.plans.inventory import hash_rows


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_broadcasts_are_hinted_by_rows_and_by_length(spark, monkeypatch):
    df = spark.range(10).select(F.lpad(F.col("id").cast("string"), 50, "x").alias("t"), F.lit(None).cast("string").alias("n"))
    assert hinted(sized(df, 10)) and not hinted(sized(df, 9)) and hinted(sized(df, 10, texts=True)) and hinted(sized(df.limit(0), 0, texts=True))
    monkeypatch.setattr("cairnframe.functions.exec.BROADCAST_BYTES", 300)
    assert hinted(sized(df, 10)) and not hinted(sized(df, 10, texts=True))


def test_expressions_are_computed_once(spark):
    df = once(spark.range(5), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    plan = df.where("h > 'a' AND h < 'c' AND length(h) = 64")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
    assert sorted(r["id"] for r in df.collect()) == list(range(5))


def test_files_of_one_folder_are_hashed_in_many_tasks(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"f{i}").write_text(str(i))
    rows = spark.createDataFrame([(f"f{i}", f"f{i}", "", len(str(i)), (tmp_path / f"f{i}").stat().st_mtime_ns) for i in range(50)], "rel_path string, name string, ext string, size long, mtime_ns long").coalesce(1)
    got = hash_rows(rows, str(tmp_path)).select("state", F.spark_partition_id().alias("p")).collect()
    assert {r["state"] for r in got} == {"ok"} and len({r["p"] for r in got}) > 4
    assert len({r["p"] for r in hash_rows(rows, str(tmp_path), 1).select("state", F.spark_partition_id().alias("p")).collect()}) == 1
