import os
import tempfile

from pyspark.sql import functions as F

from cohortlab.sources import io


def test_tsv_roundtrip_with_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="cohortlab-test-")
    p = os.path.join(d, "t.tsv")
    with open(p, "w") as f:
        f.write("id\tage\tabo\n1\t 40.5 \tA\n2\tNA\tNULL\n3\t\tB\n")
    df = io.read_tsv(spark, p, "id long, age double, abo string")
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, 40.5, "A"), (2, None, None), (3, None, "B")]
    out = os.path.join(d, "out")
    io.write_tsv(df, out, single_file=True)
    back = io.read_tsv(spark, out, "id long, age double, abo string")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_append_and_read_version(spark):
    d = tempfile.mkdtemp(prefix="cohortlab-test-")
    path = os.path.join(d, "wide")
    df = spark.createDataFrame([(1, "A"), (2, "B")], "pat_mrn_id long, abo string")
    io.append_version(df, path, "2020-04-12", "a" * 40)
    io.append_version(df.limit(1), path, "2020-04-18", "a" * 40)
    v = io.read_version(spark, path, "2020-04-18", "a" * 40)
    assert v.count() == 1
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partition" in plan.lower()
    assert io.snapshot(spark.read.parquet(path), "2020-04-12").count() == 2
    assert io.snapshot_upto(spark.read.parquet(path), "2020-04-30").count() == 3


def test_run_sql_and_literal_table(spark):
    t = io.literal_table(spark, [("A", 1188), ("B", 920)], "blood_group string, n long")
    t.createOrReplaceTempView("lit_counts")
    r = io.run_sql(spark, "SELECT SUM(n) AS s FROM IDENTIFIER(:t) WHERE n > :m", {"t": "lit_counts", "m": 1000})
    assert r.collect()[0].s == 1188


def test_bundle_and_cached(spark):
    d = tempfile.mkdtemp(prefix="cohortlab-test-")
    df = spark.createDataFrame([(1, 2.5)], "a long, b double")
    io.write_bundle({"x": df}, d)
    back = spark.read.option("sep", "\t").option("header", True).csv(os.path.join(d, "x"))
    assert back.collect()[0].b == "2.5"
    with io.cached(df.withColumn("c", F.lit(1))) as c:
        assert c.is_cached
