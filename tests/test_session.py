from pathlib import Path

import pytest
from pyspark.sql import functions as F

from anomaloom.operators import vocab
from anomaloom.operators.computed import computed
from anomaloom.operators.joins import lookup_join
from anomaloom.session import in_staging, shared_folder, stage


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stage_reads_files_back(spark):
    staged = stage(spark.range(10), "numbers")
    assert staged.count() == 10
    assert all(Path(path.removeprefix("file://")).is_relative_to(shared_folder(spark)) for path in staged.inputFiles())


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_both_ways(spark, threshold, how):
    """A hot key, a missing one, copies of a row, a map inside a struct; shuffled and broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), ("c", 3)], "k string, v int").withColumn(
            "s", F.struct(F.create_map(F.lit("x"), F.col("v")).alias("m"))
        )
        table = spark.createDataFrame([("a", 10), ("b", 20)], "k string, w int")
        got = sorted(str((r["k"], r["v"], r["s"])) for r in lookup_join(df, table, ["k"], how).collect())
        wanted = {"inner": "ab", "left": "abc", "left_semi": "ab", "left_anti": "c"}[how]
        expected = sorted(str((r["k"], r["v"], r["s"])) for r in df.collect() if r["k"] in wanted)
        assert got == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_computed_column_is_evaluated_once(spark):
    df = computed(spark.range(5).withColumn("t", F.col("id").cast("string")), m=F.md5("t"))
    plan = df.where(F.length("m") > 3).where(F.col("m").contains("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_small_vocabulary_is_folded_into_the_plan(spark):
    """No JSON parsing and no join per row."""
    table = spark.createDataFrame([("<UNK>", 1), ("a", 2)], "token string, token_id int")
    rows = spark.createDataFrame([(["a", "b"],)], "tokens array<string>").repartition(2)
    plan = vocab.encode_tokens(rows, table, 4)._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "Join" not in plan


def test_plans_push_filters_and_prune(spark, sf_dir):
    from anomaloom.plans.catalog import QUERIES

    def scan(name):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        return [part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:]]

    assert scan("event_counts") == ["struct<ts:timestamp_ntz,user_id:bigint,props:string>"]
    assert scan("token_counts") == ["struct<text:string>"]
    assert scan("stratified_split")[0].count(":") == 2


def test_no_query_multiplies_tables(spark, sf_dir):
    from anomaloom.plans.catalog import QUERIES

    for name in ("classification_report", "sliding_windows", "roc_auc", "encode_sequences", "incident_record", "stratified_split", "cap_windows", "normalize", "split_class_counts"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_a_job_leaves_no_staged_folder(spark, tmp_path):
    def folders():
        return {path.name for path in Path(shared_folder(spark).removeprefix("file://")).iterdir()}

    @in_staging
    def job(session, fail):
        stage(session.range(5), "left").write.parquet(str(tmp_path / f"out{fail}"))
        if fail:
            raise ValueError("stopped")
        return session.read.parquet(str(tmp_path / "out0"))

    before = folders()
    assert job(spark, 0).count() == 5
    with pytest.raises(ValueError):
        job(spark, 1)
    assert folders() == before
