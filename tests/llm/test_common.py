from tidewright.llm import common


def test_scans_are_dealt_to_all_cores(spark, sf_dir):
    scan = common.table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    few, many = scan.coalesce(1), scan.repartition(cores + 3)
    assert common.spread(few).rdd.getNumPartitions() == cores and common.spread(few).count() == scan.count()
    assert common.spread(many) is many


def test_carried_columns_have_names_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", None)], "score long, `a.b` string, _keep_0 double")
    columns, names, schema = common.keeping(df, tuple(df.columns))
    assert names == ["_keep_0", "_keep_1", "_keep_2"] and schema == "_keep_0 bigint, _keep_1 string, _keep_2 double, "
    assert tuple(df.select(*columns).first()) == (1, "a", None)
