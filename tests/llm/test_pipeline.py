import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_pass_documents_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        docs = out
    assert sizes[1] > 0.95 * sizes[0]
    assert sizes[2] < sizes[1]
    assert sizes[3] == sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.count() == docs.count()
    assert packed.filter(F.col("padding") < 0).count() == 0


def test_columns_of_any_name_pass_through(spark, sf_dir):
    """Extra columns with the names of the stages' own results."""
    names = ["score", "lang_pred", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "component_id", "kept", "key", "mark", "size", "copies", "taken", "target", "bucket", "_score"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns[-len(names) :] == names, name
        assert docs.filter(" OR ".join(f"`{n}` <> concat('{n} of ', doc_id)" for n in names)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registered(spark):
    from tidewright.llm import catalog

    names = list(catalog.queries())
    assert [n for n in names if n != "pipeline"] == sorted((n for n in names if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0]))
    assert set(catalog.oracles()) <= set(names) and len(corpus_pipeline.STAGES) == 5
