import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from vistaset.llm import jaccard, pii, quality


def groups(df):
    j = jaccard.Join(df, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SHINGLE_PERCENT)
    return j.reached().select("component").distinct().count() + j.sets.where("n = 0").count()


def test_stages(spark, docs):
    d, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, d = d, stage(spark, d, SF)
        seen.append(d)
        if k < 4:
            assert d.columns == docs.columns
        if k in (0, 1):
            assert d.exceptAll(before).count() == 0
    good, single, masked, mixed, encoded = seen
    stats = quality.statistics_table(docs)
    model = quality.train(stats, spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.count() == quality.score_statistics(stats, model).where("predicted = 1").count()
    assert single.count() == groups(good)
    assert masked.count() == single.count()
    assert not [t for (t,) in masked.select("text").collect() if pii.base_spans(t)]
    assert encoded.select("doc_id", F.col("decoded").alias("text")).exceptAll(mixed.select("doc_id", "text")).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_of_scattered_edits_go(spark):
    base = [f"w{i}" for i in range(400)]
    edited = [f"e{i}" if i % 50 == 25 else w for i, w in enumerate(base)]
    other = [f"e{i}" if i % 20 == 10 else w for i, w in enumerate(base)]
    # similarity of the first two: 0.82 on shingles of five words, 0.89 of three; of the third, below 0.8
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((base, edited, other))], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()) == [0, 2]
    assert jaccard.keep_first(df).count() == 3


def test_near_copy_stage_keeps_one_of_each_group(spark, docs):
    single = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert single.count() == groups(docs)
    assert single.exceptAll(docs).count() == 0
