import corpus_pipeline as pipeline
from ledgerloom.llm import decontaminate, jaccard_join, quality
from tests.oracle import DATA


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.select("doc_id").distinct().count())
        if i < 4:
            assert docs.columns == columns, name
        if i == 0:
            bad = labels.filter("quality = 0").join(docs, "doc_id", "left_semi").count()
            good = labels.filter("quality = 1").join(docs, "doc_id", "left_anti").count()
            assert bad <= 1 and good <= 1
            scores = quality.score(before, quality.training(labels))
            assert scores.filter("score >= 0.5").count() == docs.count()
        if i == 1:
            assert docs.filter("n_chars <> length(text)").count() == 0
        if i == 2:
            components = jaccard_join.components(before)
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in components.collect()}
        if i == 3:
            found = decontaminate.decontaminate(before, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert found.filter(decontaminate.contaminated()).count() == before.count() - docs.count() > 0
        if i == 4:
            assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
            assert kept[4] == kept[3]


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Null, empty, repeated and very long rows, rows without an id, and extra columns whose names the operators use."""
    sample = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = [(None, None, None, None, None), (9001, "", "en", "a", 0), (9002, "word and " * 600_000, "en", "a", 5_400_000), (None, sample[0][1], "en", "a", 1), sample[1], sample[1]]
    rows = [(*r, "x", 1, "y") for r in sample + odd]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_hit int, stats string"
    docs = whole = spark.createDataFrame(rows, schema).repartition(4)
    for i, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == whole.columns, name
            assert docs.filter("n_lines <> 'x' OR n_hit <> 1 OR stats <> 'y'").count() == 0
        if i == 2:
            assert docs.filter(docs.text == sample[1][1]).count() <= 1
    assert docs.count() > 0
    none = whole.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
