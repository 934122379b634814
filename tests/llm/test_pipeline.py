"""The stages on the smallest tables."""

import corpus_pipeline
from devquarry.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_columns(spark):
    docs = corpus_pipeline.documents(spark, SF)
    extra = docs.selectExpr("*", "'x' as row", "1 as spans")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[1:]:
        extra_next = stage(spark, extra, SF)
        ids = [r.doc_id for r in extra_next.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before, name
        if name != "packing":
            assert extra_next.columns == extra.columns
            extra = corpus_pipeline.cut(extra_next, corpus_pipeline.shared_dir(spark), name)
            before = set(ids)
    assert extra.filter("n_chars <> length(text)").count() == 0


def test_empty_tables(spark):
    docs = corpus_pipeline.documents(spark, SF).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        assert found.count() == 0 and (name == "packing" or found.columns == docs.columns), name


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_stages_release_the_driver(spark):
    """Each stage after the first lets the driver's heap be collected as a whole before it begins, near_dedup in its rounds too."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = whole()
        kept = stage(spark, docs, SF).count()
        assert whole() - before >= (4 if name == "near_dedup" else 1), name
        assert kept == (2 if name in ("exact_dedup", "near_dedup") else 3), name
