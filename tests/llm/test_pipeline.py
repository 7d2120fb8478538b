import corpus_pipeline
from codeloom.llm.toxicity import op2_toxicity

from .test_decontamination import brute as contaminated
from .test_minhash import brute as duplicates


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    out = stages["toxicity"](spark, docs, data)
    assert out.columns == docs.columns
    rejected = {r["doc_id"] for r in op2_toxicity(spark, data).collect() if r["predicted"]}
    assert {r["doc_id"] for r in out.collect()} == rows.keys() - rejected
    out = stages["near_duplicates"](spark, docs, data)
    assert out.columns == docs.columns
    left = {d for d, _, _, kept in duplicates(list(rows.items()), 80) if kept}  # stages take a similarity of 0.8 or more
    assert {r["doc_id"] for r in out.collect()} == left
    out = stages["decontamination"](spark, docs, data)
    assert out.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert {str(r["doc_id"]) for r in out.collect()} == {d for d, *_, hit in contaminated(list(rows.items()), items) if not hit}


def test_a_document_that_repeats_an_id_stays(spark, data):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(1, texts[0]), (2, texts[0] + " more"), (2, texts[1]), (3, texts[2]), (3, texts[2])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, text_hash string")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, data)
    assert sorted(tuple(r[:2]) for r in out.collect()) == sorted([rows[0], *rows[2:]]) and out.columns == docs.columns


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50


def test_odd_documents_pass_every_stage(spark, data):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, data)
        assert out.columns == odd.columns and out.count() == 5
        assert stage(spark, odd.limit(0), data).count() == 0
