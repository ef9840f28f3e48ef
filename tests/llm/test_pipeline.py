import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_substrings import brute_bytes


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        new = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert new.columns == docs.columns
        seen[name] = (docs.collect(), new.collect())
        docs = new
    names = list(seen)
    assert [n for n, _ in corpus_pipeline.STAGES] == names and len(names) == 5
    for name in names[:3]:
        before, after = ({r["doc_id"] for r in x} for x in seen[name])
        assert after < before
    before, after = seen["SimHash near-dedup"]
    assert {r["doc_id"] for r in after} == set(brute_kept([(r["doc_id"], r["text"]) for r in before]))
    before, after = seen["suffix-array dedup"]
    want = {i: n - gone for i, n, gone, *_ in brute_bytes([(r["doc_id"], r["text"]) for r in before], 200)}
    assert {r["doc_id"] for r in after} == want.keys()
    for r in after:
        if "�" not in r["text"]:
            assert len(r["text"].encode()) == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
    before, after = seen["best-fit packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
