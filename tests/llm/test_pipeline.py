"""The pipeline, stage by stage, against what each stage promises."""

import hashlib

import corpus_pipeline
from brightweir.llm import decontaminate, pii, simhash, toxicity
from brightweir.llm.common import saved, table

from .test_bpe import LIBRARY


def test_stages_call_the_operators_on_all_that_is_left(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    docs = table(spark, sf_dir, "documents")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], sf_dir), f"test-{name}"))
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert all(t.columns == columns for t in tables[:-1])
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4] == ids[5]
    assert tables[1].count() == len(ids[1])

    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    assert ids[1] == {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(tables[1]).collect()}
    assert ids[2] == set(groups.values()) and set(groups) == ids[1]
    copies = {}
    for r in tables[2].collect():
        assert r["text"] not in copies
        copies[r["text"]] = r["doc_id"]
    leaks = {r["doc_id"] for r in decontaminate.contaminated(tables[2], table(spark, sf_dir, "benchmark")).collect()}
    assert ids[3] == ids[2] - leaks
    before = {r["doc_id"]: r for r in tables[3].collect()}
    found = {r["doc_id"]: r["pii_entities"] for r in pii.replace(tables[3], "k").collect()}
    texts = {r["doc_id"]: r["text"] for r in tables[4].collect()}
    assert sum(found.values()) > 0
    assert all((texts[i] != before[i]["text"]) == (n > 0) for i, n in found.items())
    for r in tables[5].collect():
        assert r["n_tokens"] == len(LIBRARY.encode_ordinary(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_no_documents_and_nulls(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), sf_dir)
        assert out.count() == 0, name
    nulls = docs.limit(1).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in docs.dtypes])
    for _, stage in corpus_pipeline.STAGES:
        nulls = saved(stage(spark, nulls, sf_dir), "test-nulls")
    assert nulls.count() == 1
