"""The stages one after another, each judged on its own input."""

import corpus_pipeline
import pytest
from llm_helpers import frame
from test_near_dups import brute

import __spark_entry__ as driver
from wildtally.llm import decontamination, pii, toxicity
from wildtally.llm.tables import written

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        given, docs = docs, written(stage(spark, docs, FOLDER), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.fit(given, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert set(after) == {r.doc_id for r in toxicity.score(given, model).collect() if not r.predicted} < set(before)
        if name == "near_dedup":
            assert set(after) == {d for d, (_, _, kept) in brute([(d, r.text) for d, r in before.items()]).items() if kept} < set(before)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert {d for d, r in before.items() if any(i in r.text for i in items)} == set(before) - set(after)
        if name == "pii":
            assert set(before) == set(after)
            assert all(r.text == pii.redacted(before[d].text, pii.plain(before[d].text)) and r.n_chars == len(r.text) for d, r in after.items())
        if name != "sentencepiece":
            assert docs.columns == given.columns and all(after[d] == before[d] for d in after if name != "pii")
        names.append(name)
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "sentencepiece"]
    whole = {r.doc_id: r.ids_sha256 for r in driver.queries()["pipeline"](spark, FOLDER).collect()}
    assert whole == {d: r.ids_sha256 for d, r in after.items()}


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "near_dedup"], ids=lambda s: s[0])
def test_empty(spark, stage):
    assert stage[1](spark, frame(spark, []), FOLDER).collect() == []


def test_registered():
    assert {q.split("_")[0] for q in driver.queries() if q.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert decontamination.leaks and "pipeline" in driver.queries()
