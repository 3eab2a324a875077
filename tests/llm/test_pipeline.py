import re

import pytest

import corpus_pipeline
from tablewright.llm import bpe, decontaminate, language, rules

from . import brute


@pytest.fixture(scope="module")
def stages(spark, small, docs):
    """Documents, and what each stage returns of what the one before it returned."""
    out = [docs]
    for _, apply in corpus_pipeline.STAGES:
        made = apply(spark, out[-1], small)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def test_contract(stages, docs):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(s.columns == docs.columns for s in stages[:-1])


def test_rules_stage(stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    judged = rules.judge(rules.measure(stages[0]), rules.limits(rules.measure(stages[0]))).collect()
    assert after == {r.doc_id for r in judged if r.kept} and after < before
    for r in stages[0].collect():
        n, _, _, _, repeated = brute.rule_counts(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            assert r.doc_id not in after


def test_language_stage(stages):
    found = language.predict(stages[1], language.learn(language.learning_rows(stages[1]))).collect()
    want = {r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_COSINE}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_dedup_stage(stages):
    rows = sorted(stages[2].collect())
    sets = [brute.shingle_set(r.text) for r in rows]
    group = brute.groups(len(rows), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert {r.doc_id for r in stages[3].collect()} == {rows[g].doc_id for g in group}


def test_decontamination_stage(spark, small, stages):
    flat = lambda x: " " + " ".join(re.findall(decontaminate.WORD, x.lower())) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[3].collect() if not any(t in flat(r.text) for t in items)}
    assert {r.doc_id for r in stages[4].collect()} == want


def test_last_stage_and_run(spark, small, stages):
    import hashlib

    texts = {r.doc_id: r.text for r in stages[4].collect()}
    last = {r.doc_id: r for r in stages[5].collect()}
    assert {i: r.decoded_sha256 for i, r in last.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, last.values()))


def test_odd_and_empty_rows(spark, small, odd, none):
    for start in (odd.select(none.columns), none):
        rows = start
        for _, apply in corpus_pipeline.STAGES:
            made = apply(spark, rows, small)
            rows = spark.createDataFrame(made.collect(), made.schema)
        assert rows.count() <= 1
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, odd, small).columns == odd.columns
