import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.llm import catalog, decontaminate, language, licenses, quality, rules, toxicity
from tablewright.llm.texts import remainder

from . import brute


def test_rule_counts(docs, odd):
    rows = rules.measure(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.rule_counts(r.text)


def test_op3(spark, small):
    rows = catalog.op3_quality_rules(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.reasons == "") and not (r.base_failed and r.kept)


def test_sketches_merge_and_bound_the_quartiles(spark):
    values = [(i % 2, f"s{i % 3}", 100, 100 * (i + 1), i % 97, 0, 0, 10) for i in range(3000)]
    measured = spark.createDataFrame(values, "lang int, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    fine = rules.sketches(measured)
    halves = rules.sketches(measured.where("n_symbols < 40")).unionByName(rules.sketches(measured.where("n_symbols >= 40")))
    key = lambda df: sorted(map(tuple, rules.merged(df, "lang").collect()), key=str)
    assert key(fine) == key(halves)
    got = rules.fences(rules.merged(fine)).where("metric = 'word_length'").first()
    exact = sorted(100 * v[3] // v[2] for v in values)
    q1, q3 = exact[749], exact[2249]
    assert got.high == pytest.approx(q3 + rules.REACH * (q3 - q1), rel=0.05)


def test_rules_odd_rows(odd, none):
    kept = rules.keep(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {6}
    assert rules.keep(none).count() == 0


def test_decontamination(spark, small, docs):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    flat = lambda x: " " + " ".join(re.findall(decontaminate.WORD, x.lower())) + " "
    told = [(r.item_id, flat(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in told if t in flat(r.text)}
    got = {(r.doc_id, r.item_id) for r in catalog.op1_decontamination(spark, small).collect()}
    assert got == want and want
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_search_returns_all_parts_above_the_threshold(spark, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    told, parts = decontaminate.item_parts(items)
    rows = decontaminate.postings(parts).collect()
    index = decontaminate.build(rows, told.orderBy("number").collect())
    for threshold in (0.1, 0.3, 0.6):
        search = decontaminate.Search(index, threshold)
        for part in range(0, len(index.item_of), 3):
            terms = sorted({t for t in range(len(index.terms)) if part in index.parts[index.bounds[t] : index.bounds[t + 1]] or t % 17 == part % 17})
            score = Counter()
            for t in terms:
                for p, x in zip(index.parts[index.bounds[t] : index.bounds[t + 1]], index.impacts[index.bounds[t] : index.bounds[t + 1]]):
                    score[int(p)] += x
            want = {p for p, s in score.items() if s >= threshold - 1e-9}
            assert {p for p, _ in search.walk(terms)} == want


def test_decontamination_long_split_and_changed_items(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(400))
    items = spark.createDataFrame([(1, "What is the name of the red river town? It is Zum Beispiel."), (2, long), (3, None), (4, ""), (5, "yes")], "item_id long, text string")
    text = [
        (1, "before " * 90 + "WHAT is the name, of the red river town?\nIt is zum beispiel." + " after" * 50), (2, long + " end"),
        (3, "what is the name of the town"), (4, None), (5, "oh yes it is"), (6, "red river town the name is Zum of what Beispiel It the is"),
    ]
    docs = spark.createDataFrame([(*t, 1.0) for t in text], "doc_id long, text string, score double")
    want = {(1, 1), (2, 2), (5, 5)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == want
    monkeypatch.setattr(decontaminate, "INDEX_PARTS", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == want
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), items).count() == 0


def test_licenses(spark, docs, odd):
    more = spark.createDataFrame(
        [
            (50, "CC-BY cc by cc by-cc.by all rights  reserved general public license", 0), (50, "all rights reserved", 0), (51, "cc", 0),
            (52, "x Permission is granted free of charge to any person obtaining a copy of this software and its associated documentation files y", 0),
            (53, "licensed under the GNU Lesser General Public License", 0), (54, "permission " * 500, 0),
        ],
        "doc_id long, text string, score int",
    )
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more.select("doc_id", "text"))
    rows = licenses.summary(every).collect()
    want = Counter((r.doc_id, *brute.phrases(r.text, licenses.PHRASES)) for r in every.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[52] == "mit" and labels[53] == "gpl,lgpl" and labels[54] == ""
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert licenses.summary(docs.limit(0)).count() == 0


def test_short_notices_with_a_word_put_in_or_left_out(spark):
    texts = [
        ("licensed under a CC BY-NC 4.0", "cc-by,cc-by-nc"), ("licensed under Apache License version 2.0", "apache-2.0"),
        ("Licensed under the CC BY SA, 4.0", "cc-by,cc-by-sa"), ("licensed under the new Apache License, version 2.0", "apache-2.0"),
        ("licensed under nothing at all, cc", ""), ("licensed under the terms, the license version", ""),
        # pairs of everyday words all around
        ("of the " * 40 + "this source code form is subject to the terms of the mozilla public license " + "of the " * 40, "mpl-2.0"),
        # one notice after the other
        ("licensed under the apache license version 2 0 " * 20, "apache-2.0"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.summary(docs).collect()} == {i: labels for i, (_, labels) in enumerate(texts)}
    spans = [r for r in licenses.scan(docs).where("doc_id = 7 and not fixed").collect()]
    assert sorted(r.start for r in spans) == [8 * k for k in range(20)] and {r.score for r in spans} == {1.0}


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    rows = catalog.op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd, none, docs):
    profiles = language.learn(language.learning_rows(docs))
    found = {r.doc_id: r for r in language.predict(odd, profiles).collect()}
    assert [found[i].lang_pred for i in (None, 1, 2, 7)] == ["und"] * 4 and found[5].lang_pred in profiles.names
    empty = language.learn(none)
    assert empty.names == [] and {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}


def test_language_vectors_are_sums_of_products():
    import numpy as np
    import pyarrow as pa

    signs = np.random.default_rng(language.SEED).integers(0, 2, (language.LETTERS, language.DIMENSIONS), dtype=np.int8) * 2 - 1
    text, total = "The the,\ncat", np.zeros(language.DIMENSIONS)
    for word in ("the", "the", "cat"):
        s = [0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            total += np.roll(signs[a], 2).astype(int) * np.roll(signs[b], 1) * signs[c]
    run, times, _ = language.runs(pa.array([text]))
    assert np.array_equal(language.bundle(run, times), total)


@pytest.mark.parametrize("module, label, floor", [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
def test_classifiers(spark, module, label, floor):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.judge(docs, module.learn(docs, labels)).join(labels, "doc_id").where(remainder(F.col("doc_id"), module.HELD_OUT[0]) == module.HELD_OUT[1])
    got = rows.select(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > floor and 0 <= got[1] and got[2] <= 1


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Over many shards, from long texts too, and the same again."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 60_000)
    seen, kept = [], toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda shards, *rest: seen.append(shards.select(F.explode("rows.doc_id").alias("d"), "shard").collect()) or kept(shards, *rest))
    long = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.repeat(F.concat("text", F.lit(" ")), 40)).otherwise(F.col("text")))
    models = [toxicity.learn(d, labels) for d in (docs, docs, long)]
    told = labels.where((remainder(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull()).join(docs, "doc_id").select("doc_id").distinct()
    wanted = {r.doc_id for r in told.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(toxicity.APART)) != 0).collect()}
    assert all({r.d for r in rows} == wanted for rows in seen) and len({r.shard for r in seen[0]}) > 1
    assert (models[0].embeddings == models[1].embeddings).all() and models[0].thresholds == models[1].thresholds


def test_scores_know_no_language_or_label(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    for module, label, (by, rest) in ((quality, "quality", quality.HELD_OUT), (toxicity, "toxic", toxicity.HELD_OUT)):
        flipped = labels.withColumn(label, F.when(remainder(F.col("doc_id"), by) == rest, 1 - F.col(label)).otherwise(F.col(label)))
        one = {r.doc_id: r.score for r in module.judge(docs, module.learn(docs, labels)).collect()}
        two = {r.doc_id: r.score for r in module.judge(other, module.learn(other, flipped)).collect()}
        assert one == two


def test_classifiers_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, 0), (5, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for told in (labels, labels.limit(0), labels.where("doc_id = 1")):
            rows = module.judge(odd, module.learn(odd, told)).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert module.judge(none, module.learn(none, labels)).count() == 0


def test_factorisation_is_the_sum_over_pairs():
    import numpy as np

    random = np.random.default_rng(1)
    model = quality.Model(0.3, random.normal(size=12), random.normal(size=(12, quality.RANK)))
    number, value = np.array([1, 4, 7, 11, 2]), random.normal(size=5)
    pairs = sum(model.factors[number[i]] @ model.factors[number[j]] * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    want = 0.3 + (model.weight[number[:4]] * value[:4]).sum() + pairs
    got = model.margin(number, value, np.array([0, 4, 5]))
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(0.3 + model.weight[2] * value[4])
