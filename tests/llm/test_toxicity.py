from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import queries
from lattica.llm import toxicity as tox


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "the", "ion", "re", "ou", "st", "li", "da", "mo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 300))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(["zorgsnib", "blivvox", "qwenkle"]) + rng.choice(["", "s", "ed", "ish", "er"])
        rows.append((i, " ".join(w), toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t, _ in rows] + [(5000, None, "en", "s", 0.1), (5001, "", "en", "s", 0.1)], "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 0, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, tox.fit(docs, labels)


def test_held_out_accuracy(tables):
    rows, docs, _, model = tables
    score = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    held = [(score[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200
    caught = [s >= tox.THRESHOLD for s, y in held if y]
    wrong = [s >= tox.THRESHOLD for s, y in held if not y]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.01
    assert all(0 <= s <= 1 for s in score.values()) and score[5000] == score[5001] < tox.THRESHOLD


def test_unseen_spellings_and_long_texts(spark, tables):
    _, _, _, model = tables
    calm = "the ion re stli " * 2000
    docs = spark.createDataFrame([(1, calm), (2, calm + "zorgsnibbly blivvoxed qwenkler " + calm), (3, "zorgsnibz blivvoxxx")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    assert score[1] < 0.5 and score[2] > 0.5 and score[3] > 0.7


def test_held_out_labels_are_not_seen(tables):
    _, docs, labels, model = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tox.fit(docs, flipped)
    assert (again.gram == model.gram).all() and again.bias == model.bias


def test_one_class_or_no_labels(spark, tables):
    _, docs, labels, _ = tables
    assert max(r.score for r in tox.score(docs, tox.fit(docs, labels.where("toxic = 0"))).collect()) < 1e-6
    assert max(r.score for r in tox.score(docs, tox.fit(docs, labels.where("toxic > 5"))).collect()) < 1e-6
    assert min(r.score for r in tox.score(docs, tox.fit(docs, labels.where("toxic = 1"))).collect()) > 0.99
    assert tox.score(docs.where("doc_id < 0"), tox.train([], np.empty(0))).count() == 0


def test_keep_clean_keeps_columns(tables):
    rows, docs, _, model = tables
    score = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    kept = tox.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s < tox.THRESHOLD}


def test_grams():
    flat, starts = tox.grams(["ab", "a", "abcdef"])
    assert list(np.diff(starts)) == [2 + 1, 1, 6 + 5 + 4 + 3]
    assert tox.grams([])[1].tolist() == [0]
    assert (tox.grams(["ab"])[0] == flat[:3]).all()
    assert tox.worst_window(np.empty(0)) == 0 and tox.worst_window(np.array([1.0, 3.0])) == 2


def test_a_new_spelling_scores_by_the_ngrams_it_shares(tables):
    """No list of words: the vector of an unseen spelling is the mean over its n-grams, and those it shares carry it."""
    rows, _, _, model = tables
    seen = {w for _, t, _ in rows for w in tox.words(t)}
    new, far = "zorgsnibqu", "kkjjwwffpp"
    assert new not in seen and far not in seen
    shared = set(tox.grams(["zorgsnib"])[0].tolist())
    mine = tox.grams([new])[0]
    of_shared = model.gram[[g for g in mine if g in shared]].sum()
    assert model.of_words([new])[0] == pytest.approx(model.gram[mine].mean(), rel=1e-5)
    assert of_shared > 0.9 * model.gram[mine].sum() > 0 and model.of_words([new])[0] > 5 * abs(model.of_words([far])[0])
    assert (model.gram[tox.grams(sorted(seen))[0]] != 0).mean() > 0.99  # every n-gram that was seen is trained


def test_copies_of_a_key_cannot_empty_a_class(spark, tables):
    _, docs, labels, model = tables
    key = next(r.doc_id for r in labels.where("toxic = 0").orderBy("doc_id").collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    one = docs.where(f"doc_id = {key}")
    many = docs.unionByName(spark.range(6000).crossJoin(one).select(docs.columns))
    again = tox.fit(many, labels, per_class=500)
    same = tox.fit(docs, labels, per_class=500)
    assert (again.gram == same.gram).all() and again.bias == same.bias


def test_labelled_texts_without_words(spark, tmp_path):
    """A fit that finds no word, in one class or in both, gives defined scores, through op6 and the pipeline too."""
    for texts, labels in ((["", "!"], [0, 1]), ([None, ""], [0, 1]), (["...", "a bad word"], [0, 1]), (["good words", None], [0, 1]), (["?"] * 3 + ["!"], [0, 0, 0, 1])):
        got = tox._Scorer(tox.train(texts, np.array(labels)))(["", None, "a bad word", "good"])
        assert ((got >= 0) & (got <= 1)).all() and got[0] == got[1]
    assert tox._Scorer(tox.train(["", "!"], np.array([0, 1])))(["x"])[0] == 0.5
    half = tox.train([f"{'!' * i}" for i in range(1, 130)] + [f"{'?' * i}" for i in range(1, 130)], np.array([0] * 129 + [1] * 129))  # calibrated
    assert 0 < tox._Scorer(half)(["x"])[0] < 1
    seen = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, "!?"[i % 2] * (i // 2) or None, "en", "a", 1) for i in range(40)] + [(99, "some words of a text", "en", "a", 20)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, n % 2) for n, i in enumerate(seen)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 41 and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert 99 in {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
