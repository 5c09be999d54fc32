from __future__ import annotations

import hashlib

from lattica.llm import fingerprints as fp


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        out[key] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.digest(fp.canonical(text)), fp.digest(fp.canonical(changed)), float(fp.canonical(text) == fp.canonical(changed)), float(fp.canonical(text) == fp.canonical(following)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, bucket int").repartition(5)


def test_against_brute_force(spark):
    rows = [(i * 7 % 1009 * 3, ["Some  Text É%d" % (i % 40), "SOME text é%d" % (i % 40), "", None, "x" * (i % 50), "\U0001f600" * 9][i % 6]) for i in range(400)]
    rows = list({k: t for k, t in rows}.items())
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.compare_edited(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_classes(spark):
    rows = [(5, "A  b"), (3, "a B "), (9, "ａ b"), (4, "c"), (8, None), (7, " ")]
    got = {r.doc_id: r.class_id for r in fp.compare_edited(table(spark, rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4, 8: 7, 7: 7}


def test_all_texts_are_compared_where_too_many_digests_repeat(spark, monkeypatch):
    monkeypatch.setattr(fp, "MOST_BROADCAST", -1)
    rows = [(5, "A  b"), (3, "a B "), (4, "c")]
    assert {r.doc_id: r.class_id for r in fp.compare_edited(table(spark, rows)).collect()} == {5: 3, 3: 3, 4: 4}


def test_colliding_digests_stay_apart(spark):
    """With a digest of one letter all texts share a bucket; classes are still those of equal canonical bytes."""
    rows = [(1, "a x"), (2, "A  x"), (3, "a y"), (4, "a y"), (5, "a z"), (6, None)]
    weak = lambda form: form[:1].decode()
    got = fp.exact_classes(table(spark, rows), fingerprint=weak).collect()
    assert sorted((r.class_id, r.fingerprint) for r in got if r.fingerprint) == [(1, "a"), (3, "a"), (5, "a")] and len({bytes(r.check) for r in got}) == len(got)
    all_ = {r.doc_id: (r.class_id, r.fingerprint) for r in fp.compare_edited(table(spark, rows), fingerprint=weak).collect()}
    assert all_ == {1: (1, "a"), 2: (1, "a"), 3: (3, "a"), 4: (3, "a"), 5: (5, "a"), 6: (6, "")}


def test_shared_and_null_keys_have_an_order(spark):
    """Rows that share a key, or have none, follow each other alike in every run and partitioning; null keys are in many ranges."""
    rows = [(i % 7 if i % 3 else None, f"text {i % 50} of {i % 11}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.edited_sha256) for r in fp.compare_edited(frame.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 600
    own = {hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest() for _, t in rows for _, f in rows}
    assert {r[3] for r in runs[0]} <= own


def test_one_none_and_repeated_rows(spark):
    one = fp.compare_edited(table(spark, [(1, "abc")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert fp.compare_edited(table(spark, [(1, "abc")]).where("doc_id > 1")).count() == 0
    again = fp.compare_edited(spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "z"), (2, "q")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_chars) for r in again) == [(0, 1), (1, 3), (1, 3), (2, 1)]
