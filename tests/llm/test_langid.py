import zlib

import numpy as np
import pytest

from skyweft.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    for t in ("", "1234 !!", "a", "É", "x" * 100_000, "日本語", "\U0001f600", "a\x00b"):
        at, tf = langid.features(t)
        assert len(at) == len(tf) and (np.diff(at) > 0).all()
    assert (langid.features("Ab  cd!")[0] == langid.features("ab 1 CD")[0]).all()


def test_elastic_net_makes_weights_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        y = k % 3
        at = np.sort(rng.choice(np.arange(100, 2000), 20, replace=False))
        rows.append((np.concatenate([[y], at]), np.concatenate([[0.9], np.full(20, 0.05)]), y))
    w = langid.train(rows, 3)
    assert (np.argmax(w[:3], axis=1) == [0, 1, 2]).all() and (w == 0).mean() > 0.9


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = 20 * (np.eye(3)[np.where(rng.random(500) < 0.7, y, (y + 1) % 3)])
    assert langid.fit_temperature(logits, y) > 5
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_held_out_accuracy_and_columns(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    hits = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"]:
            hits.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert len(hits) > 100 and np.mean(hits) > 0.95


@pytest.mark.parametrize("with_labels", [True, False])
def test_odd_rows(spark, with_labels):
    rows = [(i, t, "x", "en" if with_labels else None) for i, t in enumerate(["the cat sat on the mat"] * 4)]
    rows += [(50 + i, "der hund und die katze", "y", "de" if with_labels else None) for i in range(4)]
    rows += [(100, None, "z", "en"), (101, "123 ...", "z", None), (None, "the cat", "z", "fr"), (0, "the cat sat on the mat", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, lang string")
    model = langid.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()}
    assert {(100, "und"), (101, "und")} <= got and (None, "fr") not in got
    assert ({(1, "en"), (51, "de"), (None, "en")} <= got) == with_labels
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == (10 if with_labels else 0)
    none = docs.limit(0)
    assert langid.predict(none, langid.fit(none)).count() == 0


def test_rare_label_is_learned_beside_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 50)
    monkeypatch.setattr(langid, "MAX_ROWS", 120)
    rows = [(k * 10_000 + i, f"{c * 3} {c * 2}o {c}a{i}", c) for k, c in enumerate("bdf") for i in range(2000)]
    rows += [(90_000 + i, f"zuzu zazo zi{i}", "rare") for i in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["b", "d", "f", "rare"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert np.mean([got[d] == lang for d, _, lang in rows if lang == "rare"]) > 0.9
