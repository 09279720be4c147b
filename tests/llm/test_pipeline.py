"""The stages against brute force, each on its own input."""

import hashlib
from array import array

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r["doc_id"]: r for r in docs.collect()}]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number < 4:
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append({r["doc_id"]: r for r in docs.collect()})
    start, identified, single, clean, private, coded = seen
    # Language: only documents without letters or with a low score may go.
    assert len(identified) >= 0.97 * len(start)
    assert len({r["text"] for r in single.values()}) == len(single)
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = {d: " ".join(r["text"].split()) for d, r in single.items()}
    held = {d for d, t in flat.items() if any(" ".join(b.split()) in t for b in bench)}
    assert not held & set(clean) and held <= set(single)
    assert set(private) == set(clean)
    assert all("@mail" not in r["text"] for r in private.values())
    assert all(r["n_chars"] == len(r["text"]) for r in private.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(coded) == set(private)
    for d, r in coded.items():
        ids = library.encode(private[d]["text"], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_and_empty_input(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "12 34", "en", "s", 5), (None, "the text of it", "en", "s", 9), (5, "the text of it", None, "s", 9), (5, "the text of it", None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, frame in enumerate((docs, docs.limit(0))):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, frame, SF).write.parquet(str(tmp_path / f"{k}-{number}"))
            assert (spark.read.parquet(str(tmp_path / f"{k}-{number}")).count() == 0) or k == 0


def test_stages_bound_the_rows_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    try:
        for given, held in ((10000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (100, 100)):
            spark.conf.set(key, given)
            corpus_pipeline.token_ids(spark, docs, "")
            assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)
