import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyweft.llm import rans

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(1, 20))
def test_file_round_trip(ids, docs):
    ids = np.array(ids, np.uint32)
    cuts = np.linspace(0, len(ids), docs + 1).astype(int)
    names = [None, *range(1, docs)]
    got = rans.unpack_file(rans.pack_file(names, np.diff(cuts), ids, 301))
    assert got[0] == names and (got[1] == np.diff(cuts)).all() and (got[2] == ids).all()


def test_many_blocks_and_single_block_decoding():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 300_000).clip(1, 50_000).astype(np.uint32)
    freq = rans.frequencies(ids, 50_257)
    assert freq.sum() == 1 << rans.SCALE and (freq[np.unique(ids)] > 0).all()
    state, words, ends = rans.encode_blocks(ids, freq, rans.STEPS)
    size = rans.LANES * rans.STEPS
    alone = rans.decode_blocks(state[2:3], words, ends[2:3], freq, rans.STEPS)[0]
    assert (alone == ids[2 * size : 3 * size]).all()
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert len(words) * 32 < 1.04 * len(ids) * -(p * np.log2(p)).sum()


def test_damage_is_seen():
    content = bytearray(rans.pack_file([1], np.array([5000]), np.arange(5000, dtype=np.uint32) % 700, 700))
    content[-40] ^= 1
    with pytest.raises(ValueError):
        rans.unpack_file(bytes(content))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "The", "'s", "12", "é", "!", "\x1c", "\xa0", " x", "<|endoftext|>", "日本"]), max_size=12))
def test_pieces_encode_like_the_library(parts):
    text = "".join(parts)
    assert rans.piece_encoder(PATH).encode([text], 0)[0].tolist() == [*LIB.encode(text, add_special_tokens=False).ids, 0]


def test_files_of_documents(spark, tmp_path):
    texts = ["one two", None, "", "x" * 5000, "one two", "last one"]
    rows = [(i if i != 4 else 0, t, "extra") for i, t in enumerate(texts)] + [(None, "no id", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    rans.write_files(docs, PATH, str(tmp_path / "f"), file_tokens=4)
    got = sorted(map(tuple, rans.read_files(spark, str(tmp_path / "f"), with_ids=True).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes()), ids))
        at += len(ids)
    assert got == want
    rans.write_files(docs.limit(0), PATH, str(tmp_path / "none"))
    assert rans.read_files(spark, str(tmp_path / "none")).count() == 0


def test_query(spark):
    from skyweft.llm import queries

    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.op6_token_files(spark, sf).orderBy("doc_id").collect()]
    at = 0
    for r, d in zip(got, spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*LIB.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        assert r == (d["doc_id"], at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
