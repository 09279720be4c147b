import hashlib
import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from skyweft.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)

HARD = [
    "", " ", "\n\t ", "Hello, World!", "don't we'll I'd 've 'S 'T", "a<|endoftext|>b <|startoftext|><|endoftext|>",
    "İstanbul ΣΊΣΥΦΟΣ ΣΑΣ", "é café ẛ̣", "a\x1cb\x1d c\x85d e　f", "²½Ⅷ١٢ 1234",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "thththththth ananananan", "😀😀 👩‍👩‍👧", "\x00\x01", "x" * 30_000, "ab" * 9_000 + "!" * 5_000,
    "<|endoftext", "<|ENDOFTEXT|>", "日本語のテキスト 中文", "ñandú über straße ﬁ ǅ",
]


def samples():
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkqjxz"
    out = ["".join(rng.choice(letters[: rng.choice((3, 8, 26))]) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    return [" ".join(out[i : i + 20]) for i in range(0, len(out), 20)]


def test_same_ids_and_text_as_library():
    own = bpe.WordBpe(PATH)
    texts = HARD + samples()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = LIB.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:40]
        assert own.decode(ids) == LIB.decode(want, skip_special_tokens=False)


def test_pair_check_agrees_with_exact_merging():
    own = bpe.WordBpe(PATH)
    words = [w + "\n" for w in " ".join(samples()).split()]
    for word, tokens in zip(words, own.encode_words(words), strict=True):
        assert tokens == own.merge(word)


def test_rows_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (1, "Hi there", "y"), (None, "Hi there", "z"), (2, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(docs, PATH, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 0), (1, 2), (2, 0)]
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(array("I", r["ids"]).tobytes()).hexdigest()
        assert r["decoded"] == LIB.decode(list(r["ids"]), skip_special_tokens=False)
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_query_matches_library(spark):
    from skyweft.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op2_bpe_encode_decode(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIB.encode(d["text"] or "", add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(),
        )
