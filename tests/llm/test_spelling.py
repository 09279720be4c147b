import re
from collections import Counter
from zlib import crc32

import pytest

from skyweft.llm import queries, spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, noise, least=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], len(around[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n)


ROWS = (
    [(i, "Colour colours COLOURS \u00e9t\u00e9rnel \u00c9t\u00e9rnel etternel colour-colours") for i in range(40)]
    + [(i, "collour collour colouur kolours aabbccdd aabbccde") for i in range(3)] + [(None, "color\u00d7s kolors")] * 6
    + [(7, "x" * 5000 + " " + "x" * 4999), (7, "x" * 5000 + " " + "x" * 4999)] * 3 + [(1, None), (2, ""), (3, "12 345 ab")]
)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize(("noise", "bucket"), [(None, 256), (2, 256), (3, 1)])
def test_equal_to_brute_force(spark, monkeypatch, no_broadcast, noise, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    monkeypatch.setattr(spelling, "HELD_WORDS", 4)
    assert rows_of(spelling.variants(frame(spark, ROWS), noise=noise)) == brute(ROWS, noise)


def test_chains_reach_their_last_form(spark):
    text = " ".join(w for k, w in enumerate(("abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg")) for _ in range(5 * 5**k))
    got = {r[0]: r[5] for r in rows_of(spelling.variants(frame(spark, [(1, text)])))}
    assert set(got.values()) == {"abjihg"} and len(got) == 5


def test_near_words_share_a_signature():
    letters = "abcdefghijklmnopqrstuvwxyz\u00e9\u00ff"
    for word in ("aaaaaa", "abcdef", "mississippi", "\u00e9t\u00e9rnel"):
        own = set(spelling.signatures(word))
        assert len(own) == len(spelling.CHOICES)
        for i in range(len(word) + 1):
            for c in letters:
                changed = {word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]}
                for other in changed:
                    assert own & set(spelling.signatures(other)), (word, other)


def test_empty_table(spark):
    assert rows_of(spelling.variants(frame(spark, []), noise=199)) == []
    assert rows_of(spelling.variants(frame(spark, [(1, "abcdef " * 4)]), noise=None)) == []


def test_query_reads_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert rows_of(got) == brute([tuple(r) for r in docs.collect()], 199)
