import re
from collections import Counter

import pytest

from skyweft.llm import collocations, queries


def brute(rows, least, top):
    counts = {1: Counter(), 2: Counter(), 3: Counter()}
    for text, lang in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in counts:
                for i in range(len(words) - m + 1):
                    counts[m][lang or "und", *words[i : i + m]] += 1
    f = {k: v for c in counts.values() for k, v in c.items()}
    n = Counter()
    for (lang, _), v in counts[1].items():
        n[lang] += v
    out = {}
    for m in (2, 3):
        for (lang, *ws), a in counts[m].items():
            if a < least:
                continue
            if m == 2 and any(k[0] == lang and v >= least and 100 * v >= 50 * a and (list(k[1:3]) == ws or list(k[2:]) == ws) for k, v in counts[3].items()):
                continue
            cuts = [(1000000 * a * a // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k) for k in range(1, m)]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


ROWS = (
    [("The old mill, the OLD mill. new york city\tnew york", "en")] * 12
    + [("new york state; a a a a a a", "en"), ("x" * 9000 + " y", "en"), ("", "en"), (None, "en"), (" .,\n!", "en")]
    + [("\u00c9t\u00e9 rouge! \u00c9t\u00e9 rouge \u00e9t\u00e9 rouge\x1cvin", None), ("\U0001f600 \U0001f601 \uffee \uffef", None)] * 11
    + [(" ".join(f"w{i % 7} w{i % 5}" for i in range(300)), "de")]
)
SCHEMA = "text string, lang string, k int, next string, slice long, a long, doc_id long"


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 1, "clash", 2, 3, None) for t, g in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("least", "top"), [(10, 2000), (1, 7)])
def test_equal_to_brute_force(spark, least, top):
    got = collocations.collocations(frame(spark, ROWS), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, least, top)


def test_small_chunks_and_hot_slices_change_nothing(spark, monkeypatch, no_broadcast):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 200)
    monkeypatch.setattr(collocations, "SAMPLE", 1)
    got = collocations.collocations(frame(spark, ROWS), least=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, 3, 2000)


def test_counts_past_64_bits_are_exact(spark):
    a, left, right = 3_000_000_017, 9_000_000_000_011, 3_000_000_021
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations._score("l", "r")).first()[0] == 1000000 * a * a // (left * right)


def test_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(None, None), ("one two", "en")])).collect() == []


def test_query_reads_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.QUERIES["op11_phrase_collocations"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.collect()) == brute([(r.text, r.lang) for r in docs.collect()], 10, 2000)
