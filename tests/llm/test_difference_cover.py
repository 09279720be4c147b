import hashlib
import random
import re

import numpy as np
import pytest

from skyweft.llm import anchors, difference_cover, queries

W = difference_cover.WINDOW


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for k, w in zip(key, words, strict=True):
        for i in range(len(w) - W + 1):
            s = tuple(w[i : i + W])
            first[s] = min(first.get(s, k), k)
    out = []
    for (d, _), k, w in zip(rows, key, words, strict=True):
        gone = set()
        for i in range(len(w) - W + 1):
            if first[tuple(w[i : i + W])] < k:
                gone.update(range(i, i + W))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_for_test():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice(["", "é", "x"])
    passage = [word() for _ in range(120)]
    rows = [(1000, None), (1001, " \n"), (1002, "a " * 300), (1003, "a " * 260), (1004, "a\n" * 49)]
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 150))]
        cut = rng.randint(0, 60)
        w += passage[cut : cut + rng.choice((49, 50, 51, 60))] + [word() for _ in range(rng.randint(0, 90))]
        rows.append((rng.randint(0, 500), " ".join(w)))
    rows += [(d + 2000, t) for d, t in rows[5:15]] + rows[20:22] + [(None, rows[30][1]), (None, rows[30][1])]
    rows += [(rows[40][0], rows[41][1] + " tail")]
    long = [word() for _ in range(4000)]
    rows += [(3000, " ".join(long)), (3001, " ".join(long[:2000] + ["edit"] + long[2000:]))]
    return rows


def test_cover_meets_every_shift():
    p, cover = difference_cover.PERIOD, difference_cover.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(anchors, "hot_anchors", lambda rows: np.array([r["ahash"] for r in difference_cover.anchor_rows(docs_keyed).select("ahash").distinct().collect()][::2], np.int64))
    rows = rows_for_test()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, tag int, marks string").repartition(5)
    docs_keyed = anchors.keyed(docs, "doc_id", "text")
    got = difference_cover.remove_repeats(docs, str(tmp_path / "t"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert difference_cover.remove_repeats(docs, str(tmp_path / "t")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op10_substring_windows(spark, sf).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 0
