import hashlib
import random

import numpy as np
import pytest

from skyweft.llm import anchors, queries, suffix_dedup

L = suffix_dedup.LENGTH


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    key = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for k, t in zip(key, texts, strict=True):
        for i in range(len(t) - L + 1):
            s = t[i : i + L]
            first[s] = min(first.get(s, (k, i)), (k, i))
    out = []
    for (d, _), k, t in zip(rows, key, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - L + 1):
            if first[t[i : i + L]] < (k, i):
                gone[i : i + L] = b"\1" * L
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 4, 250])
def test_suffix_order(size, monkeypatch):
    rng = np.random.default_rng(size)
    for n in (1, 2, 3, 10, 90, 2000):
        text = np.append(rng.integers(1, size, n), 0).astype(np.int16)
        if n == 90:
            text = np.append(np.tile([2, 1, 1], 30), 0).astype(np.int16) % size
            text[:-1] += text[:-1] == 0
        for keep in (1 << 26, 64):
            monkeypatch.setattr(suffix_dedup, "QUEUE_ITEMS", keep)
            raw = text.astype(">u2").tobytes()
            got = suffix_dedup.suffix_order(text)
            assert sorted(got.tolist()) == list(range(n + 1))
            keys = [raw[2 * i : 2 * (i + L)] for i in got.tolist()]
            assert keys == sorted(keys)


def test_every_window_has_an_anchor_that_depends_on_it_alone():
    rng = random.Random(1)
    window = bytes(rng.choice(b"ab cde") for _ in range(L))
    found = []
    for _ in range(5):
        pad = [bytes(rng.choice(b"ab cde") for _ in range(rng.randint(0, 150))) for _ in range(2)]
        text = pad[0] + window + pad[1]
        codes, starts, sizes = suffix_dedup._joined([text])
        ok = anchors.covered(starts, starts + sizes - L + 1, len(codes))
        place = suffix_dedup.anchor_places(suffix_dedup.RangeHash(codes).all(suffix_dedup.GRAM), ok) - starts[0]
        for i in range(len(text) - L + 1):
            assert ((place >= i) & (place <= i + suffix_dedup.REACH)).any()
        at = len(pad[0])
        h = suffix_dedup.RangeHash(codes).at(place + starts[0], suffix_dedup.GRAM)
        inside = (place >= at) & (place <= at + suffix_dedup.REACH)
        found.append((place[inside] - at)[np.argmin(h[inside] >> np.uint64(33))])
    assert len(set(found)) == 1


def rows_for_test():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ijklé\n") for _ in range(n))
    passage = text(400)
    rows = [(1000, None), (1001, ""), (1002, "a" * 700), (1003, "a" * 250 + "b"), (1004, "ab" * 300), (1005, "x" * 99)]
    for d in range(40):
        cut = rng.randint(0, 250)
        body = text(rng.randint(0, 300)) + passage[cut : cut + rng.choice((99, 100, 101, 140))] + text(rng.randint(0, 200))
        rows.append((d * 3, body * (2 if d % 9 == 0 else 1)))
    rows += [(d + 2000, t) for d, t in rows[6:14]] + [rows[20], (None, rows[22][1])]
    long = text(15_000)
    return rows + [(3000, long), (3001, long[:7000] + "edit" + long[7000:])]


def test_against_brute_force(spark, tmp_path):
    rows = rows_for_test()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, tag int, marks string").repartition(5)
    got = suffix_dedup.remove_repeats(docs, str(tmp_path / "t"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op5_suffix_array_dedup(spark, sf).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 0
