import random
import re

import xxhash

import pytest

from skyweft.llm import queries, simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(
        ((d, f"{fps[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=repr
    )


def hexed(df):
    return sorted(((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in df.collect()), key=repr)


def test_fingerprint():
    for t in (None, "", " \t\n", "One", "one TWO", "É a\x0bB c", "a b c d " * 50, "x" * 10_000):
        assert simhash.fingerprint(t) % (1 << 64) == brute_fp(t)


def test_links_are_complete(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {0, 1, 3, 7, 15, (1 << 64) - 1}
    for b in base:
        for _ in range(8):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want and len(want) > 50


def test_components_nulls_and_repeats(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows = [(9, None), (4, "  "), (None, ""), (3, "one two"), (7, "one two"), (7, "one two"), (None, "alone here")]
    for d in range(20, 32):
        text = [word() for _ in range(300)]
        rows.append((d, " ".join(text)))
        text[150] = "changed"
        rows.append((d + 100, " ".join(text)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    assert hexed(simhash.near_duplicates(docs)) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_no_table_that_grows_with_the_input_is_broadcast(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    rows = [(d, " ".join(word() for _ in range(3))) for d in range(3000)]
    for d in range(5000, 5020):
        text = [word() for _ in range(300)]
        rows += [(d, " ".join(text)), (d + 100, " ".join([*text[:150], "changed", *text[151:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Past this size a broadcast fails, as on a driver that is too small; the map of few rows takes over 1 MB.
    key = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(key, "2m")
    try:
        found = simhash.near_duplicates(docs)
        assert hexed(found) == brute(rows)
    finally:
        spark.conf.unset(key)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_keep_one_finds_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    stop = [word()[:2] for _ in range(20)]
    make = lambda n: [rng.choice(stop) if rng.random() < 0.4 else word() for _ in range(n)]
    rows, near, clean = [], [], []
    for d in range(60):
        base = make(rng.randint(80, 600))
        rows.append((d, " ".join(base)))
        copy = list(base)
        if d % 2:
            for at in range(rng.randint(0, 59), len(copy), 60):
                copy[at] = word()
            near.append(d)
        else:
            copy = make(300)
            clean += [d, d + 1000]
        rows.append((d + 1000, " ".join(copy)))
    rows += [(2000 + k, rows[7][1]) for k in range(30)] + [(7, rows[7][1]), (None, "no id"), (None, "no id"), (3000, None), (3001, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    texts = dict(rows)
    alike = [d for d in near if len(shingle_set(texts[d]) & shingle_set(texts[d + 1000])) / len(shingle_set(texts[d]) | shingle_set(texts[d + 1000])) >= 0.82]
    assert len(alike) > 20 and sum(d + 1000 not in ids for d in alike) >= 0.9 * len(alike)
    assert set(clean) <= set(ids) and set(near) <= set(ids) and ids.count(None) == 2
    assert not any(2000 <= (i or 0) < 2030 for i in ids) and 3000 in ids and 3001 not in ids and ids.count(7) == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_appended_prefixed_and_replaced_blocks_are_found(spark):
    rng = random.Random(8)
    rows, alike, apart = [], [], []
    for d in range(240):
        w = [f"w{rng.getrandbits(40)}" for _ in range(rng.randint(100, 600))]
        rows.append((d, " ".join(w)))
        new = [f"n{rng.getrandbits(40)}" for _ in range(int(len(w) * rng.uniform(0.05, 0.24)))]
        at = rng.randint(0, len(w) - len(new))
        half = new[: len(new) // 2]
        copy = [w + new, new + w, w[:at] + half + w[at + len(half) :]][d % 3]
        rows.append((d + 1000, " ".join(copy)))
        (alike if jaccard(*(r[1] for r in rows[-2:])) >= 0.8 else apart).append(d)
    assert len(alike) > 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert sum(d + 1000 not in kept for d in alike) >= 0.97 * len(alike)
    assert set(range(240)) | {d + 1000 for d in apart} <= kept


def test_links_are_verified_on_the_shingles(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for d in range(200):
        w = [f"w{rng.getrandbits(40)}" for _ in range(404)]
        cut = 82 + d % 20 if d % 2 else 60 + d % 18  # of 400 shingles, J = (400 - cut) / 400
        rows += [(d, " ".join(w)), (d + 1000, " ".join(w[: 404 - cut]))]
        want[d] = jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert {d + 1000 for d, alike in want.items() if not alike} <= kept  # none below 0.8 goes
    assert sum(d + 1000 not in kept for d, alike in want.items() if alike) >= 0.97 * sum(want.values())


def test_large_group_of_near_copies_makes_no_square_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(12)
    base, rows = [f"w{rng.getrandbits(40)}" for _ in range(150)], []
    for d in range(500):
        w = list(base)
        for at in rng.sample(range(6, 150, 12), 3):  # alike only with the same three places, else 0.66 to 0.76
            w[at] = f"n{rng.getrandbits(40)}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(f"w{rng.getrandbits(40)}" for _ in range(100))) for d in range(200)]
    counted, verified = [], simhash.verified

    def counting(pairs, *more):
        pairs = simhash.cut_lineage(pairs, "counted")
        counted.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "verified", counting)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: shingle_set(t) for d, t in rows}
    links = [(a, b) for a in range(500) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 200 < len(links) < 3000
    root = {d: d for d in sets}
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = {d: x if r == y else r for d, r in root.items()} if x != y else root
    assert all(root[got[d]] == root[d] for d in got) and all(got[d] == d for d in got if d >= 1000)
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    assert sum(counted) < 10 * len(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op9_simhash_near_duplicates(spark, sf).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("classes", [0, 1, 4000, 11_000_000, 12_000_000, 10**8, 10**10])
def test_segments_lie_in_the_fingerprint(classes):
    bits, segments = simhash.segments_for(classes)
    assert bits * segments <= 64 * simhash.LANES
    q = simhash.flipped()
    meet = (1 - q) ** bits + bits * q * (1 - q) ** (bits - 1)
    assert 1 - (1 - meet) ** segments >= simhash.RECALL
    lanes = [bytes(8 * simhash.LANES), b"\xff" * (8 * simhash.LANES), bytes(8 * simhash.LANES)]
    cut, values = simhash._values(lanes, bits, segments)
    assert cut.shape == (3, segments, bits) and (values[0] == values[2]).all() and (values[1] == (1 << bits) - 1).all()


def test_bitmap_lets_every_asked_row_through(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BITMAP", 1 << 16)
    rows = spark.createDataFrame([(d, "t") for d in [*range(3000), 5, None]], "doc_id int, __t string")
    ids = spark.createDataFrame([(d,) for d in range(0, 3000, 20)], "node long")
    asked, clear = (sorted((r[0] for r in part.collect()), key=str) for part in simhash.split_by(rows, "doc_id", simhash.bitmap_of(ids)))
    assert set(range(0, 3000, 20)) <= set(asked) and len(asked) < 200
    assert sorted([*asked, *clear], key=str) == sorted([*range(3000), 5, None], key=str)
    none, every = simhash.split_by(rows, "doc_id", simhash.bitmap_of(ids.limit(0)))
    assert none.count() == 0 and every.count() == 3002
