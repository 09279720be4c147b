import random

import numpy as np

from skyweft.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 90))]
        b = [rng.choice([b"a", b"b", b"c", b"e"]) for _ in range(rng.randint(0, 90))]
        assert decontaminate.lcs(decontaminate.masks_of(a), len(a), b) == plain_lcs(a, b)


def test_latent_space_keeps_the_main_directions():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.choice(words[g * 20 : g * 20 + 20], 30)) for g in rng.integers(0, 4, 60)]
    space = decontaminate.Space([decontaminate.Item.of(k, t) for k, t in enumerate(texts)])
    space.settle(np.zeros((len(space.vocabulary), space.random().shape[1])), 0)
    rows = np.zeros((60, len(space.vocabulary)))
    for k, t in enumerate(texts):
        terms, x = next(space.rows(space.numbers(decontaminate.words_of(t))))
        rows[k, terms] = x
    exact = np.linalg.svd(rows)[2][:4]
    basis = space.terms[:-1].astype(float) / space.idf[:, None]
    assert np.linalg.norm(exact @ basis, axis=1).min() > 0.999


def test_passages_are_added_up_as_they_stand(monkeypatch):
    monkeypatch.setattr(decontaminate, "PASSAGES", 3)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    space = decontaminate.Space([decontaminate.Item.of(1, " ".join(words[:20]))])
    space.idf = np.array([rng.uniform(1, 4) for _ in space.vocabulary])
    omega = space.random()
    for length in (0, 1, 15, 16, 17, 32, 33, 48, 49, 200):
        numbers = space.numbers([rng.choice(words[15:]).encode() for _ in range(length // 2)] + [rng.choice(words).encode() for _ in range(length - length // 2)])
        got, want = np.zeros((2, len(omega), omega.shape[1]))
        rows = list(space.rows(numbers))
        assert space.add_passages(got, numbers, omega) == len(rows)
        for terms, x in rows:
            want[terms] += np.outer(x, x @ omega[terms])
        assert np.allclose(got, want)


def test_the_basis_is_fitted_on_all_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SAMPLE_DOCS", 2, raising=False)  # a sample once bounded the fit
    monkeypatch.setattr(decontaminate, "PASSAGES", 3)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 16, 17, 40, 33, 200, 5, 64, 32)] + [None, "w1 " * 50]
    items = [decontaminate.Item.of(1, " ".join(words[:25]))]
    seen = {}
    monkeypatch.setattr(decontaminate.Space, "settle", lambda self, sums, passages: seen.update(sums=sums, passages=passages))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    space = decontaminate.fit(docs, items)
    counts = np.array([sum(w in decontaminate.words_of(t) for t in texts) for w in space.vocabulary])
    assert np.allclose(space.idf, np.log((1 + 11) / (1 + counts)) + 1)
    rows = [r for t in texts for r in space.rows(space.numbers(decontaminate.words_of(t)))]
    omega, want = space.random(), np.zeros(seen["sums"].shape)
    for terms, x in rows:
        want[terms] += np.outer(x, x @ omega[terms])
    assert seen["passages"] == len(rows) and np.allclose(seen["sums"], want)


def planted(spark):
    rng = random.Random(9)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d, t in docs if not any(" ".join(b.split()[:6]) in " ".join(t.split()) for _, b in bench)]
    out, want = [], {}
    for n, (d, t) in enumerate(docs):
        w = t.split()
        if d in clean and n % 3 == 0:
            i, b = bench[n % len(bench)]
            p = b.upper().split() if n % 2 else b.split()
            for k in range(len(p)):
                if rng.random() < 0.12:
                    p[k] = rng.choice(w or ["x"])
            at = rng.randint(0, len(w))
            w[at:at] = p
            want[d] = i
        out.append((d, "\n".join([" ".join(w)])))
    return out, bench, want, set(clean) - set(want)


def test_planted_paraphrases_and_clean_documents(spark):
    rows, bench, want, clean = planted(spark)
    rows += [(5000, None), (5001, ""), (None, bench[3][1]), (5002, bench[4][1]), (5002, bench[4][1]), (5003, "word " * 50_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*bench, (900, None), (901, ""), (902, "the of"), (903, bench[3][1])], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert np.mean([(d, i) in pairs for d, i in want.items()]) > 0.9
    assert not {d for d, _ in pairs} & clean
    assert {(None, bench[3][0]), (None, 903), (5002, bench[4][0])} <= pairs and not {5000, 5001, 5003} & {d for d, _ in pairs}
    assert sum((r["doc_id"], r["item_id"]) == (5002, bench[4][0]) for r in got) == 2
    kept = decontaminate.remove_leaks(docs, items)
    assert kept.columns == docs.columns
    flagged = {d for d, _ in pairs}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in rows if d not in flagged)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r[0], r[1]) for r in decontaminate.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 17)
    assert {(r[0], r[1]) for r in decontaminate.find_leaks(docs, bench).collect()} == whole


def test_sections_and_the_word_bound_lose_nothing(spark, monkeypatch):
    rows, bench, _, _ = planted(spark)
    items = [decontaminate.Item.of(*b) for b in bench] + [decontaminate.Item.of(1000 + k, " ".join(b[1].split()[:n])) for n in (9, 20) for k, b in enumerate(bench[:40])]
    space = decontaminate.fit(spark.createDataFrame(rows, "doc_id long, text string"), items)
    texts = [t for _, t in rows] + [" ".join(t for _, t in rows[:30]), None, "", "one"]
    cut = [{i for i, _ in space.leaks(t)} for t in texts]
    monkeypatch.setattr(decontaminate, "SECTION", 1 << 30)
    monkeypatch.setattr(decontaminate.Space, "possible", lambda self, numbers: np.ones(len(self.items), bool))
    whole = [{i for i, _ in space.leaks(t)} for t in texts]
    monkeypatch.setattr(decontaminate, "SECTION", 32)
    assert cut == whole == [{i for i, _ in space.leaks(t)} for t in texts] and sum(map(len, cut)) > 50


def test_changed_short_items_are_found(spark):
    rng = random.Random(4)
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    bench = [r["text"].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [" ".join(b[: (5, 8, 11, 15, 20, 24)[k % 6]]) for k, b in enumerate(bench)] + [" ".join(b) for b in bench]
    items = [decontaminate.Item.of(k, t) for k, t in enumerate(texts)]
    vocabulary = sorted({w for i in items for w in i.words})
    frame = spark.createDataFrame([(t,) for t in docs], "text string")
    space = decontaminate.fit(frame, items)
    for lengths in (range(5, 12), range(12, 25)):
        for share in (0.2, 0.35):
            hits = []
            for item in [i for i in items if len(i.words) in lengths] * 3:
                words = list(item.words)
                for at in rng.sample(range(len(words)), round(share * len(words))):
                    words[at] = rng.choice(vocabulary)
                around = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
                at = rng.randint(0, len(around))
                around[at:at] = words
                if item.score(around, at, at + len(words)) > 0:
                    hits.append(item.item_id in {i for i, _ in space.leaks(b" ".join(around).decode())})
            assert len(hits) > 30 and np.mean(hits) >= 0.98, (lengths, share, np.mean(hits))


def test_empty_sides(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.remove_leaks(docs, bench.limit(0)).count() == docs.count()


def test_query_finds_every_whole_item(spark):
    """Brute force: an item whose words stand in a document in one piece is found."""
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in queries.op8_benchmark_leaks(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    whole = set()
    for d in docs:
        text = b" " + b" ".join(decontaminate.words_of(d["text"])) + b" "
        whole |= {(d["doc_id"], b["item_id"]) for b in bench if b" " + b" ".join(decontaminate.words_of(b["text"])) + b" " in text}
    assert whole <= set(got) and len(whole) > 10
    words = {d["doc_id"]: decontaminate.words_of(d["text"]) for d in docs}
    texts = {b["item_id"]: decontaminate.words_of(b["text"]) for b in bench}
    for (d, i), share in got.items():
        assert plain_lcs(texts[i], words[d]) / len(texts[i]) >= share >= decontaminate.PARAPHRASE
