import numpy as np
import pytest

from skyweft.llm import embedding_dedup, queries


def brute(rows, threshold=0.95):
    vecs = []
    for _, v in rows:
        ok = v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)
        vecs.append(np.array(v, np.float64) if ok else None)
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vecs[i], vecs[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((d, links[i], c, d == c))
    return sorted(out, key=repr)


def sample(n_groups, size, dim=16, noise=0.05, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        center = rng.standard_normal(dim)
        out += [(int(g * 1000 + k), [float(np.float32(x)) for x in center + noise * rng.standard_normal(dim)]) for k in range(size)]
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, block):
    rows = sample(12, 12) + sample(1, 60, seed=8)
    rows = [(d + 50_000 * (i >= 144), v) for i, (d, v) in enumerate(rows)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (None, rows[20][1]), (5, rows[30][1]), (5, rows[30][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(70, None), (71, []), (72, [0.0] * 16), (73, [nan] + [1.0] * 15), (74, [inf] + [1.0] * 15), (75, [None] + [1.0] * 15)]
    rows += [(76, [1.0, 2.0]), (77, [2.0, 4.0]), (78, [1e300, 2e300]), (None, [0.0, 0.0]), (79, [-0.0, 1.0]), (80, [0.0, 1.0])]
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, node int").repartition(3)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df, block=block).collect()), key=repr)
    want = brute([(d, v if d != 78 else [1.0, 2.0]) for d, v in rows])
    assert got == want


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    linked = embedding_dedup.near_duplicates(df).where("n_links > 0").count()
    assert linked >= 0.98 * len(rows)


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op4_embedding_near_duplicates(spark, sf).collect()), key=repr) == brute(rows)
