import hashlib
import random
import re

from skyweft.llm import pii, queries

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    found = []
    for n, (kind, rule) in enumerate(RULES.items()):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(rule, text or "") if valid(kind, m.group())]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def row(doc_id, text):
    spans = brute(text)
    return (doc_id, *[sum(k == kind for k, *_ in spans) for kind in RULES], hashlib.sha256(joined(spans).encode()).hexdigest())


ODD = [
    None, "", "a@b.c_d@e.f x@y z@@q.r .a@b.c. a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0255 01.02.03.04", "4111 1111-1111 1111 x 4111111111111112 0 00",
    "+1 (243) 555-5526 +49..... +1 2 3 +123456789012345 +1234567890123456", "😀 é a@b.co 😀 10.0.0.1 ñ +44 20 7946 0958 4111111111111111",
    "1" * 30_000 + " " + "a" * 30_000 + "@" + "b." * 9000 + "c", "+1" + " " * 20_000 + "2", "x@y.z " * 700 + "4111111111111111", "1.1" * 5000, "- -1- 2 3-4" * 3000,
]


def test_base_spans_on_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "a@b.c"), (None, "a@b.c")]
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, spans string, n_ip int")
    got = [tuple(r)[:6] for r in pii.personal_data(docs).collect()]
    assert sorted(got, key=repr) == sorted([row(d, t) for d, t in rows], key=repr)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "@", ".", "b.c", "1", "22", "255", " ", "-", "+", "(", ")", "4111", "é", "_", "%", "\n", "+1 ", "😀"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for i in range(3000)]
    got = [tuple(r) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(r[:6] for r in got) == sorted(row(d, t) for d, t in rows)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    common = [word() for _ in range(900)]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, f"{fill(30)} Zanzibrook {fill(2)} reach me at jo@corp.org {fill(30)}") for i in range(6)]
    rows += [(100 + i, fill(60)) for i in range(60)] + [(200, f"{fill(5)} zanzibrook {fill(5)}"), (201, f"{fill(3)} someone@else.net {fill(3)}")]
    rows += [(300 + i, f"same words uniqueness here solo@copy.org {'x' * 3} and nothing else") for i in range(9)]
    return rows


def test_disclosive_terms_are_found_and_removed(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars int")
    terms = {r["term"] for r in pii.disclosive_terms(docs, pii.find(docs)).collect()}
    assert "zanzibrook" in terms and "uniqueness" not in terms and len(terms) <= 3
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    text = dict(rows)[200]
    at = text.index("zanzibrook")
    assert f"term:{at}:{at + 10}" in got[200]["spans"].split(",")
    assert set(joined(brute(dict(rows)[3])).split(",")) <= set(got[3]["spans"].split(","))
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all("zanzibrook" not in t.lower() and "@" not in t for t in out.values())
    assert out[201] == dict(rows)[201].replace("someone@else.net", "[email]") and out[120] == dict(rows)[120]


def test_copies_do_not_hide_independent_contexts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{fill(30)} zanzibrook {fill(2)} jo@corp.org {fill(30)}") for i in range(5)]
    before, after = fill(8).split(), fill(8)
    for i in range(200):  # copies with one word changed
        changed = list(before)
        changed[i % 8] = word()
        rows.append((100 + i, f"{' '.join(changed)} zanzibrook templateword jo@corp.org {after}"))
    rows += [(1000 + i, fill(40)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["term"] for r in pii.disclosive_terms(docs, pii.find(docs)).collect()} == {"zanzibrook"}


def test_overlaps_and_nulls_when_rewriting(spark):
    rows = [(1, None), (2, "x +1.22.33.44.5555 y"), (3, "é 1.2.3.4, a@b.co!"), (3, "é 1.2.3.4, a@b.co!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, pii.sanitise(docs).collect()), key=repr)
    assert out[0] == (1, None) and out[2:] == [(3, "é [ip], [email]!")] * 2 and "[" in out[1][1]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = [row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r)[:6] for r in queries.op1_personal_data(spark, sf).collect()) == sorted(want)
