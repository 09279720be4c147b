"""Personal data, and the terms that give it away.

Emails, IP addresses, card and phone numbers are found by pattern and checked
(parts, Luhn, digit counts). These are the protected entities. Around each of
them the words of a context are collected, and the corpus then tells how much of
an entity a word reveals: with document counts n(t, c), n(t), n(c) out of N,

    disclosure(t; c) = PMI(t; c) / IC(c)
                     = log2(n(t, c) N / (n(t) n(c))) / log2(N / n(c)),

which is 1 if the word occurs only with the entity. A word seen with an entity
in at least SUPPORT different contexts, where copies of one another count once,
and whose disclosure reaches REMOVE is taken out of every text; from GENERALISE on it is replaced by a general label.

Only DataFrame functions are used. Quantifiers in the patterns are possessive
where that matches the same text, so long runs neither backtrack nor recurse;
\\G lets a match begin where the last one ended.

Defined cases: a null text is empty; texts are read whole; rows that repeat or
share an id keep their own rows; a null id is an ordinary value; ties cannot
arise in the spans (sorted by start, then kind); an empty table gives an empty
result. Only the id and text columns are read; ``sanitise`` returns all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: What is looked for, one pattern per kind.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP = r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.(?=[0-9])|$)){4}$"
WORD = r"\p{L}{3,}+"
CONTEXT = 120  # characters on either side of an entity
SUPPORT = 3
#: Where more of the words around an entity recur, its contexts are copies.
COPIED = 0.5  # share of common words from which contexts are copies
LEADERS = 3
GENERALISE, REMOVE = 0.8, 0.95
_BLOCK = 256
SPAN = "struct<start:bigint,kind_no:int,end:bigint,value:string>"


def _positions(text: Column, pattern: str, kind_no: int) -> Column:
    """All matches as spans. Lengths of the parts between matches and of the
    matches are added up in blocks, so many matches do not cost their square."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(values)), lambda g: F.length(g).cast("bigint"))
    parts = F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), F.length(v).cast("bigint").alias("size"), v.alias("value")))

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["gap"]
            span = F.struct(begin.alias("start"), F.lit(kind_no).alias("kind_no"), (begin + p["size"]).alias("end"), p["value"].alias("value"))
            return F.struct((begin + p["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(block, start, step)

    def across(blocks: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        )["out"]

    def shifted(block: Column, base: Column) -> Column:
        return F.transform(block["out"], lambda s: F.struct(
            (s["start"] + base).alias("start"), s["kind_no"].alias("kind_no"), (s["end"] + base).alias("end"), s["value"].alias("value")
        ))

    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))

    def spans(whole: Column) -> Column:
        blocks = F.transform(numbers, lambda b: within(F.slice(whole, b * _BLOCK + 1, F.lit(_BLOCK))))
        return _let(blocks, lambda local: F.flatten(F.zip_with(local, across(local), shifted)))

    return F.when(F.size(values) > 0, _let(parts, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: _let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda span: _valid(kind, span["value"])


def _of_kind(number: int):
    return lambda span: span["kind_no"] == number


def base_spans(text: Column) -> Column:
    """Checked entities of a text, by start and then kind."""
    needs = {"email": "@", "phone": "+"}
    found = []
    for number, kind in enumerate(KINDS):
        spans = F.filter(_positions(text, PATTERNS[kind], number), _check(kind))
        if kind in needs:
            spans = F.when(F.contains(text, F.lit(needs[kind])), spans).otherwise(F.array().cast(f"array<{SPAN}>"))
        found.append(spans)
    return F.array_sort(F.concat(*found))


def span_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entities(text: Column, spans: Column) -> Column:
    """(entity, words) of each span: its words without cut ones."""

    def entity(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        after = F.substring(text, s["end"].cast("int") + 1, F.lit(CONTEXT))
        before = F.when(s["start"] > CONTEXT, F.regexp_replace(before, r"^\p{L}*+", "")).otherwise(before)
        after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, r"\p{L}*$", "")).otherwise(after)
        around = F.lower(F.concat_ws(" ", before, after))
        words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(around, PATTERNS["email"], " "), F.lit(WORD), F.lit(0)))
        plain = F.when(s["kind_no"] == 0, F.lower(s["value"])).when(s["kind_no"] == 1, s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
        return F.struct(F.concat_ws(":", s["kind_no"], plain).alias("entity"), words.alias("words"))

    return F.transform(spans, entity)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, spans, entities) of every row, written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    spanned = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"), base_spans(F.col("text")).alias("spans"))
    return cut_lineage(spanned.select("doc_id", "text_key", "spans", _entities(F.col("text"), F.col("spans")).alias("entities")), "entities")


def _words(docs: DataFrame, text_col: str) -> DataFrame:
    """(text_key, term): the different words of every text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)))
    return docs.select(F.xxhash64(F.col(text_col)).alias("text_key"), F.explode(words).alias("term"))


def _contexts(seen: DataFrame) -> DataFrame:
    """(entity, key, copy_of): each different set of context words of an entity,
    and the class of copies it belongs to. Sets that share most of their words with
    a leader, the most repeated set not placed yet, are its copies; what LEADERS
    rounds leave over are copies if their four smallest word hashes agree."""
    sketch = F.xxhash64(F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, 4))
    sets = seen.groupBy("entity", "words").agg(F.count("*").alias("n")).select("entity", "words", "n", F.xxhash64("words").alias("key"), sketch.alias("sketch"))
    sets = cut_lineage(sets, "contexts")
    weights = sets.groupBy("entity", "sketch").agg(F.sum("n").alias("weight"))
    placed = cut_lineage(sets.join(weights, ["entity", "sketch"]).withColumn("copy_of", F.lit(None).cast("bigint")), "copies")
    for _ in range(LEADERS):
        rank = F.struct("weight", "n", "key")
        leaders = placed.where(F.col("copy_of").isNull()).groupBy("entity").agg(F.max_by(F.struct("words", "key"), rank).alias("lead"))
        shared, total = F.size(F.array_intersect("words", "lead.words")), F.size(F.array_union("words", "lead.words"))
        own = F.coalesce("copy_of", F.when(shared >= COPIED * total, F.col("lead.key")))
        placed = cut_lineage(placed.join(leaders, "entity", "left").withColumn("copy_of", own).drop("lead"), "copies")
    return placed.select("entity", "key", F.coalesce("copy_of", "sketch").alias("copy_of"))


def disclosive_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """(term, disclosure): words that reveal at least GENERALISE of an entity."""
    seen = found.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("entities").alias("e")).select("row", "e.entity", F.array_sort("e.words").alias("words"))
    seen = cut_lineage(seen, "seen")
    contexts = _contexts(seen)
    entities = contexts.groupBy("entity").agg(F.count_distinct("copy_of").alias("n_c"))
    entities = entities.join(seen.groupBy("entity").agg(F.count_distinct("row").alias("rows_c")), "entity")
    met = seen.withColumn("key", F.xxhash64("words")).join(contexts.select("entity", "key", "copy_of"), ["entity", "key"])
    pairs = (
        met.select("row", "entity", "copy_of", F.explode("words").alias("term"))
        .groupBy("term", "entity").agg(F.count_distinct("copy_of").alias("n_tc"), F.count_distinct("row").alias("rows_tc"))
        .where(F.col("n_tc") >= support)
    )
    pairs = cut_lineage(pairs.join(entities, "entity"), "supported-pairs")
    counted = _words(docs, text_col).join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    # Surplus copies of an entity's contexts count in none of the numbers.
    n = F.greatest(F.lit(float(max(1, found.count()))) - F.col("rows_c") + F.col("n_c"), F.lit(1.0))
    n_t = F.col("n_t") - F.col("rows_tc") + F.col("n_tc")
    # A text holds a term that stands next to one of its entities, so n_t >= n_tc up to case and cuts.
    pmi = F.log2(F.col("n_tc") * n / (F.greatest(n_t, "n_tc") * F.col("n_c")))
    degree = F.when(F.col("n_c") < n, pmi / F.log2(n / F.col("n_c"))).otherwise(F.lit(0.0))
    terms = pairs.join(counted, "term").groupBy("term").agg(F.max(degree).alias("disclosure"))
    return cut_lineage(terms.where(F.col("disclosure") >= GENERALISE), "terms")


def _term_spans(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(text_key, terms, removed): the disclosive words of each text that has any."""
    hits = _words(docs, text_col).join(terms, "term")
    return cut_lineage(
        hits.groupBy("text_key").agg(
            F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))).alias("removed")
        ),
        "texts-with-terms",
    )


def _with_terms(text: Column, spans: Column, terms: Column) -> Column:
    """Base spans and those occurrences of the terms that overlap none of them."""
    words = F.filter(_positions(text, WORD, len(KINDS)), lambda w: F.array_contains(terms, F.lower(w["value"])))
    free = F.filter(words, lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return F.when(terms.isNull(), spans).otherwise(F.array_sort(F.concat(spans, free)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    found = find(docs, id_col, text_col)
    marked = _term_spans(docs, disclosive_terms(docs, found, text_col), text_col)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    with_terms = texts.join(marked.select("text_key", "terms"), "text_key").select("text_key", "text", "terms").dropDuplicates(["text_key", "text"])
    spanned = with_terms.select("text_key", _with_terms(F.col("text"), base_spans(F.col("text")), F.col("terms")).alias("all_spans"))
    # Two texts may share a 64-bit key; then each row takes the spans that contain its own base spans.
    everything = spanned.groupBy("text_key").agg(F.min_by("all_spans", F.size("all_spans")).alias("all_spans"))
    joined = found.join(everything, "text_key", "left")
    counts = [F.size(F.filter("spans", _of_kind(n))).cast("bigint").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return joined.select(
        "doc_id", *counts, F.sha2(span_text(F.col("spans")), 256).alias("base_sha256"),
        span_text(F.coalesce("all_spans", "spans")).alias("spans"),
    )


def _rewritten(text: Column, spans: Column, removed: Column) -> Column:
    """The text with every span replaced; of overlapping spans the first counts
    and the others are covered by it."""
    labels = F.array(*[F.lit(f"[{k}]") for k in (*KINDS, TERM)])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.when(F.array_contains(F.coalesce(removed, F.array().cast("array<string>")), F.lower(s["value"])) & (s["kind_no"] == len(KINDS)), F.lit("")).otherwise(labels[s["kind_no"]])
        piece = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        grown = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, label)).alias("out"))
        covered = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], grown).otherwise(covered)

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities and disclosive terms replaced in the text."""
    found = find(docs, id_col, text_col)
    marked = _term_spans(docs, disclosive_terms(docs, found, text_col), text_col)
    marked = marked.select(F.col("text_key").alias("__key"), F.col("terms").alias("__terms"), F.col("removed").alias("__removed"))
    joined = docs.join(marked, F.xxhash64(F.col(text_col)) == F.col("__key"), "left")
    spanned = joined.withColumn("__spans", _with_terms(F.col(text_col), base_spans(F.col(text_col)), F.col("__terms")))
    clean = spanned.withColumn(text_col, F.when(F.col(text_col).isNotNull(), _rewritten(F.col(text_col), F.col("__spans"), F.col("__removed"))))
    return clean.select(*docs.columns)
