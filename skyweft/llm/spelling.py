"""Spelling variants by PartEnum signatures.

A word is the vector of its letters: one dimension per letter and occurrence, so
``abba`` has a1, a2, b1, b2. One inserted or deleted letter changes one dimension, a
replaced one two, so near words are at most DISTANCE = 2 apart. PartEnum makes that a
set of equi-joins: the dimensions are dealt to FIRST groups, of which one differs in
at most DISTANCE // FIRST places, and each group to SECOND parts; the letters in every
choice of SECOND - DISTANCE // FIRST parts of a group are one signature. Near words
share a signature for certain. With the few letters of a word a choice must keep most
of them to tell words apart, therefore one first group and eight parts: 28 signatures
that each hold about three quarters of the letters. Words that share one are compared
by edit distance.

Hot signatures, of more than BUCKET words (runs of few letters, say), make no pairs
of all their words: inside them, words must also agree after the deletion of at most
one letter each. Near words do, and only (length + 1) x alphabet words can have one
such remainder, however many words there are.

Words are counted in each task first. A stated share of them is damaged on purpose by
``noise``, as the query's contract wants; without it words are taken as they stand.

Defined cases: a null text has no words; a null id is empty text in the noise; case
is folded for A-Z only; texts are read whole; repeated rows count again; of near
words with equal counts the smallest by code points is the form; an empty table gives
no rows. Very long runs are words like others. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, drop_table
from ..plans.skew import salted_join

DISTANCE = 2
FIRST, SECOND = 1, 8
#: Words of a signature that are compared with each other directly.
BUCKET = 256
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 1 << 19
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
_LATER = SECOND - DISTANCE // FIRST
#: Parts that each signature keeps, as (group, parts).
CHOICES = [(g, frozenset(kept)) for g in range(FIRST) for kept in combinations(range(SECOND), _LATER)]


def damaged(doc: str, run: str, share: int) -> str:
    """The run, or where ``share`` divides the checksum of document and run, the run
    without the letter that the checksum points at."""
    h = crc32(f"{doc}:{run}".encode())
    if h % share:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None,
                shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` letters and ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(RUN.findall((text.as_py() or "").translate(_FOLD)))
                if noise is None:
                    kept = ((w, n) for w, n in found.items() if len(w) >= shortest)
                else:  # a damaged run is one letter shorter
                    doc = "" if doc is None else str(doc)
                    kept = ((d, n) for w, n in found.items() if len(w) >= shortest and len(d := damaged(doc, w, noise)) >= shortest)
                for w, n in kept:
                    total[w] += n
                if len(total) >= HELD_WORDS:
                    yield out()
        if total:
            yield out()

    counted = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def signatures(word: str) -> list[int]:
    """One number per choice of parts: the letters that lie in them."""
    parts: list[list[list[str]]] = [[[] for _ in range(SECOND)] for _ in range(FIRST)]
    seen: Counter[str] = Counter()
    for c in sorted(word):
        seen[c] += 1
        # Each occurrence of a letter moves on by three parts, neighbours in the alphabet by one.
        at = ord(c) + 3 * seen[c]
        parts[at % FIRST][at // FIRST % SECOND].append(f"{c}{seen[c]}")
    made = []
    for i, (group, kept) in enumerate(CHOICES):
        held = "".join("".join(p) for k, p in enumerate(parts[group]) if k in kept)
        made.append(xxhash.xxh64_intdigest(held.encode(), seed=i))
    return made


def near_pairs(words: DataFrame) -> DataFrame:
    """(u, v) with u < v: words of the table that differ by exactly one edit."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                made = np.array([signatures(w) for w in part.column(0).to_pylist()], np.uint64).view(np.int64)
                offsets = pa.array(np.arange(0, made.size + 1, len(CHOICES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], names=["word", "sigs"])

    signed = words.select("word").mapInArrow(sign, "word string, sigs array<bigint>").select("word", F.explode("sigs").alias("sig"))
    signed = cut_lineage(signed, "signatures")
    sizes = signed.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    sizes = cut_lineage(sizes.select("sig", (F.col("size") > BUCKET).alias("hot")), "buckets")
    met = cut_lineage(salted_join(signed, sizes, ["sig"], "inner", spread_by=("word",)), "met", supersedes=signed)

    def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
        u, v = rows.select(*keys, F.col("word").alias("u")), rows.select(*keys, F.col("word").alias("v"))
        close = F.abs(F.length("u") - F.length("v")) <= 1
        found = u.join(v, keys).where((F.col("u") < F.col("v")) & close)
        return found.where(F.levenshtein("u", "v", 1) == 1).select("u", "v")

    # What is left of a word after at most one deletion, as a hash: pairs are compared anyway.
    # Letters of a run of equal ones leave the same, so only the first of a run goes.
    places = met.where("hot").select("sig", "word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    places = places.where((F.col("i") < 2) | (F.substring("word", F.col("i"), F.lit(1)) != F.substring("word", F.col("i") - 1, F.lit(1))))
    left = F.when(F.col("i") == 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("i") - 1), F.substring("word", F.col("i") + 1, F.length("word"))))
    crowded = places.select("sig", "word", F.xxhash64(left).alias("rest"))
    found = pairs(met.where("not hot"), ["sig"]).unionByName(pairs(crowded, ["sig", "rest"])).distinct()
    return cut_lineage(found, "near-words", supersedes=met)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follow the forms to the last. A form occurs several times as
    often as its word, so there is no circle; each round doubles the way."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = salted_join(links, onward, ["root"], "left", spread_by=("word",))
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return links
        links = cut_lineage(moved.select("word", F.coalesce("next", "root").alias("root")), "roots", supersedes=links)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None,
             shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word: its near words, the most
    frequent of them if it occurs ``ratio`` times as often, and the end of that way."""
    words = cut_lineage(word_counts(docs, id_col, text_col, noise, shortest, least), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = salted_join(both, words.select(F.col("word").alias("v"), F.col("n").alias("v_n")), ["v"], "inner", spread_by=("u",))
    best = known.groupBy("u").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("v_n")).alias("minus"), F.col("v").alias("form"))).alias("best"))
    judged = words.join(best.withColumnRenamed("u", "word"), "word", "left")
    wins = -F.col("best.minus") >= ratio * F.col("n")
    judged = cut_lineage(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(wins, F.col("best.form")).alias("form"), F.when(wins, -F.col("best.minus")).alias("form_n")), "judged-words")
    drop_table(pairs)
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
