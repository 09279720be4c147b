"""Phrase collocations by the stripes pattern.

Every prefix of none, one or two words keys a stripe: a counter of the words that
follow it inside a piece. The stripe of the empty prefix counts single words, those
of one word count pairs, those of two words triples; the total of a prefix is its
own count in the stripe of the prefix before it. Tasks build the stripes of a chunk
of words as arrays and send one row per stripe; after one shuffle by prefix the
stripes are merged element by element in a hash aggregate, which may spill. All
counts a phrase needs (its extensions, the totals of its parts, the largest count
of a longer candidate around it) are then looked up in that one table.

Stripes of two-word prefixes are made in a second pass, as most triples are rare: both
pairs of a frequent triple are frequent. Every task holds the frequent pairs as a
bitmap of FILTER_BITS bits, whatever their number. A pair that only shares its bit
with a frequent one is counted in vain and dropped by its count; none is missed.

Hot prefixes: words that make up more than one in SLICES of all words are looked for
on one in SAMPLE documents, so the list has at most SLICES words. Stripes of
prefixes made only of such words are cut by the following word into as many slices as
the rarest word of the prefix asks for. The list only decides how rows are dealt.

The first ``top`` rows of a language are ranked in two steps, the first over slices
of a language. Arithmetic is in decimals of 38 digits: exact for counts below
10**13.

Defined cases: a null text has no words and a null language is ``und``; case is
folded for A-Z only; phrases never cross a piece or a text; repeated rows and rows
without an id count like others (ids are not read); texts are read whole; an empty
table, or a language without a frequent phrase, gives no rows. Ties follow score,
count and the UTF-8 bytes of the phrase. Only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from ..plans.skew import salted_join

#: One in so many documents is looked at for hot words; a word is hot above 1 / SLICES.
SAMPLE, SLICES = 64, 1024
#: Bytes of text whose stripes a task makes at once; a longer text is taken whole.
CHUNK_BYTES = 1 << 24
#: Slices of a language when the first rows are ranked.
RANK_SLICES = 64
END = b"."
# A-Z in lower case; the characters that end a piece all become a full stop.
_FOLD = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits that stand for the frequent pairs: 16 MB in every task.
FILTER_BITS = 27
STRIPES = "lang string, k int, w1 string, w2 string, slice int, next array<string>, counts array<bigint>"


def marked_text(text: bytes) -> bytes:
    """Folded, with END as a word of its own between pieces."""
    return text.translate(_FOLD).replace(END, b" . ")


def tokens_of(text: bytes) -> list[bytes]:
    """Words in order, and END wherever a piece ends."""
    return marked_text(text).split()


def pair_bits(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bit of each pair, from the hashes of its words."""
    salt = np.uint64(crc32(lang.encode()))
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ salt) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


class Chunk:
    """Word numbers of the texts of one language, and their stripes: of prefixes of
    up to one word, or with the bitmap of frequent ``pairs`` of two."""

    def __init__(self, lang: str, hot: dict[bytes, int], pairs: np.ndarray | None = None):
        self.lang, self.hot, self.pairs = lang, hot, pairs
        self.texts: list[bytes] = [END]  # so that END is word number 0
        self.size = 0

    def add(self, text: bytes) -> None:
        marked = marked_text(text)
        self.texts += [marked, END]
        self.size += len(marked)

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """The stripes of the chunk, shortest prefixes first."""
        words = pc.ascii_split_whitespace(pa.array(self.texts, pa.large_binary()).view(pa.large_string())).flatten()
        encoded = words.filter(pc.not_equal(words, "")).dictionary_encode()
        ids = np.concatenate([encoded.indices.to_numpy().astype(np.int64), np.zeros(3, np.int64)])
        vocabulary = encoded.dictionary.cast(pa.string())
        listed = vocabulary.view(pa.binary()).to_pylist()
        n = np.int64(len(listed))
        slices = np.ones(int(n), np.int64)
        if self.hot:
            for i, w in enumerate(listed):
                if w in self.hot:
                    slices[i] = self.hot[w]
        hashed = hashes(listed)
        spread = (hashed >> np.uint64(32)).astype(np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        pairs = (a > 0) & (b > 0)
        if self.pairs is None:
            yield from self._rows(0, np.zeros(0, np.int64), a[a > 0], n, vocabulary, spread, slices)
            yield from self._rows(1, a[pairs], b[pairs], n, vocabulary, spread, slices)
            return
        bits = pair_bits(self.lang, hashed[a], hashed[b])
        pairs &= self.pairs[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 == 1
        triples = pairs & np.r_[pairs[1:], False]
        yield from self._rows(2, a[triples] * n + b[triples], c[triples], n, vocabulary, spread, slices)

    def _rows(self, k: int, prefix: np.ndarray, following: np.ndarray, n: np.int64, vocabulary: pa.Array,
              spread: np.ndarray, slices: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(following):
            return
        if k < 2:  # prefix and next word fit one number
            code, counts = np.unique(following if k == 0 else prefix * n + following, return_counts=True)
            prefix, following = code // n, code % n
        else:
            order = np.lexsort((following, prefix))
            prefix, following = prefix[order], following[order]
            start = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (following[1:] != following[:-1])])
            counts = np.diff(np.r_[start, len(prefix)])
            prefix, following = prefix[start], following[start]
        w1, w2 = (prefix // n, prefix % n) if k == 2 else (prefix, prefix)
        many = np.full(len(prefix), SLICES) if k == 0 else np.minimum(slices[w1], slices[w2])
        part = np.where(many > 1, spread[following] % many, 0)
        if (many > 1).any():
            order = np.lexsort((part, prefix))
            prefix, following, counts, part, w1, w2 = (x[order] for x in (prefix, following, counts, part, w1, w2))
        start = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
        bounds = np.r_[start, len(prefix)].astype(np.int32)
        word = lambda at: vocabulary.take(pa.array(at))
        none = pa.nulls(len(start), pa.string())
        for at in range(0, len(start), 1 << 15):  # batches of bounded size
            to = min(at + (1 << 15), len(start))
            low, high = bounds[at], bounds[to]
            offsets = pa.array(bounds[at : to + 1] - low)
            yield pa.RecordBatch.from_arrays([
                pa.array([self.lang] * (to - at), pa.string()), pa.array(np.full(to - at, k, np.int32)),
                word(w1[start[at:to]]) if k else none[at:to], word(w2[start[at:to]]) if k == 2 else none[at:to],
                pa.array(part[start[at:to]].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, word(following[low:high])),
                pa.ListArray.from_arrays(offsets, pa.array(counts[low:high].astype(np.int64))),
            ], names=["lang", "k", "w1", "w2", "slice", "next", "counts"])


def _read(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())


def hot_words(read: DataFrame) -> dict[bytes, int]:
    """Slices of every word that makes up more than one in SLICES of the sampled
    words: at most SLICES words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, int] = {}
            for text in batch.column(0).cast(pa.binary()):
                for w in tokens_of(text.as_py()):
                    counts[w] = counts.get(w, 0) + 1
            counts.pop(END, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    sample = read.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counted = cut_lineage(sample.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "sampled-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.where(F.col("n") * SLICES > total)  # their shares add up to 1 at most
    return {bytes(r["word"]): -(-r["n"] * SLICES // total) for r in hot.collect()}


def stripes(read: DataFrame, hot: dict[bytes, int], pairs: Broadcast | None = None) -> DataFrame:
    """The stripes of each chunk of a task; equal stripes are still to be merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, Chunk] = {}
        bitmap = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if lang not in chunks:
                    chunks[lang] = Chunk(lang, hot, bitmap)
                chunk, before = chunks[lang], chunks[lang].size
                chunk.add(text.as_py())
                held += chunk.size - before
                if held >= CHUNK_BYTES:
                    for chunk in chunks.values():
                        yield from chunk.stripes()
                    chunks.clear()
                    held = 0
        for chunk in chunks.values():
            yield from chunk.stripes()

    return read.mapInArrow(run, STRIPES)


def frequent_pairs(pairs: DataFrame) -> Broadcast:
    """The bitmap of the pairs (lang, w1, w2); its size does not depend on them."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).to_pandas()
            for lang, rows in table.groupby("lang", sort=False):
                bits = pair_bits(lang, *(hashes(w.encode() for w in rows[c]) for c in ("w1", "w2")))
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], names=["word", "bits"])

    marked = pairs.select("lang", "w1", "w2").mapInArrow(mark, "word bigint, bits bigint")
    found = marked.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**FILTER_BITS bits
    bitmap = np.zeros(1 << FILTER_BITS - 6, "<i8")
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def merged(parts: DataFrame, least: int) -> DataFrame:
    """(lang, k, w1, w2, w3, a): all single words, and the longer phrases that
    occur at least ``least`` times. One shuffle moves whole stripes;
    the counters are added up where they arrive."""
    dealt = parts.repartition("lang", "k", "w1", "w2", "slice")
    entries = dealt.select("lang", "k", "w1", "w2", "slice", F.explode(F.arrays_zip("next", "counts")).alias("e"))
    summed = entries.groupBy("lang", "k", "w1", "w2", "slice", F.col("e.next").alias("next")).agg(F.sum("e.counts").alias("a"))
    kept = summed.where((F.col("k") == 0) | (F.col("a") >= least))
    return cut_lineage(kept.select(
        "lang", "k", F.coalesce("w1", "next").alias("w1"),
        F.when(F.col("k") > 0, F.coalesce("w2", "next")).alias("w2"), F.when(F.col("k") == 2, F.col("next")).alias("w3"), "a"), "phrases")


def _wide(count: str) -> Column:
    return F.col(count).cast("decimal(13,0)")


def _score(left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) without overflow: at most 35 digits."""
    square = (_wide("a") * _wide("a")).cast("decimal(26,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", square, _wide(left) * _wide(right)).cast("bigint")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A candidate is a phrase of two or three words that occurs ``least`` times. Its
    cuts into two parts with l and r occurrences score floor(1000000 a a / (l r));
    the lowest score counts, and of equal ones the first cut. Candidates inside a
    longer candidate with at least half their occurrences are dropped."""
    read = _read(docs, text_col, lang_col)
    hot = hot_words(read)
    phrases = merged(stripes(read, hot), least)
    words = phrases.where("k = 0").select("lang", F.col("w1").alias("word"), F.col("a").alias("f"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))  # one row per language
    words = words.where(F.col("f") >= least)
    pairs = phrases.where("k = 1").drop("k", "w3")
    triples = merged(stripes(read, hot, frequent_pairs(pairs)), least).drop("k")

    # The largest count of a longer candidate around each pair.
    around = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    around = around.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(around, ["lang", "w1", "w2"], "left")
    pair_counts = pairs.select("lang", "w1", "w2", F.col("a").alias("f"))
    pairs = pairs.where(F.coalesce(100 * F.col("longer") < 50 * F.col("a"), F.lit(True))).drop("longer")

    def counted(rows: DataFrame, word: str, name: str) -> DataFrame:
        known = words.withColumnsRenamed({"word": word, "f": name})
        return salted_join(rows, known, ["lang", word], "inner", spread_by=("w1", "w2"))

    scored = counted(counted(pairs, "w1", "l"), "w2", "r").withColumn("score", _score("l", "r"))
    scored = scored.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    long = counted(counted(triples, "w1", "l1"), "w3", "r2")
    long = long.join(pair_counts.withColumnRenamed("f", "l2"), ["lang", "w1", "w2"])
    long = long.join(pair_counts.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1")), ["lang", "w2", "w3"])
    long = long.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    long = long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                       F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                       F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))

    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES))
    ranked = scored.unionByName(long).withColumn("slice", part)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
