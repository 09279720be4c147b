"""Benchmark leaks in documents by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages of about the
item's length, at most PASSAGE words (LEVELS). Their TF-IDF vectors over the benchmark's vocabulary are projected to a
latent space found by a randomised SVD (one pass, Nystrom form): every task adds
up A'(A Omega) over its passages, the sums are small. Passages whose cosine with
a passage of an item reaches the level's limit are checked word by word: the longest
common subsequence of item and surroundings must cover EXACT of the item, or
PARAPHRASE of it if also most words of its answer part are there in order. The
answer part of an item is what follows its last question mark, else its last
sentence.

Document frequencies and the basis of the latent space are fitted on all
documents, and all passages of all documents are searched against all items.
Items are taken in blocks of BLOCK_ITEMS, so what tasks hold is bounded however
large the benchmark is.

Defined cases: a null text has no words; items of fewer than LEAST words cannot
be told from chance and match nothing; repeated items match alike; a row without
an id is reported with a null id; equal rows are reported once each; texts are
read whole; an empty table on either side gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, drop_table

STRIDE = 16
PASSAGE = 2 * STRIDE
#: Passage lengths searched and their strides, each by the items of fewer words than
#: the limit (the last takes all others), with the cosine that makes a candidate.
LEVELS = ((8, 2, 12, 0.4), (16, 8, 25, 0.5), (PASSAGE, STRIDE, None, 0.6))
RANK, OVERSAMPLING = 96, 32
EXACT, PARAPHRASE, ANSWER = 0.8, 0.6, 0.5
LEAST = 5
BLOCK_ITEMS = 5_000
SEED = 7
#: Passages added up at a time while the basis is fitted, and words searched at a time.
PASSAGES, SECTION = 2048, 512
# ASCII characters other than letters and digits separate words.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def lcs(a_masks: dict[bytes, int], size: int, other: list[bytes]) -> int:
    """Length of the longest common subsequence; bit-parallel over ``a``, whose
    words are given as masks of their positions."""
    full = (1 << size) - 1
    row = full
    for w in other:
        if m := a_masks.get(w):
            u = row & m
            row = (row + u) | (row - u)
    return size - (row & full).bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]
    masks: dict[bytes, int] = field(default_factory=dict)
    answer_masks: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def of(cls, item_id: int | None, text: str | None) -> Item:
        text = text or ""
        tail = text.rpartition("?")[2] if "?" in text else re.split(r"[.!]\s+", text.strip(" .!\n\t"))[-1]
        words, answer = words_of(text), words_of(tail)
        return cls(item_id, words, answer, masks_of(words), masks_of(answer))

    def score(self, doc: list[bytes], low: int, high: int) -> float:
        """Best covered share of the item in doc[low:high], 0 if it is no leak."""
        n, best = len(self.words), 0.0
        around = doc[max(0, low - n) : high + n]
        # Item words that are there at all bound the common subsequence.
        if sum(map(set(around).__contains__, self.words)) < PARAPHRASE * n or lcs(self.masks, n, around) < PARAPHRASE * n:
            return 0.0
        reach, step = n + n // 4 + 1, max(1, n // 8)
        for at in range(0, max(1, len(around) - reach + step), step):
            part = around[at : at + reach]
            share = lcs(self.masks, n, part) / n
            if share >= EXACT or (share >= PARAPHRASE and lcs(self.answer_masks, len(self.answer), part) >= ANSWER * len(self.answer)):
                best = max(best, share)
        return best


class Space:
    """Vocabulary, weights and latent vectors of one block of items."""

    def __init__(self, items: list[Item]):
        self.items = [i for i in items if len(i.words) >= LEAST]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for i in self.items for w in i.words))}
        self.idf = np.ones(len(self.vocabulary))
        self.terms = np.zeros((0, 0), np.float32)  # idf times basis, one row per term and a zero row
        self.queries: list[np.ndarray] = []  # of each level
        self.query_item: list[np.ndarray] = []
        self.lengths = np.array([len(i.words) for i in self.items], np.int64)
        self.item_terms = self.numbers([w for i in self.items for w in i.words])
        self.item_of = np.repeat(np.arange(len(self.items)), self.lengths)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get, size = self.vocabulary.get, len(self.vocabulary)
        return np.fromiter([get(w, size) for w in words], np.int64, len(words))

    def rows(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, unit TF-IDF weights) of each passage that has any."""
        for at in range(0, max(1, len(numbers) - STRIDE), STRIDE):
            part = numbers[at : at + PASSAGE]
            terms, tf = np.unique(part[part < len(self.vocabulary)], return_counts=True)
            if len(terms):
                x = tf * self.idf[terms]
                yield terms, x / np.sqrt(x @ x)

    def add_passages(self, sums: np.ndarray, numbers: np.ndarray, omega: np.ndarray, lengths: np.ndarray | None = None) -> int:
        """Add x' (x omega) of every passage x of ``rows`` to ``sums``; how many there are.
        ``numbers`` holds one document, or several of the given lengths."""
        size, added = len(self.vocabulary), 0
        lengths = np.array([len(numbers)]) if lengths is None else lengths
        own = -(-lengths // STRIDE)
        after = np.cumsum(own + 1)  # an empty block ends each document
        term = np.full(int(after[-1]) * STRIDE, size)
        term[np.arange(len(numbers)) + np.repeat((after - own - 1) * STRIDE - np.cumsum(lengths) + lengths, lengths)] = numbers
        term = term.reshape(-1, STRIDE)
        begins = np.ones(len(term), bool)  # a passage begins at each block but a document's last, if it has several
        begins[after - 1] = False
        begins[(after - 2)[own > 1]] = False
        weighted = np.concatenate([self.idf[:, None] * omega, np.zeros((1, omega.shape[1]))])  # a zero row for other words
        squared = np.append(self.idf * self.idf, 0.0)
        for first in range(0, len(term) - 1, PASSAGES):
            here = term[first : first + PASSAGES + 1]
            many = len(here) - 1
            known = np.flatnonzero(here < size)
            if not len(known):
                continue
            words, block = here.ravel()[known], known // STRIDE
            one = np.bincount(block, squared[words], many + 1)
            norm = one[:-1] + one[1:]  # and twice each pair of equal words of a passage
            pair = np.sort(np.concatenate([here[:-1], here[1:]], axis=1), axis=1)
            passage, slot = np.nonzero((pair[:, 1:] == pair[:, :-1]) & (pair[:, 1:] < size))
            pair, at, step = pair.ravel(), passage * PASSAGE + slot, 1
            while len(at):
                norm += 2 * np.bincount(at // PASSAGE, squared[pair[at]], many)
                step += 1
                at = at[at % PASSAGE + step < PASSAGE]
                at = at[pair[at] == pair[at + step]]
            valid = begins[first : first + many] & (norm > 0)
            added += int(valid.sum())
            projected = weighted[here[:, 0]]
            for k in range(1, STRIDE):
                projected += weighted[here[:, k]]
            projected[:-1] += projected[1:]
            projected[:-1] *= np.where(valid, 1 / np.where(valid, norm, 1), 0)[:, None]
            projected[-1] = 0
            projected[1:] += projected[:-1].copy()  # a word stands in the passages of its block and the one before
            present = np.flatnonzero(np.bincount(words, minlength=size))
            place = np.zeros(size, np.int64)
            place[present] = np.arange(len(present))
            place = place[words]
            columns = [np.bincount(place, column.take(block), len(present)) for column in np.ascontiguousarray(projected.T)]
            sums[present] += self.idf[present, None] * np.array(columns).T
        return added

    def random(self) -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((len(self.vocabulary), min(len(self.vocabulary), RANK + OVERSAMPLING)))

    def settle(self, sums: np.ndarray, passages: float) -> None:
        """Basis from the documents' sums and the items, then the items' vectors."""
        omega = self.random()
        own = [r for i in self.items for r in self.rows(self.numbers(i.words))]
        weight = max(1.0, passages / max(1, len(own)))  # items and documents count alike
        sums = sums.copy()
        for terms, x in own:
            sums[terms] += weight * np.outer(x, x @ omega[terms])
        shift = np.sqrt(len(omega)) * np.finfo(float).eps * np.linalg.norm(sums)
        sums += shift * omega
        core = omega.T @ sums
        half = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.trace(core) * np.eye(len(core)))
        basis = np.linalg.svd(np.linalg.solve(half, sums.T).T, full_matrices=False)[0][:, :RANK]
        self.terms = np.concatenate([self.idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
        least = 0
        for passage, stride, limit, _ in LEVELS:
            mine = [k for k, i in enumerate(self.items) if least <= len(i.words) and (limit is None or len(i.words) < limit)]
            found = [(k, v) for k in mine for v in self.latent(self.blocks(self.numbers(self.items[k].words), stride), passage // stride)]
            self.query_item.append(np.array([k for k, _ in found], np.int64))
            self.queries.append(np.array([v for _, v in found], np.float32))
            least = limit

    def possible(self, numbers: np.ndarray) -> np.ndarray:
        """Which items can be covered at all: enough of their words are among these."""
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[numbers] = True
        held = np.bincount(self.item_of[there[self.item_terms]], minlength=len(self.items))
        return held >= PARAPHRASE * self.lengths

    def blocks(self, numbers: np.ndarray, stride: int) -> np.ndarray:
        """Latent vectors of every ``stride`` words, added up."""
        padded = np.full(-(-len(numbers) // stride) * stride, len(self.vocabulary))  # the last row of terms is zero
        padded[: len(numbers)] = numbers
        return sum(self.terms[padded[k::stride]] for k in range(stride))

    def latent(self, blocks: np.ndarray, many: int) -> np.ndarray:
        """Unit latent vectors of the passages of ``many`` blocks each."""
        if many := min(many, len(blocks)):
            blocks = sum(blocks[k : len(blocks) - many + 1 + k] for k in range(many))
        norm = np.sqrt(np.einsum("ij,ij->i", blocks, blocks))
        return blocks / np.where(norm > 0, norm, 1)[:, None]

    def search(self, numbers: np.ndarray, start: int, possible: np.ndarray, spans: list[dict[int, set[int]]]) -> None:
        """Add the places of passages whose cosine with a possible item is high enough."""
        blocks, block = None, 0
        for (size, stride, _, candidate), queries, query_item, found in zip(LEVELS, self.queries, self.query_item, spans, strict=True):
            asked = np.flatnonzero(possible[query_item])
            if not len(asked):
                continue
            if blocks is None:
                blocks = self.blocks(numbers, stride)
            else:  # blocks of the level before, added up
                step = stride // block
                blocks = np.concatenate([blocks, np.zeros((-len(blocks) % step, blocks.shape[1]), np.float32)])
                blocks = sum(blocks[k::step] for k in range(step))
            block = stride
            if start and len(blocks) < size // stride:
                continue  # the section before searched these words
            near = self.latent(blocks, size // stride) @ queries[asked].T >= candidate
            for passage, k in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                found.setdefault(int(query_item[asked[k]]), set()).add(start + passage * stride)

    def leaks(self, text: str | None) -> list[tuple[int | None, float]]:
        """(item id, covered share) of every item that a document holds."""
        words = words_of(text)
        if not words or not self.items:
            return []
        numbers, longest = self.numbers(words), int(self.lengths.max())
        spans: list[dict[int, set[int]]] = [{} for _ in LEVELS]
        for start in range(0, len(words), SECTION):
            # Words that score() can look at for a passage that starts in this section.
            possible = self.possible(numbers[max(0, start - longest) : start + SECTION + PASSAGE + longest])
            if possible.any():
                self.search(numbers[start : start + SECTION + STRIDE], start, possible, spans)
        best: dict[int, float] = {}
        for (size, *_), found in zip(LEVELS, spans, strict=True):
            for k, places in found.items():
                low = None
                for at in [*sorted(places), None]:
                    if low is not None and (at is None or at > high):
                        best[k] = max(best.get(k, 0.0), self.items[k].score(words, low, high))
                        low = None
                    if at is not None:
                        low, high = at if low is None else low, at + size
        return [(self.items[k].item_id, s) for k, s in sorted(best.items()) if s > 0]


def _sum_rows(frame: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums): rows (key, values) added up by key, at most one per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for key, v in zip(batch.column(0).to_pylist(), values, strict=True):
                total[key] = total[key] + v if key in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["key", "values"])

    rows = frame.repartition("key").mapInArrow(run, "key bigint, values array<double>").collect()
    return np.array([r["key"] for r in rows], np.int64), np.array([r["values"] for r in rows], np.float64).reshape(-1, width)


def fit(docs: DataFrame, items: list[Item], text_col: str = "text") -> Space:
    """Document frequencies over all documents, then the latent space."""
    space = Space(items)
    size = len(space.vocabulary)
    if not size:
        return space
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    code = np.dtype(np.uint16 if size < 1 << 16 else np.uint32)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [space.numbers(words_of(text.as_py())).astype(code).tobytes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.binary())], names=["numbers"])

    # Written, so that texts are cut into words once for both passes.
    coded = cut_lineage(texts.mapInArrow(numbered, "numbers binary"), "numbers")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros(size + 1), 0
        for batch in batches:
            documents += len(batch)
            for numbers in batch.column(0).to_pylist():
                counts[np.unique(np.frombuffer(numbers, code))] += 1
        counts[size] = documents
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["key", "n"])

    counts = np.zeros(size + 1)
    for r in coded.mapInArrow(frequencies, "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most one per term
        counts[r["key"]] = r["n"]
    n_docs = counts[size]
    space.idf = np.log((1 + n_docs) / (1 + counts[:size])) + 1
    width = min(size, RANK + OVERSAMPLING)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, sums, passages = space.random(), np.zeros((size + 1, width)), 0
        for whole in batches:
            for at in range(0, len(whole), 256):
                held = [np.frombuffer(n, code) for n in whole.column(0).slice(at, 256).to_pylist()]
                passages += space.add_passages(sums, np.concatenate(held), omega, np.array([len(n) for n in held]))
        sums[size] = passages
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["key", "values"])

    keys, values = _sum_rows(coded.mapInArrow(sketch, "key bigint, values array<double>"), width)
    drop_table(coded)
    sums = np.zeros((size + 1, width))
    sums[keys] = values
    space.settle(sums[:size], float(sums[size, 0]))
    return space


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Item]]:
    """The items, at most BLOCK_ITEMS at a time on the driver."""
    held = []
    for r in benchmark.select(F.col(id_col).cast("bigint"), text_col).toLocalIterator():
        held.append(Item.of(r[0], r[1]))
        if len(held) == BLOCK_ITEMS:
            yield held
            held = []
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, share): every document that holds an item, and how much of it."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, share double"
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(fit(docs, items, text_col))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for leak in shared.value.leaks(t.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                        names=["doc_id", "item_id", "share"],
                    )

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    spark, where = docs.sparkSession, docs.columns.index(text_col)
    for items in blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(fit(docs, items, text_col))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(t.as_py()) for t in batch.column(where)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
