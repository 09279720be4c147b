"""Repeated byte strings by induced suffix sorting of the places that can repeat.

Every LENGTH-byte window holds a local minimum of the hashes of its GRAM-byte
strings; equal windows hold the same one. These anchors, with the hash of all
that their windows can reach, say which places are certain repeats and which
still have to be compared (see ``anchors``). Only the latter, usually a few
percent of the text, are suffix sorted: their contexts are dealt to shards by
anchor, so that equal windows always meet. A shard is sorted by induction:
suffixes that begin a local minimum (LMS) are sorted as a shorter string of
names, recursively, and then induce all others in two sweeps over queues per
first byte. The queues hold suffix positions and move to disk when they grow
past QUEUE_ITEMS. Neighbours in suffix order with a common prefix of LENGTH
bytes are equal windows, and all but the earliest are repeats. (Common prefixes
are compared on the sorted order, eight bytes at a time, instead of being
carried through the queues: only whether they reach LENGTH matters.)

A byte is removed if a LENGTH-byte string over it also starts earlier, in a
smaller document or before in the same one.

Defined cases: a null text is empty; rows without an id come after all ids; rows
that share an id are parts of one document, ordered by a hash of their text, and
equal rows do not repeat each other; texts of any length are read whole; an
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import covered, keyed, mixed, pack

LENGTH = 100
GRAM = 24
REACH = LENGTH - GRAM  # a window starts at most so many bytes before its anchor
HALF = anchors.half_reach(REACH)
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 19
SHARD_BYTES = 1 << 20
QUEUE_ITEMS = 1 << 26
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_values: list[np.ndarray] = []


# -- hashes -----------------------------------------------------------------
class RangeHash:
    """Hashes of arbitrary byte ranges: sums of value times power, shifted back
    by the inverse power, modulo 2**64. Code 256 is padding and counts as nothing."""

    def __init__(self, codes: np.ndarray):
        if not _values:
            _values.append(np.concatenate([np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1), np.zeros(1, np.uint64)]))
        n = len(codes) + 1
        if not _powers or len(_powers[0]) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse)]
        self.back = _powers[1]
        self.sums = np.zeros(n, np.uint64)
        np.add.accumulate(_values[0][codes] * _powers[0][: n - 1], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + size], by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchor_places(hashes: np.ndarray, window_ok: np.ndarray) -> np.ndarray:
    """Positions that are a minimum of some allowed window of REACH + 1 hashes."""
    size = REACH + 1
    order = (hashes >> np.uint64(33)).astype(np.int32)
    low = np.where(window_ok[: len(order) - size + 1], _sliding(order, size, np.minimum), -1)
    edge = np.full(size - 1, -1, np.int32)
    best = _sliding(np.concatenate([edge, low, edge]), size, np.maximum)
    return np.flatnonzero(best == order)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts with padding (256) around each, starts, sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    gap = np.full(REACH + LENGTH, 256, np.uint16)
    parts = [gap[:REACH]]
    for t in texts:
        parts += [np.frombuffer(t, np.uint8).astype(np.uint16), gap]
    starts = REACH + np.concatenate([[0], np.cumsum(sizes[:-1] + REACH + LENGTH)])
    return np.concatenate(parts), starts, sizes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[bytes]]]:
    rows, texts, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                texts.append(anchors.take_text(row))
                rows.append(row)
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield rows, texts
                    rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def anchor_rows(keyed_docs: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    hot = np.zeros(0, np.int64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for rows, texts in _chunks(batches):
            fit = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
            if not fit:
                continue
            codes, starts, sizes = _joined([texts[i] for i in fit])
            hashed = RangeHash(codes)
            ok = covered(starts, starts + sizes - LENGTH + 1, len(codes))
            place = anchor_places(hashed.all(GRAM), ok)
            owner = np.searchsorted(starts, place, "right") - 1
            doc = np.array([rows[i]["doc"] for i in fit], np.int64)[owner]
            tag = np.array([rows[i]["tag"] for i in fit], np.int64)[owner]
            held.append((
                hashed.at(place, GRAM).view(np.int64), hashed.at(place - REACH, REACH + LENGTH).view(np.int64),
                doc, pack(tag, place - starts[owner]),
                anchors.sides_of(hashed.at(place - HALF, GRAM + HALF), hashed.at(place, LENGTH - HALF + 1)),
            ))
            count += len(place)
            if count >= CHUNK_ROWS:
                yield anchors.settle_early(*map(np.concatenate, zip(*held, strict=True)), hot, True)
                held, count = [], 0
        if held:
            yield anchors.settle_early(*map(np.concatenate, zip(*held, strict=True)), hot, True)

    return keyed_docs.select("text", "doc", "tag").mapInArrow(run, anchors.ROWS)


# -- induced suffix sorting -------------------------------------------------
class Queue:
    """First-in first-out suffix positions, on disk beyond a share of QUEUE_ITEMS."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.held, self.file = keep, [], 0, None

    def add(self, positions: np.ndarray) -> None:
        if self.held + len(positions) > self.keep:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.parts = [p if isinstance(p, tuple) else self._write(p) for p in [*self.parts, positions]]
            self.held = 0
        else:
            self.parts.append(positions)
            self.held += len(positions)

    def _write(self, p: np.ndarray) -> tuple[int, int]:
        at = self.file.seek(0, 2)
        p.astype(np.int64).tofile(self.file)
        self.file.flush()
        return at, len(p)

    def take(self) -> np.ndarray:
        """Everything in the queue, which is empty afterwards."""
        out = []
        for p in self.parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                p = np.fromfile(self.file, np.int64, p[1])
            out.append(p)
        self.parts, self.held = [], 0
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order (or, for ordering
    LMS substrings, in any order)."""
    keep = max(1, QUEUE_ITEMS // size)

    def deal(queues: list[Queue], positions: np.ndarray) -> None:
        if not len(positions):
            return
        chars = text[positions]
        order = np.argsort(chars, kind="stable")
        counts = np.bincount(chars, minlength=size)
        used = np.flatnonzero(counts)
        for c, part in zip(used.tolist(), np.split(positions[order], np.cumsum(counts[used])[:-1]), strict=True):
            queues[c].add(part)

    seeds = [Queue(keep) for _ in range(size)]
    deal(seeds, lms)
    waiting, larger = [Queue(keep) for _ in range(size)], [Queue(keep) for _ in range(size)]
    for c in range(size):  # larger-type suffixes, smallest first
        while len(batch := waiting[c].take()):
            larger[c].add(batch)
            before = batch[batch > 0] - 1
            if len(before := before[~is_s[before]]):
                deal(waiting, before)
        batch = seeds[c].take()
        if len(before := batch[batch > 0] - 1):
            deal(waiting, before)
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):  # smaller-type suffixes, largest first
        while len(batch := waiting[c].take()):
            out.append(batch)
            before = batch[batch > 0] - 1
            if len(before := before[is_s[before]]):
                deal(waiting, before)
        if len(batch := larger[c].take()[::-1]):
            out.append(batch)
            before = batch[batch > 0] - 1
            if len(before := before[is_s[before]]):
                deal(waiting, before)
    out.append(np.array([len(text) - 1]))  # nothing induces the end, which is the smallest
    return np.concatenate(out)[::-1]


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over a large alphabet, to a depth of at
    least LENGTH names."""
    n, rank, depth = len(names), names.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - depth)] = rank[depth:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        depth *= 2
        if depth >= LENGTH or rank[order[-1]] == n - 1:
            return order


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative codes, right to a depth of LENGTH at
    least; the last code must be a zero, and no other zero may come before it directly."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    changes = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(changes[::-1])[::-1]
    is_s = np.concatenate([np.concatenate([step, [1]])[nearest] > 0, [True]])
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    size = int(text.max()) + 1
    order = _induce(text, is_s, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # Names: neighbouring LMS substrings are equal if length and bytes are.
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, n)
    sums = RangeHash(text).sums if size <= 257 else _wide_sums(text)
    begin, end = order, ends[index[order]]
    content = (sums[end] - sums[begin]) * _powers[1][begin]
    new = np.concatenate([[False], (content[1:] != content[:-1]) | ((end - begin)[1:] != (end - begin)[:-1])])
    names = np.empty(len(lms), np.int64)
    names[index[order]] = np.cumsum(new)
    if new.sum() < len(lms) - 1:
        reduced = suffix_order(names) if names.max() < 256 and len(names) > 64 else _by_doubling(names)
        order = lms[reduced]
    return _induce(text, is_s, order, size)


def _wide_sums(text: np.ndarray) -> np.ndarray:
    RangeHash(np.zeros(len(text), np.int64))  # makes the powers long enough
    return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed(text.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(text)])])


def repeated_windows(contexts: list[bytes], docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(doc, place) rows of the windows in the contexts that also start earlier.
    ``places`` is where each context starts in its document."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    # A zero ends each context; bytes move up by one to keep it apart.
    text = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1
    text = np.insert(text, np.cumsum(sizes), 0)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    allowed = covered(starts, np.maximum(starts, starts + sizes - LENGTH + 1), len(text))
    order = suffix_order(text)
    order = order[allowed[order]]
    if not len(order):
        return np.zeros((0, 2), np.int64)
    owner = np.searchsorted(starts, order, "right") - 1
    doc, place = docs[owner], places[owner] + order - starts[owner]
    # Common prefix of at least LENGTH with the suffix before, a few codes at a time.
    alike = np.flatnonzero(order[1:] >= 0)
    for k in range(0, LENGTH, 4):
        if not len(alike):
            break
        a, b = order[alike], order[alike + 1]
        same = text[a + k] == text[b + k]
        for j in range(k + 1, min(k + 4, LENGTH)):
            same &= text[a + j] == text[b + j]
        alike = alike[same]
    new = np.ones(len(order), bool)
    new[alike + 1] = False
    group = np.cumsum(new) - 1
    by = np.lexsort((place, doc, group))
    first = by[np.concatenate([[True], group[by][1:] != group[by][:-1]])]
    later = (doc != doc[first][group]) | (place != place[first][group])
    return np.unique(np.stack([doc[later], place[later]], axis=1), axis=0)


# -- Spark ------------------------------------------------------------------
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _starts(marks: list[int] | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(settled starts, open starts, open anchors) of a text of n bytes."""
    return anchors.window_starts(marks, n, LENGTH, REACH)


def _result(doc_id: int | None, text: bytes, starts: np.ndarray) -> dict:
    at = np.flatnonzero(starts)
    gone = covered(at, at + LENGTH, len(text))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
    cuts = [0, *edges, len(text)]
    kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(edges) // 2, "kept": kept}


def remove_repeats(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row.
    ``target`` is a new shared folder for what passes between the two steps."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    sample = anchor_rows(rows.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(anchors.SAMPLE)) == 0))
    hot = anchors.hot_anchors(sample)
    marks = anchors.per_document(anchors.decide(anchor_rows(rows, hot), within=True))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    result = RESULT + ", kept binary" * with_text
    carried = "doc bigint, tag int, packed binary, marks array<bigint>, open boolean"

    def digest(made: list[dict]) -> list[pa.Array]:
        out = [pa.array([m[k] for m in made], pa.int64()) for k in names[:4]]
        out.append(pa.array([hashlib.sha256(m["kept"]).hexdigest() for m in made], pa.string()))
        return out + [pa.array([m["kept"] for m in made], pa.binary())] * with_text

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish texts without open windows; pass the others on."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made, extra = [], {"doc": [], "tag": [], "packed": [], "marks": [], "open": []}
                for row in batch.slice(at, 256).to_pylist():
                    text = row["text"].encode("utf-8", "replace")
                    sure, maybe, _ = _starts(row["marks"], len(text))
                    left = bool(maybe.any())
                    made.append({"doc_id": row["doc_id"], "n_bytes": 0, "n_removed": 0, "n_spans": 0, "kept": b""} if left else _result(row["doc_id"], text, sure))
                    for k in ("doc", "tag", "marks"):
                        extra[k].append(row[k] if left else None)
                    extra["packed"].append(anchors.packed_text(row["text"]) if left else None)
                    extra["open"].append(left)
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [*digest(made), *[pa.array(v, k) for v, k in zip(extra.values(), kinds, strict=True)]], names=[*names, *extra]
                )

    joined = rows.join(marks, ["doc", "tag"], "left").select("doc_id", "doc", "tag", "text", "marks")
    joined.mapInArrow(first, f"{result}, {carried}").write.partitionBy("open").parquet(target)
    stored = spark.read.schema(f"{result}, {carried}").parquet(target)
    undecided = stored.where("open").select("doc_id", "doc", "tag", "packed", "marks")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per open anchor: the bytes of its windows that are not settled."""
        for part, texts in _chunks(batches):
            codes, begins, _ = _joined(texts)
            hashed = RangeHash(codes)
            made: list[list] = [[], [], [], []]
            for row, text, begin in zip(part, texts, begins.tolist(), strict=True):
                _, maybe, spans = _starts(row["marks"], len(text))
                seen = np.concatenate([[0], np.cumsum(maybe)])
                anchored, low, high = spans[:, 0], spans[:, 1], spans[:, 2] + 1
                live = seen[high] > seen[low]
                anchored, low, high = anchored[live], low[live], high[live]
                at = np.flatnonzero(maybe)
                low = at[np.searchsorted(at, low)]
                high = at[np.searchsorted(at, high) - 1] + LENGTH
                made[0] += hashed.at(begin + anchored, GRAM).view(np.int64).tolist()
                made[1] += [row["doc"]] * len(anchored)
                made[2] += pack(np.full(len(anchored), row["tag"]), low).tolist()
                made[3] += [text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            if made[0]:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(m, pa.int64()) for m in made[:3]], pa.array(made[3], pa.binary())], names=["ahash", "doc", "at", "context"]
                )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor: whole anchors are gathered to shards and sorted.
        Repeats come out as runs of starts."""
        group: list[tuple[int, int, bytes]] = []
        shard: list[tuple[int, int, bytes]] = []
        held, current = 0, None

        def solve() -> Iterator[pa.RecordBatch]:
            if shard:
                d, t, c = zip(*shard, strict=True)
                found = repeated_windows(list(c), np.array(d, np.int64), np.array(t, np.int64))
                shard.clear()
                if len(found):
                    new = np.concatenate([[True], (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1] + 1)])
                    first = np.flatnonzero(new)
                    size = np.diff(np.append(first, len(found)))
                    yield pa.RecordBatch.from_arrays([pa.array(found[first, 0]), pa.array(found[first, 1]), pa.array(size)], names=["doc", "at", "size"])

        for batch in batches:
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != current:
                    if len(group) > 1:
                        shard += group
                        held += sum(len(g[2]) for g in group)
                    group, current = [], key
                    if held >= SHARD_BYTES:
                        yield from solve()
                        held = 0
                group.append(tuple(row))
        if len(group) > 1:
            shard += group
        yield from solve()

    dealt = undecided.select("doc", "tag", "packed", "marks").mapInArrow(contexts, "ahash bigint, doc bigint, at bigint, context binary")
    sorted_shards = dealt.repartition("ahash").sortWithinPartitions("ahash", "doc", "at")
    runs = sorted_shards.mapInArrow(shards, "doc bigint, at bigint, size bigint")
    place = F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("first"), "size")
    repeats = runs.groupBy("doc", F.shiftright("at", 32).cast("int").alias("tag")).agg(F.collect_list(place).alias("starts"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = []
                for row in batch.slice(at, 256).to_pylist():
                    text = anchors.take_text(row)
                    sure = _starts(row["marks"], len(text))[0]
                    for run in row["starts"] or []:
                        sure[run["first"] : run["first"] + run["size"]] = True
                    made.append(_result(row["doc_id"], text, sure))
                yield pa.RecordBatch.from_arrays(digest(made), names=names)

    late = undecided.join(repeats, ["doc", "tag"], "left").select("doc_id", "packed", "marks", "starts").mapInArrow(second, result)
    return stored.where("not open").select(*names).unionByName(late)
