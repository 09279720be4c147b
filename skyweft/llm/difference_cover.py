"""Repeated word windows across documents by difference-cover anchors.

For every pair of positions there is a shift below the period that moves both of
them onto the cover, so two equal windows always share an anchor: the hash of
ANCHOR words at a cover position of both documents. The anchor's context is all
that windows holding it can reach. Rows of contexts that occurred in a smaller
document are settled (see ``anchors``); from the remaining open anchors the
match is extended: the windows around them, compared by 128-bit hashes.

A window counts as repeated if its words also start in a document with a smaller
id; the words of repeated windows are removed.

Defined cases: a null text has no words; rows without an id come after all ids
and do not repeat each other; rows that share an id do not repeat each other and
are told apart by their text; texts of any length are read whole; repeated
windows inside one document stay; an empty table gives an empty result. Only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import Powers, covered, keyed, mixed, pack

WINDOW = 50
#: A perfect difference set, so that every residue is a difference.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
REACH = WINDOW - ANCHOR  # a window may start up to so many words before its anchor
HALF = anchors.half_reach(REACH)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK_ROWS = 1 << 19
CACHED_WORDS = 400_000
_known: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space (bytes.split cuts exactly there)."""
    return text.encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _known
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w) | 1
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _chunks(batches: Iterator[pa.RecordBatch], words: int = 1 << 18) -> Iterator[tuple[list[dict], list[list[bytes]]]]:
    """Rows and their words, some hundred thousand words at a time."""
    rows, cut, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                cut.append(anchors.take_text(row).split())
                rows.append(row)
                held += len(cut[-1])
                if held >= words:
                    yield rows, cut
                    rows, cut, held = [], [], 0
    if rows:
        yield rows, cut


def _joined(cut: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with zeros around each text, where each text
    starts in them, and its number of words."""
    sizes = np.array([len(c) for c in cut], np.int64)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1] + REACH + WINDOW])) + REACH
    flat = np.zeros(int(sizes.sum()) + len(cut) * (REACH + WINDOW), np.uint64)
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    flat[inside] = word_hashes([w for c in cut for w in c])
    return flat, starts, sizes


def anchor_rows(keyed_docs: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    hot = np.zeros(0, np.int64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for rows, cut in _chunks(batches):
            fit = [i for i, c in enumerate(cut) if len(c) >= WINDOW]
            if not fit:
                continue
            flat, starts, sizes = _joined([cut[i] for i in fit])
            powers = Powers(flat, BASES[0])
            position = np.concatenate([np.arange(n - ANCHOR + 1) for n in sizes])
            owner = np.repeat(np.arange(len(fit)), sizes - ANCHOR + 1)
            on = np.isin(position % PERIOD, COVER)
            position, owner = position[on], owner[on]
            place = starts[owner] + position
            doc = np.array([rows[i]["doc"] for i in fit], np.int64)[owner]
            tag = np.array([rows[i]["tag"] for i in fit], np.int64)[owner]
            ahash = mixed(powers.of(ANCHOR)[place]).view(np.int64)
            chash = mixed(powers.of(REACH + WINDOW)[place - REACH]).view(np.int64)
            left = mixed(powers.of(ANCHOR + HALF)[place - HALF])
            right = mixed(powers.of(WINDOW - HALF + 1)[place])
            held.append((ahash, chash, doc, pack(tag, position), anchors.sides_of(left, right)))
            count += len(ahash)
            if count >= CHUNK_ROWS:
                yield anchors.settle_early(*map(np.concatenate, zip(*held, strict=True)), hot, False)
                held, count = [], 0
        if held:
            yield anchors.settle_early(*map(np.concatenate, zip(*held, strict=True)), hot, False)

    return keyed_docs.select("text", "doc", "tag").mapInArrow(run, anchors.ROWS)


def _starts(marks: list[int] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(settled, open): window starts of a text of n words, as booleans."""
    return anchors.window_starts(marks, n, WINDOW, REACH)[:2]


def _result(doc_id: int | None, words: list[bytes], starts: np.ndarray) -> dict:
    at = np.flatnonzero(starts)
    gone = covered(at, at + WINDOW, len(words))
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
    return {"doc_id": doc_id, "n_words": len(words), "n_removed": int(gone.sum()), "kept": kept}


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row.
    ``target`` is a new shared folder for what passes between the two steps."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    sample = anchor_rows(rows.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(anchors.SAMPLE)) == 0))
    hot = anchors.hot_anchors(sample)
    marks = anchors.per_document(anchors.decide(anchor_rows(rows, hot), within=False))

    def digest(made: list[dict]) -> list[pa.Array]:
        out = [pa.array([m[k] for m in made], pa.int64()) for k in ("doc_id", "n_words", "n_removed")]
        out.append(pa.array([hashlib.sha256(m["kept"]).hexdigest() for m in made], pa.string()))
        if with_text:
            out.append(pa.array([m["kept"].decode() for m in made], pa.string()))
        return out

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    result = RESULT + ", kept string" * with_text
    carried = "doc bigint, tag int, packed binary, marks array<bigint>, open boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish texts without open windows; pass the others on."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made, extra = [], {"doc": [], "tag": [], "packed": [], "marks": [], "open": []}
                for row in batch.slice(at, 256).to_pylist():
                    words = words_of(row["text"])
                    sure, maybe = _starts(row["marks"], len(words))
                    left = bool(maybe.any())
                    made.append({"doc_id": row["doc_id"], "n_words": 0, "n_removed": 0, "kept": b""} if left else _result(row["doc_id"], words, sure))
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

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part, cut in _chunks(batches):
            flat, starts, _ = _joined(cut)
            hashes = [Powers(flat, base).of(WINDOW) for base in BASES]
            for row, words, begin in zip(part, cut, starts.tolist(), strict=True):
                at = np.flatnonzero(_starts(row["marks"], len(words))[1])
                keys = [mixed(h[begin + at]).view(np.int64) for h in hashes]
                held.append((*keys, np.full(len(at), row["doc"]), pack(np.full(len(at), row["tag"]), at), np.zeros(len(at), np.int64)))
                count += len(at)
            if count >= CHUNK_ROWS:
                yield anchors.settle_early(*map(np.concatenate, zip(*held, strict=True)), none, False)
                held, count = [], 0
        if held:
            yield anchors.settle_early(*map(np.concatenate, zip(*held, strict=True)), none, False)

    # The 128-bit window hash takes the places of anchor and context.
    none = np.zeros(0, np.int64)
    opened = undecided.select("doc", "tag", "packed", "marks").mapInArrow(windows, anchors.ROWS)
    repeats = anchors.per_document(anchors.decide(opened, within=False).where(F.col("state") == anchors.SURE)).withColumnRenamed("marks", "starts")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = []
                for row in batch.slice(at, 256).to_pylist():
                    words = anchors.take_text(row).split()
                    sure = _starts(row["marks"], len(words))[0]
                    sure[np.array(row["starts"] or [], np.int64) >> 3] = True
                    made.append(_result(row["doc_id"], words, sure))
                yield pa.RecordBatch.from_arrays(digest(made), names=names)

    late = undecided.join(repeats, ["doc", "tag"], "left").select("doc_id", "packed", "marks", "starts").mapInArrow(second, result)
    return stored.where("not open").select(*names).unionByName(late)
