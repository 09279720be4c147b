"""Token-id files coded with a static range asymmetric numeral system.

Documents are range-partitioned by id, each task encodes its range in order and
closes a file whenever it holds ``FILE_TOKENS`` ids, so memory is bounded by one
file and its last document. A file has one frequency table shared by all of its
blocks. A block is a fixed number of ids spread over interleaved lanes; the file
directory keeps for every block where its words end (the checkpoint from which
it can be decoded alone) and a CRC-32 of its ids. All blocks of a file are coded
side by side in NumPy.

Files are rows of a Parquet table that Spark commits, so a lost executor leaves
no half file and any store that Spark reaches will do.

File bytes: the 8-byte mark, a header of five unsigned 64-bit integers (ids,
documents, blocks, steps of a block, bytes of the packed tables), the zlib-packed
tables (frequencies, lengths of documents, null flags and ids of documents,
ends of blocks, checksums), lane states, words. Everything is little-endian.

Defined cases: a null text counts as empty and yields the end id only; a null id
comes first; repeated ids are ordered by text; a document of any length stays in
one file; an empty table gives an empty table of files. Only the id and text
columns are read.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"SWRANS1\n"
HEADER = struct.Struct("<5Q")
LANES = 128
STEPS = 512
SCALE = 20  # frequencies of a table sum to 2 ** SCALE
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
FILE_TOKENS = 1 << 22
CACHED_PIECES = 1_000_000
# Cutting before a space that a visible character follows never changes the ids.
_CUT = re.compile(r" (?=\S)")
#: After letters, each of these is a token sequence of its own.
_ENDINGS = ".,;:!?"


# -- coder ------------------------------------------------------------------
def frequencies(ids: np.ndarray, size: int) -> np.ndarray:
    """Counts scaled to the table's sum; every id that occurs keeps at least one."""
    counts = np.bincount(ids, minlength=size)
    present = counts > 0
    free = (1 << SCALE) - int(present.sum())
    if free < 0:
        raise ValueError("more different ids than the table can tell apart")
    out = np.where(present, 1 + counts * free // max(1, len(ids)), 0)
    out[np.argmax(counts)] += (1 << SCALE) - out.sum()
    return out.astype(np.uint32)


def encode_blocks(ids: np.ndarray, freq: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, words, ends): final lane states, the words of all blocks one
    block after the other, and the end of each block's words."""
    blocks = -(-len(ids) // (LANES * steps))
    padded = np.full(blocks * steps * LANES, int(np.argmax(freq)), np.int64)
    padded[: len(ids)] = ids
    padded = padded.reshape(blocks, steps, LANES)
    cumulative = (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
    wide = freq.astype(np.uint64)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words, owners = [], []
    for step in range(steps - 1, -1, -1):
        symbol = padded[:, step, :]
        f = wide[symbol]
        full = state >= f << np.uint64(63 - SCALE)
        if full.any():
            words.append((state[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owners.append(np.nonzero(full)[0].astype(np.uint16))
            state = np.where(full, state >> np.uint64(32), state)
        whole = state // f
        state = (whole << np.uint64(SCALE)) + (state - whole * f) + cumulative[symbol]
    if not words:
        return state, np.zeros(0, np.uint32), np.zeros(blocks, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return state, np.concatenate(words)[order], np.cumsum(np.bincount(owner, minlength=blocks))


def decode_blocks(
    state: np.ndarray, words: np.ndarray, ends: np.ndarray, freq: np.ndarray, steps: int
) -> np.ndarray:
    """Ids of the given blocks, (blocks, steps * LANES); any subset of a file's
    blocks will do, with ``ends`` pointing into ``words``."""
    cumulative = (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
    wide = freq.astype(np.uint64)
    symbol_at = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.int32), freq)
    mask = np.uint64((1 << SCALE) - 1)
    at = ends.astype(np.int64)
    out = np.empty((len(state), steps, LANES), np.uint32)
    state = state.copy()
    for step in range(steps):
        slot = state & mask
        symbol = symbol_at[slot]
        out[:, step, :] = symbol
        state = wide[symbol] * (state >> np.uint64(SCALE)) + slot - cumulative[symbol]
        empty = state < LOW
        taken = empty.sum(axis=1)
        if taken.any():
            at = at - taken
            where = (np.cumsum(empty, axis=1) - 1 + at[:, None])[empty]
            state[empty] = state[empty] << np.uint64(32) | words[where]
    return out.reshape(len(state), -1)


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, size: int) -> bytes:
    steps = max(1, min(STEPS, -(-len(ids) // LANES)))
    freq = frequencies(ids, size)
    state, words, ends = encode_blocks(ids, freq, steps)
    crcs = [zlib.crc32(ids[i : i + LANES * steps].astype("<u4").tobytes()) for i in range(0, len(ids), LANES * steps)]
    tables = zlib.compress(b"".join([
        freq.astype("<u4").tobytes(), lengths.astype("<i8").tobytes(),
        bytes(i is None for i in doc_ids), np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        ends.astype("<i8").tobytes(), np.array(crcs, "<u4").tobytes(),
    ]), 1)
    header = HEADER.pack(len(ids), len(doc_ids), len(ends), steps, len(tables))
    return b"".join([MARK, header, struct.pack("<I", size), tables, state.astype("<u8").tobytes(), words.astype("<u4").tobytes()])


def unpack_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their lengths, all ids); a wrong checksum raises."""
    if content[:8] != MARK:
        raise ValueError("not a token file")
    n, docs, blocks, steps, packed = HEADER.unpack_from(content, 8)
    size = struct.unpack_from("<I", content, 8 + HEADER.size)[0]
    at = 12 + HEADER.size
    tables = zlib.decompress(content[at : at + packed])
    parts, k = [], 0
    for kind, count in (("<u4", size), ("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", blocks), ("<u4", blocks)):
        parts.append(np.frombuffer(tables, kind, count, k))
        k += parts[-1].nbytes
    freq, lengths, null, doc_ids, ends, crcs = parts
    state = np.frombuffer(content, "<u8", blocks * LANES, at + packed).reshape(blocks, LANES)
    words = np.frombuffer(content, "<u4", -1, at + packed + state.nbytes)
    ids = decode_blocks(state, words, ends, freq, steps).reshape(-1)[:n]
    for b, crc in enumerate(crcs):
        if zlib.crc32(ids[b * LANES * steps : (b + 1) * LANES * steps].tobytes()) != crc:
            raise ValueError(f"block {b} is damaged")
    return [None if z else int(i) for z, i in zip(null, doc_ids, strict=True)], lengths, ids


# -- ids of texts -----------------------------------------------------------
class PieceEncoder:
    """Ids of the tokenizers library; a piece between spaces is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.token_bytes = np.array([len(self.library.id_to_token(i)) for i in range(self.size)], np.int64)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.endings = {c: np.array(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in _ENDINGS}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _learn(self, table: dict[str, bytes], pieces: list[str], lead: str) -> None:
        """Encode new pieces in one call of the library. Later pieces stay apart
        because each begins with a space; the first pieces go one by one."""
        if not pieces:
            return
        joined = [lead + p for p in pieces]
        ids = np.array(self.library.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, "<u4")
        # No token reaches over a cut, and tokens spell the text byte by byte.
        until = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in joined])
        ends = ((np.searchsorted(np.cumsum(self.token_bytes[ids]), until) + 1) * 4).tolist()
        raw, at = ids.tobytes(), 0
        for piece, end in zip(pieces, ends, strict=True):
            table[piece] = raw[at:end]
            at = end

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text with the end id, as unsigned 32-bit arrays."""
        for name in ("first", "later"):
            if len(getattr(self, name)) > CACHED_PIECES:  # pieces met early are the frequent ones
                setattr(self, name, dict(itertools.islice(getattr(self, name).items(), CACHED_PIECES // 2)))
        # An added token in a text changes how the white space before it is cut.
        whole = [self.added is not None and "<|" in t and bool(self.added.search(t)) for t in texts]
        cut = [[] if w else _CUT.split(t) for t, w in zip(texts, whole, strict=True)]
        first, later = self.first, self.later
        for piece in {c[0] for c in cut if c}.difference(first):
            self._learn(first, [piece], "")
        new = set(itertools.chain.from_iterable(c[1:] for c in cut)).difference(later)
        ended = [p for p in new if p[-1] in self.endings and p[:-1].isalpha()]
        self._learn(later, list(new.difference(ended).union({p[:-1] for p in ended}.difference(later))), " ")
        later.update((p, later[p[:-1]] + self.endings[p[-1]]) for p in ended)
        mark, out = np.array([end], "<u4").tobytes(), []
        for text, pieces, w in zip(texts, cut, whole, strict=True):
            if w:
                raw = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + mark
            else:
                raw = b"".join([first[pieces[0]], *map(later.__getitem__, pieces[1:]), mark])
            out.append(np.frombuffer(raw, "<u4"))
        return out


_loaded: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


# -- Spark ------------------------------------------------------------------
FILES = "part int, first_token bigint, n_tokens bigint, content binary"
_STEP = 64


def write_files(
    docs: DataFrame, path: str, target: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, file_tokens: int = FILE_TOKENS,
) -> None:
    """Encode every text, end it with ``end_id`` and write the files in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        part, first, held, names = TaskContext.get().partitionId(), 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal first
            ids = np.concatenate(held)
            row = {
                "part": [part], "first_token": [first], "n_tokens": [len(ids)],
                "content": [pack_file(names, np.array([len(h) for h in held]), ids, encoder.size)],
            }
            first += len(ids)
            held.clear()
            names.clear()
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = batch.slice(at, _STEP)
                coded = encoder.encode([t or "" for t in rows.column(1).to_pylist()], end_id)
                for name, ids in zip(rows.column(0).to_pylist(), coded, strict=True):
                    held.append(ids)
                    names.append(name)
                    waiting += len(ids)
                    if waiting >= file_tokens:
                        waiting = 0
                        yield close()
        if held:
            yield close()

    ordered = docs.select(F.col(id_col).cast("bigint"), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(run, FILES).write.option("compression", "none").parquet(target)


def read_files(spark: SparkSession, source: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files."""
    files = spark.read.schema(FILES).parquet(source)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row per partition
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["part"], before))
        before += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, _, content in zip(*[c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns)], strict=True):
                names, lengths, ids = unpack_file(content.as_py())
                ends = np.cumsum(lengths)
                spans = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()),
                    pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    shift = F.broadcast(spark.createDataFrame(offsets, "part int, before bigint"))
    out = files.mapInArrow(run, schema).join(shift, "part")
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), *out.columns[3:-1])
