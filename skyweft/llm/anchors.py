"""Which anchored contexts repeat: shared by both exact substring operators.

Both hash short anchors at positions that equal windows share, together with the
whole context an anchor may vouch for. Rows are (ahash, chash, doc, at): hash of
the anchor, hash of its context, document and place. One shuffle by anchor hash
and one streaming pass decide for every row:

* its context occurred before: *settled*, all of its windows are repeats;
* it is the first with its context, but another context of its anchor goes on
  alike to the left or to the right: *open* on that side, its windows have to be
  compared with those of the other contexts. (A window around an anchor covers
  all of its left or all of its right side, so each row carries 16 bits of a hash
  of either side.)
* there is no such context (or, where only other documents count, none in
  another document): nothing is repeated, and no row comes out.

Hot anchors: every task first settles rows whose context it has already seen, so
a context held by a third of all documents reaches the shuffle once per chunk of
a task; the settled rows travel spread out. Anchors with very many contexts are
found on a fixed share of the documents and spread by context; their first rows
count as open, which is always safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One in so many documents is looked at for hot anchors.
SAMPLE = 64
#: An anchor is hot from this many estimated rows on, and from this share of all.
HOT_ROWS, HOT_SHARE = 20_000, 1 / 2000
NORMAL, HOT, SETTLED = 0, 1, 2
#: States of a place, as bits.
SURE, LEFT, RIGHT = 1, 2, 4
#: Rows of one anchor that are held to compare their sides; beyond, all stay open.
HELD_ROWS = 1 << 20
#: ``flag``: the kind in two bits, then 16 bits each of the left and right side.
ROWS = "ahash bigint, chash bigint, doc bigint, at bigint, flag bigint"
NO_ID = (1 << 63) - 1  # stands for a null id: after all others


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, doc, tag): ``tag`` tells rows apart that share an id; it is
    zero, and costs nothing in a shuffle, where no id is repeated."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    repeated = docs.select(doc.alias("doc")).groupBy("doc").count().where(F.col("count") > 1)
    tag = F.lit(0) if repeated.isEmpty() else F.hash(text)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), doc.alias("doc"), tag.alias("tag"))


def pack(tag: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Place of an anchor: the row's tag above the 32-bit position."""
    return tag.astype(np.int64) << 32 | position


def mixed(h: np.ndarray) -> np.ndarray:
    """Avalanche of a 64-bit hash (multiply and shift)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Polynomial hashes of fixed lengths by doubling, modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, self.values = base, {1: values}

    def of(self, length: int) -> np.ndarray:
        """Hash of values[i : i + length] at every i where it fits."""
        if length not in self.values:
            half = 1 << (length.bit_length() - 1)
            if half == length:
                half //= 2
            a, b = self.of(half), self.of(length - half)
            n = len(self.values[1]) - length + 1
            if n <= 0:
                return a[:0]
            power = np.uint64(pow(self.base, length - half, 1 << 64))
            self.values[length] = a[:n] * power + b[half : half + n]
        return self.values[length]


def settle_early(
    ahash: np.ndarray, chash: np.ndarray, doc: np.ndarray, at: np.ndarray, sides: np.ndarray, hot: np.ndarray, within: bool
) -> pa.RecordBatch:
    """Rows of one chunk of a task, with those flagged that the chunk settles."""
    order = np.lexsort((at, doc, chash, ahash))
    a, c, d, t = ahash[order], chash[order], doc[order], at[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    flag = np.where(np.isin(a, hot), HOT, NORMAL) if len(hot) else np.zeros(len(a), int)
    settled = d > d[first]
    if within:
        settled |= (d == d[first]) & (t > t[first])
    flag[settled] = SETTLED
    columns = [pa.array(v.astype(np.int64, copy=False)) for v in (a, c, d, t, flag | sides[order] << 2)]
    return pa.RecordBatch.from_arrays(columns, names=["ahash", "chash", "doc", "at", "flag"])


def sides_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """16 bits of the hash of either side, in one integer."""
    return ((left >> np.uint64(48)) | (right >> np.uint64(48)) << np.uint64(16)).astype(np.int64)


def _shared(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows whose side another row of the group has, too."""
    _, inverse, counts = np.unique(group << 16 | side, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


class _Stream:
    """Decides rows sorted by anchor, context, document and place. Rows that are
    first with their context wait until their anchor is complete."""

    def __init__(self, within: bool):
        self.within = within
        self.a = self.c = self.d = self.t = None
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.overflow = 0, False

    def add(self, a: np.ndarray, c: np.ndarray, d: np.ndarray, t: np.ndarray, flag: np.ndarray) -> list[tuple]:
        """(doc, at, state) arrays that are decided now."""
        n = len(a)
        new_a, new_c = np.ones(n, bool), np.ones(n, bool)
        new_a[1:] = a[1:] != a[:-1]
        new_a[0] = self.a is None or a[0] != self.a
        new_c[1:] = new_a[1:] | (c[1:] != c[:-1])
        new_c[0] = new_a[0] or c[0] != self.c
        first = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
        d0, t0 = np.where(first >= 0, d[first], self.d or 0), np.where(first >= 0, t[first], self.t or 0)
        settled = d > d0
        if self.within:
            settled |= (d == d0) & (t > t0)
        out = [(d[settled], t[settled], np.full(int(settled.sum()), SURE))]
        cut = int(np.flatnonzero(new_a)[-1]) if new_a.any() else 0  # from here on the anchor goes on
        rows = np.flatnonzero(~settled)
        if new_a.any():
            done = rows[rows < cut]
            began = int(np.flatnonzero(new_a)[0])
            out += self._close(self._hold(done[done < began], d, t, flag))
            rest = done[done >= began]
            out += self._sides(np.cumsum(new_a)[rest], d[rest], t[rest], flag[rest])
            rows = rows[rows >= cut]
        out += self._hold(rows, d, t, flag) or []
        self.a, self.c, self.d, self.t = a[-1], c[-1], d0[-1], t0[-1]
        return out

    def _hold(self, rows: np.ndarray, d: np.ndarray, t: np.ndarray, flag: np.ndarray) -> list[tuple]:
        """Keep rows of the unfinished anchor; of too many, all are open."""
        self.held.append((d[rows], t[rows], flag[rows]))
        self.waiting += len(rows)
        if self.overflow or self.waiting > HELD_ROWS:
            self.overflow = True
            out = [(d, t, np.full(len(d), LEFT | RIGHT)) for d, t, _ in self.held]
            self.held = []
            return out
        return []

    def _close(self, before: list[tuple] | None = None) -> list[tuple]:
        out = before or []
        if self.held:
            d, t, flag = (np.concatenate(x) for x in zip(*self.held, strict=True))
            out += self._sides(np.zeros(len(d), np.int64), d, t, flag)
        self.held, self.waiting, self.overflow = [], 0, False
        return out

    def finish(self) -> list[tuple]:
        return self._close()

    def _sides(self, group: np.ndarray, d: np.ndarray, t: np.ndarray, flag: np.ndarray) -> list[tuple]:
        """Rows of whole anchors: which sides another row shares."""
        if not len(d):
            return []
        group = np.unique(group, return_inverse=True)[1].astype(np.int64)
        left, right = _shared(group, flag >> 2 & 0xFFFF), _shared(group, flag >> 18 & 0xFFFF)
        if not self.within:  # only other documents count
            low, high = np.full(group[-1] + 1, NO_ID), np.full(group[-1] + 1, -NO_ID)
            np.minimum.at(low, group, d)
            np.maximum.at(high, group, d)
            several = (low < high)[group]
            left, right = left & several, right & several
        state = np.where(flag & 3 == HOT, LEFT | RIGHT, left * LEFT + right * RIGHT)
        live = state > 0
        return [(d[live], t[live], state[live])]


def hot_anchors(sample_rows: DataFrame) -> np.ndarray:
    """Anchors with very many rows, estimated from the rows of one in SAMPLE
    documents. At most 1 / HOT_SHARE anchors can be in the list."""
    counts = sample_rows.groupBy("ahash").agg(F.count("*").alias("n"))
    total = sample_rows.count()
    least = max(HOT_ROWS / SAMPLE, total * HOT_SHARE)
    return np.array([r["ahash"] for r in counts.where(F.col("n") >= least).collect()], np.int64)


def decide(rows: DataFrame, within: bool) -> DataFrame:
    """(doc, at, state) for all rows that are settled or open. ``within``: an
    earlier place in the same document settles a context, too."""
    kind = F.col("flag").bitwiseAND(F.lit(3))
    spread = F.when(kind == SETTLED, F.xxhash64("doc", "at")).when(kind == HOT, F.xxhash64("ahash", "chash")).otherwise(F.col("ahash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(within)

        def packed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            d, t, state = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(state.astype(np.int32))], names=["doc", "at", "state"])

        for batch in batches:
            a, c, d, t, flag = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            through = flag & 3 == SETTLED
            parts = [(d[through], t[through], np.full(int(through.sum()), SURE))]
            if not through.all():
                rest = ~through
                parts += stream.add(a[rest], c[rest], d[rest], t[rest], flag[rest])
            yield from packed(parts)
        yield from packed(stream.finish())

    placed = rows.repartition(spread).sortWithinPartitions(kind, "ahash", "chash", "doc", "at")
    return placed.mapInArrow(run, "doc bigint, at bigint, state int")


def per_document(marks: DataFrame) -> DataFrame:
    """(doc, tag, marks): places of a document, eight times the position plus the state."""
    packed = F.shiftleft(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), 3) + F.col("state")
    return (
        marks.select("doc", F.shiftright("at", 32).cast("int").alias("tag"), packed.alias("mark"))
        .groupBy("doc", "tag").agg(F.collect_list("mark").alias("marks"))
    )


def window_starts(marks: list[int] | None, n: int, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(settled starts, open starts, open anchors) of a text of n units with
    windows of ``length`` that begin up to ``reach`` before their anchor. Of an
    open anchor: its position and the first and last start it leaves open."""
    m = np.array(marks or [], np.int64)
    position, state = m >> 3, m & 7
    size, half = max(0, n - length + 1), half_reach(reach)
    last = np.minimum(position, n - length) + 1

    def within(bit: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        on = state & bit > 0
        low, high = np.maximum(low[on], 0), np.minimum(high, last)[on]
        return covered(low[low < high], high[low < high], size)

    sure = within(SURE, position - reach, last)
    maybe = within(LEFT, position - reach, position - half + 1) | within(RIGHT, position - half + 1, last)
    on = state > SURE
    low = np.where(state & LEFT > 0, position - reach, position - half + 1)
    high = np.where(state & RIGHT > 0, position, position - half)
    spans = np.stack([position, np.maximum(low, 0), np.minimum(high, n - length)], axis=1)[on]
    return sure, maybe & ~sure, np.unique(spans[spans[:, 1] <= spans[:, 2]], axis=0)


def half_reach(reach: int) -> int:
    """Windows that begin at least so far before their anchor cover its left side,
    the others its right side."""
    return (reach + 1) // 2


def packed_text(text: str) -> bytes:
    """Text that still has to travel, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(text.encode("utf-8", "replace"))


def take_text(row: dict) -> bytes:
    """The row's text in UTF-8; it leaves the row."""
    packed = row.pop("packed", None)
    if packed is not None:
        return zstandard.ZstdDecompressor().decompress(packed)
    return row.pop("text").encode("utf-8", "replace")


def covered(starts_from: np.ndarray, starts_to: np.ndarray, size: int) -> np.ndarray:
    """Boolean array: index inside one of the ranges [from, to)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts_from, 1)
    np.add.at(steps, starts_to, -1)
    return np.cumsum(steps)[:size] > 0
