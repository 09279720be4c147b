"""Near-duplicate documents by SimHash and multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that
differ in at most three bits differ in at most one bit of some segment, so it is
enough to look up a ball of radius one around each segment. A segment that
differs in one bit has a zero there on one of the two sides; only that side has
to flip it, which halves the ball. Matches are verified on all 64 bits. Equal
fingerprints are one node throughout, so copies never make pairs, and only
links between different fingerprints enter the component search.

Defined cases: a null or blank text has fingerprint zero, which links like any
other; fewer than three words are one shingle; texts of any length are read
whole; repeated rows and ids keep their own output rows; a null id never is the
smallest of a component (component_id is null when no member has an id); an
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.lineage import cut_lineage, drop_table

SHINGLE = 3
SEED = 42
MAX_BITS = 3
# A-Z in lower case; bytes.split() cuts exactly at the six ASCII white-space characters.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of every byte value, lowest bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The majority bits of the shingles' XXH64 values, as a signed integer."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64).astype("<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(_WEIGHTS[2 * counts > len(hashes)].sum(dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def _segments(fp: Column) -> list[Column]:
    """Both segments as keys that carry the segment's number in bit 32."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return [low, F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))]


def links(nodes: DataFrame) -> DataFrame:
    """(u, v) with u < v: different fingerprints (column fp) within MAX_BITS."""
    index = nodes.select(F.col("fp").alias("other"), F.explode(F.array(*_segments(F.col("fp")))).alias("key"))
    key = F.explode(F.array(*_segments(F.col("fp")))).alias("base")
    zero_bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("getbit", F.col("base"), i) == 0)
    flips = F.transform(zero_bits, lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    ball = F.concat(F.array(F.lit(0).cast("bigint")), flips)
    probes = (
        nodes.select("fp", key)
        .select("fp", F.explode(ball).alias("mask"), "base")
        .select("fp", F.col("base").bitwiseOR(F.col("mask")).alias("key"), (F.col("mask") == 0).alias("same"))
    )
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS
    once = F.when(F.col("same"), F.col("fp") < F.col("other")).otherwise(F.col("fp") != F.col("other"))
    # Catalyst knows nothing of the rows that explode adds and would broadcast the probes.
    found = probes.hint("merge").join(index, (probes["key"] == index["key"]) & near & once)
    return found.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    members = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    # Merged: these tables grow with the input, and compressed files hide how large one is on the driver.
    rooted = nodes.join(members.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written, so that the join has an exchange on both sides and a large component can be split.
    smallest = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    component = rooted.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return rows.join(component.hint("merge"), "fp").select("doc_id", "fp", "component_id")


# -- documents alike in most of their five-word shingles --------------------------
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Share of the pairs exactly at the similarity that must meet as candidates.
RECALL = 0.99
#: Segments in which the first round looks for close copies.
SEGMENTS, SEGMENT_BITS = 16, 24
#: 64-bit lanes of the fingerprint.
LANES = 16
#: Chance members of a value: shorter segments meet more often, so fewer rows are shuffled.
OCCUPANCY = 8
BLOCK = 512
#: Times the pairs that chance members put on a value: from there on the value is crowded.
CROWDED = 6
#: Bytes of shingle hashes of a block of a crowded value, which has at most about BLOCK members.
CROWD_BYTES = 16 << 20
#: Size of a bitmap of hashed ids, and of its rows (as ``bitmap_construct_agg`` makes them): 16 MB in all.
BITMAP, BITMAP_ROW = 1 << 27, 1 << 15


def bitmap_of(ids: DataFrame) -> DataFrame:
    """(__row, __map) of at most BITMAP bits: those that the ids (one column) hash to.
    Its size does not depend on the number of ids; a full one only selects less."""
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITMAP))
    placed = ids.select(F.floor(place / BITMAP_ROW).cast("int").alias("__row"), F.pmod(place, F.lit(BITMAP_ROW)).alias("bit"))
    # Dealt before they are added up, so that no task sends a whole row for a single bit.
    return placed.repartition("__row").groupBy("__row").agg(F.bitmap_construct_agg("bit").alias("__map"))


def split_by(rows: DataFrame, id_col: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in the bitmap, rows whose id surely is not), without a shuffle of rows."""
    place = F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(BITMAP))
    joined = rows.withColumn("__row", F.floor(place / BITMAP_ROW).cast("int")).join(F.broadcast(bitmap), "__row", "left")
    at = F.pmod(place, F.lit(BITMAP_ROW))
    byte = F.conv(F.hex(F.substring("__map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return joined.where(hit).select(*rows.columns), joined.where(~hit).select(*rows.columns)


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Majority bits of ``lanes`` independent 64-bit hashes made from each hash."""
    steps = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 4096):
        h = (hashes[at : at + 4096, None] + steps) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.view(np.uint8), axis=1)
        for part in range(0, len(bits), 255):  # so many ones fit a byte
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def wide_shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different five-word shingles."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = min(len(words), WIDE_SHINGLE) or 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*[words[k:] for k in range(n)]))), np.uint64))


def flipped(similarity: float = SIMILARITY) -> float:
    """Expected share of differing bits, at most, of two sets that are so similar."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_bits(bits: int, similarity: float = SIMILARITY, deviations: float = 4.0) -> int:
    """Differing bits to expect of such sets, and some standard deviations more."""
    share = flipped(similarity)
    return int(np.ceil(bits * share + deviations * np.sqrt(bits * share * (1 - share))))


def segments_for(classes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits a segment, segments): about ``OCCUPANCY`` random members a value, and at
    least ``recall`` for a pair exactly at the similarity by balls of radius one."""
    q = flipped(similarity)

    def needed(bits: int) -> int:
        meet = (1 - q) ** bits + bits * q * (1 - q) ** (bits - 1)
        return int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))

    bits = min(24, max(12, round(np.log2(max(2, classes) / OCCUPANCY))))
    while bits > 1 and bits * needed(bits) > 64 * LANES:  # all segments lie in the fingerprint
        bits -= 1
    return bits, needed(bits)


def _values(lanes: list[bytes], bits: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, values) of the segments of each fingerprint."""
    rows = np.frombuffer(b"".join(lanes), np.uint8).reshape(-1, 8 * LANES)
    cut = np.unpackbits(rows, axis=1)[:, : bits * segments].reshape(-1, segments, bits)
    return cut, cut.astype(np.int64) @ (np.int64(1) << np.arange(bits))


def _close_copies(classes: DataFrame) -> DataFrame:
    """(u, v): of all classes that agree in a segment, each with the smallest one
    that its bits put within the similarity. Buckets are compared whole, large ones
    in pairs of blocks, and emit one row per member, never all pairs."""
    limit = most_bits(64 * LANES, deviations=0)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch.column(1).to_pylist(), SEGMENT_BITS, SEGMENTS)[1] if len(batch) else np.zeros((0, SEGMENTS), np.int64)
            keys = values + (np.arange(SEGMENTS, dtype=np.int64) << SEGMENT_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), SEGMENTS)), pa.array(keys.ravel())], names=["node", "key"])

    entries = classes.select("node", "lanes").mapInArrow(entered, "node bigint, key bigint")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    sizes = cut_lineage(sizes.where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "buckets")
    spread = entries.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    units = spread.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "node")
    units = units.join(classes.select("node", "lanes"), "node").select("key", "low", "high", "node", "lanes")
    keys = ["key", "low", "high"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        current = None

        def close() -> list[tuple[int, int]]:
            node = np.array([h[0] for h in held])
            order = np.argsort(node)
            x = np.frombuffer(b"".join([held[i][1] for i in order]), np.uint64).reshape(-1, LANES)
            first = np.zeros(len(x), np.int64)
            for at in range(0, len(x), 64):
                first[at : at + 64] = (np.bitwise_count(x[at : at + 64, None] ^ x[None]).sum(axis=2, dtype=np.int32) <= limit).argmax(axis=1)
            held.clear()
            return [(int(node[order[r]]), int(node[order[i]])) for i, r in enumerate(first.tolist()) if i != r]

        for batch in batches:
            made: list[tuple[int, int]] = []
            for *key, node, lanes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != current:
                    if len(held) > 1:
                        made += close()
                    held, current = [], key
                held.append((node, lanes))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in zip(*made, strict=True)], names=["u", "v"])
        if len(held) > 1 and (made := close()):
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in zip(*made, strict=True)], names=["u", "v"])

    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(linked, "u bigint, v bigint").distinct()


def _entries(classes: DataFrame, bits: int, segments: int, probing: bool) -> DataFrame:
    """(key, node, part, lane, flips) and any further columns of the classes (node, lanes,
    part, ...): each class under its segments' values and, when probing, also under those
    with one zero flipped. Keys carry the segment's number."""
    more = [c for c in classes.columns if c not in ("node", "lanes", "part")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                lanes = batch.column(1).to_pylist()
                cut, values = _values(lanes, bits, segments)
                keys = values + (np.arange(segments, dtype=np.int64) << bits)
                row, flips = np.repeat(np.arange(len(keys)), segments), np.zeros(keys.size, bool)
                keys_all = keys.ravel()
                if probing:
                    d, m, b = np.nonzero(cut == 0)
                    keys_all = np.concatenate([keys_all, keys[d, m] + (np.int64(1) << b)])
                    row, flips = np.concatenate([row, d]), np.concatenate([flips, np.ones(len(d), bool)])
                last = np.frombuffer(b"".join(lanes), np.int64).reshape(-1, LANES)[:, -1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys_all), pa.array(batch.column(0).to_numpy()[row]), pa.array(batch.column(2).to_numpy()[row]), pa.array(last[row]), pa.array(flips),
                    *[batch.column(c).take(pa.array(row)) for c in more],
                ], names=["key", "node", "part", "lane", "flips", *more])

    schema = "".join(f", {c} {classes.schema[c].dataType.simpleString()}" for c in more)
    return classes.select("node", "lanes", "part", *more).mapInArrow(run, f"key bigint, node bigint, part bigint, lane bigint, flips boolean{schema}")


def _crowded(classes: DataFrame, bits: int, segments: int) -> DataFrame:
    """(key, blocks): values whose pairs are many times those of chance members."""
    held = _entries(classes, bits, segments, False).groupBy("key").agg(F.count("*").alias("n"))
    zero_bits = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("getbit", F.col("key"), i) == 0)
    flips = F.transform(zero_bits, lambda i: F.col("key") + F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    met = held.select(F.explode(F.concat(F.array("key"), flips)).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("met"))
    mean = max(OCCUPANCY, classes.count() / (1 << bits))
    many = held.join(met, "key").where(F.col("n") * F.col("met") > CROWDED * mean * mean * (1 + bits / 2))
    return cut_lineage(many.select("key", F.ceil(F.col("met") / BLOCK).cast("int").alias("blocks")), "crowded")


def _meetings(rows: list[tuple], bits: int, segments: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's rows (key, low, high, own, node, part, lanes, ...) that the join
    of ``candidates`` would give for this key, if they also agree in all bits."""
    key, low, high = rows[0][:3]
    own, node, part = (np.array([r[c] for r in rows]) for c in (3, 4, 5))
    lanes = [r[6] for r in rows]
    x = np.frombuffer(b"".join(lanes), np.uint64).reshape(-1, LANES)
    values, segment = _values(lanes, bits, segments)[1], key >> bits
    flips = values[:, segment] != key - (segment << bits)
    limit, most = most_bits(64, similarity, 3.25), most_bits(64 * LANES, similarity, 3.25)
    index = np.flatnonzero(~flips)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(index), 64):
        i = index[at : at + 64]
        apart = np.bitwise_count(x[i, None] ^ x[None])
        near = (apart.sum(axis=2, dtype=np.int32) <= most) & (apart[:, :, -1] <= limit) & (part[i, None] != part)
        near &= ((own[i, None] != own) == (low != high)) & (flips | (node[i, None] < node))
        a, b = np.nonzero(near)
        left.append(i[a])
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _units(members: DataFrame, held: DataFrame) -> DataFrame:
    """Members (key, node, blocks) of crowded values in pairs of blocks (key, low, high,
    own, and the columns of ``held``), dealt by pair of blocks."""
    spread = members.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = spread.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = met.select("key", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own", "node")
    keys = ["key", "low", "high"]
    return units.join(held, "node").select(*keys, "own", *held.columns).repartition(*keys).sortWithinPartitions(*keys)


def _each_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one unit after another."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for _, unit in groupby(rows, itemgetter(0, 1, 2)):
        yield list(unit)


def _crowds(classes: DataFrame, members: DataFrame, bits: int, segments: int, similarity: float) -> DataFrame:
    """(key, u, v) of the units of crowded values: their pairs where they are fewer than
    the members, else the members that have a pair (v is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _each_unit(batches):
            i, j = _meetings(unit, bits, segments, similarity)
            nodes = np.array([row[4] for row in unit])
            if len(i) <= len(unit):
                u, v = pa.array(np.minimum(nodes[i], nodes[j])), pa.array(np.maximum(nodes[i], nodes[j]))
            else:
                u = pa.array(nodes[np.unique(np.concatenate([i, j]))])
                v = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), unit[0][0])), u, v], names=["key", "u", "v"])

    return _units(members, classes.select("node", "part", "lanes")).mapInArrow(run, "key bigint, u bigint, v bigint")


def crowd_links(dense: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, bits: int, segments: int, similarity: float) -> DataFrame:
    """(u, v): links among the members (key, node) of crowded values with more candidates
    than members. They are verified where their shingle sets meet, in pairs of blocks;
    a unit gives only links that join what it had not joined, so fewer than its members."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([wide_shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["node", "shingles"])

    texts = class_texts(dense.select("node").distinct(), classes, docs)
    held = cut_lineage(texts.mapInArrow(sets, "node bigint, shingles binary").join(parts, "node").select("node", "part", "lanes", "shingles"), "crowd-sets")
    sizes = dense.join(held.select("node", F.length("shingles").alias("bytes")), "node").groupBy("key")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / CROWD_BYTES)).cast("int")
    members = dense.join(sizes.agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "key").select("key", "node", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _each_unit(batches):
            i, j = _meetings(unit, bits, segments, similarity)
            found = [(unit[a][4], unit[b][4]) for a, b in _spanning(unit, i, j, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["u", "v"])

    links = cut_lineage(_units(members, held).mapInArrow(run, "u bigint, v bigint"), "crowd-links")
    drop_table(texts)
    drop_table(held)
    return links


def _spanning(unit: list[tuple], i: np.ndarray, j: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Of the pairs (i, j) so similar by their shingles, those that join parts."""
    sets = [np.frombuffer(row[7], np.uint64) for row in unit]
    length = np.array([len(s) for s in sets])
    numbers = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(length)[:-1])
    marked = np.zeros(int(length.sum()), bool)
    root = np.unique(np.array([row[5] for row in unit]), return_inverse=True)[1]
    # The larger set bounds the similarity by the smaller one.
    able = (np.minimum(length[i], length[j]) + 1e-9 >= similarity * np.maximum(length[i], length[j])) & (length[i] > 0) & (length[j] > 0)
    i, j = i[able], j[able]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for a, start, n in zip(*np.unique(i, return_index=True, return_counts=True), strict=True):
        others = j[start : start + n]
        others = others[root[others] != root[a]]
        if not len(others):
            continue
        marked[numbers[a]] = True
        starts = np.concatenate([[0], np.cumsum(length[others])[:-1]])
        shared = np.add.reduceat(marked[np.concatenate([numbers[b] for b in others])], starts, dtype=np.int64)
        marked[numbers[a]] = False
        for b in others[(shared > 0) & (shared + 1e-9 >= similarity * (length[a] + length[others] - shared))]:
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                yield int(a), int(b)


def candidates(classes: DataFrame, bits: int, segments: int, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(u, v) with u < v: classes (node, lanes, part) of different parts within one
    bit in some segment. The side with the zero flips, as in ``links``; another 64
    bits with a generous limit leave few chance meetings. Values that many alike
    share are compared in blocks instead: the second table has the (key, node) of
    those whose pairs are too many to be listed."""
    limit = most_bits(64, similarity, 3.25)
    crowded = _crowded(classes, bits, segments)
    members = cut_lineage(_entries(classes, bits, segments, True).join(crowded, "key").select("key", "node", "flips", "blocks"), "crowd-members")
    crowds = cut_lineage(_crowds(classes, members, bits, segments, similarity), "crowds")
    # Pairs that meet under a crowded value are not listed under others; classes that have one
    # themselves also carry all their bits, seven bytes a number, so that only close pairs are.
    own = F.collect_list(F.when(~F.col("flips"), F.col("key")))
    hot = members.groupBy("node").agg(own.alias("own"), F.collect_list("key").alias("met"))
    seven = [F.conv(F.hex(F.substring("lanes", at, F.lit(7))), 16, 10).cast("bigint") for at in range(1, 8 * LANES + 1, 7)]
    carried = F.struct("own", "met", F.when(F.size("own") > 0, F.array(*seven)).alias("all"))
    known = classes.join(hot, "node", "left").select("node", "lanes", "part", F.when(F.col("met").isNotNull(), carried).alias("hot"))
    known = cut_lineage(known, "known")
    index = _entries(known, bits, segments, False).drop("flips").join(crowded, "key", "left_anti")
    a, b = _entries(known, bits, segments, True).alias("a"), index.alias("b")
    met = F.arrays_overlap("a.hot.own", "b.hot.met") | F.arrays_overlap("a.hot.met", "b.hot.own")
    most = most_bits(64 * LANES, similarity, 3.25)
    apart = sum(F.bit_count(F.col("a.hot.all")[k].bitwiseXOR(F.col("b.hot.all")[k])) for k in range(len(seven)))
    listed = ~F.coalesce(met, F.lit(False)) & F.coalesce(apart <= most, F.lit(True))
    near = F.bit_count(F.col("a.lane").bitwiseXOR(F.col("b.lane"))) <= limit
    once = F.col("a.flips") | (F.col("a.node") < F.col("b.node"))
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & near & once & listed)
    pairs = found.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, LANES) for c in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32) <= most))

    x, y = (classes.select(F.col("node").alias(c), F.col("lanes").alias(f"{c}_lanes")) for c in "uv")
    alike = pairs.join(x, "u").join(y, "v").select("u", "v", "u_lanes", "v_lanes").mapInArrow(close, "u bigint, v bigint")
    few = crowds.where(F.col("v").isNotNull()).select("u", "v")
    dense = crowds.where(F.col("v").isNull()).select("key", F.col("u").alias("node")).distinct()
    return alike.unionByName(few).distinct(), dense


def class_texts(needed: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the classes (node, first, text_key) asked for, from ``docs`` (doc_id, text)."""
    wanted = cut_lineage(classes.select("node", "first", "text_key").join(needed, "node"), "wanted")
    # Only rows that may be asked for are shuffled.
    keyed = split_by(docs, "doc_id", bitmap_of(wanted.select("first")))[0].withColumn("key", F.xxhash64("text"))
    found = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("text_key")))
    texts = cut_lineage(found.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")
    drop_table(wanted)
    return texts


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those pairs (u, v) whose shingle sets really are so similar. The texts of
    candidate classes (node, first, text_key) are fetched from ``docs`` (doc_id,
    text); sets are made where two texts meet and are never written."""
    pairs = cut_lineage(pairs, "candidates")
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    texts = class_texts(needed, classes, docs)
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v").select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = lru_cache(maxsize=16)(wide_shingles)  # a text stands in several rows
        for batch in batches:
            alike: list[bool] = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingles(x.as_py()), shingles(y.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(shared > 0 and shared + 1e-9 >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    links = cut_lineage(both.mapInArrow(run, "u bigint, v bigint"), "links")
    for table in (texts, pairs):
        drop_table(table)
    return links


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row, linking documents whose five-word
    shingles have a Jaccard similarity of at least ``similarity``.

    Multi-index hashing again, for larger distances: a first round joins close
    copies that agree in a whole segment, so that large groups of them make no
    pairs; then all that is not joined yet is looked up by balls of radius one,
    in as many segments as the recall asks for. Fingerprints only select: every
    link of either round is verified on the shingles themselves."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):  # the sets are larger than the texts
                batch = whole.slice(at, 256)
                sets = [wide_shingles(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(2), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([_lanes(s, LANES).tobytes() for s in sets], pa.binary()),
                ], names=["doc_id", "text_key", "same", "lanes"])

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    made = read.withColumn("text_key", F.xxhash64("text")).mapInArrow(prints, "doc_id bigint, text_key bigint, same binary, lanes binary")
    rows = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()), "wide-fingerprints")
    # Equal sets are one class; the first of its rows stands for it, by its id and text.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    classes = rows.groupBy("same", "lanes").agg(one.alias("one"), F.min("row").alias("node"))
    classes = cut_lineage(classes.select("same", "lanes", "node", F.col("one.doc_id").alias("first"), F.col("one.text_key").alias("text_key")), "classes")
    close = verified(_close_copies(classes), classes, read, similarity)
    joined = connected_components(close).withColumnRenamed("root", "part")
    parts = cut_lineage(classes.join(joined, "node", "left").withColumn("part", F.coalesce("part", "node")).select("node", "lanes", "part"), "parts")
    cut = segments_for(parts.count(), similarity)
    pairs, dense = candidates(parts, *cut, similarity)
    more = verified(pairs, classes, read, similarity)
    if not dense.isEmpty():
        more = more.unionByName(crowd_links(dense, parts, classes, read, *cut, similarity))
    drop_table(parts)
    rooted = classes.join(connected_components(close.unionByName(more)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written, so that the join has an exchange on both sides and a large component can be split.
    smallest = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    component = rooted.join(smallest, "root").select("same", "component_id")
    return rows.select("doc_id", "same").join(component, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates (five-word shingles, see
    ``similar_documents``): of each component the smallest id stays. Rows without an id are not compared and stay. Where an id
    that stays is repeated, the row with the smallest text stays."""
    found = similar_documents(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    stays = F.bool_or(F.col("doc_id") == F.col("component_id"))
    judged = found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__copies"), stays.alias("__stays"))
    # Ids that go or are repeated; rows of all others stay where they are.
    doubtful = cut_lineage(judged.where(~F.col("__stays") | (F.col("__copies") > 1)), "doubtful")
    asked, clear = split_by(docs.where(F.col(id_col).isNotNull()), id_col, bitmap_of(doubtful.select("__id")))
    joined = asked.join(doubtful, asked[id_col] == F.col("__id"), "left").where(F.coalesce("__stays", F.lit(True)))
    order = Window.partitionBy("__id").orderBy(text_col)
    repeated = joined.where("__copies > 1").withColumn("__copies", F.row_number().over(order)).where("__copies = 1")
    once = joined.where(F.coalesce("__copies", F.lit(1)) == 1)
    kept = once.unionByName(repeated).select(*docs.columns)
    return kept.unionByName(clear).unionByName(docs.where(F.col(id_col).isNull()))
