"""Near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors become one class. Every class is put into one bucket of each of
several tables, keyed by the signs of its dot products with random hyperplanes;
the number of planes follows the number of classes and the number of tables a
recall target at the threshold itself (closer pairs are found more surely). In a
bucket all cosines are computed in double precision as one matrix product. A
pair counts in the first table in which its two classes meet, which both know
from their own signatures, so links are counted without emitting pairs; for the
components a bucket emits only one row per member, to the smallest member it
hangs together with. Buckets above BLOCK members are cut into blocks, and every
pair of blocks is its own task unit: large buckets stay exact and spread out.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing, not even with equal ones; vectors of different
length never link; a null id counts in n_links but never names a component;
rows that share an id are separate rows; an empty table gives an empty result.
Only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.lineage import cut_lineage

THRESHOLD = 0.95
RECALL = 0.999
BLOCK = 512
SEED = 20_240_229


def tables_for(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(planes per table, tables): about eight random members a bucket, and at
    least ``recall`` for a pair exactly at the threshold."""
    planes = min(28, max(4, round(math.log2(max(2, classes))) - 3))
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _double(value: list | None) -> np.ndarray | None:
    """The vector in double precision, or None if it links with nothing."""
    if not value or None in value:
        return None
    out = np.array(value, np.float64) + 0.0  # no negative zero
    return out if np.isfinite(out).all() and out.any() else None


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of all rows, key null for vectors without links; and one row
    (node, key, vector, copies, first) per class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_double(v) for v in batch.column(1).to_pylist()]
            digest = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "key", "vector"]
            )

    read = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>"))
    rows = read.mapInArrow(keys, "vec_id bigint, key binary, vector array<double>")
    grouped = rows.where("key is not null").groupBy("key").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    return rows.select("vec_id", "key"), classes


def _signed(classes: DataFrame, planes: int, tables: int) -> DataFrame:
    """(node, copies, vector, signs): the signatures in all tables, unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            units, signs = [], []
            for v in batch.column(2).to_pylist():
                v = np.array(v)
                v /= np.abs(v).max()
                v /= np.linalg.norm(v)
                if len(v) not in drawn:
                    drawn[len(v)] = np.random.default_rng([SEED, len(v)]).standard_normal((tables * planes, len(v)))
                bits = (drawn[len(v)] @ v > 0).reshape(tables, planes)
                units.append(v)
                signs.append((bits @ weights).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64())), pa.array(signs, pa.list_(pa.int32()))],
                names=["node", "copies", "vector", "signs"],
            )

    return classes.select("node", "copies", "vector").mapInArrow(run, "node bigint, copies bigint, vector array<double>, signs array<int>")


def smallest_linked(near: np.ndarray) -> np.ndarray:
    """Index of the smallest member that each member hangs together with."""
    label = np.arange(len(near))
    while True:
        lower = np.where(near, label[None, :], len(near)).min(axis=1)
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compare(table: int, left: dict, right: dict | None, threshold: float) -> list[tuple]:
    """(node, weight, root) of the members of a block, or of two blocks with
    links counted across them only."""
    both = left if right is None else {k: np.concatenate([left[k], right[k]]) for k in left}
    order = np.argsort(both["node"])
    both = {k: v[order] for k, v in both.items()}
    near = both["vector"] @ both["vector"].T >= threshold
    np.fill_diagonal(near, False)
    if right is not None:
        side = np.isin(both["node"], right["node"])
        near &= side[:, None] != side[None, :]
    if not near.any():
        return []
    first = near.copy()
    i, j = np.nonzero(near)
    if table:
        met = np.zeros(len(i), bool)
        for t in range(table):
            met |= both["signs"][i, t] == both["signs"][j, t]
        first[i[met], j[met]] = False
    weight = first @ both["copies"]
    root = both["node"][smallest_linked(near)]
    return [(n, w, r) for n, w, r in zip(both["node"].tolist(), weight.tolist(), root.tolist(), strict=True) if w or n != r]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows, classes = classes_of(vectors, id_col, vector_col)
    planes, tables = tables_for(classes.count(), threshold, recall)
    signed = _signed(classes, planes, tables)
    entries = signed.select(
        F.posexplode("signs").alias("table", "sign"), "node", "copies", "vector", "signs", F.size("vector").alias("dim")
    )
    sizes = (
        signed.select(F.posexplode("signs").alias("table", "sign"), F.size("vector").alias("dim"))
        .groupBy("table", "sign", "dim").agg(F.count("*").alias("n"))
        .where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block)).drop("n")
    )
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)).cast("int") - 1))
    units = (
        entries.join(sizes, ["table", "sign", "dim"], "left").withColumn("own", own).withColumn("met", met)
        .select("table", "sign", "dim", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own", "node", "copies", "vector", "signs")
    )
    keys = ["table", "sign", "dim", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def close() -> list[tuple]:
            t = pa.Table.from_batches(held)
            held.clear()
            if len(t) < 2:
                return []
            dim = current[2]
            data = {k: t[k].to_numpy() for k in ("own", "node", "copies")}
            data["vector"] = t["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            data["signs"] = t["signs"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            mine = data.pop("own")
            if current[3] == current[4]:
                return _compare(current[0], data, None, threshold)
            sides = [{k: v[mine == b] for k, v in data.items()} for b in current[3:]]
            return _compare(current[0], *sides, threshold) if all(len(s["node"]) for s in sides) else []

        for batch in batches:
            made: list[tuple] = []
            ks = np.stack([batch.column(k).to_numpy() for k in range(5)], axis=1)
            cuts = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1).tolist(), len(ks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(ks[a].tolist())
                if key != current:
                    if held:
                        made += close()
                    current = key
                held.append(batch.slice(a, b - a))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["node", "weight", "root"])
        if held and (made := close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["node", "weight", "root"])

    found = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node bigint, weight bigint, root bigint")
    found = cut_lineage(found.groupBy("node", "root").agg(F.sum("weight").alias("weight")), "vector-links")
    weights = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    members = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    slim = classes.select("node", "key", "copies", "first")
    rooted = slim.join(members, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written, so that the join has an exchange on both sides and a large component can be split.
    smallest = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    result = (
        rooted.join(smallest, "root").join(weights, "node", "left")
        .select("key", "component_id", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = rows.join(result, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
