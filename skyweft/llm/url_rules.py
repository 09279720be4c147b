"""URL rules by a memory-mapped sorted digest array.

A rule is a host, the start of a path and a verdict. Its key is the string
``host/path``; the array holds the 64-bit XXH64 of all keys in ascending order as one
file, with the keys themselves and their verdicts behind it. Tasks map the file, so
its pages are shared by the workers of a machine and read only where a search goes.
A URL asks for every suffix of its host at a dot and every start of its path that is
as long as some rule's; all questions of a batch are one vectorised binary search,
and a digest that is found counts only if the stored string is equal.

The file is built and shipped whole while the rules take at most ARRAY_BYTES
(measured exactly). Longer lists are cut by digest into arrays of about SHARD_RULES
rules: the distinct questions of all URLs and the rules meet by shard, every task
sorts, maps and searches the arrays of its own shards, and what was found goes back
to the URLs. Both ways search the same array and give the same rows.

Defined cases: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
the end, with A-Z in lower case; path goes on up to ``?``, ``#`` or the end; a null
URL or one without ``://`` has neither and meets no rule. The longest fitting rule
wins, by characters of host and path, then of the host; of equal rules with two
verdicts ``block`` wins. Without a fitting rule the verdict is ``default``. Rules
with a null or empty host are ignored, a null path is ``/``. Very long URLs are read
whole; equal rows and rows without an id keep their own rows; an empty table gives no
rows; no rules leave every URL to ``default``. Only the id and URL columns are read.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_root, cut_lineage
from ..plans.skew import salted_join

BLOCK, ALLOW = "block", "allow"
#: The array is built on the driver and shipped while the keys take no more than this.
ARRAY_BYTES = 64 << 20
#: Rules, or distinct questions, of one shard of a longer list.
SHARD_RULES = 1 << 20
_HEAD = struct.Struct("<8sQ")
_MAGIC = b"URLRULE1"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def write_array(path: str, rules: Iterable[tuple[bytes, bool]]) -> None:
    """Write (key, blocked) pairs, sorted by digest; of equal keys a blocked one counts."""
    verdicts: dict[bytes, bool] = {}
    for key, blocked in rules:
        verdicts[key] = verdicts.get(key, False) or blocked
    order = sorted((digest(k), k) for k in verdicts)
    ends = np.cumsum([0, *(len(k) for _, k in order)]).astype("<u8")
    with open(path, "wb") as f:
        f.write(_HEAD.pack(_MAGIC, len(order)))
        f.write(np.array([d for d, _ in order], "<u8").tobytes())
        f.write(ends.tobytes())
        f.write(bytes(verdicts[k] for _, k in order))
        f.writelines(k for _, k in order)


class DigestArray:
    """A mapped file of ``write_array``."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        magic, n = _HEAD.unpack(self.raw[: _HEAD.size].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"no digest array: {path}")
        at = _HEAD.size
        self.digests = self.raw[at : at + 8 * n].view("<u8")
        self.ends = self.raw[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.blocked = self.raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.text = self.raw[at + 17 * n + 8 :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key in the array, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return found
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        low = np.searchsorted(self.digests, wanted, "left")
        hit = np.flatnonzero(self.digests[np.minimum(low, len(self.digests) - 1)] == wanted)
        for i in hit.tolist():
            at = int(low[i])
            while at < len(self.digests) and self.digests[at] == wanted[i]:  # keys that collide stand together
                if self.text[int(self.ends[at]) : int(self.ends[at + 1])].tobytes() == keys[i]:
                    found[i] = at
                    break
                at += 1
        return found


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def suffixes(host: str) -> list[str]:
    """The host and the domains above it, longest first."""
    out = [host]
    while (dot := host.find(".")) >= 0:
        host = host[dot + 1 :]
        out.append(host)
    return out


def questions(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Keys of the rules that would fit, those that win first."""
    if not host:
        return []
    made = [(len(h) + n, len(h), h + path[:n]) for h in suffixes(host) if h for n in lengths if n <= len(path)]
    made.sort(key=lambda m: m[:2], reverse=True)
    return [m[2].encode("utf-8", "replace") for m in made]


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), _AZ, _az), F.regexp_extract(url, parts, 2)


def _rules(rules: DataFrame) -> DataFrame:
    """(key, blocked, length of the path) of the usable rules."""
    host = F.translate(F.col("host"), _AZ, _az)
    path = F.coalesce(F.col("path"), F.lit("/"))
    usable = rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
    return usable.select(F.concat(host, path).alias("key"), (F.col("verdict") == BLOCK).alias("blocked"), F.length(path).alias("n"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW,
          array_bytes: int = ARRAY_BYTES, shard_rules: int = SHARD_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rules`` has host, path
    and verdict (block or allow)."""
    spark = pages.sparkSession
    keyed = cut_lineage(_rules(rules), "url-rules")
    sums = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    # One entry per length of a path in the list: no more than the longest path has characters.
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    host, path = host_and_path(F.col(url_col))
    read = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    if 17 * sums["n"] + (sums["bytes"] or 0) <= array_bytes:
        name = f"url-rules-{uuid.uuid4().hex}"
        shared = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{name}")
        with tempfile.TemporaryDirectory() as folder:  # executors fetch the copy in the shared folder
            local = os.path.join(folder, name)
            write_array(local, ((r["key"].encode(), bool(r["blocked"])) for r in keyed.toLocalIterator()))
            shared.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(local), shared)
        spark.sparkContext.addFile(shared.toString())
        return _judge_mapped(read, name, lengths, default)
    return _judge_sharded(read, keyed, sums["n"], lengths, default, shard_rules)


def _judge_mapped(read: DataFrame, name: str, lengths: list[int], default: str) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _mapped(name)
        for batch in batches:
            asked = [questions(h, p, lengths) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = iter(array.find([k for keys in asked for k in keys]).tolist())
            rule, verdict = [], []
            for keys in asked:
                hits = [(k, at) for k in keys if (at := next(found)) >= 0]
                rule.append(hits[0][0].decode() if hits else None)
                verdict.append((BLOCK if array.blocked[hits[0][1]] else ALLOW) if hits else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    return read.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


def _judge_sharded(read: DataFrame, keyed: DataFrame, n_rules: int, lengths: list[int], default: str, shard_rules: int) -> DataFrame:
    rows = cut_lineage(read.withColumn("row", F.monotonically_increasing_id()), "urls")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [questions(h, p, lengths) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            many = [len(a) for a in asked]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array([i for n in many for i in range(n)], pa.int32()),
                pa.array([k.decode() for a in asked for k in a], pa.string()),
            ], names=["row", "place", "key"])

    asked = cut_lineage(rows.select("row", "host", "path").mapInArrow(ask, "row bigint, place int, key string"), "questions")
    distinct = cut_lineage(asked.select("key").distinct(), "keys")
    shards = 1 + max(n_rules, distinct.count()) // shard_rules
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    both = keyed.select(shard, F.lit(0).alias("kind"), "key", "blocked").unionByName(distinct.select(shard, F.lit(1).alias("kind"), "key", F.lit(None).cast("boolean").alias("blocked")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rules of a shard come first, then its questions, ``shard_rules`` at a time."""
        names, current, rules, keys, array = ["key", "blocked"], None, [], [], None
        with tempfile.TemporaryDirectory() as folder:  # scratch of the task

            def answer() -> Iterator[pa.RecordBatch]:
                nonlocal array
                if array is None:
                    path = os.path.join(folder, uuid.uuid4().hex)
                    write_array(path, rules)
                    array = DigestArray(path)
                    os.unlink(path)  # the mapping keeps it until it is dropped
                    rules.clear()
                at = array.find(keys)
                hits = np.flatnonzero(at >= 0).tolist()
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i].decode() for i in hits], pa.string()),
                                                      pa.array([bool(array.blocked[at[i]]) for i in hits], pa.bool_())], names=names)
                keys.clear()

            for batch in batches:
                for s, kind, key, blocked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s != current:
                        if keys:
                            yield from answer()
                        rules.clear()
                        current, array = s, None
                    if kind == 0:
                        rules.append((key.encode(), bool(blocked)))
                    else:
                        keys.append(key.encode())
                        if len(keys) >= 1 << 16:
                            yield from answer()
            if keys:
                yield from answer()

    found = cut_lineage(both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(search, "key string, blocked boolean"), "found-rules")
    hits = salted_join(asked, found, ["key"], "inner", spread_by=("row",))
    best = hits.groupBy("row").agg(F.min_by(F.struct("key", "blocked"), "place").alias("best"))
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"),
        F.when(F.col("best").isNull(), default).when(F.col("best.blocked"), BLOCK).otherwise(ALLOW).alias("verdict"))
