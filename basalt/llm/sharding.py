"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Row i of the matrix says how many rows partition i sends to each block of each shard. It is a
draw without replacement, so that after permuting the rows inside every partition, exchanging them
and permuting again inside every block, each global order is equally likely and every shard has
its exact size. No task needs the whole matrix: partitions are the leaves of a binary tree whose
nodes split the blocks' room by seeded multivariate hypergeometric draws, and a task walks from the
root to its own leaf.

Defined cases: nulls, empty texts and repeated rows are ordinary rows; an empty table gives no
rows; fewer rows than shards leave the last shards empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import checkpoint, configure

SHARDS = 24
SEED = 20240607
#: Most rows of one block, the unit that a single task orders.
BLOCK_ROWS = 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn without replacement; also beyond numpy's limit of 1e9.

    Large cases sum the probabilities outwards from the mode over 12 standard deviations, beyond
    which less than 1e-30 is left.
    """
    total = good + bad
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if n == total:
        return good
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    sd = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))
    mid, reach = (n + 1) * (good + 1) // (total + 2), int(12 * sd) + 30
    ks = np.arange(max(0, n - bad, mid - reach), min(n, good, mid + reach) + 1, dtype=np.float64)
    steps = np.log((good - ks[:-1]) / (ks[:-1] + 1)) + np.log((n - ks[:-1]) / (bad - n + ks[:-1] + 1))
    logp = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logp - logp.max()))
    return int(ks[min(np.searchsorted(p, rng.random() * p[-1], side="right"), len(ks) - 1)])


def multivariate(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows fall to each of the places, without replacement."""
    total = int(room.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out = np.zeros_like(room)
    for j, here in enumerate(room):
        out[j] = got = hypergeometric(rng, int(here), total - int(here), n)
        total, n = total - int(here), n - got
    return out


def matrix_row(i: int, sizes: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """Row i of the communication matrix for partitions of these sizes and blocks of this room."""
    first, last, before = 0, len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    while last - first > 1:
        middle = (first + last) // 2
        left = multivariate(np.random.default_rng([seed, first, last]), room, int(before[middle] - before[first]))
        if i < middle:
            last, room = middle, left
        else:
            first, room = middle, room - left
    return room


def blocks(n: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of every block."""
    shard, first, room = [], [], []
    for j in range(shards):
        rows = n // shards + (j < n % shards)
        parts = max(1, -(-rows // block_rows))
        at = 0
        for b in range(parts):
            size = rows // parts + (b < rows % parts)
            shard.append(j)
            first.append(at)
            room.append(size)
            at += size
    return np.array(shard), np.array(first), np.array(room, dtype=np.int64)


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of df with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Input columns of these names, or starting with ``__``, are replaced. The input is checkpointed
    once, because both passes must see the same partitions, also after an executor is lost.
    """
    spark = configure(df.sparkSession)
    keep = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("__")]
    fixed = checkpoint(df.select(*keep))
    sizes_of = {r[0]: r[1] for r in fixed.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    sizes = np.zeros(max(sizes_of, default=0) + 1, dtype=np.int64)
    for p, n in sizes_of.items():
        sizes[p] = n
    shard, first, room = blocks(int(sizes.sum()), shards, block_rows)
    law = spark.sparkContext.broadcast((sizes, room))

    def deal(batches):
        i = TaskContext.get().partitionId()
        sizes, room = law.value
        if i >= len(sizes) or not sizes[i]:
            return
        rng = np.random.default_rng([seed, i])
        to = np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(i, sizes, room, seed))
        rng.shuffle(to)
        at = 0
        for batch in batches:
            n = batch.num_rows
            own = [pa.array(to[at : at + n]), pa.array(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "__block", "__r"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema.fields)
    dealt = fixed.mapInArrow(deal, f"{fields}, __block int, __r long")
    where = spark.createDataFrame([(int(b), int(s), int(f)) for b, (s, f) in enumerate(zip(shard, first, strict=True))], "__block int, shard int, __first long")
    order = Window.partitionBy("__block").orderBy("__r", *(F.xxhash64(c) for c in keep[:1]))
    placed = dealt.withColumn("__at", F.row_number().over(order).cast("long") - 1)
    return placed.join(F.broadcast(where) if len(shard) <= 100_000 else where, "__block").select(*keep, "shard", (F.col("__first") + F.col("__at")).alias("slot"))


def op_query(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of every document, shuffled into shards with counts at most one apart."""
    digest = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shuffle_into_shards(digest)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
