"""Randomness from keys: the same draw for the same key, however rows are partitioned."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: str, *key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and key."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key))
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def _poisson_bounds() -> list[float]:
    """Chances that a Poisson(1) count is 0, 1 at most, and so on to 8 at most."""
    total, term = 0.0, 0.36787944117144233
    bounds = []
    for k in range(9):
        total += term
        bounds.append(total)
        term /= k + 1
    return bounds


def poisson(u: Column) -> Column:
    """A Poisson(1) count from a uniform number: how often a bootstrap sample takes a group."""
    out = F.lit(9)
    for k, bound in reversed(list(enumerate(_poisson_bounds()))):
        out = F.when(u < bound, k).otherwise(out)
    return out


def resampled(groups: DataFrame, key: str, values: list[str], seed: str, samples: int) -> DataFrame:
    """``(sample, *values)``: the sums of whole numbers over ``samples`` bootstrap samples, each of which takes a group as
    often as ``poisson(uniform(seed, sample, key))`` says.

    Every group has one row. No row is made for a sample of a group: a task draws the counts of some groups for all samples
    at once and hands on one row a sample."""
    shape = ", ".join(["sample int", *(f"{v} long" for v in values)])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [f"{seed}:{s}:".encode() for s in range(samples)]
        bounds, sha = np.array(_poisson_bounds()), hashlib.sha256
        sums = np.zeros((len(values), samples), np.int64)
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            weights = np.array([batch.column(v).to_numpy(zero_copy_only=False) for v in values], np.int64)
            for i in range(0, len(keys), 64):
                digests = b"".join([sha(x + k).digest() for k in (g.encode() for g in keys[i : i + 64]) for x in before])
                # 52 bits of each, as uniform takes them
                u = (np.frombuffer(digests, ">u8").reshape(-1, samples, 4)[:, :, 0] >> np.uint64(12)).astype(float) / float(1 << 52)
                sums += weights[:, i : i + 64] @ np.searchsorted(bounds, u, side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples, dtype=np.int32)), *map(pa.array, sums)], ["sample", *values])

    # few bytes, much work: a number of tasks that is not coalesced by size
    dealt = groups.select(F.col(key).cast("string").alias("_key"), *values).repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    return dealt.mapInArrow(drawn, shape).groupBy("sample").agg(*(F.sum(v).alias(v) for v in values))


def thirds(text: Column) -> Column:
    """The SHA-256 of a text modulo 3: powers of 16 are 1 modulo 3, so eight 32-bit words may be summed."""
    digest = F.sha2(text, 256)
    words = [F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(8)]
    return sum(words[1:], words[0]) % 3
