"""References to records that do not exist (problem 7): range-partitioned sorted-array probe.

Parents and references are range-partitioned by one set of bounds over the 64-bit hash of their
key. Each range stores its parents as a sorted array of hashes beside their texts; reference
batches probe it by one vectorised binary search, and texts are compared where hashes meet, so
the answer is exact. The row's own hash takes part in the bounds: references of a hot key spread
over as many ranges as they need, and a range that begins inside such a key is told the last
parent of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranged import batches_of, numbered, part_of, ranged
from lamina.session import pin


class SortedKeys:
    """Parents of one range: hashes in ascending order and their texts."""

    def __init__(self, hashes: np.ndarray, texts: pa.Array):
        self.hashes, self.texts = hashes, texts

    def missing(self, hashes: np.ndarray, texts: pa.Array) -> np.ndarray:
        """True where a key is not among the parents."""
        n = len(self.hashes)
        if not n:
            return np.ones(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        safe = np.minimum(at, n - 1)
        met = (at < n) & (self.hashes[safe] == hashes)
        same = pc.equal(self.texts.take(pa.array(safe)), texts).to_numpy(zero_copy_only=False) & met
        for i in np.flatnonzero(met & ~same):  # another text of the same hash lies first
            k, text = int(at[i]) + 1, texts[int(i)].as_py()
            while k < n and self.hashes[k] == hashes[i] and not same[i]:
                same[i] = self.texts[k].as_py() == text
                k += 1
        return ~same


def missing_references(refs: DataFrame, parents: DataFrame, *, ref_key: Column, parent_key: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``ref_key`` of every reference whose key no parent has.

    Keys are compared as texts. Null keys are no references and no parents (turn blanks into null before). Repeated
    parents are one; repeated references each come out. An empty parent table makes every
    reference an orphan; an empty reference table gives none.
    """
    spark = refs.sparkSession
    row = F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))
    r = refs.select(ref_key.cast("string").alias("ref_key"), F.lit(1).cast("byte").alias("_ref"), row.alias("_row")).filter("ref_key is not null")
    p = parents.select(parent_key.cast("string").alias("ref_key")).filter("ref_key is not null").distinct()
    p = p.select("ref_key", F.lit(0).cast("byte").alias("_ref"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"))
    both = r.unionByName(p).withColumns({"_k": F.xxhash64("ref_key"), "_h": F.xxhash64("_row")})
    # in a range the parents come first and in order; references need none
    laid = ranged(both, ["_k", "_ref", "_h"], ["_ref", F.when(F.col("_ref") == 0, F.col("_k"))])
    laid = pin(numbered(laid.select("_k", "_ref", "ref_key", "_row")))

    def tail(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last parent of the range, and those that share its hash."""
        last, texts = None, []
        for b in batches_of(it):
            k = b.column("_k").to_numpy()
            if last is None or k[-1] != last:
                last, texts = int(k[-1]), []
            part = part_of(b)
            texts += b.column("ref_key").filter(pa.array(k == last)).to_pylist()
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last], pa.int64()), pa.array([texts], pa.list_(pa.string()))], ["part", "last", "texts"])

    ends = {t["part"]: (t["last"], list(t["texts"])) for t in laid.filter("_ref = 0").select("_k", "ref_key", "_part").mapInArrow(tail, "part int, last long, texts array<string>").collect()}  # one row per range
    carried, before = {}, None
    for part in range(max(ends, default=-1) + 2):
        carried[part] = before
        last = ends.get(part, before)
        # texts of one hash may lie on both sides of a bound
        before = (last[0], before[1] + last[1]) if last is not before and before and last[0] == before[0] else last
    shared = spark.sparkContext.broadcast((carried, before))

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, final = shared.value
        hashes: list[np.ndarray] | None = None
        texts: list[pa.Array] = []
        store: SortedKeys | None = None
        for b in batches_of(it):
            if hashes is None:
                seen = known.get(part_of(b), final)
                hashes = [np.full(len(seen[1]), seen[0], np.int64)] if seen else []
                texts = [pa.array(seen[1], pa.string())] if seen else []
            n = int((b.column("_ref").to_numpy() == 0).sum())
            if n:
                hashes.append(b.column("_k").slice(0, n).to_numpy())
                texts.append(b.column("ref_key").slice(0, n))
            if n == b.num_rows:
                continue
            if store is None:
                store = SortedKeys(np.concatenate(hashes) if hashes else np.empty(0, np.int64), pa.concat_arrays(texts) if texts else pa.array([], pa.string()))
            b = b.slice(n)
            out = store.missing(b.column("_k").to_numpy(), b.column("ref_key"))
            if out.any():
                yield b.select(["ref_key", "_row"]).filter(pa.array(out))

    out = laid.mapInArrow(probe, "ref_key string, _row " + r.schema["_row"].dataType.simpleString())
    return out.select("ref_key", *([F.col("_row")[c].alias(c) for c in keep]))


def orphan_report(missing: DataFrame, *, ref_field: str, period: Column) -> DataFrame:
    """Misses per reference field and month: ``ref_field, period, orphan_rows, orphan_keys``."""
    return missing.groupBy(F.lit(ref_field).alias("ref_field"), F.date_format(period, "yyyy-MM").alias("period")).agg(
        F.count("*").alias("orphan_rows"), F.count_distinct("ref_key").alias("orphan_keys")
    )
