"""History of changing entity attributes from periodic snapshots or updates (problem 1).

All snapshots are co-partitioned by entity and time, and each is key-sorted inside every
partition. A k-way merge walks the sorted runs, one per snapshot, each known by its current block
of rows only, and emits them in the order of entity and time, in stretches as long as one run
stays ahead of all others; one streaming pass closes a version whenever the payload changes. No
history is ever held, only one block per snapshot and one row of carry. An entity that is larger
than a partition continues in the next ones: each partition reports its first and last version,
and these edges decide what continues.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranged import batches_of, numbered, part_of, ranged
from lamina.session import pin

HIGH = "9999-12-31 00:00:00"
_NONE = np.iinfo(np.int64).max

_RUN = "entity_name string, entity_id string, payload string, start_us long, next_us long, ends_us long, ord long"


def snapshot(
    df: DataFrame, name: str, entity: Column, at: Column, payload: Column, ends: Column | None = None, rank: int = 0
) -> DataFrame:
    """One source in the operator's common form.

    Rows without entity or time say nothing about any version and are left out; a null
    payload is the value ''. ``rank`` settles rows of one entity and instant: the
    highest rank, then the greatest payload, is the state that holds from that instant.
    """
    return (
        df.select(
            F.lit(name).alias("entity_name"),
            entity.cast("string").alias("entity_id"),
            F.unix_micros(at.cast("timestamp")).alias("at_us"),
            F.lit(rank).alias("rank"),
            F.coalesce(payload.cast("string"), F.lit("")).alias("payload"),
            (F.unix_micros(ends.cast("timestamp")) if ends is not None else F.lit(None).cast("long")).alias("ends_us"),
        )
        .filter(F.col("entity_id").isNotNull() & F.col("at_us").isNotNull())
    )


#: Columns of a laid row, in the order that settles what holds when.
_KEY = ["entity_name", "entity_id", "at_us", "rank", "payload", "ends_us"]
#: Rows of a block: what the merge knows of one run at a time.
BLOCK = 4096


def _key(b: pa.RecordBatch, i: int) -> tuple:
    v = [b.column(c)[i].as_py() for c in _KEY]
    return (*v[:5], -1 if v[5] is None else v[5])


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, sorted run after run -> blocks of one run each, with the key of their first row."""
    for b in batches_of(it):
        src = b.column("src").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(src)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for k in range(lo, hi, BLOCK):
                part = b.slice(k, min(BLOCK, hi - k)).select(_KEY)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                head = _key(part, 0)
                yield pa.RecordBatch.from_pylist([dict(zip(_KEY, (*head[:5], None if head[5] < 0 else head[5]), strict=True)) | {"src": int(src[lo]), "block": sink.getvalue().to_pybytes()}], _BLOCK_SCHEMA)


_BLOCK_SCHEMA = pa.schema([("entity_name", pa.string()), ("entity_id", pa.string()), ("at_us", pa.int64()), ("rank", pa.int32()), ("payload", pa.string()), ("ends_us", pa.int64()), ("src", pa.int32()), ("block", pa.binary())])
_BLOCK_DDL = "entity_name string, entity_id string, at_us long, rank int, payload string, ends_us long, src int, block binary"


def _first_not_below(b: pa.RecordBatch, bound: tuple, lo: int) -> int:
    """First row from ``lo`` on whose key exceeds ``bound``; the rows are in order."""
    hi = b.num_rows
    if _key(b, hi - 1) <= bound:
        return hi
    while lo < hi:
        mid = (lo + hi) // 2
        if _key(b, mid) <= bound:
            lo = mid + 1
        else:
            hi = mid
    return lo


def merge_runs(blocks: Iterator[tuple[tuple, int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """K-way merge: blocks (first key, run, rows) come by first key, the blocks of a run in order.

    The heap holds the open block of each run with its next row. The smallest one gives all its rows up to
    the next one's key, be that another open run or a block not opened yet, as one stretch.
    """
    heap: list[tuple[tuple, int, int, pa.RecordBatch]] = []  # next key, run, position, block
    n = 0  # settles ties of key and run before blocks would be compared
    todo = next(blocks, None)
    while heap or todo is not None:
        while todo is not None and (not heap or todo[0] <= heap[0][0]):
            heapq.heappush(heap, (todo[0], n, 0, todo[2]))
            n += 1
            todo = next(blocks, None)
        _, run, at, b = heapq.heappop(heap)
        bound = min((k for k in (heap[0][0] if heap else None, todo[0] if todo is not None else None) if k is not None), default=None)
        end = b.num_rows if bound is None else max(at + 1, _first_not_below(b, bound, at))
        yield b.slice(at, end - at)
        if end < b.num_rows:
            heapq.heappush(heap, (_key(b, end), run, end, b))


def _merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one partition, by first key -> its versions."""

    def opened() -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
        for b in batches_of(it):
            for i in range(b.num_rows):
                rows = pa.ipc.open_stream(b.column("block")[i].as_buffer()).read_next_batch()
                yield _key(b, i), b.column("src")[i].as_py(), rows

    yield from _runs(merge_runs(opened()))


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition -> runs of equal payload, as a stream."""
    carry = None  # the newest row; its instant may still be overruled by the next row
    run = None  # [name, id, payload, start, ends]
    n = 0
    done: list[tuple] = []

    def take(name, eid, at, payload, ends):
        nonlocal run, n
        if run is not None and run[0] == name and run[1] == eid:
            if run[2] == payload:
                if ends != _NONE:
                    run[4] = ends
                return
            done.append((*run[:4], at, run[4], n))
            n += 1
        elif run is not None:
            done.append((*run[:4], _NONE, run[4], n))
            n += 1
        run = [name, eid, payload, at, ends]

    def out():
        cols = list(zip(*done, strict=True))
        done.clear()
        types = [pa.string()] * 3 + [pa.int64()] * 4
        names = ["entity_name", "entity_id", "payload", "start_us", "next_us", "ends_us", "ord"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for b in batches_of(it):
        name = b.column("entity_name").to_numpy(zero_copy_only=False)
        eid = b.column("entity_id").to_numpy(zero_copy_only=False)
        at = b.column("at_us").to_numpy(zero_copy_only=False)
        pay = b.column("payload").to_numpy(zero_copy_only=False)
        ends = b.column("ends_us").fill_null(_NONE).to_numpy(zero_copy_only=False)
        same = np.zeros(len(at), bool)  # the row before is of the same entity
        same[1:] = (eid[1:] == eid[:-1]) & (name[1:] == name[:-1])
        overruled = np.zeros(len(at), bool)  # a later row of the same entity and instant holds
        overruled[:-1] = same[1:] & (at[1:] == at[:-1])
        plain = np.zeros(len(at), bool)  # repeats the state of the row before and ends nothing
        plain[1:] = same[1:] & (pay[1:] == pay[:-1]) & ~overruled[:-1] & (ends[1:] == _NONE)
        if carry is not None and not (carry[0] == name[0] and carry[1] == eid[0] and carry[2] == at[0]):
            take(*carry)
        last = len(at) - 1
        for i in np.flatnonzero(~overruled & ~plain):
            if i < last:
                take(name[i], eid[i], int(at[i]), pay[i], int(ends[i]))
        carry = (name[last], eid[last], int(at[last]), pay[last], int(ends[last]))
        if len(done) >= 8192:
            yield out()
    if carry is not None:
        take(*carry)
    if run is not None:
        done.append((*run[:4], _NONE, run[4], n))
    if done:
        yield out()


def _edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last run of a partition, with the partition's number."""
    first = last = None
    for b in batches_of(it):
        if first is None:
            first = b.slice(0, 1).to_pylist()[0]
        last = b.slice(b.num_rows - 1, 1).to_pylist()[0]
    if first is not None:
        p = first.pop("_part")
        last.pop("_part")
        yield pa.RecordBatch.from_pylist([{**first, "part": p, "side": 0}, {**last, "part": p, "side": 1}])


def _stitch(edges: list[dict]) -> dict[int, tuple[bool, int, int]]:
    """Per partition: drop its first run?; instant and own end that close its last run.

    Walks backwards so that a version that spans many partitions finds its close in one step each.
    """
    by: dict[int, dict[int, dict]] = {}
    for e in edges:
        by.setdefault(e["part"], {})[e["side"]] = e
    order = sorted(by)
    same = lambda a, b: a["entity_name"] == b["entity_name"] and a["entity_id"] == b["entity_id"]
    out: dict[int, list] = {p: [False, _NONE, _NONE] for p in order}
    for p, q in zip(order, order[1:], strict=False):
        out[q][0] = same(by[p][1], by[q][0]) and by[p][1]["payload"] == by[q][0]["payload"]
    for p, q in zip(reversed(order[:-1]), reversed(order[1:]), strict=True):
        tail, head = by[p][1], by[q][0]
        if not same(tail, head):
            continue
        if tail["payload"] != head["payload"]:
            out[p][1] = head["start_us"]
            continue
        whole = by[q][1]["ord"] == head["ord"]  # partition q holds nothing but this run
        nxt, ends = (out[q][1], out[q][2]) if whole else (head["next_us"], _NONE)
        out[p][1] = nxt
        out[p][2] = ends if ends != _NONE else head["ends_us"]
    return {p: tuple(v) for p, v in out.items()}


def version_history(snapshots: list[DataFrame], *, high: str = HIGH, keep_payload: bool = True) -> DataFrame:
    """Versions ``(entity_name, entity_id, payload, valid_from, valid_to)``, half open.

    A version begins where the payload differs from the state before; the next version
    ends it, or an own end (``ends``) that comes sooner; otherwise it holds to ``high``.
    Empty inputs give no versions; repeated rows change nothing; columns beyond those
    named to :func:`snapshot` do not matter.
    """
    all_rows = snapshots[0].withColumn("src", F.lit(0))
    for i, s in enumerate(snapshots[1:], 1):
        all_rows = all_rows.unionByName(s.withColumn("src", F.lit(i)))
    spark = all_rows.sparkSession
    # co-partitioned by one set of bounds; inside a partition every snapshot is one sorted run
    laid = ranged(all_rows, ["entity_name", "entity_id", "at_us"], ["src", *_KEY])
    blocks = laid.mapInArrow(_blocks, _BLOCK_DDL).sortWithinPartitions(*_KEY, "src")
    runs = pin(numbered(blocks.mapInArrow(_merged, _RUN)))
    edges = [r.asDict() for r in runs.mapInArrow(_edges, _RUN + ", part long, side long").collect()]
    plan = _stitch(edges)
    high_us = int(np.datetime64(high.replace(" ", "T"), "us").astype(np.int64))
    shared = spark.sparkContext.broadcast(plan)

    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        first = True

        drop, nxt, ends = False, _NONE, _NONE

        def emit(b: pa.RecordBatch, fix: bool) -> pa.RecordBatch:
            to = np.minimum(b.column("next_us").to_numpy(), b.column("ends_us").to_numpy())
            if fix:
                own = ends if ends != _NONE else int(b.column("ends_us")[-1].as_py())
                to = to.copy()
                to[-1] = min(nxt, own)
            return pa.RecordBatch.from_arrays(
                [b.column("entity_name"), b.column("entity_id"), b.column("payload"), b.column("start_us"), pa.array(np.minimum(to, high_us))],
                ["entity_name", "entity_id", "payload", "start_us", "to_us"],
            )

        for b in batches_of(it):
            if first:
                drop, nxt, ends = shared.value.get(part_of(b), (False, _NONE, _NONE))
                b = b.slice(int(drop))
            first = False
            if b.num_rows:
                if held is not None:
                    yield emit(held, False)
                held = b
        if held is not None:
            yield emit(held, True)

    out = runs.mapInArrow(close, "entity_name string, entity_id string, payload string, start_us long, to_us long")
    cols = ["entity_name", "entity_id", *(["payload"] if keep_payload else [])]
    return out.select(*cols, F.timestamp_micros("start_us").alias("valid_from"), F.timestamp_micros("to_us").alias("valid_to"))
