"""Overlapping and gapped time intervals (problem 6).

The state of an entity is an ordered map of disjoint intervals and the gaps between them: an
insertion finds the overlapped stretch by binary search, merges it and puts the gaps around it
right. Rows are range-partitioned by (entity, start), so a busy entity is spread over many tasks,
and every task keeps the map of one entity at a time; as starts ascend, all but the last interval
are settled and leave the map early. What a task must know of the earlier ones is a single
number, the greatest end so far of the entity that continues into it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranged import batches_of, numbered, part_of, ranged
from lamina.session import pin

HIGH = "9999-12-31 00:00:00"


class IntervalMap:
    """Ordered disjoint half-open intervals and the gaps between them; touching intervals are one."""

    __slots__ = ("ends", "gap_ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts = starts or []
        self.ends = ends or []
        self.gap_ends: dict[int, int] = dict(zip(self.ends, self.starts[1:], strict=False))  # begin of a gap -> its end

    def insert(self, start: int, end: int) -> None:
        if start >= end:
            return
        lo = bisect_left(self.ends, start)  # the first interval that ends at or after start
        hi = bisect_right(self.starts, end)  # the first that begins after end
        if lo < hi:
            start = min(start, self.starts[lo])
            end = max(end, self.ends[hi - 1])
        # the gaps inside and at either side of the merged stretch change, no others
        for k in range(max(lo - 1, 0), hi):
            self.gap_ends.pop(self.ends[k], None)
        if lo:
            self.gap_ends[self.ends[lo - 1]] = start
        if hi < len(self.starts):
            self.gap_ends[end] = self.starts[hi]
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def settle(self, before: int) -> list[tuple[str, int, int]]:
        """Take out the intervals that end before an instant nothing will begin before, each with the gap after it."""
        n = min(bisect_left(self.ends, before), len(self.ends) - 1)
        out = [x for s, e in zip(self.starts[:n], self.ends[:n], strict=True) for x in (("period", s, e), ("gap", e, self.gap_ends.pop(e)))]
        del self.starts[:n], self.ends[:n]
        return out

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        return [(e, self.gap_ends[e]) for e in self.ends if e in self.gap_ends]


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last entity of a partition with the greatest end of each."""
    first = last = None
    first_end = last_end = 0
    for b in batches_of(it):
        ent, end = b.column("entity"), b.column("end_us").to_numpy()
        head, tail = ent[0].as_py(), ent[b.num_rows - 1].as_py()
        if first is None:
            part = part_of(b)
            first, first_end = head, int(end[0])
        if head == first:
            first_end = max(first_end, int(end[pc.equal(ent, first).to_numpy(zero_copy_only=False)].max()))
        top = int(end[pc.equal(ent, tail).to_numpy(zero_copy_only=False)].max())
        last_end = max(last_end, top) if tail == last else top
        last = tail
    if first is not None:
        yield _arrow([(part, first, first_end, last, last_end)], ["part", "first", "first_end", "last", "last_end"], [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()])


#: Intervals of a map from which settled ones are taken out.
SETTLE = 4096
#: Start of an interval that began in an earlier partition.
_OPEN = -(1 << 62)
_NEVER = 1 << 62


def spans(df: DataFrame, *, entity: Column, start: Column, end: Column, high: str = HIGH) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    Result: ``entity, span_kind ('period' | 'gap'), start_ts, end_ts``. A null end lasts to
    ``high``. Rows without entity or start, and rows whose end is not after the start,
    count for nothing; repeated rows change nothing; an empty input gives no spans.
    """
    high_ts = F.lit(high).cast("timestamp")
    rows = df.select(entity.cast("string").alias("entity"), F.unix_micros(start.cast("timestamp")).alias("start_us"), F.unix_micros(F.coalesce(end.cast("timestamp"), high_ts)).alias("end_us")).filter(
        F.col("entity").isNotNull() & F.col("start_us").isNotNull() & (F.col("end_us") > F.col("start_us"))
    )
    spark = df.sparkSession
    laid = pin(numbered(ranged(rows, ["entity", "start_us"], ["entity", "start_us"])))
    edges = sorted((r.asDict() for r in laid.mapInArrow(_edges, "part int, first string, first_end long, last string, last_end long").collect()), key=lambda r: r["part"])
    carry: dict[int, tuple[str, int]] = {}  # partition -> entity that continues into it, its greatest end so far
    goes_on: dict[int, bool] = {}  # does the last entity of the partition continue in a later one
    last: tuple[str, int] | None = None
    for e, nxt in zip(edges, [*edges[1:], None], strict=False):
        if last is not None and last[0] == e["first"]:
            carry[e["part"]] = last
        same = last is not None and last[0] == e["last"]
        last = (e["last"], max(e["last_end"], last[1]) if same else e["last_end"])
        goes_on[e["part"]] = nxt is not None and nxt["first"] == e["last"]
    shared = spark.sparkContext.broadcast((carry, goes_on))

    def final(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole periods and gaps; a period open at either edge comes as 'begin' and 'end' halves."""
        p = None
        carries, more = shared.value
        names, types = ["part", "entity", "span_kind", "start_us", "end_us"], [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        out: list[tuple] = []
        who, m = None, IntervalMap()

        def put(found: list[tuple[str, int, int]]) -> None:
            for kind, s, e in found:
                out.append((p, who, "end", None, e) if s == _OPEN else (p, who, kind, s, e))

        for b in batches_of(it):
            if p is None:
                p = part_of(b)
                if p in carries:
                    who = carries[p][0]
                    m.insert(_OPEN, carries[p][1])
            ent, start, end = b.column("entity").to_pylist(), b.column("start_us").to_pylist(), b.column("end_us").to_pylist()
            for e, s, t in zip(ent, start, end, strict=True):
                if e != who:
                    if who is not None:
                        put(m.settle(_NEVER))
                        put([("period", *m.periods()[0])])
                    who, m = e, IntervalMap()
                m.insert(s, t)
                if len(m.starts) > SETTLE:
                    put(m.settle(s))
            if len(out) >= 16384:
                yield _arrow(out, names, types)
                out.clear()
        if who is not None:
            put(m.settle(_NEVER))
            s, e = m.periods()[0]
            if not more.get(p):
                put([("period", s, e)])
            elif s != _OPEN:
                out.append((p, who, "begin", s, None))
        if out:
            yield _arrow(out, names, types)

    pieces = pin(laid.mapInArrow(final, "part int, entity string, span_kind string, start_us long, end_us long"))
    whole = pieces.filter("span_kind in ('period', 'gap')").select("entity", "span_kind", "start_us", "end_us")
    # at most one half of either kind per partition
    halves = [r.asDict() for r in pieces.filter("span_kind in ('begin', 'end')").orderBy("part", "entity").collect()]
    joined, begun = [], None
    for h in sorted(halves, key=lambda r: (r["part"], r["span_kind"] == "begin")):
        if h["span_kind"] == "begin":
            begun = h
        else:
            joined.append((h["entity"], "period", begun["start_us"], h["end_us"]))
    if joined:
        whole = whole.unionByName(spark.createDataFrame(joined, "entity string, span_kind string, start_us long, end_us long"))
    return whole.select("entity", "span_kind", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"))
