"""Filling fixed-capacity containers with items (problem 8): conflict-constrained best-fit.

Items are dealt to shards of about ``SHARD_TOKENS`` tokens by a hash, so that shards stay equal in
size however much there is. In a shard, items come longest first; bins are kept by residual
room, and the successor search starts at the tightest bin that holds the item and goes on to the
next larger residual until a bin is compatible. A bin carries two bitmaps: the sources it
draws on, of which it may have ``max_sources``, and the duplicate clusters in it, of which it may
hold one member each. Copies of a text have one size and come one after another, so all
copies share a single sweep over the bins.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.words import plain_words
from lamina.session import pin, ship

CAPACITY = 2_048
SHARD_TOKENS = 4_000_000
#: What an item costs a shard besides its tokens, in tokens.
ITEM_COST = 16
MAX_SOURCES = 6
#: Ranks file of a public byte-level BPE; a parameter, the file stays where it is.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measure(docs: DataFrame, *, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, cluster, tokens``: length in tokens and a hash of the text's plain words.

    Null and empty texts have no tokens. Equal clusters are exact copies up to case,
    punctuation, markup and layout.
    """
    ship(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, cluster long, tokens int"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in it:
            texts = b.column("text").to_pylist()
            words = [b" ".join(plain_words(t)) for t in texts]
            marks = [(zlib.crc32(w) << 31) ^ zlib.adler32(w) ^ (len(w) << 1) for w in words]
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(marks, pa.int64()), pa.array(sizes, pa.int32())], ["doc_id", "source", "cluster", "tokens"])

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, schema)


class Bins:
    """Open bins of one shard, kept by residual room."""

    def __init__(self, capacity: int, max_sources: int):
        self.capacity, self.max_sources = capacity, max_sources
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set when a bin with room r is open
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _push(self, b: int, room: int) -> None:
        if room:
            self.by_room[room].append(b)
            self.rooms |= 1 << room

    def place(self, size: int, source: int, cluster: int, copies: int) -> list[int]:
        """Bins for ``copies`` items of one size, source bit and cluster bit (0: no copies elsewhere)."""
        out: list[int] = []
        moved: list[tuple[int, int]] = []
        ahead = self.rooms >> size
        room = size - 1
        while ahead and len(out) < copies:
            step = (ahead & -ahead).bit_length()
            room += step
            ahead >>= step
            here = self.by_room[room]
            rest: list[int] = []
            for k, b in enumerate(here):
                if len(out) == copies:
                    rest += here[k:]
                    break
                if self.clusters[b] & cluster or (self.sources[b] | source).bit_count() > self.max_sources:
                    rest.append(b)
                    continue
                self.sources[b] |= source
                self.clusters[b] |= cluster
                out.append(b)
                moved.append((b, room - size))
                if not cluster:  # items without copies come singly
                    rest += here[k + 1 :]
                    break
            if len(rest) != len(here):
                self.by_room[room] = rest
                if not rest:
                    self.rooms &= ~(1 << room)
        while len(out) < copies:
            b = len(self.sources)
            self.sources.append(source)
            self.clusters.append(cluster)
            out.append(b)
            moved.append((b, self.capacity - size))
        for b, left in moved:
            self._push(b, left)
        return out


def pack_shard(sizes: list[int], sources: list[str], clusters: list[int], capacity: int = CAPACITY, max_sources: int = MAX_SOURCES) -> list[int]:
    """Bin number of each item of one shard; items must come longest first, copies side by side."""
    bins = Bins(capacity, max_sources)
    src = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    count: dict[int, int] = {}
    for c in clusters:
        count[c] = count.get(c, 0) + 1
    bit: dict[int, int] = {}
    for c, n in count.items():
        if n > 1:
            bit[c] = 1 << len(bit)
    out: list[int] = []
    i = 0
    while i < len(sizes):
        j = i + 1
        c = bit.get(clusters[i], 0)
        while c and j < len(sizes) and (sizes[j], sources[j], clusters[j]) == (sizes[i], sources[i], clusters[i]):
            j += 1
        out += bins.place(sizes[i], src[sources[i]], c, j - i)
        i = j
    return out


#: Repeated rows that are numbered in one go.
RUN = 65_536


def pack(items: DataFrame, *, capacity: int = CAPACITY, max_sources: int = MAX_SOURCES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``container_id, doc_id, piece, tokens, first_token`` of every piece of ``items`` (see :func:`measure`).

    An item is one piece unless it exceeds the capacity: then it gives whole containers and a rest.
    Items without tokens need no room and give no row. Null sources are one source. Repeated
    rows are items of their own (and copies of each other, so they part).
    """
    ship(items.sparkSession)
    it = pin(items.filter("tokens > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "cluster", "tokens"))
    total, n = it.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    shards = max(1, round((total + ITEM_COST * n) / shard_tokens))
    # repeated rows are counted and numbered, so that they spread over the shards too
    same = it.groupBy("doc_id", "source", "cluster", "tokens").agg(F.count("*").alias("n"))
    runs = same.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)")))
    it = runs.withColumn("copy", F.explode(F.expr(f"sequence(`from`, least(`from` + {RUN}L, n) - 1)"))).drop("n", "from")
    last = F.col("tokens") % capacity
    pieces = it.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))))
    pieces = pieces.withColumn("first_token", F.col("piece") * capacity).withColumn("size", F.when((F.col("first_token") + capacity > F.col("tokens")) & (last > 0), last).otherwise(capacity))
    full = pieces.filter(F.col("size") == capacity)
    part = pieces.filter(F.col("size") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "tokens", "copy"), F.lit(shards)).cast("int"))
    # every shard is one task: shards are equal in size, and there are as many as the data asks for
    laid = part.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.desc("size"), "cluster", "source", "doc_id")
    schema = f"container_id string, doc_id {items.schema['doc_id'].dataType.simpleString()}, piece int, tokens int, first_token int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            if held:
                x = pd.concat(held)
                bins = pack_shard(x["size"].tolist(), x["source"].tolist(), x["cluster"].tolist(), capacity, max_sources)
                ids = [f"{s}-{b}" for s, b in zip(x["shard"], bins, strict=True)]
                yield pd.DataFrame({"container_id": ids, "doc_id": x["doc_id"].to_numpy(), "piece": x["piece"].to_numpy(), "tokens": x["size"].to_numpy(), "first_token": x["first_token"].to_numpy()})
                held.clear()

        for b in batches:
            for s, g in b.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != s:
                    yield from done()
                held.append(g)
        yield from done()

    packed = laid.mapInPandas(run, schema)
    alone = full.select(F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("container_id"), "doc_id", "piece", F.col("size").cast("int").alias("tokens"), "first_token")
    return packed.unionByName(alone)


def check_packed(packed: DataFrame, items: DataFrame, *, capacity: int = CAPACITY, max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row of what a packing must hold: items packed, and counts of broken rules, all of which must be 0.

    ``over_capacity`` and ``mixed`` containers, ``torn`` items (pieces that do not add up to the item, or more pieces than
    its length asks for) and ``twins`` (copies in one container).
    """
    need = items.filter("tokens > 0").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.ceil(F.col("tokens") / capacity)).alias("pieces"), F.min("cluster").alias("cluster"), F.min("source").alias("source"))
    have = packed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("p"))
    torn = need.join(have, "doc_id", "full").filter("t is null or tokens is null or t <> tokens or p <> pieces").agg(F.count("*").alias("torn"))
    whole = packed.join(need.select("doc_id", "cluster", "source"), "doc_id")
    room = whole.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count_distinct(F.coalesce("source", F.lit(""))).alias("s"), F.count("*").alias("n"), F.count_distinct("cluster").alias("c"))
    rules = room.agg(F.count_if(F.col("t") > capacity).alias("over_capacity"), F.count_if(F.col("s") > max_sources).alias("mixed"), F.count_if(F.col("c") < F.col("n")).alias("twins"))
    return need.agg(F.count("*").alias("items")).crossJoin(torn).crossJoin(rules)  # one row each


def fill_report(packed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, share of room used, and the number of containers that are less than 95 % full."""
    c = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    used: Column = F.sum("t") / (F.count("*") * capacity)
    return c.agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.round(used, 6).alias("used"), F.count_if(F.col("t") < 0.95 * capacity).alias("below_95"))
