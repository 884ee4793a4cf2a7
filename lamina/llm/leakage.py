"""Evaluation texts leaking into training text (problem 9): Wu-Manber search over words.

The patterns are all windows of ``SEED`` consecutive words of the test items. The window slides
over the word numbers of a text: a hashed table of fixed size over blocks of two words tells how
far it may jump; where it may not, the block's suffix bucket selects the patterns that end so, and
direct comparison of all words confirms an occurrence.

Where an item has enough confirmed occurrences, common words of text and item are chained in
order, and of every chain the longest stretch that passes as a leak is taken: at least twenty item
words, errors in at most about one word in six, and no more numbers of the item replaced than
kept. The last rule judges a passage by its own item alone: texts of the same make state other
figures throughout, a copy with scattered errors keeps most. A chain that passes holds at least
``SEEDS_OF_LEAK`` occurrences (w words with e errors leave w - 4 e - 3 untouched windows), so that
the search loses none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.words import plain_words
from lamina.session import ship

SEED = 4
BLOCK = 2
#: Words of an item that must stand in a row.
MIN_WORDS = 20
#: Of these, words at the ends of a passage that may be among the errors.
EDGE_WORDS = 2
#: Words per error, and words granted on top when the errors of a passage are counted ("about" one in six).
WORDS_PER_ERROR, GRACE = 6, 1
#: Occurrences that every passage of at least ``MIN_WORDS`` that passes has.
SEEDS_OF_LEAK = 4
#: Most item words missing or doc words added between two neighbouring common words.
MAX_GAP = 5
#: Bytes of item texts searched for in one pass; they bound what is broadcast, and the result does not depend on them.
ITEM_BYTES = 64 << 20
_LANES = 4096
_TABLE = 1 << 20


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of a block of two word numbers in the shift table."""
    return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & (_TABLE - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 32) | b


class WuManber:
    """Multi-pattern search for windows of ``SEED`` word numbers; items shorter than that are found whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        vocab: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                vocab.setdefault(w, len(vocab) + 1)  # 0 stands for any other word
        self.vocab = vocab
        self.names = [n for n, _ in items]
        self.words = [np.array([vocab[w] for w in ws], dtype=np.int64) for _, ws in items]
        self.number = np.zeros(len(vocab) + 1, bool)  # is the word a number
        for w, i in vocab.items():
            self.number[i] = any(48 <= c < 58 for c in w)
        long = [k for k, ws in enumerate(self.words) if len(ws) >= SEED]
        windows = [np.lib.stride_tricks.sliding_window_view(self.words[k], SEED) for k in long]
        flat = np.concatenate(windows) if windows else np.empty((0, SEED), np.int64)
        item = np.repeat(long, [len(w) for w in windows]) if windows else np.empty(0, np.int64)
        at = np.concatenate([np.arange(len(w)) for w in windows]) if windows else np.empty(0, np.int64)
        # patterns in the order of their suffix, then of their head; equal windows of items lie side by side
        suffix, head = _pair(flat[:, 2], flat[:, 3]), _pair(flat[:, 0], flat[:, 1])
        order = np.lexsort((head, suffix))
        suffix, head = suffix[order], head[order]
        first = np.ones(len(order), bool)
        first[1:] = (suffix[1:] != suffix[:-1]) | (head[1:] != head[:-1])
        self.item, self.at = item[order].astype(np.int32), at[order].astype(np.int32)
        self.begin = np.append(np.flatnonzero(first), len(order))  # windows of pattern p: begin[p] .. begin[p + 1]
        self.head = head[first]
        bucket = suffix[first]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        self.suffix = bucket[new]
        self.bucket = np.append(np.flatnonzero(new), len(bucket))  # patterns of suffix s: bucket[s] .. bucket[s + 1]
        # shift table: distance of a block's last occurrence from the end of any pattern
        self.shift = np.full(_TABLE, SEED - BLOCK + 1, np.int8)
        for end in range(BLOCK, SEED + 1):
            np.minimum.at(self.shift, _slot(flat[:, end - 2], flat[:, end - 1]), SEED - end)
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for k, ws in enumerate(self.words):
            if 0 < len(ws) < SEED:
                self.short[tuple(ws.tolist())].append(k)

    def numbers(self, words: list[bytes]) -> list[int]:
        get = self.vocab.get
        return [get(w, 0) for w in words]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions in ``ids`` and pattern numbers of all occurrences, by position."""
        n = len(ids)
        if n < SEED or not len(self.head):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lanes = min(_LANES, max(1, n // 64))
        cuts = np.linspace(SEED - 1, n, lanes + 1).astype(np.int64)
        pos, stop = cuts[:-1].copy(), cuts[1:]
        stops = []
        while len(pos):
            sh = self.shift[_slot(ids[pos - 1], ids[pos])]
            stops.append(pos[sh == 0])
            pos = pos + np.maximum(sh, 1)
            on = pos < stop
            if not on.all():
                pos, stop = pos[on], stop[on]
        ends = np.sort(np.concatenate(stops))
        suffix = _pair(ids[ends - 1], ids[ends])
        at = np.minimum(np.searchsorted(self.suffix, suffix), len(self.suffix) - 1)
        ok = self.suffix[at] == suffix
        ends, at = ends[ok], at[ok]
        head = _pair(ids[ends - 3], ids[ends - 2])
        # binary search of the head inside the bucket of the suffix, for all places at once
        lo, hi = self.bucket[at], self.bucket[at + 1]
        last = hi
        while (lo < hi).any():
            mid = (lo + hi) // 2
            less = (lo < hi) & (self.head[np.minimum(mid, len(self.head) - 1)] < head)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        ok = (lo < last) & (self.head[np.minimum(lo, len(self.head) - 1)] == head)
        return ends[ok] - SEED + 1, lo[ok]

    def whole_short(self, ids: list[int]) -> list[int]:
        """Numbers of the items under ``SEED`` words that stand in a text."""
        found = set()
        for n in {len(k) for k in self.short}:
            for i in range(len(ids) - n + 1):
                if ids[i] and (hit := self.short.get(tuple(ids[i : i + n]))):
                    found.update(hit)
        return sorted(found)


def _chains(doc: list[int], item: list[int], lo: int, hi: int, span: int) -> list[list[tuple[int, int]]]:
    """Chains of common words of ``doc[lo:hi]`` and ``item`` as (doc place, item place), in order, none a part of another.

    Only chains that cover at least ``span`` item words.

    A chain scores a point per common word and loses one per error between neighbours; every common word goes
    on the best chain before it, or begins one.
    """
    at: dict[int, list[int]] = defaultdict(list)
    for j, w in enumerate(item):
        at[w].append(j)
    nodes: list[tuple[int, int, int, int, int]] = []  # doc place, item place, score, node before, item place of the first
    used: set[int] = set()
    first = 0  # nodes before this one are too far back
    for i in range(lo, hi):
        js = at.get(doc[i])
        if not js:
            continue
        while first < len(nodes) and nodes[first][0] < i - MAX_GAP - 1:
            first += 1
        new = []
        for j in js:
            s, prev, begin = 1, -1, j
            for k in range(len(nodes) - 1, first - 1, -1):
                i2, j2, s2, _, j0 = nodes[k]
                if j2 < j <= j2 + MAX_GAP + 1:
                    t = s2 + 2 - (i - i2 if i - i2 > j - j2 else j - j2)
                    if t > s or (prev < 0 and t == s):
                        s, prev, begin = t, k, j0
            new.append((i, j, s, prev, begin))
            if prev >= 0:
                used.add(prev)
        nodes += new
    out = []
    for k in range(len(nodes)):
        if k not in used and nodes[k][1] - nodes[k][4] + 1 >= span:
            path = []
            while k >= 0:
                path.append(nodes[k][:2])
                k = nodes[k][3]
            out.append(path[::-1])
    return out


def best_stretch(chain: list[tuple[int, int]], item: list[int], number: np.ndarray, min_words: int = MIN_WORDS) -> tuple[int, int] | None:
    """Item words covered and errors of the longest stretch of a chain that passes as a leak; None if none does."""
    need = min(min_words, len(item))
    slack = EDGE_WORDS if len(item) >= min_words else 0
    p = np.array(chain)
    gap = np.maximum(np.diff(p[:, 0]), np.diff(p[:, 1])) - 1
    err = np.concatenate([[0], np.cumsum(gap)])
    isnum = number[np.array(item)]
    before = np.concatenate([[0], np.cumsum(isnum)])  # numbers of the item before a place
    kept = np.concatenate([[0], np.cumsum(isnum[p[:, 1]])])
    best = None
    for z in range(len(p), 0, -64):  # ends of stretches, 64 at a time; all begins before each
        ends = np.arange(max(0, z - 64), z)[:, None]
        words = p[ends, 1] - p[None, :z, 1] + 1
        if best is not None and words.max() <= best[0]:
            continue
        e = err[ends] - err[None, :z]
        k = kept[ends + 1] - kept[None, :z]
        lost = before[p[ends, 1] + 1] - before[p[None, :z, 1]] - k
        edge = np.maximum(need - words, 0)  # erroneous words at the ends make up for what is short
        if len(item) >= min_words:
            fits = WORDS_PER_ERROR * (e + edge) <= words + edge + GRACE
        else:
            fits = e == 0  # a short item stands whole
        ok = (words > 0) & (edge <= slack) & fits & ((lost <= 1) | (lost <= k))
        if ok.any():
            at = np.argmax(np.where(ok, words * len(p) * MAX_GAP - e, -1))
            got = int(words.flat[at]), int(e.flat[at])
            if best is None or (got[0], -got[1]) > (best[0], -best[1]):
                best = got
    return best


def passages(model: WuManber, ids: np.ndarray, starts: np.ndarray, pats: np.ndarray, min_words: int = MIN_WORDS) -> dict[int, tuple[int, int]]:
    """Per item number the longest passage of one text that passes, from its occurrences: words, errors."""
    n = model.begin[pats + 1] - model.begin[pats]
    own = np.repeat(np.arange(len(pats)), n)
    k = model.begin[pats][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    items, begins = model.item[k], starts[own] - model.at[k]
    order = np.lexsort((begins, items))
    items, begins = items[order], begins[order]
    cut = np.flatnonzero(np.diff(items)) + 1
    out: dict[int, tuple[int, int]] = {}
    doc = None
    for a, z in zip([0, *cut], [*cut, len(items)], strict=True):
        item = int(items[a])
        words = model.words[item]
        long = len(words) >= min_words
        least = SEEDS_OF_LEAK if long else len(words) - SEED + 1
        slack = len(words) // 3 + MAX_GAP
        spot = begins[a:z]
        for part in np.split(spot, np.flatnonzero(np.diff(spot) > slack) + 1) if z - a >= least else ():  # an item may occur several times
            if len(part) < least:
                continue
            doc = ids.tolist() if doc is None else doc
            seq = words.tolist()
            lo, hi = max(0, int(part[0]) - slack), min(len(doc), int(part[-1]) + len(seq) + slack)
            for chain in _chains(doc, seq, lo, hi, min_words - EDGE_WORDS if long else len(seq)):
                got = best_stretch(chain, seq, model.number, min_words)
                if got and (item not in out or (got[0], -got[1]) > (out[item][0], -out[item][1])):
                    out[item] = got
    return out


def find_passages(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_words: int = MIN_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, item_id, words, errors``: every text that holds a passage of an item.

    Null and empty texts and items hold nothing; an item shorter than ``min_words`` counts when it stands whole and
    without error. Repeated items and texts each count; other columns do not matter. Texts are read whole and
    never shuffled; items of more than ``item_bytes`` take several passes with the same result.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    total = known.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-total // item_bytes))
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, words int, errors int"
    parts = []
    for k in range(passes):
        some = known if passes == 1 else known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        rows = sorted(((r[0], plain_words(r[1])) for r in some.collect()), key=lambda r: str(r[0]))  # about item_bytes at most
        shared = sc.broadcast(WuManber([r for r in rows if r[1]]))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in it:
                texts, ids = b.column(1).to_pylist(), b.column(0)
                seq = [np.array([*model.numbers(plain_words(t)), 0], dtype=np.int64) for t in texts]
                if not seq:
                    continue
                ends = np.cumsum([len(s) for s in seq])
                starts, pats = model.search(np.concatenate(seq))
                owner = np.searchsorted(ends, starts, side="right")
                found: list[tuple[int, int, int, int]] = []
                cut = np.flatnonzero(np.diff(owner)) + 1
                for own, ss, pp in zip(np.split(owner, cut), np.split(starts, cut), np.split(pats, cut), strict=True):
                    if len(own):
                        d = int(own[0])
                        found += [(d, item, *got) for item, got in passages(model, seq[d], ss - int(ends[d] - len(seq[d])), pp, min_words).items()]
                if model.short:
                    found += [(d, item, len(model.words[item]), 0) for d, s in enumerate(seq) for item in model.whole_short(s.tolist())]
                if found:
                    d, i, w, e = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array([model.names[x] for x in i]), pa.array(w, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "item_id", "words", "errors"])

        parts.append(docs.select(doc_id, text).mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
