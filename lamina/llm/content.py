"""Abusive, hateful or sexual content (problem 10): subword-bag embeddings under a linear softmax.

A segment (a sentence or line) is the average of the embeddings of its words, their
character n-grams and its word pairs; a softmax over two classes sits on top, and both
are trained together in numpy. Unseen misspellings share n-gram vectors with known words.
Judgements exist per document only, so training is an expectation maximisation over the
segments of a document: a document is flagged when at least one of its segments is abusive.
A document's score is the greatest probability of its segments.

Only judged documents teach what is abusive. What is ordinary comes from all documents: the share of
segments that hold a feature bucket, counted over the whole corpus, draws the bucket towards clean as a prior of
fixed weight. The score of 0.5 is where judged documents are told apart best when they are weighted to the
rate of the whole corpus, which is read from the histogram of all scores. Training runs in one task; only
vectors of fixed length and a histogram pass the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.words import fold, strip_markup
from lamina.session import pin, ship

BUCKETS = 1 << 17
DIM = 12
#: Labelled documents used for training at most; the choice is by a hash of doc_id, so it is the same on every run.
TRAIN_DOCS = 8_000
#: Weight of the corpus as a prior, per judged document: so much clean mass, spread over the ordinary buckets by their share.
PRIOR = 0.054
#: A bucket is ordinary when at least this share of all segments holds it.
ORDINARY = 3e-4
#: Score from which a document counts as abusive.
THRESHOLD = 0.5
#: Words of a segment; longer ones are cut into overlapping windows.
WINDOW, STRIDE = 14, 7

_SPLIT = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|[\r\n]+|\s{2,}")
_LEET = str.maketrans("013457$@8|", "oieastsabl")
_UNIT = re.compile(r"^[0-9.,/:%+-]+[a-z]{0,4}$")
_SPACED = re.compile(r"^(?:[a-z0-9$@*][.\-_~]){2,}[a-z0-9$@*]$")
_SAME = re.compile(r"(.)\1+")
_OUTER = ".,;:?!\"'()[]{}<>«»“”‘’…#~-_/\\"


@lru_cache(maxsize=200_000)
def _token(raw: str) -> str:
    t = raw.strip(_OUTER)
    if _SPACED.match(t):
        t = re.sub(r"[.\-_~]", "", t)
    if not t:
        return ""
    if _UNIT.match(t) and "$" not in t:
        return "0" + t.lstrip("0123456789.,/:%+-")
    if not t.isalpha():
        t = t.translate(_LEET)
        t = re.sub(r"[^a-z*]", "", t)
    return _SAME.sub(r"\1", t)


def segments(text: str | None) -> list[tuple[str, ...]]:
    """Token tuples of the sentences and lines of a text; spelled-out words are joined again."""
    if not text:
        return []
    out = []
    for part in _SPLIT.split(fold(strip_markup(text, joined=False))):
        toks: list[str] = []
        run: list[str] = []
        for raw in part.split():
            if len(raw) == 1 and not raw.isdigit():
                run.append(raw)
                continue
            if run:
                toks += ["".join(run)] if len(run) > 2 else run
                run = []
            toks.append(raw)
        if run:
            toks += ["".join(run)] if len(run) > 2 else run
        words = [w for w in map(_token, toks) if w]
        for i in range(0, max(1, len(words) - STRIDE), STRIDE) if len(words) > WINDOW else (0,):
            if seg := tuple(words[i : i + WINDOW]):
                out.append(seg)
    return out


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) % BUCKETS


@lru_cache(maxsize=200_000)
def _word_features(w: str) -> tuple[int, ...]:
    b = f"<{w}>"
    grams = {b[i : i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)}
    return (_hash("w " + w), *sorted(_hash("c " + g) for g in grams))


def features(seg: tuple[str, ...]) -> list[int]:
    """Buckets of words, their n-grams, and pairs of neighbours and next-but-one neighbours."""
    out: list[int] = []
    for w in seg:
        out += _word_features(w)
    for step in (1, 2):
        out += [_hash(f"{step} {a} {b}") for a, b in zip(seg, seg[step:], strict=False)]
    return out


class SubwordBag:
    """Average of bucket embeddings, linear softmax over (clean, abusive)."""

    def __init__(self, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = (rng.standard_normal((BUCKETS, dim)) / dim).astype(np.float32)
        self.out = (rng.standard_normal((dim, 2)) * 0.1).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.rng = rng
        # sums of squared gradients, kept from one call of fit to the next
        self.seen = np.full(BUCKETS, 1e-4, np.float32), np.full(self.out.shape, 1e-4, np.float32), np.full(2, 1e-4, np.float32)

    def fit(self, segs: list[list[int]], target: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.5, batch: int = 256) -> None:
        """Softmax regression on soft targets, Adagrad on embeddings and output together."""
        lens = np.array([len(s) for s in segs])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        flat = np.concatenate([np.array(s, dtype=np.int32) for s in segs])
        g_emb, g_out, g_bias = self.seen
        for _ in range(epochs):
            order = self.rng.permutation(len(segs))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                n = lens[pick]
                idx = flat[np.repeat(starts[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                cut = np.concatenate([[0], np.cumsum(n)[:-1]])
                h = np.add.reduceat(self.emb[idx], cut, axis=0) / n[:, None]
                p = _softmax(h @ self.out + self.bias)
                y = np.stack([1 - target[pick], target[pick]], 1)
                d = (p - y) * weight[pick, None]
                go, gb = h.T @ d / len(pick), d.mean(0)
                ge = np.repeat(d @ self.out.T / n[:, None], n, axis=0)
                order_f = np.argsort(idx)
                sorted_f = idx[order_f]
                first = np.flatnonzero(np.concatenate([[True], sorted_f[1:] != sorted_f[:-1]]))
                uniq, grad = sorted_f[first], np.add.reduceat(ge[order_f], first, axis=0).astype(np.float32)
                g_emb[uniq] += (grad**2).mean(1)
                self.emb[uniq] -= rate * grad / np.sqrt(g_emb[uniq])[:, None]
                g_out += go**2
                self.out -= (rate * go / np.sqrt(g_out)).astype(np.float32)
                g_bias += gb**2
                self.bias -= (rate * gb / np.sqrt(g_bias)).astype(np.float32)

    def weights(self) -> tuple[np.ndarray, float]:
        """Log-odds contribution of every bucket, and of the bias."""
        return (self.emb @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Share of judgements that are wrong either way (a prior; it keeps single misjudged documents from counting fully).
NOISE = 0.1


def train(docs: list[tuple[str, float]], usual: np.ndarray | None = None, rounds: int = 2, epochs: int = 6) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Bucket weights, bias, and per document its cross-fitted log-odds and flag, from (text, share of 'review' judgements).

    ``usual`` has the share of all segments of the corpus that hold each bucket. In every round each half of the
    documents is judged by a model of the other half, so that a misjudged document cannot confirm itself. The last
    model sees all documents.
    """
    bags = [(sorted(set(segments(t))), y) for t, y in docs]
    bags = [(b, y) for b, y in bags if b]
    index = {s: i for i, s in enumerate(sorted({s for b, _ in bags for s in b}))}
    if not index:
        return np.zeros(BUCKETS, np.float32), -5.0, np.empty(0), np.empty(0, bool)
    feats = [features(s) for s in index]
    ids = [np.array([index[s] for s in b]) for b, _ in bags]
    flagged = np.array([y > 0.5 for _, y in bags])
    common = np.flatnonzero(usual >= ORDINARY) if usual is not None else np.empty(0, np.int64)
    # responsibilities: how far each segment is the reason for the flag; weight of each document's segments
    resp = [np.full(len(b), 1 / len(b) if y else 0.0) for b, y in zip(ids, flagged, strict=True)]
    trust = [np.ones(len(b)) for b in ids]

    def fit(pick: np.ndarray, epochs: int) -> SubwordBag:
        mass, seen = np.zeros(len(feats)), np.zeros(len(feats))
        for k in pick:
            mass[ids[k]] += resp[k] * trust[k]
            seen[ids[k]] += trust[k]
        use = np.flatnonzero(seen > 0)
        segs, target, weight = [feats[i] for i in use], mass[use] / seen[use], np.sqrt(seen[use])
        if len(common):
            segs = segs + [[int(f)] for f in common]
            target = np.concatenate([target, np.zeros(len(common))])
            weight = np.concatenate([weight, PRIOR * len(pick) * usual[common]])
        model = SubwordBag()
        model.fit(segs, target, weight, epochs)
        return model

    fold = np.arange(len(bags)) % 2
    top = np.zeros(len(bags))
    for _ in range(rounds):
        new = list(resp)
        for f in (0, 1):
            w, bias = fit(np.flatnonzero(fold != f), epochs).weights()
            p = {}
            for k in np.flatnonzero(fold == f):
                q = np.array([p[i] if i in p else p.setdefault(i, float(_sigmoid(w[feats[i]].mean() + bias))) for i in ids[k]])
                top[k] = q.max()
                if flagged[k]:
                    none = np.prod(1 - q)
                    real = (1 - none) * (1 - NOISE) / ((1 - none) * (1 - NOISE) + none * NOISE)
                    new[k] = np.minimum(q / max(1e-9, 1 - none), 1.0) * real
                else:
                    trust[k] = np.where(q > 0.8, NOISE, 1.0)
        resp = new
    w, bias = fit(np.arange(len(bags)), 2 * epochs).weights()
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return w, bias, np.log(top / (1 - top)), flagged


def _cut(score: np.ndarray, flagged: np.ndarray, clean_weight: float = 1.0) -> float:
    """Log-odds that separate best by F1, clean documents weighted; the middle of all cuts that are nearly as good."""
    if not flagged.any():
        return 0.0
    order = np.argsort(-score)
    hit, wrong = np.cumsum(flagged[order]), np.cumsum(~flagged[order]) * clean_weight
    f1 = 2 * hit / (hit + wrong + flagged.sum())
    good = score[order][f1 >= f1.max() - 0.01]
    return float((good.max() + good.min()) / 2)


#: Bins of log-odds in the histogram of all scores.
_BINS = 20


def calibrate(score: np.ndarray, flagged: np.ndarray, seen: dict[int, int]) -> float:
    """Log-odds of the score 0.5: judged documents are weighted to the rate of all, which the cut itself gives.

    Of several rates that agree with their own cut the lowest is taken: the search begins where next to nothing is abusive.
    """
    cut = _cut(score, flagged)
    bins, n = np.array(sorted(seen)), np.array([seen[b] for b in sorted(seen)])
    share = flagged.mean() if len(flagged) else 0.0
    if not 0 < share < 1 or not n.sum():
        return cut
    cut = _cut(score, flagged, 999 * share / (1 - share))
    for _ in range(20):
        rate = np.clip(n[bins >= cut * _BINS].sum() / n.sum(), 1e-6, share)
        new = _cut(score, flagged, (1 - rate) / rate * share / (1 - share))
        if new == cut:
            break
        cut = new
    return cut


class Scorer:
    """Scores texts with trained bucket weights; equal segments and words are computed once."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.w, self.bias = weights, bias
        self.segment = lru_cache(maxsize=300_000)(self._segment)
        self.word = lru_cache(maxsize=200_000)(self._word)

    def _word(self, w: str) -> tuple[float, int]:
        f = list(_word_features(w))
        return float(self.w[f].sum()), len(f)

    def _segment(self, seg: tuple[str, ...]) -> float:
        total, n = 0.0, 0
        for w in seg:
            s, k = self.word(w)
            total += s
            n += k
        for step in (1, 2):
            for a, b in zip(seg, seg[step:], strict=False):
                total += float(self.w[_hash(f"{step} {a} {b}")])
                n += 1
        return total / n + self.bias

    def log_odds(self, text: str | None) -> float | None:
        """Greatest log-odds of a text's segments; None if it has none."""
        return max(map(self.segment, segments(text)), default=None)


def training_rows(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_DOCS) -> DataFrame:
    """At most ``limit`` labelled texts with the share of 'review' among their judgements; ties and null verdicts are left out."""
    v = F.lower(F.trim("verdict"))
    votes = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.avg(F.when(v == "review", 1.0).when(v == "clean", 0.0)).alias("share")).filter("share is not null and share <> 0.5")
    pick = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # the bounded training sample
    # of repeated rows of a document the smallest text counts
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(pick), "doc_id").groupBy("doc_id", "share").agg(F.min("text").alias("text"))


#: Different segments a task counts before it turns them into buckets.
_HELD = 100_000


def usual_buckets(docs: DataFrame) -> np.ndarray:
    """Share of all segments of the corpus that hold each bucket. One sum per bucket passes the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)  # the last one counts segments
        held: Counter[tuple[str, ...]] = Counter()

        def spend() -> None:
            for s, n in held.items():
                total[list(set(features(s)))] += n
                total[BUCKETS] += n
            held.clear()

        for b in it:
            for t in b.column(0).to_pylist():
                held.update(set(segments(t)))
            if len(held) > _HELD:
                spend()
        spend()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1)
    out[rows["bucket"]] = rows["n"]
    return out[:BUCKETS] / max(1.0, out[BUCKETS])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    judged: np.ndarray  # cross-fitted log-odds of the judged documents
    flagged: np.ndarray


_fitted: dict[tuple, Model] = {}


def fit(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS) -> Model:
    """Model of the judged documents, trained in one task; fitted once per pair of tables and session."""
    key = (docs.sparkSession.sparkContext.applicationId, docs.semanticHash(), labels.semanticHash(), train_docs)
    if key in _fitted:
        return _fitted[key]
    ship(docs.sparkSession)
    usual = docs.sparkSession.sparkContext.broadcast(usual_buckets(docs))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for b in it for t, y in zip(b.column("text").to_pylist(), b.column("share").to_pylist(), strict=True)]
        if rows:
            w, bias, judged, flagged = train(rows, usual.value)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([bias]), pa.array([judged.astype(float).tobytes()]), pa.array([flagged.tobytes()])], ["w", "bias", "judged", "flagged"])

    one = training_rows(docs, labels, limit=train_docs).repartition(1).sortWithinPartitions("doc_id").select("text", "share")
    got = one.mapInArrow(run, "w binary, bias double, judged binary, flagged binary").collect()  # at most one row
    if got:
        r = got[0]
        m = Model(np.frombuffer(r["w"], np.float32), r["bias"], np.frombuffer(r["judged"]), np.frombuffer(r["flagged"], bool))
    else:
        m = Model(np.zeros(BUCKETS, np.float32), -5.0, np.empty(0), np.empty(0, bool))
    _fitted[key] = m
    return m


def score_documents(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id``, ``keep`` columns and ``score`` in [0, 1] of every row of ``docs``.

    Null and empty texts score 0; without any judgement every text scores near 0. Texts are read
    whole; repeated rows each get their score.
    """
    fitted = fit(docs, labels, train_docs=train_docs)
    model = docs.sparkSession.sparkContext.broadcast((fitted.weights, fitted.bias))
    keep = keep or []
    src = docs.select(F.struct("doc_id", *keep).alias("row"), "text")
    schema = f"row {src.schema['row'].dataType.simpleString()}, z double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([scorer.log_odds(t) for t in b.column("text").to_pylist()], pa.float64())], ["row", "z"])

    scored = pin(src.mapInArrow(run, schema))
    seen = scored.groupBy(F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "z")) * _BINS).alias("b")).agg(F.count("*").alias("n")).filter("b is not null").collect()  # at most 60 * _BINS rows
    cut = calibrate(fitted.judged, fitted.flagged, {r["b"]: r["n"] for r in seen})
    return scored.select("row.*", F.coalesce(1 / (1 + F.exp(F.lit(cut) - F.col("z"))), F.lit(0.0)).alias("score"))
