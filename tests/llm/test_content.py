import random

from conftest import rows

import numpy as np

from lamina.llm.content import BUCKETS, THRESHOLD, Scorer, calibrate, features, score_documents, segments, train, usual_buckets

CLEAN = ["The visit went well and the staff were kind.", "I felt so stupid after missing the visit, sorry.", "We waited 4 hours and the chairs are awful.", "Can I take this together with that?", "Pain 3/10, equal and reactive pupils.", "The shower was filthy and the bin was full.", "Thanks for your help."]
NOUNS = ["glorpface", "snarkwit", "mudbrain", "zonkhead"]
ADJ = ["worthless", "pathetic", "rotten", "useless"]


def abuse(rng):
    return f"you are a {rng.choice(ADJ)} {rng.choice(NOUNS)}, {rng.choice(ADJ)} {rng.choice(NOUNS)}!"


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = [rng.choice(CLEAN) for _ in range(rng.randrange(1, 6))]
        bad = i % 4 == 0
        if bad:
            s.insert(rng.randrange(len(s) + 1), abuse(rng))
        out.append((i, " ".join(s), bad))
    return out


def test_held_out_accuracy_and_unseen_spellings():
    rng = random.Random(9)
    tr = [(t, float(bad if rng.random() > 0.05 else not bad)) for _, t, bad in corpus(600, 1)]
    w, bias, judged, flagged = train(tr)
    s = Scorer(w, bias - calibrate(judged, flagged, {}))
    test = corpus(300, 2)
    right = sum((s.log_odds(t) >= 0) == bad for _, t, bad in test)
    assert right >= 0.97 * len(test)
    for odd in ("you are a w0r7hl3$$ gl0rpf4c3", "you are a p.a.t.h.e.t.i.c snaaarkwit", "YOU ARE A ROTTEN m u d b r a i n", "you are a usless zonkhaed, rottn glrpface"):
        assert s.log_odds("Thanks for your help. " + odd) > 0, odd
    assert s.log_odds(None) is None and s.log_odds("") is None and s.log_odds("!!! ...") is None


def test_the_cut_follows_the_rate_of_the_corpus():
    rng = np.random.default_rng(0)
    flagged = np.arange(2000) % 5 == 0  # one in five is judged abusive
    z = np.where(flagged, rng.normal(2, 1.5, 2000), rng.normal(-2, 1.5, 2000))
    corpus = lambda rate: {int(k): int(n) for k, n in zip(*np.unique(np.floor(20 * np.where(rng.random(50_000) < rate, rng.normal(2, 1.5, 50_000), rng.normal(-2, 1.5, 50_000))), return_counts=True), strict=True)}
    rare, common = calibrate(z, flagged, corpus(0.01)), calibrate(z, flagged, corpus(0.4))
    assert rare > common and rare > calibrate(z, flagged, {})
    assert calibrate(np.empty(0), np.empty(0, bool), {}) == 0.0


def test_ordinary_buckets_are_counted_over_all_documents(spark):
    texts = ["one two. three", "one two.", None, "", "three three\nfour"]
    want, n = np.zeros(BUCKETS), 0
    for t in texts:
        for seg in set(segments(t)):
            want[list(set(features(seg)))] += 1
            n += 1
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.allclose(usual_buckets(d), want / n)
    assert usual_buckets(d.limit(0)).sum() == 0


def test_score_documents(spark):
    data = corpus(200, 3)
    d = spark.createDataFrame([(i, t, "src", 1.0) for i, t, _ in data] + [(900, None, "src", 1.0), (901, "", None, 1.0), (902, "Thanks for your help. " * 20_000, "src", 1.0), (3, data[3][1], "again", 1.0)], "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame([(i, f"r{k}", "review" if bad else "clean") for i, _, bad in data for k in range(2)] + [(900, "r", "review"), (1, "r", None), (None, "r", "review")], "doc_id long, rater_id string, verdict string")
    got = score_documents(d, lab, keep=["source"])
    assert got.columns == ["doc_id", "source", "score"] and got.count() == 204
    flag = {r.doc_id for r in got.filter(f"score >= {THRESHOLD}").collect()}
    bad = {i for i, _, b in data if b}
    assert len(flag & bad) >= 0.95 * len(bad) and len(flag - bad) <= 5
    assert max(r.score for r in score_documents(d, lab.limit(0)).collect()) < 0.1
    assert rows(score_documents(d.limit(0), lab)) == []


def test_segments():
    assert segments("One two. Three\nfour  five") == [("one", "two"), ("thre",), ("four",), ("five",)]
    assert segments("b l e e d n.o.w wooould 33 mg") == [("bled", "now", "would", "0", "mg")]
    assert segments(None) == []
