import random

import numpy as np
from conftest import rows

from lamina.llm.leakage import SEED, WuManber, find_passages
from lamina.llm.words import plain_words

WORDS = [f"{a}{b}" for a in ("bel", "dor", "fan", "gim", "hul", "jok", "lam", "mip", "nor", "pel", "qua", "rin", "sol", "tam", "vex", "wol", "zur", "kip", "bra", "cle") for b in ("an", "er", "is", "ot", "um", "ay", "el", "on")]


def item(rng, n=50):
    return [rng.choice(WORDS) for _ in range(n)]


def filler(rng, n):
    return [f"x{rng.choice('abcdefgh')}{rng.choice('ijklmno')}{rng.choice('pqrst')}" for _ in range(n)]


def noisy(rng, ws, rate=1 / 7):
    out = []
    for k, w in enumerate(ws):
        if k % round(1 / rate) == 3:
            how = rng.randrange(4)
            if how == 0:
                out.append(w[:-1] + "q")
            elif how == 1:
                out += [w, "still"]
            elif how == 2:
                out.append("nearly")
            continue
        out.append(w)
    return out


def test_search_equals_brute_force():
    rng = random.Random(0)
    items = [(f"i{k}", [w.encode() for w in item(rng, 30)]) for k in range(20)]
    m = WuManber(items)
    text = []
    for _ in range(400):
        ws = rng.choice(items)[1]
        a = rng.randrange(len(ws) - 3)
        text += ws[a : a + rng.randrange(2, 9)] + ([b"other"] if rng.random() < 0.5 else [])
    ids = np.array(m.numbers(text))
    pats = {tuple(ws[p : p + SEED]) for _, ws in items for p in range(len(ws) - SEED + 1)}
    want = [i for i in range(len(text) - SEED + 1) if tuple(text[i : i + SEED]) in pats]
    starts, which = m.search(ids)
    assert starts.tolist() == want and len(which) == len(want)


def test_planted_passages_and_decoys(spark):
    rng = random.Random(1)
    items = {f"i{k}": item(rng) for k in range(12)}
    docs, want, n = [], set(), 0

    def add(words, leak=None, dress=str):
        nonlocal n
        docs.append((n, dress(" ".join(words)), "s", "item"))
        if leak:
            want.add((n, leak))
        n += 1

    for k, ws in items.items():
        add(filler(rng, 40) + ws[5:27] + filler(rng, 30), k)  # plain, 22 words
        add(noisy(rng, ws), k)  # misspelt, missing, added
        add(ws[:30], k, lambda t: "<p>" + t.upper().replace(" ", "&nbsp;<b>x</b>".replace("x", ""), 3).replace("A", "А") + "</p>")  # markup and look-alikes
        add(ws[:30], k, lambda t: t.replace("e", "e​").replace(" ", ",\n", 7))  # invisible characters and layout
        add(filler(rng, 10) + ws[10:22] + filler(rng, 10))  # too short
        add([rng.choice(WORDS) if j % 3 == 0 else w for j, w in enumerate(ws)])  # same make, other facts
    docs += [(n, None, "s", "item"), (n + 1, "", "s", "item"), (n + 2, " ".join(filler(rng, 60_000) + items["i3"][:30]), "s", "item")]
    want.add((n + 2, "i3"))
    d = spark.createDataFrame(docs, "doc_id long, text string, words string, item_id string")
    e = spark.createDataFrame([(k, " ".join(ws), 1) for k, ws in items.items()] + [("none", None, 1), ("empty", "", 1)], "item_id string, item_text string, errors int")
    assert set(rows(find_passages(d, e), "doc_id", "item_id")) == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    e = spark.createDataFrame([("i", "a b c d e f")], "item_id string, item_text string")
    assert rows(find_passages(d, e), "doc_id", "item_id", "words", "errors") == [(1, "i", 6, 0)]  # a short item that stands whole
    assert rows(find_passages(d.limit(0), e)) == [] and rows(find_passages(d, e.limit(0))) == []


def test_plain_words():
    assert plain_words("A <b>22-year-old</b> d'été&nbsp;!\n") == [b"a", b"22yearold", b"dete"]
    assert plain_words("hyphen-\nated  line") == [b"hyphenated", b"line"]
    assert plain_words(None) == [] and plain_words("...") == []


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    e = spark.createDataFrame(list(items.items()), "item_id string, item_text string")
    return set(rows(find_passages(d, e, **kw), "doc_id", "item_id"))


def figures(rng, ws):
    """The same words with a figure at every fifth place."""
    return [str(rng.randrange(1000, 9999)) if k % 5 == 2 else w for k, w in enumerate(ws)]


def test_a_leak_beside_a_longer_lookalike_is_found(spark):
    rng = random.Random(5)
    ws = figures(rng, item(rng, 70))
    other = [str(rng.randrange(1000, 9999)) if w.isdigit() else w for w in ws]  # the same make, other figures throughout
    docs = [" ".join(ws[:25]), " ".join(other[5:65]), " ".join(ws[:25] + filler(rng, 30) + other[5:65]), " ".join(other[5:65] + filler(rng, 3) + ws[:25])]
    assert found(spark, docs, {"i": " ".join(ws)}) == {(0, "i"), (2, "i"), (3, "i")}


def test_changed_words_count_the_same_whatever_other_items_say(spark):
    rng = random.Random(6)
    ws = item(rng, 50)
    new = ["cotton", "harbour", "velvet"]
    text = list(ws[10:34])
    for k, w in zip((4, 11, 18), new, strict=True):
        text[k] = w
    alone = {"i": " ".join(ws)}
    crowd = alone | {f"o{k}": " ".join(item(rng, 20) + new) for k in range(5)}
    assert found(spark, [" ".join(text)], alone) == {(0, "i")}
    assert found(spark, [" ".join(text)], crowd) == {(0, "i")}


def test_errors_near_the_edges_of_twenty_words(spark):
    rng = random.Random(7)
    ws = item(rng, 40)
    docs = []
    for at in [(), (2,), (17,), (2, 17), (1, 9), (0, 19), (1, 10, 18)]:
        t = list(ws[10:30])
        for k in at:
            t[k] = "zzz"
        docs.append(" ".join(filler(rng, 8) + t + filler(rng, 8)))
    n = len(docs)
    for cut in (15, 17):  # shorter ones are none, even without error
        docs.append(" ".join(filler(rng, 8) + ws[10 : 10 + cut] + filler(rng, 8)))
    docs.append(" ".join(w if k % 4 else "zzz" for k, w in enumerate(ws)))  # one in four
    assert found(spark, docs, {"i": " ".join(ws)}) == {(k, "i") for k in range(n)}


def test_short_items_stand_whole(spark):
    items = {"one": "zebrafish", "three": "cold blue lamp", "six": "p q r s t u", "dots": "..."}
    docs = ["A zebra-fish, swims", "the cold  blue lamp is on", "cold blue", "p q r s x u", "o p q r s t u v", "lamp cold blue zebra fish"]
    assert found(spark, docs, items) == {(0, "one"), (1, "three"), (4, "six")}


def test_passes_do_not_change_the_result(spark):
    rng = random.Random(8)
    items = {f"i{k}": " ".join(item(rng, 30)) for k in range(9)}
    docs = [" ".join(filler(rng, 5) + t.split()[3:26]) for t in items.values()]
    want = {(k, f"i{k}") for k in range(9)}
    assert found(spark, docs, items) == want and found(spark, docs, items, item_bytes=300) == want


def test_long_tags_are_markup():
    attrs = " ".join(f'data-{i}="{"v" * 20}"' for i in range(30))
    assert plain_words(f"<span {attrs}>two</span> <a href='x'>words</a>") == [b"two", b"words"]
    assert plain_words("temp < normal, and pulse > 100") == [b"temp", b"normal", b"and", b"pulse", b"100"]


def test_vocabulary_beyond_sixty_thousand_words():
    words = [f"w{i}".encode() for i in range(70_000)]
    m = WuManber([(str(k), words[k * 100 : k * 100 + 100]) for k in range(700)])
    ids = np.array(m.numbers(words[69_900:] + [b"x"] + words[:50]))
    starts, which = m.search(ids)
    assert len(starts) == 97 + 47 and {int(m.item[m.begin[p]]) for p in which} == {0, 699}
