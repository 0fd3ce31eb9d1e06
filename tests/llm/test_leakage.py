import random

from cotejo.llm import leakage as L
from cotejo.llm.textform import bare
from cotejo.llm.words import spellings


def brute(docs, items):
    out = set()
    for d, t in docs:
        ws = [bare(w) for w in spellings(t or "")]
        have = {tuple(ws[i : i + 8]) for i in range(len(ws) - 7)}
        for i, x in items:
            xs = [bare(w) for w in spellings(x or "")]
            got = {p + j for p in range(len(xs) - 7) if tuple(xs[p : p + 8]) in have for j in range(8)}
            if xs and got and 2 * len(got) >= len(xs):
                out.add((d, i, len(xs), len(got)))
    return out


def make():
    rng = random.Random(4)
    words = [f"pal{i}ñ" for i in range(60)]
    sent = lambda n: " ".join(rng.choice(words) for _ in range(n))
    stock = sent(9)
    items = [(i, f"{sent(12)}. {stock}, {sent(rng.randint(6, 20))}.") for i in range(25)] + [(90, None), (91, ""), (92, "uno dos"), (93, " ".join([stock] * 4))]
    docs = []
    for d in range(120):
        x = items[rng.randrange(25)][1].split()
        a = rng.randrange(len(x))
        piece = " ".join(x[a : a + rng.randint(8, len(x))])
        docs.append((d, f"{sent(rng.randint(0, 40))} {piece if d % 2 else stock} {sent(5)}"))
    dirty = items[3][1]
    docs += [(200, dirty.upper()), (201, "<p>" + dirty.replace("ñ", "&ntilde;").replace(" ", "&nbsp;", 3) + "</p>"), (202, dirty.replace("al", "a­l")), (203, dirty.replace("pal", "pa-\nl", 5)), (204, f"| 1 | {dirty} |"), (205, None), (206, ""), (207, (sent(40000) + " " + dirty))]
    return docs + [docs[1]], items


def test_against_brute_force(spark):
    docs, items = make()
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id bigint, text string, item string").repartition(3)
    i = spark.createDataFrame([(*x, "c") for x in items + items[:2]], "item_id bigint, t string, doc string")
    want = brute(docs, items)
    assert {(200, 3), (201, 3), (202, 3), (203, 3), (204, 3), (207, 3)} <= {w[:2] for w in want}
    got = [tuple(r) for r in L.leaks(d, "doc_id", "text", i, "item_id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_PASS", 100)
    docs, items = make()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, t string")
    got = {tuple(r) for r in L.leaks(d, "doc_id", "text", i, "item_id", "t").collect()}
    assert got == brute(docs, items)


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, t string")
    assert L.leaks(d, "doc_id", "text", i, "item_id", "t").collect() == []
    assert L.leaks(d, "doc_id", "text", i.limit(0), "item_id", "t").collect() == []


def test_repeated_phrase_covers_two_places(spark):
    w = [f"w{i}" for i in range(1, 10)]
    docs, items = [(1, " ".join(w))], [(5, " ".join([*w[:8], "x", "y", *w[1:9], "z"]))]
    assert brute(docs, items) == {(1, 5, 19, 16)}
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, t string")
    assert [tuple(r) for r in L.leaks(d, "doc_id", "text", i, "item_id", "t").collect()] == [(1, 5, 19, 16)]


def test_first_of_several_texts_under_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(9)) for c in "ab")
    d = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, b), (7, a), (7, None)], "item_id bigint, t string").repartition(3)
    assert [(r.doc_id, r.item_id) for r in L.leaks(d, "doc_id", "text", i, "item_id", "t").collect()] == [(1, 7)]


def test_window(spark):
    words = [f"w{i}" for i in range(20)]
    far = " ".join([*words[:8], *(f"z{i}" for i in range(60)), *words[10:18]])
    d = spark.createDataFrame([(1, " ".join(words)), (2, far)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, t string")
    found = lambda w: sorted(tuple(r) for r in L.leaks(d, "doc_id", "text", i, "item_id", "t", window=w).collect())
    assert found(None) == [(1, 7, 20, 20), (2, 7, 20, 16)] and found(1.0) == [(1, 7, 20, 20)] and found(5.0) == found(None)
