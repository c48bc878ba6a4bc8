"""Leak search against a comparison of all windows of words."""

import random

from trellis.llm import leaks

RNG = random.Random(3)
WORDS = [f"w{k}" for k in range(60)]
ITEMS = [(k, " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(10, 60)))) for k in range(80)]


def brute(text: str, items) -> set[int]:
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leaks.words(t)] for i in range(len(w) - 11)}
    own = grams(text)
    return {k for k, t in items if t and own & grams(t)}


def documents(n):
    for _ in range(n):
        out = []
        for _ in range(RNG.randint(0, 6)):
            w = RNG.choice(ITEMS)[1].split()
            a = RNG.randint(0, max(0, len(w) - 5))
            out += w[a : a + RNG.randint(5, 40)] + [RNG.choice(["zzz", *WORDS]) for _ in range(RNG.randint(0, 20))]
        yield " ".join(out)


def test_index_finds_what_brute_force_finds():
    index, found = leaks.Index(ITEMS), 0
    for text in documents(400):
        want = brute(text, ITEMS)
        found += len(want)
        assert index.leaked(text) == want
    assert found > 300


def test_wand_returns_every_item_at_the_threshold():
    index = leaks.Index(ITEMS)
    for _ in range(300):
        terms = set(RNG.sample(range(len(index.vocabulary)), RNG.randint(1, 40)))
        for threshold in (0.3, 1.0, 2.0):
            scores: dict[int, float] = {}
            for x in terms:
                for d, v in zip(index.docs[x], index.impacts[x]):
                    scores[d] = scores.get(d, 0) + v
            assert set(index.retrieve(terms, threshold)) >= {d for d, s in scores.items() if s >= threshold + 1e-9}


def test_documents(spark):
    item = " ".join(f"q{k}" for k in range(20))
    items = spark.createDataFrame([(1, "s", item), (2, "s", "too short"), (3, "s", None), (4, "s", item)], "item_id bigint, suite string, text string")
    html = "From: a@x\nContent-Type: text/html\n\n<p>" + item.upper().replace(" Q9", " <b>Q9</b>") + "</p>"
    quoted = "From: a@x\n\n> " + item[:45] + "\n> " + item[45:]
    rows = [(1, html), (2, quoted), (3, None), (4, ""), (5, " ".join(item.split()[:11])), (6, html), (7, "x" * 300_000 + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id")
    assert sorted(map(tuple, leaks.leaks(docs, items).collect())) == [(d, i) for d in (1, 2, 6, 7) for i in (1, 4)]
    assert leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.leaks(docs.limit(0), items).count() == 0
