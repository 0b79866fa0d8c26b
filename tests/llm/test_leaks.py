import random

import numpy as np
import plain
import pytest
from factloom.llm import leaks
from pyspark.sql import functions as F

WORDS = [f"w{k}" for k in range(40)]


def run(spark, documents, items, **shard):
    d = spark.createDataFrame(documents, "doc_id long, text string").withColumn("words", F.lit(3)).withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    return leaks.leaks(d, i, **shard), d


def made(seed, typography=True):
    r = random.Random(seed)
    items = [(k, " ".join(r.choices(WORDS, k=r.randrange(5, 40)))) for k in range(12)] + [(90, ""), (91, None), (92, "same " * 20), (93, "same " * 20)]
    documents = []
    for k in range(60):
        text = r.choices(WORDS + ["other", "ähm"], k=r.randrange(0, 60))
        if r.random() < 0.6:
            own = items[r.randrange(12)][1].split()
            a = r.randrange(len(own))
            part = own[a : a + r.randrange(8, 20)]
            at = r.randrange(len(text) + 1)
            text[at:at] = [w.upper() if typography and r.random() < 0.3 else w for w in part]
        documents.append((k, "".join(w + r.choice([" ", ", ", "\n", " — ", "-"]) for w in text)))
    return documents, items


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    documents, items = made(seed)
    documents += [(900, None), (901, ""), (902, "Same " * 5000), (903, "same " * 11 + "x " + "same " * 11), *documents[:3]]
    found, frame = run(spark, documents, items, shard_words=200)
    want = plain.leaked([d for d in documents if d[1]], [i for i in items if i[1]])
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert {r.doc_id for r in leaks.without_leaks(frame, found).collect()} == {d for d, _ in documents} - {d for d, _ in want}


def test_longest_match_and_places(spark):
    item = " ".join(f"a{k}" for k in range(30))
    found, _ = run(spark, [(1, "x y " + " ".join(f"A{k}" for k in range(5, 25)) + " z " + " ".join(f"a{k}" for k in range(12)))], [(7, item)])
    assert [tuple(r) for r in found.collect()] == [(1, 7, 20, 2, 5)]


def test_case_and_letters(spark):
    item = "Größe ÉTÉ x1 STRASSE İ" + " word" * 8
    found, _ = run(spark, [(1, item.upper().replace(" ", "_")), (2, item.lower())], [(1, item)])
    assert 1 in {r.doc_id for r in found.collect()}


def test_empty_and_bound(spark, monkeypatch):
    found, _ = run(spark, [], [])
    assert found.count() == 0
    monkeypatch.setattr(leaks, "ITEMS_BOUND", 3)
    with pytest.raises(ValueError):
        run(spark, [], [(1, "four words are long")])


def test_search_of_one_shard():
    items = leaks.Items([(1, "a b c d"), (2, "b c d")], 3)
    ids = lambda t: np.array([items.vocabulary[w] for w in t.split()])
    assert sorted(leaks.search(items, [(5, ids("x a b c d")), (6, ids("b c")), (7, ids("d b c d"))])) == [(5, 1, 4, 1, 0), (5, 2, 3, 2, 0), (7, 1, 3, 1, 1), (7, 2, 3, 1, 0)]
    assert leaks.search(items, [(6, ids("b c"))]) == []


def test_items_above_the_bound_come_in_parts(spark, monkeypatch):
    documents, items = made(7)
    monkeypatch.setattr(leaks, "ITEMS_BOUND", 400)
    found, _ = run(spark, documents, items, shard_words=300)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == plain.leaked(documents, [i for i in items if i[1]])


def test_memory_does_not_follow_the_longest_item():
    items = leaks.Items([(1, " ".join(f"w{k % 977}" for k in range(200_000)))], 12)
    text = np.array([items.vocabulary[f"w{k % 977}"] for k in range(50_000)])
    assert leaks.search(items, [(1, text)]) == [(1, 1, 50_000, 0, 0)]
    assert items.heads.nbytes <= 48 * 200_000
