import random

from tallyspark.llm import decontaminate as dc

ITEM = "A farmer named Anna keeps 12 brown goats near the old mill and sells 3.5 kg of cheese to Peter every week before Anna walks home over the hill"


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, rk string")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_copies_reparameterised_and_inconsistent(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet consectetur elit sed do".split()) + str(rng.randint(0, 9)) * 0 for _ in range(n))
    other = ITEM.replace("Anna", "Maria").replace("12", "1,450").replace("3.5", "7").replace("kg", "lb")
    mixed = ITEM.replace("named Anna", "named Maria").replace("before Anna", "before Paul")
    docs = [
        (1, fill(50) + ". " + ITEM + ". " + fill(40), "x"),
        (2, fill(50) + " " + other + " " + fill(10), "x"),
        (3, fill(20) + ". " + mixed + ". " + fill(5), None),
        (4, fill(300), None),
        (5, None, None),
        (6, "", None),
        (7, " ".join(ITEM.split()[:9]), None),
        (1, fill(50), None),
        (8, "tiny question about seven blue seas here", None),
        (9, "ask: Tiny question about seven blue seas?", None),
    ]
    docs.append(docs[0])
    d, items = run(spark, docs, [(70, ITEM), (71, None), (72, ""), (73, "tiny question about seven blue seas"), (74, "one two")])
    got = {(r.doc_id, r.item_id, r.changed) for r in dc.contamination(d, items).collect()}
    # 3 has a slot with two values, and 19 words of the item in a row without it
    assert got == {(1, 70, False), (2, 70, True), (3, 70, False), (8, 73, False), (9, 73, False)}
    kept = dc.remove_contaminated(d, items)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7]


def test_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, "start " + ITEM.replace("12", str(i)) + " end", None) for i in range(5)]
    d, items = run(spark, docs, [(70, ITEM), (71, ITEM + " and sleeps")])
    whole = sorted(map(tuple, dc.contamination(d, items).collect()))
    monkeypatch.setattr(dc, "BLOCK", 7)
    assert sorted(map(tuple, dc.contamination(d, items).collect())) == whole and len(whole) == 10


def test_empty(spark):
    d, items = run(spark, [], [(1, ITEM)])
    assert dc.contamination(d, items).count() == 0
    d, items = run(spark, [(1, ITEM, None)], [])
    assert dc.contamination(d, items).count() == 0 and dc.remove_contaminated(d, items).count() == 1
