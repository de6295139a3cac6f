from tallyspark.llm import decontaminate as dc

from .test_decontaminate import ITEM, run


def test_one_inconsistent_slot_keeps_the_rest_of_the_diagonal(spark):
    mixed = ITEM.replace("named Anna", "named Maria").replace("before Anna", "before Paul")
    together = ITEM.replace("12", "3.5")  # two numbers fall together
    form = "the first Anna went to town and the second Anna came from there with the third Anna today"
    other = form.replace("first Anna", "first Maria").replace("second Anna", "second Paul").replace("third Anna", "third Clara")
    d, items = run(spark, [(1, "so. " + mixed + ". end", None), (2, "so. " + together + ". end", None), (3, "so " + other + " end", None)], [(70, ITEM), (71, form)])
    assert {(r.doc_id, r.item_id, r.changed) for r in dc.contamination(d, items).collect()} == {(1, 70, False), (2, 70, False)}


def test_exact_copies_of_slot_dense_items(spark):
    dense = "Evaluate 3 + 4 * 5 - 6 / 2 and 7 + 8 - 9 and give the sum"
    end = "Which day is it in 3 4 5 6 7"
    first = "What is the name of the river by Riga?"
    docs = [(1, "lorem ipsum " + dense + " dolor", None), (2, "Lorem. " + end + " dolor", None), (3, "lorem the question What is the name of the river by Riga dolor", None), (4, "lorem the question What is the name of the river by Oslo dolor", None), (5, "lorem 3 4 5 6 2 dolor", None)]
    d, items = run(spark, docs, [(1, dense), (2, end), (3, first)])
    assert {(r.doc_id, r.item_id, r.changed) for r in dc.contamination(d, items).collect()} == {(1, 1, False), (2, 2, False), (3, 3, False), (4, 3, True)}


def test_items_of_one_id_are_all_looked_for(spark):
    second = "The quick green ship sailed along seven quiet rivers until the captain found a small and hidden harbour"
    third = "Nobody expected that the old violin would sound so warm after forty winters in a cold and empty attic"
    d, items = run(spark, [(1, "a " + ITEM, None), (2, "a " + second, None), (3, "a " + third, None)], [(0, ITEM), (0, second), (None, third), (0, ITEM)])
    assert {(r.doc_id, r.item_id) for r in dc.contamination(d, items).collect()} == {(1, 0), (2, 0), (3, None)}
    assert dc.remove_contaminated(d, items).count() == 0


def test_short_items_are_found_where_they_stand_alone(spark):
    docs = [(1, "12 + 7 = 19", None), (2, "What is 2 + 2?", None), (3, "Some prose.\r\n  what is 2 + 2\nmore prose", None), (4, "We asked what is 2 + 2 and went on with the day", None), (5, "12 + 7 = 20", None), (6, "!!", None), (7, "Where?\nNow", None)]
    d, items = run(spark, docs, [(1, "12 + 7 = 19"), (2, "What is 2 + 2?"), (3, ""), (4, "--"), (5, "where now"), (6, ITEM)])
    want = {(1, 1, False), (2, 2, False), (3, 2, False), (7, 5, False)}
    assert {(r.doc_id, r.item_id, r.changed) for r in dc.contamination(d, items).collect()} == want
    assert {(r.doc_id, r.item_id, r.changed) for r in dc.contamination(d, items.where("length(text) < 20")).collect()} == want
    assert {r.doc_id for r in dc.remove_contaminated(d, items).collect()} == {4, 5, 6}
