"""Benchmark items: verbatim, with other parameters, and chance meetings."""

from llm_helpers import frame, tuples

from wildtally.llm import decontamination as D

ITEM = "One day we saw that John has 5 apples and gives 3 of them to Mary before the long trip of 20 km ends there."


def found(spark, rows, items=((9, ITEM),)):
    return {(d, i): v for d, i, v in tuples(D.leaks(frame(spark, rows), spark.createDataFrame(list(items), "item_id long, text string")), "doc_id", "item_id", "verbatim")}


def test_leaks(spark):
    other = ITEM.replace("John", "Alice").replace("Mary", "Bob").replace("5", "1,200").replace("3 of", "12.5 of").replace("20 km", "31 miles")
    mixed = "a saw that John has 5 apples and gives 3 of them to Mary before the b c d e"
    rows = [
        (1, "some words " + ITEM + " and more"),
        (2, "x " + other),
        (3, None),
        (4, ""),
        (5, "one day we saw that the apples ended"),
        (6, mixed),
        (None, ITEM),
        (7, ITEM + "\n" + other),
        (8, "word " * 30_000 + ITEM),
    ]
    rows += [(i, ITEM) for i in range(20, 60)] + [(20, ITEM)]
    items = [(9, ITEM), (9, ITEM), (10, None), (11, ""), (12, "too short"), (None, ITEM), (13, "exactly these five words here")]
    got = found(spark, rows + [(70, "we have exactly these five words here too")], items)
    assert got == {(1, 9): True, (2, 9): False, (6, 9): True, (7, 9): True, (8, 9): True, (70, 13): True, **{(i, 9): True for i in range(20, 60)}}


def test_slots_have_to_be_consistent(spark):
    item = "first take 7 red marbles then 7 blue marbles then 7 green marbles and 7 more"
    steady = item.replace("7", "8")
    parts = item.split("7")
    unsteady = "".join(p + n for p, n in zip(parts, ["1", "2", "3", "4", ""]))
    assert found(spark, [(1, steady), (2, unsteady)], [(1, item)]) == {(1, 1): False}


def test_verbatim_anywhere(spark):
    items = [
        (1, "Exactly these five words here"),
        (2, "Alice has two red balls and one blue ball in her bag"),
        (3, "What is 5 plus 7 ?"),
        (4, "Which planet is known as the red planet?"),
        (5, "John has 5 apples"),
        (6, "days before the feast we all went home again"),
        (7, "is the largest ocean on the whole earth?"),
        (8, "12 Monkeys is a film about the year 2035"),
        (9, ITEM),
    ]
    around = ["{}", "we have {} there", "yes, {} and", "so {} it goes", "A heading line\n{}\nmore", 'He asked "{}" again.', "It ended. {} Then", "Note: {} End", "in 5 {} ends", "about 1,000\t{}", "(see {})"]
    forms = [lambda t: t, lambda t: t[0].upper() + t[1:], lambda t: t[0].lower() + t[1:]]
    rows = [(1000 * i + 10 * j + k, a.format(f(t))) for i, t in items for j, a in enumerate(around) for k, f in enumerate(forms)]
    got = found(spark, rows, items)
    assert {d for d, i in got if d // 1000 == i} == {d for d, _ in rows}
    assert all(v for (d, i), v in got.items() if d // 1000 == i)
    # The fifth item is word for word in the ninth; nothing else is found.
    assert {(d // 1000, i) for d, i in got if d // 1000 != i} == {(9, 5)}


def test_other_names_at_the_start(spark):
    item = "Alice has 5 apples and gives 2 of them to her friend"
    rows = [(n, a.format("Bob has 9 apples and gives 4 of them to her friend")) for n, a in enumerate(["{}", "yes, {}", "It ended. {}", "x\n{}"])]
    assert found(spark, rows, [(1, item)]) == {(n, 1): False for n in range(4)}
    # Words that begin a question are no names, and a dense item is only found word for word.
    clean = [(1, "we say London is the capital of England"), (2, "Mary has 6 pears. Tom has 5 apples"), (3, "so that is 6 plus 9 ?")]
    assert found(spark, clean, [(1, "What is the capital of France"), (2, "John has 5 apples"), (3, "What is 5 plus 7 ?")]) == {}


def test_empty(spark):
    assert found(spark, []) == {} and found(spark, [(1, ITEM)], []) == {} and found(spark, [(1, None)]) == {}
    kept = D.without_leaks(frame(spark, [(1, ITEM), (2, "fine"), (None, ITEM)]), spark.createDataFrame([(9, ITEM)], "item_id long, text string"))
    assert sorted(tuples(kept, "doc_id"), key=repr) == [(2,), (None,)] and kept.columns == frame(spark, []).columns


def test_no_python(spark):
    leaks = D.leaks(frame(spark, [(1, ITEM)]), spark.createDataFrame([(9, ITEM)], "item_id long, text string"))
    plan = leaks._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan and "Cartesian" not in plan
