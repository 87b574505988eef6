"""Toxicity: the grammar's readings, held-out accuracy, odd rows."""

import numpy as np
from llm_helpers import crc, frame, tuples

from wildtally.llm import toxicity as T

FOLDER = "/root/testdata/sf0.1"


def outputs(text):
    model = T.Grammar(dict.fromkeys(T.INSULTS, 1.0))
    return {f for f, v in zip(T.FEATURES, model.features(text)) if v > 0}


def test_grammar():
    assert outputs("What an idiot. Fine day") == {T.INSULT}
    assert outputs("You are an idiot") == {T.AIMED}
    assert outputs("you are not an idiot") == {T.DENIED}
    assert outputs("he said you are an idiot") == {T.QUOTED}
    assert outputs("I will kill you") == {T.THREAT, T.MENACE}
    assert outputs("You are kind; an idiot wrote it") == {T.INSULT}
    assert outputs("idiotic idioms, killer apps") == set()
    for text in [
        "he said: you are an idiot",
        'She wrote: "You are an idiot."',
        '"You are an idiot," he said',
        '"You are an idiot!" the man said.',
        'The paper called them, "idiot after idiot"',
        'He said, "You, sir, are an idiot"',
        "Then she says:\n“what an idiot you are”",
        '«Vous, idiot», dit il',
    ]:
        assert outputs(text) == {T.QUOTED}, text
    for text in ["He left. You are an idiot", "I say this: hear me, you are an idiot", 'You are an idiot, and "he" said so', 'The "report" is long, you are an idiot', "it is 10:30, you are an idiot"]:
        assert outputs(text) == {T.AIMED}, text
    weight = lambda t: float(T.Grammar(dict.fromkeys(T.INSULTS, 1.0)).score(np.array([T.Grammar(dict.fromkeys(T.INSULTS, 1.0)).features(t)]))[0])
    assert weight("you are not an idiot") < weight("such an idiot") < weight("you are an idiot") and weight("") < 0.5


def test_composition_equals_running_in_turn():
    first, second = T._scope(T.NEGATION, 3, {T.INSULT: T.DENIED}), T._menace()
    symbols = np.random.RandomState(3).randint(0, 6, 500).tolist()
    assert list((first >> second).run(symbols)) == list(second.run(list(first.run(symbols))))


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = T.fit(docs, labels)
    rows = T.score(docs, model).join(labels, "doc_id").filter("held_out").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(crc(r.doc_id, 5) == 0 and r.predicted == (r.score >= 0.5) for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right > 0.97 and caught > 0.85


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "you idiot"), (4, "you idiot"), (4, "you idiot"), (5, "word " * 50_000 + "you idiot")]
    labels = spark.createDataFrame([(1, None), (2, 0), (4, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        model = T.fit(frame(spark, rows), given)
        found = {(d, s > 0.5, p) for d, s, p in tuples(T.score(frame(spark, rows), model), "doc_id", "score", "predicted")}
        assert found == {(1, False, 0), (2, False, 0), (None, True, 1), (4, True, 1), (5, True, 1)}
        kept = T.without_toxic(frame(spark, rows), model)
        assert {r.doc_id for r in kept.collect()} == {1, 2} and kept.columns == frame(spark, rows).columns
    assert T.score(frame(spark, []), T.fit(frame(spark, []), labels)).collect() == []
