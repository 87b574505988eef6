"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, other). Four transducers rewrite the
symbols of a clause one after another and are composed into one: negation turns insults and threats
in its scope into denied ones, reported speech into quoted ones, a target close by makes them aimed.
The scope of a word of reporting goes on over a colon, into a quotation after it, and back into one before it.
The weights of what comes out add up over a document's clauses; a logistic model turns them into a score.

Insults and their weights are learned from labelled texts, as words, or stems that words begin with,
that are far more common in toxic ones; so are the weights of the outputs, starting from those below.
"""

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings
from wildtally.llm.tokens import slices
from wildtally.operators.sizes import measured

# Labelled rows that the model is fitted on at most.
FIT_ROWS = 10_000
# A stem has so many letters; it is written with a star.
STEMS = range(4, 9)
# An insult is so much (as a logarithm) more common in toxic texts, and its log-likelihood ratio against
# chance is so large that none of millions of words passes by chance.
MIN_LIFT, MIN_EVIDENCE = 2.5, 18

THREATS = set("kill hurt beat destroy murder shoot stab strangle crush töten schlagen tuer frapper matar golpear".split())
TARGETS = set("you your yours u he she they them him her his their du dich dir ihr euch sie tu te toi vous il elle usted ustedes te ti".split())
NEGATIONS = set("not no never isn't aren't wasn't don't doesn't didn't won't without nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = set("said says say called calls wrote reported quoted claimed alleged sagte nannte schrieb dit disait écrit dijo llamó escribió".split())
INSULTS = set("idiot moron stupid scum pathetic loser worthless disgusting".split())
SEED_WEIGHT = 2.0
# Put before a clause that is reported from outside of it.
REPORTED = "said"

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT, DENIED, QUOTED, AIMED, MENACE = range(10)
SYMBOLS = 10


class Transducer:
    """A deterministic transducer: ``moves[state][symbol] = (next state, symbol)``; it starts in state 0."""

    def __init__(self, moves):
        self.moves = moves

    def __rshift__(self, other: "Transducer") -> "Transducer":
        """This transducer's output fed to the other one, as one machine with the states that can be reached."""
        names, moves, todo = {(0, 0): 0}, [], [(0, 0)]
        for a, b in todo:
            row = []
            for symbol in range(SYMBOLS):
                a2, middle = self.moves[a][symbol]
                b2, out = other.moves[b][middle]
                if (a2, b2) not in names:
                    names[a2, b2] = len(names)
                    todo.append((a2, b2))
                row.append((names[a2, b2], out))
            moves.append(row)
        return Transducer(moves)

    def run(self, symbols):
        state = 0
        for symbol in symbols:
            state, out = self.moves[state][symbol]
            yield out


def _scope(opener: int, reach: int, becomes: dict[int, int], closes: bool = True) -> Transducer:
    """After ``opener`` the symbols of ``becomes`` change for the next ``reach`` words (to the end without ``closes``)."""
    moves = []
    for state in range(reach + 1):
        row = []
        for symbol in range(SYMBOLS):
            after = max(0, state - 1) if closes else state
            row.append((reach, symbol) if symbol == opener else (after, becomes.get(symbol, symbol) if state else symbol))
        moves.append(row)
    return Transducer(moves)


def _menace() -> Transducer:
    """A target within three words after a threat word makes a menace."""
    moves = []
    for state in range(4):
        row = [(max(0, state - 1), s) for s in range(SYMBOLS)]
        row[THREAT] = (3, THREAT)
        if state:
            row[TARGET] = (0, MENACE)
        moves.append(row)
    return Transducer(moves)


GRAMMAR = (
    _scope(NEGATION, 3, {INSULT: DENIED, THREAT: DENIED})
    >> _scope(REPORT, 1, {INSULT: QUOTED, THREAT: QUOTED}, closes=False)
    >> _menace()
    >> _scope(TARGET, 3, {INSULT: AIMED})
)

# Outputs that are counted, and the weights (and the bias) that fitting starts from and is drawn to.
FEATURES = (INSULT, AIMED, DENIED, QUOTED, MENACE, THREAT)
PRIOR = np.array([2.0, 2.6, 0.2, 0.3, 2.6, 0.1, -2.5])

_CLAUSE_END = re.compile(r"[.!?;:,\n]+(?=\s|$)|\n")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
# A quotation ends at its mark; after it a word of reporting may follow within three words.
_OPENS, _CLOSES = '"“«„', '"”»“'
_TAIL = re.compile(rf"[^{_OPENS}{_CLOSES}\n]*[{_CLOSES}][,.]?\s+((?:[^\W\d_]+\s+){{0,2}}[^\W\d_]+)")
# How far a quotation is followed back to its mark, and how many words before that may hold the one of reporting.
_QUOTED_CHARS, _LEAD_WORDS = 400, 6


def _leads(text: str, end: int, marks: str) -> bool:
    """Whether ``text`` up to ``end`` closes with one of ``marks`` and a clause of reporting before it."""
    lead = text[max(0, end - 200) : end].rstrip()
    if not lead or lead[-1] not in marks and not lead[-1].isalpha():
        return False
    lead = re.split(r"[.!?;:,\n]", lead.rstrip(marks))[-1]
    words = _WORD.findall(lead)[-_LEAD_WORDS:]
    # Without a mark the word of reporting has to be the last one.
    return not REPORTS.isdisjoint(words if text[:end].rstrip()[-1] in marks else words[-1:])


def reported(text: str, clause: int, start: int, end: int) -> bool:
    """Whether the word [start, end) of ``text`` (lower case), in a clause from ``clause``, is in speech that is reported around it."""
    if clause and text[max(0, clause - 80) : clause].rstrip()[-1:] == ":" and _leads(text, clause, ":"):
        return True
    near = max(0, start - _QUOTED_CHARS)
    opening = max(text.rfind(mark, near, start) for mark in _OPENS)
    if opening < 0 or text[opening + 1 : opening + 2].isspace() or opening and text[opening - 1].isalnum():
        return False
    if any(text.find(mark, opening + 1, start) >= 0 for mark in _CLOSES):
        return False
    if _leads(text, opening, ":,"):
        return True
    after = _TAIL.match(text, end, end + _QUOTED_CHARS)
    return bool(after) and not REPORTS.isdisjoint(_WORD.findall(after[1]))


class Grammar:
    def __init__(self, insults: dict[str, float], weights=PRIOR):
        self.insults, self.weights = insults, np.asarray(weights, dtype=float)
        self.symbols = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, insults)) for w in words}
        self.heads = None

    def entry(self, word: str) -> str:
        """The insult that ``word`` is: itself or a stem of it, else nothing."""
        if word in self.insults:
            return word
        return next((word[:n] + "*" for n in STEMS if word[:n] + "*" in self.insults), "")

    def symbol(self, word: str) -> int:
        return self.symbols.get(word, INSULT if self.entry(word) else OTHER)

    def __getstate__(self):
        return {**self.__dict__, "heads": None}

    def features(self, text: str) -> np.ndarray:
        """log(1 + weight of matches) of each output; only clauses with an insult or threat are read."""
        if self.heads is None:
            self.heads = ahocorasick.Automaton()
            for word in {*self.insults, *THREATS}:
                self.heads.add_word(word.rstrip("*"), (len(word.rstrip("*")), word[-1] == "*"))
            self.heads.make_automaton()
        text, total, done = text.lower(), dict.fromkeys(FEATURES, 0.0), 0
        for end, (size, stem) in self.heads.iter(text):
            start = end - size + 1
            if start < done or start and text[start - 1].isalpha() or not stem and text[end + 1 : end + 2].isalpha():
                continue
            first = max(text.rfind(mark, done, start) for mark in ".!?;:,\n") + 1
            stop = _CLAUSE_END.search(text, end + 1)
            done_now = stop.end() if stop else len(text)
            words = _WORD.findall(text, max(first, done), stop.start() if stop else len(text))
            if reported(text, max(first, done), start, end + 1):
                words = [REPORTED, *words]
            for word, out in zip(words, GRAMMAR.run([self.symbol(w) for w in words])):
                if out in total:
                    total[out] += self.insults.get(self.entry(word), 1.0)
            done = done_now
        return np.log1p([total[f] for f in FEATURES])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def remainder(modulus: int):
    """crc32 of the doc_id as text modulo ``modulus``; null without a doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def _features(model: Grammar, more):
    def scan(batches):
        for batch in slices(batches):
            found = [model.features(text or "") for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield more(batch, np.array(found).reshape(-1, len(FEATURES)))

    return scan


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> Grammar:
    """Learn from rows of ``docs`` with a label, but for those whose ``remainder(held_out)`` is 0.

    At most about FIT_ROWS rows are used, picked by a hash of doc_id, equal texts once. Several labels of one id count as toxic
    if one is; null labels do not count. Without labels of both kinds the prior weights and a few
    seed words make the model.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(remainder(held_out) != 0)
    many = known.count()
    known = measured(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, FIT_ROWS / max(many, 1)))))
    rows = docs.select("doc_id", F.lower("text").alias("text")).join(known, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    insults = dict.fromkeys(INSULTS, SEED_WEIGHT)
    if len(sizes) < 2:
        return Grammar(insults)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}]+(?:'[\p{L}]+)?"), 0))
    stems = [F.transform(F.filter("w", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    found = rows.select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat("w", *stems))).alias("word"))
    counts = found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    lift = F.log((F.col("bad") + 0.1) / (sizes[1] + 0.2)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1.0))
    share = sizes[1] / (sizes[0] + sizes[1])
    evidence = sum(F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (F.col("bad") + F.col("good")) / s)).otherwise(0) for k, s in (("bad", share), ("good", 1 - share)))
    counts = counts.withColumn("lift", lift).withColumn("evidence", F.round(evidence, 6)).filter((F.col("lift") >= MIN_LIFT) & (F.col("evidence") >= MIN_EVIDENCE))
    chosen, heads = set(), set()
    # As many as the evidence of the bounded number of rows is for.
    for row in counts.orderBy(F.desc("evidence"), F.desc(F.length("word")), "word").collect():
        stem = row.word.rstrip("*")
        parts = [stem[:n] for n in range(1, len(stem) + 1)]
        # Of words and stems that begin alike the one with the most evidence stands for all.
        if stem not in heads and chosen.isdisjoint(parts):
            chosen.add(stem)
            heads.update(parts)
            insults[row.word] = max(0.2, row.lift / 2)
    model = Grammar(insults)

    def told(batch, found):
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = rows.mapInArrow(_features(model, told), "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count("*").alias("n")).collect()
    x, y, n = np.array([r.x for r in seen]), np.array([r.toxic for r in seen]), np.array([r.n for r in seen], dtype=float)
    model.weights = _regression(x, y, n)
    return model


def _regression(x, y, n, pull: float = 2.0) -> np.ndarray:
    """Logistic weights, drawn to the prior, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - pull * (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Grammar, held_out: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text).

    A null text counts as empty; an empty text, or one without a match, scores by the bias alone.
    Rows are scored one by one, so repeated rows and other columns make no difference; a row without
    a doc_id is not held out. An empty table gives no rows.
    """
    settings(docs.sparkSession)

    def told(batch, found):
        scores = model.score(found)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=_NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(held_out) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_features(model, told), "doc_id long, held_out boolean, score double, predicted int")


_NAMES = ["doc_id", "held_out", "score", "predicted"]


def without_toxic(docs: DataFrame, model: Grammar) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    settings(docs.sparkSession)

    def told(batch, found):
        return batch.filter(pa.array(model.score(found) < 0.5))

    return docs.mapInArrow(_features(model, told), docs.schema)
