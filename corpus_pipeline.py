"""Corpus preparation: documents in, filtered, redacted and encoded documents out."""

from wildtally.llm import decontamination, near_dups, pieces, pii, registry, toxicity
from wildtally.llm.tables import table, written


def drop_toxic(spark, docs, sf_dir):
    """Documents that score below 0.5; the labels teach the grammar, but for the held-out fifth."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates the document with the smallest doc_id."""
    return near_dups.without_near_dups(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold no benchmark item, verbatim or with other parameters."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark, docs, sf_dir):
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark, docs, sf_dir):
    """The piece ids of each document, with digests of the ids and of the text decoded from them."""
    return pieces.digests(docs, registry.model_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("sentencepiece", encode),
]

# Similarity joins, learned scores and piece merges have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
