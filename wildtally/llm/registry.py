"""The text queries by name: each applies one operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession

from wildtally.llm import conversation_trie, decontamination, fingerprints, language_model, licenses, main_text, manifest, near_dups, packing, pieces, pii, substring_dups, toxicity
from wildtally.llm.tables import table

_registered = {}
_oracles = {}


def query(function):
    _registered[function.__name__] = function
    return function


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def queries():
    return dict(_registered)


def oracle_sql():
    return dict(_oracles)


@query
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.components(table(spark, folder, "documents"))


@query
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dups.remove_repeats(table(spark, folder, "documents"))[0]


@query
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), model_path())


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edits(table(spark, folder, "documents"))


_oracles["op5_document_fingerprints"] = fingerprints.EDITS_SQL


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(licenses.with_paths(table(spark, folder, "documents")))


_oracles["op1_license_scan"] = licenses.SCAN_SQL


@query
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


@query
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.train_and_score(table(spark, folder, "documents"))


@query
def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), word_vocabulary())


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(table(spark, folder, "documents"))


_oracles["op11_merkle_manifest"] = manifest.MANIFEST_SQL


@query
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.trie(table(spark, folder, "conversations"))


_oracles["op12_conversation_trie"] = conversation_trie.TRIE_SQL
