"""The corpus pipeline: language, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet in the shared folder and read again. All but the last return the columns of
``documents``, whatever other columns there are and whatever their names. Very long texts are read
whole in every stage; repeated rows are judged alike; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tricord.llm.common import materialize
from tricord.llm.decontaminate import without_leaks
from tricord.llm.jaccard import one_of_each
from tricord.llm.language import accepted, fit_language_model, predict_language
from tricord.llm.packing import pack, token_pieces
from tricord.llm.queries import table, tokenizer_path
from tricord.llm.toxicity import fit_toxicity, predict_toxicity


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language: null or empty texts, texts without letters, scores under the calibrated threshold.

    Rows without an id or a language of their own are judged like others; without any language to learn from, all go.
    """
    model = fit_language_model(docs)
    # the model's columns stand beside the documents' own, whatever their names
    own = docs.select(*[docs[c].alias(f"doc_{k}") for k, c in enumerate(docs.columns)], docs["text"].alias("text"))
    kept = predict_language(own, model).where(accepted(model))
    return kept.select(*[kept[f"doc_{k}"].alias(c) for k, c in enumerate(docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents. Null and empty texts aren't toxic; without labels of both kinds nothing is."""
    chain = fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    own = docs.select(*[docs[c].alias(f"doc_{k}") for k, c in enumerate(docs.columns)], docs["text"].alias("text"))
    kept = predict_toxicity(own, chain).where("NOT is_toxic")
    return kept.select(*[kept[f"doc_{k}"].alias(c) for k, c in enumerate(docs.columns)])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; of rows that repeat an id, one.

    Texts without words have no duplicates; rows without an id stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark; an id goes with all its rows if one of them does.

    Null and empty texts hold none; an empty benchmark takes nothing away; rows without an id count as one id.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are the end id alone."""
    return pack(token_pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: Models, components and packing are beyond SQL; tests compare each stage's rows, and run(), with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
