"""Corpus pipeline: language id, near duplicates, repeated passages, decontamination, packing.

Each stage gets the documents that its predecessor kept and writes a table; all but the last keep the columns of
documents. Clean documents stay; what a stage decides is done.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isochron.llm import decontaminate, jaccard_join, language_id, packing, suffix_dedup
from isochron.llm.store import small_batches, written


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with all columns but doc_id and text renamed, so that none clashes with what an operator adds; and the
    new names, in order."""
    names = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language id rejects go: no letters (so null and empty texts too), or too narrow a margin. `lang`
    stays as it was given. Each row is judged by its own text, so repeated rows fare alike; an empty table gives none."""
    small_batches(spark)
    own, names = _plain(docs)
    dictionaries = language_id.learn(docs.filter(~language_id.held_out()))
    return language_id.identify(own, dictionaries, names).filter(~F.col("rejected")).select(*names).toDF(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the least doc_id stays.

    Rows with one doc_id are one document: they go together, and of those with the same text one stays. Null and
    empty texts are like nothing and stay; so do rows with a null doc_id."""
    found = jaccard_join.near_duplicates(docs, words=5, num=80, den=100)
    gone = written(found.filter("component_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    often = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if often.isEmpty():
        return kept
    (number,) = _free(docs, "number")
    once = kept.join(often, "doc_id", "left_semi").select(*docs.columns)
    once = once.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(0)))).filter(F.col(number) == 1)
    return kept.join(often, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes go that also start in a document with a smaller doc_id, and so do passages of
    PASSAGE_WORDS words, however short; a document whose text goes altogether goes with it. Null and empty texts and
    rows with a null doc_id stay as they are; rows with one doc_id aren't compared with each other."""
    own, names = _plain(docs)
    rest = [c for c in names if c != "text"]
    out = suffix_dedup.dedup(own.withColumn("column_none", F.col("text").isNull()), [*rest, "column_none"], span=PASSAGE, with_text=True, words=PASSAGE_WORDS)
    cut = out.withColumn("text", F.when(~F.col("column_none"), F.col("kept_text")))
    if "n_chars" in docs.columns:
        n_chars = names[docs.columns.index("n_chars")]
        kind = dict(cut.dtypes)[n_chars]
        cut = cut.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col(n_chars)))
    return cut.filter("n_removed = 0 OR length(trim(kept_text)) > 0").select(*names).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item's passage of ten words (or a whole shorter item) go, with all rows of their
    doc_id. Null and empty texts hold no passage and stay; so do rows with a null doc_id."""
    hits = decontaminate.hits(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=10)
    gone = written(hits.filter(F.size("spans") > 0).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of each row. An empty text is one piece, its end id."""
    return packing.pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=4096)


#: Bytes or words of a repeated passage, whichever is less: phrases that clean documents share stay.
PASSAGE, PASSAGE_WORDS = 250, 51

STAGES = [
    ("language id", keep_known_language),
    ("near duplicates", keep_one_of_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can neither compress by dictionary nor tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each read back from the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
