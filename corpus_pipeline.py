"""From raw documents to token ids: toxic documents and near copies go, personal data is blanked, sources are mixed, texts encoded.

No stage catches an import error, and none but the mix leaves out or repeats a document that it has nothing against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import bpe, mixing, ngram_join, pii, toxicity
from glyphflow.llm.common import fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less those that the model, learned from the labels outside the held-out fold, gives 0.7 or more."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), toxicity.training_out())
    score = fresh(docs, "toxic")
    return toxicity.scored(docs, model, score_col=score).where(~toxicity.rejected(F.col(score))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one of least id; repeated rows once.

    Rows are what is linked: of rows that share an id, each stays or goes by its own text. Of equal ids in one group the text of
    least hash stays. Documents without words link with nothing and stay, each text once an id; null ids come last.
    """
    rows = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("uid", F.monotonically_increasing_id()), "pipeline-rows")
    found = ngram_join.joined(rows.select("uid", F.col("doc.text").alias("text")), n=5, num=80, den=100, id_col="uid")
    found = found.select(F.col("doc_id").alias("uid"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    order = rows.select("uid", F.col("doc.doc_id").alias("id"), F.xxhash64(F.coalesce("doc.text", F.lit(""))).alias("sign")).join(found, "uid")
    # The least of each group is combined before the shuffle, however large the group; texts without words are groups by id.
    key = [F.coalesce("group", F.lit(-1)).alias("g"), F.when(F.col("group").isNull(), F.struct("id", "sign")).alias("alone")]
    kept = order.groupBy(*key).agg(F.min(F.struct(F.col("id").isNull(), "id", "sign", "uid")).alias("best")).select(F.col("best.uid").alias("uid"))
    return rows.join(kept, "uid", "left_semi").select("doc.*")


def blank_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span replaced by its kind in brackets; n_chars counts what is then there."""
    return counted(pii.scrubbed(docs, spans_col=fresh(docs, "pii")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the mix takes, as rows of their documents; n_chars counts what is then there.

    Words of each source are within one and a half blocks of its target.
    """
    return counted(mixing.mixed(docs), docs)


def counted(now: DataFrame, docs: DataFrame) -> DataFrame:
    return now.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts."""
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", blank_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Models, pseudorandom permutations and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
