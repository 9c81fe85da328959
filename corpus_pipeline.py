"""The corpus pipeline: toxic documents go, near-duplicates go, contaminated documents go, personal data is replaced, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``; ``n_chars`` follows the
text where a stage changes it. Rows with a null id stay where an operator keeps
them; a repeated row is one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixlake.llm import decontamination, near_dedup, packing, pii, toxicity
from matrixlake.llm.common import bucket, materialize, unused

#: ids of dropped documents are broadcast up to this many (16 bytes each), joined by a shuffle beyond
BROADCAST_IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated score below 0.7 stay; trained on the labels that op8 trains on.

    Null and empty texts have a score like any other; repeated rows stay or go together; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, bucket("doc_id", 3) != 1)
    score = unused(docs.columns, "score")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the smallest id stays.

    Documents without words and rows with a null id stay. Rows that share an id are one
    document; of rows with the same id and text one stays, other texts of that id stay with it.
    """
    found = materialize(near_dedup.near_duplicates(docs, shingle=5, percent=80), "components")
    gone = found.where("not kept").select("doc_id").distinct()
    many = found.agg(F.count_if(~F.col("kept")), F.count("doc_id"), F.count_distinct("doc_id")).first()
    left = docs.join(F.broadcast(gone) if many[0] <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    if many[1] == many[2]:
        return left
    mark = unused(left.columns, "mark")
    once = left.where("doc_id is not null").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return once.unionByName(left.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than one word in twenty inside a benchmark window stay, those without words and with a null text too; repeated rows stay or go together."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; found values and disclosing terms in its text give way to labels. A null text stays null."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, each token of each row in exactly one; a null text is its end token alone."""
    return packing.pack(docs, cache_pieces=150_000)  # the workers' memory is shared with what earlier stages left


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: training, similarity and packing are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
