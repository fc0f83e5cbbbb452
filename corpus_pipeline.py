"""From raw documents to token ids: toxic documents go, one of each group of near copies stays, repeated passages are
cut, sources are mixed to target weights, and texts are encoded.

Each stage takes (spark, docs, sf_dir) and all its predecessor kept; all but the last return the columns of
``documents``. Rows with a null id or text pass the filters; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import jaccard_join, mixing, substring_dedup, toxicity
from riskweave.llm.queries import mixed, piece_digests
from riskweave.session import cut_lineage, prepare

#: Rows of ids and rates that may be broadcast (eight bytes each); more are joined.
BROADCAST_ROWS = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _small(rows: DataFrame) -> DataFrame:
    """A narrow table, stored once; broadcast if its count allows, so that texts need not be shuffled."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least 0.7 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels)
    bad = _small(scored.filter("predicted = 1").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(bad, "doc_id", "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays."""
    found = jaccard_join.similar_documents(docs)
    copies = _small(found.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier too are cut; texts without any stay as they are."""
    kept = substring_dedup.remove_repeats(docs.withColumn("_whole", F.col("text")), carry=("lang", "source", "n_chars", "_whole"))
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("_whole"))
    return kept.select(
        "doc_id", text.alias("text"), "lang", "source",
        F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; a document may stand several times or not at all."""
    rates = _small(mixed(spark, docs, sf_dir).groupBy("doc_id").agg(F.max("rate").alias("rate")))
    times = mixing.draws(F.col("rate"), F.col("doc_id"))
    taken = docs.select(*COLUMNS).join(rates, docs["doc_id"].eqNullSafe(rates["doc_id"]), "left").drop(rates["doc_id"])
    taken = taken.withColumn("_times", times).filter("_times > 0")
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text read back, as digests."""
    return piece_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
