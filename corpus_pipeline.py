"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
documents. Rows are told apart by doc_id and a hash of their text, so repeated ids and null ids are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaplan.llm.common import NULL_ID, fresh_dir, table, text_hash
from lumaplan.llm.decontaminate import decontaminate
from lumaplan.llm.minhash_dart import near_duplicates
from lumaplan.llm.mixing import mix_sources, queue_place
from lumaplan.llm.token_arrow import op3_token_arrow
from lumaplan.llm.toxicity import judgement, train_toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, nested so that no name clashes), key_id and key_hash."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key_id"), text_hash(F.coalesce(F.col("text"), F.lit(""))).alias("key_hash"))


def _key_of(decisions: DataFrame) -> DataFrame:
    return decisions.withColumns({"key_id": F.coalesce("doc_id", F.lit(NULL_ID)), "key_hash": F.col("th")})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. Labels come from the table labels, texts for training from docs."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(~judgement(F.col("text"), model)["toxic"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of least doc_id stays (of repeated rows, one)."""
    classes = _key_of(near_duplicates(docs))
    least = F.coalesce("class_id", F.lit(NULL_ID))
    kept = classes.where(F.col("key_id") == least).groupBy("key_id", "root").agg(F.min("key_hash").alias("key_hash"))
    found = _keyed(docs).join(kept.select("key_id", "key_hash").distinct(), ["key_id", "key_hash"])
    # Of rows equal in id and text any may stay; the least of their other values makes reruns agree.
    order = F.xxhash64("row")
    return found.groupBy("key_id", "key_hash").agg(F.min_by("row", order).alias("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bad = _key_of(decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")).select("key_id", "key_hash").distinct()
    return _keyed(docs).join(bad, ["key_id", "key_hash"], "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mix_sources(docs).where("copies > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key_id"), "row_hash", F.col("source").alias("of"), "nth", "copies")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key_id"), queue_place().alias("row_hash"), F.col("source").cast("string").alias("from"))
    # Rows equal in id, text and source (none after the stage before the last) are numbered as the mix numbers them.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key_id", "row_hash", "from").orderBy(F.xxhash64("row"))).cast("long"))
    found = rows.join(taken, ["key_id", "row_hash", "nth"]).where(F.col("from").eqNullSafe(F.col("of")))
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in order of doc_id, read back: doc_id, start, n_tokens, ids_crc32."""
    return op3_token_arrow(spark, sf_dir, docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("token_output", write_tokens)]
#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
