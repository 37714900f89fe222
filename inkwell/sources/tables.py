"""Driver tables and the labelled views the operators consume (SURVEY
§7.1 fixture mapping).  Every view is a lazy DataFrame over the parquet
scan, so filters and column pruning reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import table

# Conversation roles -> class label (system turns dropped).
ROLE_LABEL = {"user": 0, "assistant": 1}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a label.  ``result`` = quality, ``dataset`` =
    language, ``generator`` = source.  Inner join on ``doc_id``; the label
    table is the smaller side and Catalyst/AQE pick the strategy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("result"))
    return docs.join(labels, "doc_id").select(
        "doc_id", "text", "result", "lang", "source",
        F.col("lang").alias("dataset"), F.col("source").alias("generator"))


def labelled_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user turns are human (0), assistant turns machine (1); system
    turns are dropped.  ``doc_id = conv_id * 100 + turn``."""
    conv = table(spark, sf_dir, "conversations")
    label = (F.when(F.col("role") == "user", F.lit(ROLE_LABEL["user"]))
              .when(F.col("role") == "assistant", F.lit(ROLE_LABEL["assistant"])))
    return (conv.where(F.col("role").isin(*ROLE_LABEL))
                .select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"),
                        "conv_id", "turn", "text", label.alias("result")))


# The text column of each named corpus (others: the name).
DATASET_KEYS = {"xsum": "document", "squad": "context", "writing": "document", "fluoroscopy": "text"}


def pick_text(df: DataFrame, dataset: str) -> DataFrame:
    """Select the dataset's text column as ``text``; a dataset not
    in the table uses its own name as the column (lookup with default)."""
    key = DATASET_KEYS.get(dataset, dataset)
    return df.select(F.col(key).alias("text"))
