"""Text tables that the steps hand to each other, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBES = "id int, prompt string, answer string"
SCORES = "doc_id string, L_base double, L_ref double, AI_Score double, total_tokens_seen bigint"
WEIGHTS = "layer int, proj string, row_idx int, w array<double>"
SELECTION = "doc_id string, AI_Score double, tok_len bigint"


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBES).json(path)


def write_probes(probes: DataFrame, path: str) -> None:
    probes.selectExpr("cast(id as int) id", "prompt", "answer").write.json(path)


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """(layer, head) of lines of two numbers, apart by commas or blanks; empty lines are passed over."""
    line = F.regexp_replace("value", "^\\s+|\\s+$", "")
    parts = F.split(line, "[ ,]+")
    return spark.read.text(path).where(line != "").select(parts[0].cast("int").alias("layer"), parts[1].cast("int").alias("head"))


def write_heads(heads: DataFrame, path: str) -> None:
    """heads(rank, layer, head_in_layer) as lines in the order of rank; one file, since a model has few heads."""
    heads.orderBy("rank").select(F.concat_ws(",", "layer", "head_in_layer").alias("value")).coalesce(1).write.text(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(layer, proj, row_idx, w) of a model's attention projections, a row of a matrix a row."""
    return spark.read.schema(WEIGHTS).parquet(path)


def write_weights(weights: DataFrame, path: str) -> None:
    weights.selectExpr("cast(layer as int) layer", "proj", "cast(row_idx as int) row_idx", "w").write.parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).option("sep", "\t").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """As tab-separated text, losses to 4 places and scores to 6, and as Parquet, under path/tsv and path/parquet."""
    rounded = scores.select("doc_id", F.round("L_base", 4).alias("L_base"), F.round("L_ref", 4).alias("L_ref"), F.round("AI_Score", 6).alias("AI_Score"), "total_tokens_seen")
    _both(rounded, path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SELECTION).option("sep", "\t").option("header", True).csv(path)


def write_selection(selected: DataFrame, path: str) -> None:
    _both(selected.select("doc_id", "AI_Score", "tok_len"), path)


def _both(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(f"{path}/tsv")
    rows.write.parquet(f"{path}/parquet")
