"""Leave-one-out folds, described from group counts and applied as filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.profile import one_row


def loso_folds(df: DataFrame, group: str = "scenario", label: str = "label_binary") -> DataFrame:
    """Sizes of every leave-one-group-out fold: the training side is the total less the held-out group."""
    cells = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col(label) == 1).alias("n_test_attack"))
    total = one_row(cells.agg(F.count(F.lit(1)).alias("g"), F.sum("n_test").alias("n"), F.sum("n_test_attack").alias("a")), ["g", "n", "a"])
    return cells.select(
        F.concat(F.lit("loso_"), group).alias("fold_name"), F.col(group).alias("test_group"), "n_test", "n_test_attack", (total["n"] - F.col("n_test")).alias("n_train"),
        (total["a"] - F.col("n_test_attack")).alias("n_train_attack"), (total["g"] - 1).alias("n_train_groups"),
    )


def loso_split(df: DataFrame, held_out: str, group: str = "scenario") -> tuple[DataFrame, DataFrame]:
    """Train and test of one fold; the filter prunes partitions when the table is stored by group."""
    return df.where(F.col(group) != held_out), df.where(F.col(group) == held_out)


def loao_folds(df: DataFrame, kind: str = "attack_cat", benign: str = "Normal") -> DataFrame:
    """Sizes of every leave-one-attack-out fold; benign rows are on both sides."""
    cells = df.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    is_benign = F.col("kind") == benign
    total = cells.agg(F.sum(F.when(is_benign, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(~is_benign, F.col("n")).otherwise(0)).alias("a"))
    b, a = one_row(total, ["b", "a"]).values()
    return cells.where(~is_benign).select(
        F.col("kind").alias("held_out_attack"), (b + a - F.col("n")).alias("n_train"), (a - F.col("n")).alias("n_train_attack"),
        (b + F.col("n")).alias("n_test"), F.col("n").alias("n_test_attack"), b.alias("n_benign"),
    )


def loao_split(df: DataFrame, held_out: str, kind: str = "attack_cat", benign: str = "Normal") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(kind) != held_out), df.where(F.col(kind).isin(benign, held_out))
