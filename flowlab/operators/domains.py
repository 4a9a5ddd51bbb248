"""Domain registry, source groups, pairs and filter specs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.clean import slugify
from flowlab.functions.labels import scenario_family
from flowlab.session import settle, values


def to_filter_json(dataset: Column, path: Column, column: Column, value: Column) -> Column:
    """Filter spec of one domain as JSON: a text value becomes ``eq``, an array ``in``."""
    filters = F.array(F.struct(column.alias("column"), F.lit("eq").alias("op"), value.alias("value")))
    return F.to_json(F.struct(dataset.alias("dataset"), filters.alias("filters"), path.alias("path")))


def to_filter_json_in(dataset: Column, path: Column, column: Column, members: Column) -> Column:
    filters = F.array(F.struct(column.alias("column"), F.lit("in").alias("op"), members.alias("values")))
    return F.to_json(F.struct(dataset.alias("dataset"), filters.alias("filters"), path.alias("path")))


def apply_filter(df: DataFrame, spec: str) -> DataFrame:
    """Rows that meet every condition of a filter spec; plain column predicates, so they reach the scan."""
    def test(f: dict) -> Column:
        if f["op"] == "eq":
            return F.col(f["column"]) == f["value"]
        if f["op"] == "in":
            return F.col(f["column"]).isin(*f["values"])
        raise ValueError(f"unknown filter op: {f['op']}")

    return df.where(reduce(lambda a, b: a & b, map(test, json.loads(spec)["filters"]), F.lit(True)))


DOMAIN_COLUMNS = ["domain_id", "dataset", "grouping", "group_value", "group_slug", "domain_family", "split", "n_rows", "n_benign", "n_attack", "attack_rate", "filter_json"]


def big_enough(df: DataFrame, min_rows: int, min_attack: int, min_benign: int) -> DataFrame:
    return df.where((F.col("n_rows") >= min_rows) & (F.col("n_attack") >= min_attack) & (F.col("n_benign") >= min_benign))


def iot_domains(summary: DataFrame, min_rows: int = 1000, min_attack: int = 100, min_benign: int = 100) -> DataFrame:
    """One domain per scenario with enough rows of both classes."""
    s = F.lower(F.trim("split"))
    base = summary.select(F.trim("scenario").alias("group_value"), s.alias("split"), "n_rows", "n_benign", F.col("n_malicious").alias("n_attack"))
    kept = big_enough(base, min_rows, min_attack, min_benign).where(F.col("split").isin("train", "val", "test"))
    return kept.withColumn("group_slug", slugify(F.col("group_value"))).withColumns({
        "domain_id": F.concat_ws("__", F.lit("iot23"), F.lit("scenario"), "split", "group_slug"), "dataset": F.lit("iot23"), "grouping": F.lit("scenario"),
        "domain_family": scenario_family(F.col("group_value")), "attack_rate": F.col("n_attack") / F.col("n_rows"),
        "filter_json": to_filter_json(F.lit("iot23"), F.col("split"), F.lit("scenario"), F.col("group_value")),
    }).select(DOMAIN_COLUMNS)


def source_groups(domains: DataFrame, max_rate: float = 0.98, top_benign: int = 5) -> DataFrame:
    """Three mixed training sources over the scenario domains: all, moderate attack rate, richest in benign rows."""
    train = domains.where("split = 'train'")
    rich = train.orderBy(F.desc("n_benign"), "group_value").limit(top_benign)
    mixes = {"all_train_mixed": train, "moderate_attack_mix": train.where(F.col("attack_rate") <= max_rate), "benign_rich_mix": rich}
    marked = reduce(lambda a, b: a.unionByName(b), [d.select("group_value", "n_rows", "n_benign", "n_attack", F.lit(name).alias("mix")) for name, d in mixes.items()])
    members = F.array_sort(F.collect_list("group_value"))
    out = marked.groupBy("mix").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_benign", "n_attack")], members.alias("members"))
    return out.select(F.col("mix").alias("group_value"), "*").withColumns({
        "group_slug": slugify(F.col("mix")), "domain_id": F.concat(F.lit("iot23__source_group__train__"), slugify(F.col("mix"))), "dataset": F.lit("iot23"),
        "grouping": F.lit("source_group"), "domain_family": F.lit("iot_source_group"), "split": F.lit("train"), "attack_rate": F.col("n_attack") / F.col("n_rows"),
        "filter_json": to_filter_json_in(F.lit("iot23"), F.lit("train"), F.lit("scenario"), F.col("members")),
    }).select(DOMAIN_COLUMNS)


def unsw_domains(counts: DataFrame, min_rows: int = 1000, min_attack: int = 100, min_benign: int = 100, top_k: int = 8) -> DataFrame:
    """The largest groups per grouping and split, ties by value."""
    order = Window.partitionBy("grouping", "split").orderBy(F.desc("n_rows"), "group_value")
    kept = big_enough(counts, min_rows, min_attack, min_benign).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top_k)
    return kept.withColumn("group_slug", slugify(F.col("group_value"))).withColumns({
        "domain_id": F.concat_ws("__", F.lit("unsw"), slugify(F.col("grouping")), "split", "group_slug"), "dataset": F.lit("unsw"), "domain_family": F.col("grouping"),
        "attack_rate": F.col("n_attack") / F.col("n_rows"), "filter_json": to_filter_json(F.lit("unsw"), F.col("split"), F.col("grouping"), F.col("group_value")),
    }).select(DOMAIN_COLUMNS)


def domain_rows(df: DataFrame, registry: DataFrame, groupings: list[str], split: str = "split") -> DataFrame:
    """Rows beside the domains they belong to: one equi-join per grouping column, so a row may appear under several domains.

    The registry is settled first: rows are matched to a broadcast of checked
    size, so a group value held by a third of all rows is not shuffled.
    """
    registry, parts = settle(registry), []
    for g in groupings:
        ids = registry.where(F.col("grouping") == g).select(F.col("group_value").alias("_value"), F.col("split").alias("_split"), "domain_id")
        hit = (F.trim(F.coalesce(F.col(g).cast("string"), F.lit("missing"))) == F.col("_value")) & (F.col(split) == F.col("_split"))
        parts.append(df.join(ids, hit).drop("_value", "_split"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def domain_pairs(domains: DataFrame) -> DataFrame:
    """Every train source of one dataset with every held-out target of the other, both directions.

    Registry rows are few (top-k per grouping); the pairing runs over a
    two-row direction table with equi-joins on the dataset names.
    """
    grouped = domains.where("dataset = 'iot23' and split = 'train' and grouping = 'source_group'").limit(1).select(F.lit(True).alias("_grouped"), F.lit("iot23").alias("dataset"))
    source = domains.where("split = 'train'").join(grouped, "dataset", "left")
    wanted = F.when(F.coalesce("_grouped", F.lit(False)), "source_group").otherwise("scenario")
    source = source.where((F.col("dataset") == "unsw") | (F.col("grouping") == wanted)).drop("_grouped")
    target = domains.where("(dataset = 'iot23' and grouping = 'scenario' and split in ('val', 'test')) or (dataset = 'unsw' and split = 'test')")
    ways = values(domains.sparkSession, [("iot23", "unsw"), ("unsw", "iot23")], "source_dataset string, target_dataset string")
    fields = ["domain_id", "dataset", "grouping", "domain_family", "split", "n_rows", "attack_rate"]
    left = source.select(*[F.col(c).alias(f"source_{c}") for c in fields])
    right = target.select(*[F.col(c).alias(f"target_{c}") for c in fields])
    return left.join(ways, "source_dataset").join(right, "target_dataset").withColumns({
        "pair_id": F.concat("source_domain_id", F.lit("__TO__"), "target_domain_id"), "pair_family": F.concat("source_dataset", F.lit("_to_"), "target_dataset"),
    })
