"""Ordered selection without sorting a whole group in one task.

Order columns are first turned into keys that compare alike everywhere: a
missing value and NaN come last, infinities have their own place, and text gets
its first bytes as numbers (``total_order``).  The k-th row of a group is then
found by histogram: count rows per slice of the key, step into the slice that
holds rank k, repeat until few rows are left, and rank only those.  Rows are kept
or dropped by comparing them with that cut key, so a scenario with a third of
all rows is never shuffled to a single task.  Groups whose checked size is small
take a plain window over the same keys; both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.session import cut_lineage, settle

GROUP_LIMIT = 2_000_000
CANDIDATES = 20_000
SLICES = 4096
#: Numbers that the first bytes of a text are read as, and the bytes of each.
LEADS, LEAD_BYTES = 3, 6
WHOLE = "_all"


def whole(df: DataFrame) -> DataFrame:
    """One group for the whole table; its single cut key then becomes a plain filter."""
    return df.withColumn(WHOLE, F.lit(0))


def hash_key(key: Column, seed) -> Column:
    """Seeded pseudo-random text, equal in every engine that has md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_lead(hash_text: Column) -> Column:
    """First 48 bits of a hex digest as a number; same order as the text."""
    return F.conv(F.substring(hash_text, 1, 12), 16, 10).cast("long")


def total_order(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the keys of each order column, none of which is ever null, NaN or infinite.

    A number has its place (-1 minus infinity, 0 finite, 1 infinity, 2 missing or NaN)
    and its finite value; text has its place, its first bytes as numbers, and itself.
    """
    added: dict[str, Column] = {}
    for i, name in enumerate(order):
        value, kind = F.col(name), df.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            place = F.when(value.isNull() | F.isnan(value), 2).when(value == float("inf"), 1).when(value == float("-inf"), -1).otherwise(0)
            added[f"_key{i}_place"] = place
            added[f"_key{i}"] = F.when(place == 0, value.cast("double")).otherwise(0.0)
            continue
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.unix_micros(value.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            value = F.unix_date(value)
        elif isinstance(kind, T.BooleanType):
            value = value.cast("int")
        added[f"_key{i}_place"] = F.when(value.isNull(), 2).otherwise(0)
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            text = F.coalesce(value.cast("string"), F.lit(""))
            for j in range(LEADS):
                digits = F.rpad(F.hex(F.substring(text.cast("binary"), LEAD_BYTES * j + 1, LEAD_BYTES)), 2 * LEAD_BYTES, "0")
                added[f"_key{i}_lead{j}"] = F.conv(digits, 16, 10).cast("long")
            added[f"_key{i}"] = text
        else:
            added[f"_key{i}"] = F.coalesce(value, F.lit(0).cast(value_type(kind)))
    return df.withColumns(added), list(added)


def value_type(kind: T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.NumericType) else T.IntegerType() if isinstance(kind, (T.BooleanType, T.DateType)) else T.LongType()


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return settle(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_group")))


def window_limit(by: list[str], group_limit: int | None) -> int:
    """Rows of a group that one window task may rank; a whole table, which has one group, gets few."""
    limit = GROUP_LIMIT if group_limit is None else group_limit
    return min(limit, CANDIDATES) if by == [WHOLE] else limit


def largest(sizes: DataFrame) -> int:
    return sizes.agg(F.max("n_group")).first()[0] or 0


def key_after(order: list[str], cut: list[Column]) -> Column:
    """Row key strictly after the cut key, compared column by column."""
    tests, equal = [], F.lit(True)
    for name, bound in zip(order, cut):
        tests.append(equal & (F.col(name) > bound))
        equal = equal & (F.col(name) == bound)
    return reduce(lambda a, b: a | b, tests)


def cut_keys(df: DataFrame, by: list[str], order: list[str], ranks: DataFrame, group_limit: int | None = None, slices: int | None = None) -> DataFrame:
    """Order key of the k-th row: ``ranks`` (by..., tag, k) -> (by..., tag, k, cut_<order>...).

    ``order`` are keys of ``total_order``. Each step narrows a span whose ends differ, so
    that its first and last slice hold fewer rows than the span: the search ends.
    The search keeps, per wanted rank, the span of keys that still holds it.
    Ranks with the same span share one histogram, so a pass over the rows costs
    the same for one rank as for many.
    """
    few = min(GROUP_LIMIT if group_limit is None else group_limit, CANDIDATES)
    slices = SLICES if slices is None else slices
    keys = [*by, "tag"]
    numeric = [c for c in order if isinstance(df.schema[c].dataType, T.NumericType)]
    rows = df.select(*by, *order)
    measures = [f(c).alias(f"{p}_{c}") for c in order for p, f in (("lo", F.min), ("hi", F.max))]
    span = [f"{p}_{c}" for c in order for p in ("lo", "hi")]
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *measures).join(ranks, by)
    state = settle(state.where("k >= 1 and k <= n").select(*keys, "k", "n", *span))

    def shared(live: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows inside the distinct spans of ``live``, and which span each wanted rank looks into."""
        spans = settle(live.select(*by, *span).distinct().withColumn("span", F.monotonically_increasing_id()))
        inside = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in order])
        return rows.join(spans, by).where(inside), live.join(spans, [*by, *span]).select(*keys, "k", "span")

    for name in numeric:
        fixed = [F.col(f"lo_{c}") == F.col(f"hi_{c}") for c in order[: order.index(name)]]
        open_ = reduce(lambda a, b: a & b, fixed, (F.col("n") > few) & (F.col(f"lo_{name}") < F.col(f"hi_{name}")))
        while not (busy := state.where(open_)).isEmpty():
            inside, aims = shared(busy)
            width, offset = _distance(df, name, F.col(f"hi_{name}")), _distance(df, name, F.col(name))
            slice_ = F.least(F.lit(slices - 1), F.floor(offset / width * slices))
            counted = inside.groupBy("span", slice_.alias("slice")).agg(F.count(F.lit(1)).alias("n"), *measures)
            upto = F.sum("n").over(Window.partitionBy("span").orderBy("slice"))
            hit = (F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))
            stepped = counted.withColumn("upto", upto).join(aims, "span").where(hit)
            stepped = stepped.select(*keys, (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n", *span)
            state = settle(state.where(~open_).unionByName(stepped))

    one_key = reduce(lambda a, b: a & b, [F.col(f"lo_{c}") == F.col(f"hi_{c}") for c in order])
    known = state.where(one_key).select(*keys, *[F.col(f"lo_{c}").alias(f"cut_{c}") for c in order])
    inside, aims = shared(state.where(~one_key))
    placed = inside.withColumn("pos", F.row_number().over(Window.partitionBy("span").orderBy(*order))).select("span", "pos", *order)
    found = placed.join(aims, "span").where("pos = k").select(*keys, *[F.col(c).alias(f"cut_{c}") for c in order])
    return settle(ranks.join(known.unionByName(found), keys))


def _distance(df: DataFrame, name: str, value: Column) -> Column:
    """From the span's lower end to ``value`` as a finite double; half of it where a span of doubles may be too wide."""
    low = F.col(f"lo_{name}")
    if isinstance(df.schema[name].dataType, T.DoubleType):
        half = F.when((F.col(f"hi_{name}") > 1e307) | (low < -1e307), 0.25).otherwise(1.0)
        return value * half - low * half
    if isinstance(df.schema[name].dataType, T.LongType):
        return (value.cast("decimal(20,0)") - low.cast("decimal(20,0)")).cast("double")
    return (value - low).cast("double")


def mark_first(
    df: DataFrame, by: list[str], order: list[str], quota: DataFrame, out: str, group_limit: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Adds ``out``: is the row among the first ``k`` of its group in ``order``?

    ``quota`` is (by..., k); no quota means none.  ``sizes`` saves a count when the caller has it.
    Missing values and NaN of an order column come last.
    """
    columns = df.columns
    df, order = total_order(df, order)
    limit = window_limit(by, group_limit)
    sizes = group_sizes(df, by) if sizes is None else sizes
    if largest(sizes) <= limit:
        pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        if by == [WHOLE]:
            return df.select(*columns, (pos <= (quota.agg(F.max("k")).first()[0] or 0)).alias(out))
        marked = df.withColumn("_pos", pos).join(quota.select(*by, "k"), by, "left")
        return marked.select(*columns, (F.col("_pos") <= F.coalesce("k", F.lit(0))).alias(out))
    ranks = quota.join(sizes, by).select(*by, F.lit(0).alias("tag"), F.least("k", "n_group").alias("k"))
    cuts = cut_keys(df, by, order, settle(ranks), limit).drop("tag", "k")
    if by == [WHOLE]:
        bound = cuts.first()
        return df.select(*columns, (F.lit(False) if bound is None else ~key_after(order, [F.lit(bound[f"cut_{c}"]) for c in order])).alias(out))
    cuts = cuts.withColumn("_known", F.lit(True))
    inside = F.col("_known").isNotNull() & ~key_after(order, [F.col(f"cut_{c}") for c in order])
    return df.join(cuts, by, "left").select(*columns, F.coalesce(inside, F.lit(False)).alias(out))


def first_rows(df: DataFrame, by: list[str], order: list[str], quota: DataFrame, group_limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The first ``k`` rows of each group in ``order``; ``quota`` is (by..., k)."""
    return mark_first(df, by, order, quota, "_first", group_limit, sizes).where("_first").drop("_first")


def distinct_sizes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """About how many distinct values each group holds: one scan with small sketches, no shuffle of the values.

    Good enough to choose between two exact ways.
    """
    return settle(df.groupBy(*by).agg(F.approx_count_distinct(value).alias("n_group")))


def running_sums(
    df: DataFrame, by: list[str], value: str, cols: list[str], descending: bool = False, group_limit: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Running totals ``run_<col>`` over the distinct ``value``s of each group.

    ``df`` holds one row per (by, value).  Where a group is large, rows are dealt to slices
    by range of (by, value), so that a hot group lies in as many slices as it needs; the
    totals of a group's slices give each slice its offset, and rows add up within it.
    """
    limit = GROUP_LIMIT if group_limit is None else group_limit
    sizes = group_sizes(df, by) if sizes is None else sizes
    way = F.col(value).desc() if descending else F.col(value).asc()
    over = Window.partitionBy(*by).orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    if largest(sizes) <= limit:
        return df.select("*", *[F.sum(c).over(over).alias(f"run_{c}") for c in cols])
    cut = range_slices(df, by, [way], sizes, limit)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"tot_{c}") for c in cols])
    offsets = totals.select(*by, "_slice", *[F.coalesce(F.sum(f"tot_{c}").over(before), F.lit(0)).alias(f"off_{c}") for c in cols])
    inside = Window.partitionBy(*by, "_slice").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(settle(offsets), [*by, "_slice"]).select(
        *df.columns, *[(F.col(f"off_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in cols]
    )


def range_slices(df: DataFrame, by: list[str], order: list[Column], sizes: DataFrame, limit: int) -> DataFrame:
    """``df`` settled with ``_slice``: numbers that rise with (by, order), each of about half of ``limit`` rows."""
    total = sizes.agg(F.sum("n_group")).first()[0] or 0
    parts = max(2, 2 * total // limit)
    return settle(df.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id()))


def row_ranks(df: DataFrame, by: list[str], order: list[Column], out: str, group_limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Position of every row in its group; ``order`` must tell all rows of a group apart.

    Large groups are dealt to slices by range; a slice's rows start after those of the
    group's earlier slices.
    """
    limit = GROUP_LIMIT if group_limit is None else group_limit
    sizes = group_sizes(df, by) if sizes is None else sizes
    if largest(sizes) <= limit:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    cut = range_slices(df, by, order, sizes, limit)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    return cut.join(settle(offsets), [*by, "_slice"]).select(*df.columns, (F.col("_off") + F.row_number().over(inside)).alias(out))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], group_limit: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles (by..., prob, quantile); nulls are left out."""
    limit = GROUP_LIMIT if group_limit is None else group_limit
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sizes = group_sizes(rows, by)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    if largest(sizes) <= limit:
        wide = rows.groupBy(*by).agg(F.percentile("_v", wanted).alias("q"))
        return wide.select(*by, F.explode(F.arrays_zip(wanted.alias("prob"), F.col("q").alias("quantile"))).alias("z")).select(
            *by, F.col("z.prob"), F.col("z.quantile")
        )
    spot = sizes.select(*by, "n_group", F.explode(wanted).alias("prob")).withColumn("at", F.col("prob") * (F.col("n_group") - 1))
    spot = spot.withColumn("low", F.floor("at") + 1).withColumn("high", F.least(F.floor("at") + 2, F.col("n_group")))
    ranks = settle(spot.select(*by, F.explode(F.array("low", "high")).alias("k")).distinct().withColumn("tag", F.col("k")))
    keyed, order = total_order(rows, ["_v"])
    place = F.col("cut__key0_place")
    value = F.when(place == 2, float("nan")).when(place == 1, float("inf")).when(place == -1, float("-inf")).otherwise(F.col("cut__key0"))
    cuts = settle(cut_keys(keyed, by, order, ranks, limit).select(*by, "tag", value.alias("cut__v")))
    low = cuts.select(*by, F.col("tag").alias("low"), F.col("cut__v").alias("v_low"))
    high = cuts.select(*by, F.col("tag").alias("high"), F.col("cut__v").alias("v_high"))
    joined = spot.join(low, [*by, "low"]).join(high, [*by, "high"])
    part = F.col("at") - F.floor("at")
    between = (1 - part) * F.col("v_low") + part * F.col("v_high")
    return joined.select(*by, "prob", F.when((part == 0) | (F.col("v_low") == F.col("v_high")), F.col("v_low")).otherwise(between).alias("quantile"))


def column_quantiles(
    df: DataFrame, by: list[str], cols: list[str], probs: dict[str, float], group_limit: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Exact quantiles of several columns: (by..., feature, one column per name in ``probs``).

    Groups of a checked size need one wide aggregate; larger ones are unfolded
    and searched rank by rank.  ``sizes`` saves a read of the table when the caller has counted.
    """
    limit = GROUP_LIMIT if group_limit is None else group_limit
    numbers = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    if largest(group_sizes(numbers, by) if sizes is None else sizes) <= limit:
        wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
        wide = numbers.groupBy(*by).agg(*[F.percentile(c, wanted).alias(c) for c in cols])
        rows = [F.struct(F.lit(c).alias("feature"), *[F.get(c, F.lit(i)).alias(name) for i, name in enumerate(probs)]) for c in cols]
        return wide.select(*by, F.inline(F.array(*rows)))
    long = exact_quantiles(numbers.unpivot(list(by), cols, "feature", "value"), [*by, "feature"], "value", list(probs.values()), limit)
    return long.groupBy(*by, "feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in probs.items()])
