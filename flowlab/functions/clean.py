"""Column expressions for cleaning and feature engineering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.schemas import CATEGORICAL, NUMERIC

NULL_TOKENS = ["-", "(empty)"]
RATIO_CEILING = 1.0e6


def null_tokens(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Whole-cell null tokens become null in the string columns."""
    cols = cols or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)) for c in cols})


def to_double(col: Column, finite: bool = False) -> Column:
    """Bad text and NaN become null; with ``finite`` also the infinities."""
    number = col.try_cast("double")
    usable = ~F.isnan(number)
    if finite:
        usable = usable & (F.abs(number) != float("inf"))
    return F.when(usable, number)


def fill_missing(df: DataFrame, numeric: list[str], categorical: list[str], token: str = "unknown") -> DataFrame:
    return df.fillna({**{c: 0.0 for c in numeric}, **{c: token for c in categorical}})


def clip(col: Column, low, high) -> Column:
    """Bounds a value; null stays null (least/greatest would skip it, and generate more code)."""
    return F.when(col < low, F.lit(low)).when(col > high, F.lit(high)).otherwise(col)


def ratio_columns() -> dict[str, Column]:
    def per(top: str, bottom: str) -> Column:
        return F.col(top) / (F.col(bottom) + 1.0)

    return {
        "bytes_ratio": per("orig_bytes", "resp_bytes"),
        "pkts_ratio": per("orig_pkts", "resp_pkts"),
        "orig_bytes_per_pkt": per("orig_bytes", "orig_pkts"),
        "resp_bytes_per_pkt": per("resp_bytes", "resp_pkts"),
    }


def ratio_features(df: DataFrame) -> DataFrame:
    return df.withColumns(ratio_columns())


def clean_flows(df: DataFrame) -> DataFrame:
    """Parsed strings to typed, filled, engineered columns.

    Numbers need no token test of their own: a token does not parse, so it is
    missing already.  Short expressions keep the generated stage within the
    size that the JVM still compiles.
    """
    words = [c for c in (*CATEGORICAL, "label", "detailed_label") if c in df.columns]
    filled = null_tokens(df, words).withColumns({
        "ts": to_double(F.col("ts")), **{c: F.coalesce(to_double(F.col(c)), F.lit(0.0)) for c in NUMERIC},
        **{c: F.coalesce(c, F.lit("unknown")) for c in CATEGORICAL},
    })
    return filled.withColumns({name: clip(ratio, 0.0, RATIO_CEILING) for name, ratio in ratio_columns().items()})


def safe_div(top: Column, bottom: Column) -> Column:
    """0 when the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    return safe_div(part, whole) * 100.0


def f1(precision: Column, recall: Column) -> Column:
    return safe_div(2.0 * precision * recall, precision + recall)


def log10_positive(col: Column) -> Column:
    return F.when(col > 0, F.log10(col + 1e-9))


def slugify(col: Column, max_len: int | None = None, empty: str = "missing") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(F.btrim(col)), "[^a-z0-9]+", "_"), F.lit("_"))
    if max_len:
        slug = F.substring(slug, 1, max_len)
    return F.when(slug == "", F.lit(empty)).otherwise(F.coalesce(slug, F.lit(empty)))


def fraction_slug(col: Column) -> Column:
    return F.replace(col.cast("string"), F.lit("."), F.lit("p"))


def downcast(df: DataFrame, ranges: dict[str, str]) -> DataFrame:
    """Narrow numeric columns by schema; a whole number that would not fit stays visible as null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in ranges.items()})
