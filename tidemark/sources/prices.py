"""Price tables: files, refresh checks and differences."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.usage import resolve_prices

RATES = ["inp", "out", "cw", "cr"]


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """prices(model, inp, out, cw, cr) of a JSON file {"models": {name: {...rates}}}."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    models = v.select(F.explode(F.try_variant_get("v", "$.models", "map<string,map<string,double>>")).alias("model", "r"))
    return models.select("model", F.col("r")["in"].alias("inp"), F.col("r")["out"].alias("out"), F.col("r")["cw"].alias("cw"), F.col("r")["cr"].alias("cr"))


def read_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(model, inp, out, cw, cr) of the `[prices]` tables of a hand-written TOML file, and its snapshot date.

    Keys are input, output, cache_write and cache_read; what isn't a table or a number is left out.
    """
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
    block = tomllib.loads(text).get("prices")
    block = block if isinstance(block, dict) else {}
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    rows = [(name.lower(), *(number(own.get(k)) for k in ("input", "output", "cache_write", "cache_read"))) for name, own in block.items() if isinstance(own, dict)]
    date = block.get("snapshot_date")
    return spark.createDataFrame(rows, "model string, inp double, out double, cw double, cr double"), date if isinstance(date, str) else None


def overridden(prices: DataFrame, overrides: DataFrame, aliases: DataFrame) -> DataFrame:
    """Layered prices with the user's rates: what an override leaves out comes from the price its name resolves to, else it is 0."""
    base = resolve_prices(overrides, prices, aliases).select("model", *[F.col(c).alias(f"_{c}") for c in RATES])
    own = overrides.join(base, "model", "left").select("model", *[F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) for c in RATES], F.lit("user").alias("provenance"))
    families = prices.where("is_family").select(F.col("model").alias("_m"))
    own = own.join(F.broadcast(families), F.col("model") == F.col("_m"), "left").withColumn("is_family", F.col("_m").isNotNull()).drop("_m")
    return prices.join(own.select("model"), "model", "left_anti").unionByName(own)


def refreshed(raw: DataFrame, allowed: str) -> DataFrame:
    """Upstream rates per token (model, input, output, cache_write, cache_read) as rates per million.

    Names must match `allowed`; cache rates default to 1.25 and 0.1 of the input rate; rows with a
    rate outside 0 to 1000 or without input or output are dropped.
    """
    m = lambda c: F.col(c).cast("double") * 1e6
    rows = raw.where(F.col("model").rlike(allowed)).select(
        F.lower("model").alias("model"), m("input").alias("inp"), m("output").alias("out"),
        F.coalesce(m("cache_write"), m("input") * 1.25).alias("cw"), F.coalesce(m("cache_read"), m("input") * 0.1).alias("cr"),
    )
    return rows.where(" and ".join(f"{c} between 0 and 1000" for c in RATES))


def price_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Models added, removed or changed between two tables."""
    a, b = old.select("model", F.struct(*RATES).alias("o")), new.select("model", F.struct(*RATES).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return a.join(b, "model", "full_outer").select("model", kind.alias("change")).where("change is not null")
