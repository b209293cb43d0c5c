"""Prices of models and costs of usage events."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATES = ("input_rate", "output_rate", "cache_write_rate", "cache_read_rate", "input_rate_above", "output_rate_above", "cache_write_rate_above", "cache_read_rate_above")
SCHEMA = "key string, " + ", ".join(f"{r} double" for r in RATES)
#: Tokens of one event and category beyond which the higher rates hold.
THRESHOLD = 200_000

#: The fields of a public price list, in the order of RATES.
FIELDS = (
    "input_cost_per_token",
    "output_cost_per_token",
    "cache_creation_input_token_cost",
    "cache_read_input_token_cost",
    "input_cost_per_token_above_200k_tokens",
    "output_cost_per_token_above_200k_tokens",
    "cache_creation_input_token_cost_above_200k_tokens",
    "cache_read_input_token_cost_above_200k_tokens",
)
#: Providers whose prices are kept when a price list is compacted.
PROVIDERS = ("anthropic", "openai", "moonshotai", "baseten", "zai", "openrouter")


def parse_prices(spark: SparkSession, text: str, providers: tuple[str, ...] | None = None) -> DataFrame:
    """Prices from a JSON object of models; entries without finite input and output rates are left out, a malformed text gives none."""
    source = spark.createDataFrame([(text,)], "j string")
    entries = source.select(F.explode(F.from_json("j", "map<string,string>")).alias("key", "entry"))
    if providers:
        entries = entries.where(F.get_json_object("entry", "$.litellm_provider").isin(*providers))

    def rate(field: str) -> Column:
        value = F.try_variant_get(F.try_parse_json("entry"), f"$.{field}", "double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    rows = entries.where(F.try_parse_json("entry").isNotNull()).select("key", *[rate(f).alias(r) for f, r in zip(FIELDS, RATES, strict=True)])
    return rows.where("input_rate is not null and output_rate is not null")


def layered(*layers: DataFrame) -> DataFrame:
    """Prices of all layers; of one key the last layer's."""
    ranked = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    newest = Window.partitionBy("key").orderBy(F.desc("layer"))
    return ranked.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "layer")


def normalized(key: str) -> str:
    return re.sub(r"[.@]", "-", key).lower()


def _contains(text: str, key: str) -> bool:
    """``key`` stands in ``text`` between boundaries; a number behind a key that ends in one is another version, unless it is a date of eight digits."""
    if not key:
        return False
    at = text.find(key)
    while at >= 0:
        before, rest = text[at - 1 : at], text[at + len(key) :]
        if not (before.isalnum() and before.isascii()):
            number = re.match(r"[-.](\d+)", rest) if key[-1].isdigit() else None
            if number:
                digits, after = number[1], rest[number.end() : number.end() + 1]
                if len(digits) == 8 and not (after.isalnum() and after.isascii()):
                    return True
            elif not rest or not (rest[0].isalnum() and rest[0].isascii()):
                return True
        at = text.find(key, at + 1)
    return False


def matches(model: str, key: str) -> bool:
    """Either name contains the other, as written or normalised."""
    a, b = normalized(model), normalized(key)
    return _contains(model, key) or _contains(key, model) or _contains(a, b) or _contains(b, a)


def best_key(model: str, keys: dict[str, str] | list[str]) -> str | None:
    """The key itself, else the longest that matches, of equals the smallest. ``keys`` may come with their normalised forms."""
    if model in keys:
        return model
    if not isinstance(keys, dict):
        keys = {k: normalized(k) for k in keys}
    plain = normalized(model)
    found = [k for k, n in keys.items() if (n in plain or plain in n) and matches(model, k)]
    return min(found, key=lambda k: (-len(k), k)) if found else None


def _pieces(name: Column) -> Column:
    """Runs of ASCII letters and digits of a name, in lower case, as written and as normalised; one empty piece if there are none.

    Where a name contains another between boundaries, it has all of that
    one's pieces: those as written, or those of the normalised form.
    """
    ascii_lower = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    forms = F.array_distinct(F.array(ascii_lower, F.lower(name)))
    return F.transform(forms, lambda x: F.array_distinct(F.filter(F.split(x, "[^a-z0-9]+"), lambda t: t != "")))


def _rarest(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, piece): of each form of a name the piece that fewest price names have; none if a piece is in no price name."""
    forms = names.select("name", F.posexplode(_pieces(F.col("name"))).alias("form", "pieces"))
    bare = forms.where(F.size("pieces") == 0).select("name", F.lit("").alias("piece"))
    each = forms.select("name", "form", F.explode("pieces").alias("piece")).join(counts, "piece", "left")
    best = each.groupBy("name", "form").agg(F.min(F.struct("n", "piece")).alias("best"), F.count_if(F.col("n").isNull()).alias("unknown"))
    return best.where("unknown = 0").select("name", "best.piece").unionByName(bare).distinct()


def candidates(models: DataFrame, keys: DataFrame) -> DataFrame:
    """(model, key): pairs of names (column ``name``) of which either may contain the other.

    An inverted index of pieces: the contained name is looked up by its rarest
    piece among all pieces of the other. Both directions are joins on a piece,
    so no name is tried against all others, and the pairs grow with how often
    the rarest pieces occur.
    """
    every = F.array_union(F.flatten(_pieces(F.col("name"))), F.array(F.lit("")))
    of_keys, of_models = keys.select(F.col("name").alias("key"), F.explode(every).alias("piece")), models.select(F.col("name").alias("model"), F.explode(every).alias("piece"))
    counts = of_keys.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    held = _rarest(keys, counts).withColumnRenamed("name", "key").join(of_models, "piece")
    holding = _rarest(models, counts).withColumnRenamed("name", "model").join(of_keys, "piece")
    return held.select("model", "key").unionByName(holding.select("model", "key")).distinct()


def resolve_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, key): each distinct model with the key of its price, null if there is none.

    The name itself is taken by a join, else the longest that matches, of
    equals the smallest. Only names that share their pieces are compared, in
    Arrow batches; nothing is collected, however long the price list.
    """
    wanted = models.select("model").distinct()
    keys = prices.select(F.col("key").alias("name")).where("name <> ''").distinct()
    exact = wanted.join(keys, wanted["model"] == keys["name"], "left")
    rest = exact.where("name is null and model <> ''").select(F.col("model").alias("name"))

    @F.pandas_udf("boolean")
    def agree(found: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([matches(m, k) for m, k in zip(found, key, strict=True)], dtype=bool)

    pairs = candidates(rest, keys).where(agree("model", "key"))
    best = pairs.groupBy("model").agg(F.min(F.struct((-F.length("key")).alias("size"), "key")).alias("best")).select("model", F.col("best.key").alias("near"))
    return exact.join(best, "model", "left").select("model", F.coalesce("name", "near").alias("key"))


def tiered(tokens: Column, base: Column, above: Column) -> Column:
    """Tokens times rate; with a second rate, those beyond the threshold cost that."""
    t = tokens.cast("double")
    split = F.lit(float(THRESHOLD)) * base + (t - THRESHOLD) * above
    return F.when((tokens <= 0) | tokens.isNull(), 0.0).when(above.isNotNull() & (tokens > THRESHOLD), split).otherwise(t * base)


def computed_cost() -> Column:
    """Cost of an event row that has its price's columns; 0 without a price."""
    rate = F.col
    write, write_above = F.coalesce("cache_write_rate", F.col("input_rate") * 1.25), rate("cache_write_rate_above")
    hour = F.coalesce("cache_write_1h", F.lit(0))
    short = F.greatest(F.lit(0), F.col("cache_write") - hour)
    cost = (
        tiered(F.col("input"), rate("input_rate"), rate("input_rate_above"))
        + tiered(F.col("output"), rate("output_rate"), rate("output_rate_above"))
        + tiered(F.col("cache_read"), F.coalesce("cache_read_rate", F.col("input_rate") * 0.1), rate("cache_read_rate_above"))
        + tiered(short, write, write_above)
        + tiered(hour, F.col("input_rate") * 2, F.col("input_rate_above") * 2)
    )
    return F.when(F.col("input_rate").isNull(), 0.0).otherwise(cost)


def with_cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Events with ``cost_usd`` (a recorded cost wins, also 0) and ``priced`` (false where a price was needed and missing)."""
    keyed = resolve_models(events.where("cost_usd is null"), prices).join(prices, "key")
    joined = events.join(keyed.drop("key"), "model", "left")
    priced = F.col("cost_usd").isNotNull() | F.col("input_rate").isNotNull()
    return joined.withColumn("priced", priced).withColumn("cost_usd", F.coalesce("cost_usd", computed_cost())).drop(*RATES)


def _reported_tokens() -> Column:
    """Reads from the cache count here."""
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")


def unpriced() -> Column:
    """Whether an event of ``with_cost`` has tokens but no price."""
    return ~F.col("priced") & (_reported_tokens() > 0)


def warnings(costed: DataFrame) -> DataFrame:
    """(model, tokens) of every event without a price that has tokens."""
    return costed.where(unpriced()).select("model", _reported_tokens().alias("tokens"))
