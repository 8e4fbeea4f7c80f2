"""Two-sided market quotes: open/close, consensus, de-vig, movement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ledgerfold.functions import scalars as S
from ledgerfold.functions.bands import rate

OUTCOME = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
MARKET = T.StructType([T.StructField("key", T.StringType()), T.StructField("outcomes", T.ArrayType(OUTCOME))])
BOOK = T.StructType([T.StructField("key", T.StringType()), T.StructField("title", T.StringType()),
                     T.StructField("markets", T.ArrayType(MARKET))])
EVENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("commence_time", T.StringType()),
                      T.StructField("bookmakers", T.ArrayType(BOOK))])


def parse_events(df: DataFrame, doc: str, keep: list[str], market: str = "h2h") -> DataFrame:
    """JSON text or struct column ``doc`` -> one row per event, book and market."""
    if isinstance(df.schema[doc].dataType, T.StringType):
        df = df.withColumn(doc, F.from_json(doc, EVENT))
    books = df.select(*keep, F.col(f"{doc}.id").alias("event_id"), F.col(f"{doc}.commence_time").alias("commence_time"),
                      F.explode(f"{doc}.bookmakers").alias("_b"))
    rows = books.select("*", F.explode("_b.markets").alias("_m")).where(
        (F.col("_m.key") == market) & (F.size("_m.outcomes") == 2))
    a, b = F.col("_m.outcomes")[0], F.col("_m.outcomes")[1]
    return rows.select(
        *keep, "event_id", "commence_time", F.col("_b.key").alias("book"), a["name"].alias("side_a"), b["name"].alias("side_b"),
        a["price"].alias("odds_a"), b["price"].alias("odds_b"), S.american_to_prob(a["price"]).alias("prob_a"),
        S.american_to_prob(b["price"]).alias("prob_b"))


def mean_first_side(doc: str, market: str = "h2h"):
    """Mean implied probability of the first side, without exploding the document."""
    prices = F.flatten(F.transform(F.col(f"{doc}.bookmakers"), lambda b: F.transform(
        F.filter(b["markets"], lambda m: (m["key"] == market) & (F.size(m["outcomes"]) == 2)),
        lambda m: m["outcomes"][0]["price"])))
    probs = F.transform(F.filter(prices, lambda p: p.isNotNull()), S.american_to_prob)
    return F.try_divide(F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x), F.size(probs))


def open_close(quotes: DataFrame, key: list[str], ts: str, tie: str, values: list[str]) -> DataFrame:
    """Earliest and latest quote per key as ``opening`` / ``closing`` rows.

    min_by/max_by reduce on the map side, so a key with a third of all quotes
    never gathers in one task.
    """
    order = F.struct(ts, tie)
    best = quotes.groupBy(*key).agg(
        F.min_by(F.struct(ts, *values), order).alias("o"), F.max_by(F.struct(ts, *values), order).alias("c"))
    both = F.array(F.struct(F.lit("opening").alias("line_type"), F.col("o").alias("q")),
                   F.struct(F.lit("closing").alias("line_type"), F.col("c").alias("q")))
    return best.select(*key, F.explode(both).alias("_x")).select(*key, "_x.line_type", "_x.q.*")


def consensus(raw: DataFrame, by: list[str]) -> DataFrame:
    """Mean implied probability over books; rows without a key are dropped."""
    for b in by:
        raw = raw.where(F.col(b).isNotNull())
    return raw.groupBy(*by).agg(F.avg("prob_a").alias("prob_a"), F.avg("prob_b").alias("prob_b"),
                                F.countDistinct("book").alias("n_books"), F.min("snapshot_ts").alias("snapshot_ts"))


def devig(df: DataFrame) -> DataFrame:
    """Scale both sides to sum to one."""
    tot = F.col("prob_a") + F.col("prob_b")
    return df.withColumn("fair_a", F.try_divide(F.col("prob_a"), tot)).withColumn("fair_b", F.try_divide(F.col("prob_b"), tot))


def price_panel(cons: DataFrame, key: list[str]) -> DataFrame:
    """One row per event: opening, closing, movement and book counts of both sides."""
    pick = lambda lt, c: F.max(F.when(F.col("line_type") == lt, F.col(c)))
    p = cons.groupBy(*key).agg(
        *[pick(lt, f"fair_{s}").alias(f"{n}_{s}") for lt, n in (("opening", "open"), ("closing", "close")) for s in "ab"],
        pick("opening", "n_books").alias("open_n_books"), pick("closing", "n_books").alias("close_n_books"))
    return p.withColumn("move_a", F.col("close_a") - F.col("open_a")).withColumn("move_b", F.col("close_b") - F.col("open_b"))


def line_movement(cons: DataFrame, key: list[str]) -> DataFrame:
    """Closing minus opening on both line types, NULL when one is missing.

    At most two rows per key after :func:`consensus`: aggregate and join back.
    """
    return cons.join(price_panel(cons, key).select(*key, "move_a", "move_b"), key)


def side_explode(panel: DataFrame, keep: list[str]) -> DataFrame:
    """One row per side with favourite flag and the opponent's columns."""
    def side(s: str, o: str):
        return F.struct(F.lit(s).alias("side"), F.col(f"side_{s}").alias("name"), F.col(f"open_{s}").alias("open_prob"),
                        F.col(f"close_{s}").alias("close_prob"), F.col(f"move_{s}").alias("line_move"),
                        (F.col(f"close_{s}") > 0.5).cast("int").alias("is_favorite"), F.col(f"side_{o}").alias("opponent"),
                        F.col(f"close_{o}").alias("opponent_close"))
    return panel.select(*keep, F.explode(F.array(side("a", "b"), side("b", "a"))).alias("_s")).select(*keep, "_s.*")


def coverage(sides: DataFrame, date: str = "date_id", entity: str = "name") -> DataFrame:
    """Counts and shares of rows with a price, a move and a favourite."""
    return sides.agg(
        F.countDistinct(date).alias("n_dates"), F.countDistinct(entity).alias("n_entities"), F.count(F.lit(1)).alias("n_rows"),
        rate(F.col("open_prob").isNotNull()).alias("open_share"), rate(F.col("line_move").isNotNull()).alias("move_share"),
        rate(F.col("is_favorite") == 1).alias("favorite_share"), F.avg("close_prob").alias("mean_close"))


def quality_tier(price: str = "prob", prop: str = "prop"):
    """``none`` without a price, ``high`` with a prop price, else ``medium``."""
    return F.when(F.col(price).isNull(), "none").when(F.col(prop).isNotNull(), "high").otherwise("medium")


def move_direction(col: str = "line_move", threshold: float = 0.02, missing: str = "unknown"):
    """``steamed``, ``drifted`` or ``stable``."""
    m = F.col(col)
    return F.when(m.isNull() | F.isnan(m), missing).when(m > threshold, "steamed").when(m < -threshold, "drifted").otherwise("stable")
