"""Bounded samples and distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.windows import even_sample
from loomlog.sources.shared import written

SEED = 0x4D534E54


def top(rows: DataFrame, score: Column, order: list, k: int) -> DataFrame:
    """The k rows of highest score, ties by order. Each task keeps k at most."""
    return rows.withColumn("_score", score).orderBy(F.desc("_score"), *order).limit(k).drop("_score")


def drawn(key: str, seed: int = SEED) -> Column:
    """The place of a row in the draw: a digest that any engine can take."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def reservoir(rows: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """k rows drawn evenly: those of smallest seeded hash. The same rows give the same sample however they are dealt."""
    return rows.withColumn("_h", drawn(key, seed)).orderBy("_h", key).limit(k).drop("_h")


def bounded(rows: DataFrame, key: str, score: Column, order: list, k: int) -> DataFrame:
    """At most k rows: two thirds by score (of those above 1), the rest from the reservoir."""
    scored = rows.withColumn("_score", score)
    first = written(scored.where("_score > 1").orderBy(F.desc("_score"), *order).limit((2 * k + 2) // 3).drop("_score"), "first")
    rest = reservoir(rows, key, k).join(first.select(key), key, "left_anti")
    left = k - first.count()
    return first.unionByName(rest.withColumn("_h", drawn(key)).orderBy("_h", key).limit(max(0, left)).drop("_h"))


def distinct_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. The row itself is the aggregate, so partial results keep one row a key and task."""
    pick = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick.alias("_row")).select("_row.*")


def distinct_best(rows: DataFrame, keys: list[str], rank: Column, order: list) -> DataFrame:
    """The row of highest rank of each key; ties go to the first by order."""
    pick = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct((-rank).alias("_r"), *order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick.alias("_row")).select("_row.*")


def prompt_sample(rows: DataFrame, clean: str, rank: Column, low_value: Column, score: Column, order: list[str], key: str, k: int) -> DataFrame:
    """Rows for a prompt: distinct by clean text, without low-value rows if enough remain, 2/3 by score, the rest at even steps."""
    rows = written(distinct_best(rows, [clean], rank, order), "prompt")
    worth = rows.where(~low_value)
    pool = worth if worth.count() >= k else rows
    if pool.count() <= k:
        return pool
    first = top(pool.where(score > 0), score, order, max(1, k * 2 // 3))
    spread = even_sample(pool, order, k - k * 2 // 3 + 2).join(first.select(key), key, "left_anti").orderBy(*order)
    taken = first.unionByName(spread.limit(max(0, k - first.count())))
    rest = pool.join(taken.select(key), key, "left_anti").orderBy(*order).limit(max(0, k - taken.count()))
    return taken.unionByName(rest)


def fit_budget(texts: list[str], most_chars: int) -> list[str]:
    """A list of collected rows, shortened by a quarter again and again until its text fits."""
    texts = list(texts)
    while texts and sum(map(len, texts)) > most_chars:
        texts = texts[: max(0, min(len(texts) - 1, len(texts) * 3 // 4))]
    return texts


#: The share of evidence that is taken by score alone, and the score from which rows are taken in their order then.
BY_SCORE, WORTH = (3, 5), 50


def evidence(rows: DataFrame, keys: list[str], masked: Column, score: Column, order: list[str], k: int) -> DataFrame:
    """k rows of each group, distinct by masked text: 3 of 5 by score, then those worth WORTH in their order, then by score again.

    Rows are reduced to one a masked text first, with its best row and its first worthy one,
    so a group is as many rows as it has different texts.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    at = F.struct(*order)
    marked = rows.withColumn("_m", masked).withColumn("_s", score.cast("double"))
    texts = marked.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)], "_m").agg(
        F.max("_s").alias("_s"), F.min_by(whole, F.struct((-F.col("_s")).alias("s"), *order)).alias("_best"), F.min_by(whole, F.when(F.col("_s") >= WORTH, at)).alias("_first")
    )
    group = [f"_{i}" for i in range(len(keys))]
    of = lambda name: F.struct(*[F.col(f"{name}.{c}") for c in order])
    quota = max(1, min(k, k * BY_SCORE[0] // BY_SCORE[1]))
    ranked = texts.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_s"), of("_best"))))
    step = F.when(F.col("_r") <= quota, 1).when(F.col("_first").isNotNull(), 2).otherwise(3)
    ranked = ranked.withColumn("_step", step).withColumn("_at", F.when(F.col("_step") == 2, of("_first")))
    picked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_step", "_at", "_r"))).where(F.col("_n") <= k)
    return picked.select(F.when(F.col("_step") == 2, F.col("_first")).otherwise(F.col("_best")).alias("_row")).select("_row.*")
