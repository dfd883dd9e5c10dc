"""Class probabilities as an array per row, in the order of a label list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K


def align(probabilities: Column, source: list[str], target: list[str]) -> Column:
    """Reorder from the labels of a model to the shared labels; an absent label gets 0."""
    places = {label: i for i, label in enumerate(source)}
    return F.array(
        *[F.get(probabilities, F.lit(places[x])) if x in places else F.lit(0.0) for x in target]
    )


def padded(probabilities: Column, size: int) -> Column:
    """Fill up to ``size`` entries with 0, for models that have not seen the last classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(probabilities, i), F.lit(0.0)))


def argmax(probabilities: Column) -> Column:
    """0-based position of the largest entry; the first of equals."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def weighted(probabilities: Column, weights: list[float], op: str = "multiply") -> Column:
    """Scale every class by its weight."""
    factors = F.array(*[F.lit(float(w)) for w in weights])
    if op == "multiply":
        return F.zip_with(probabilities, factors, lambda p, w: p * w)
    if op == "divide":
        return F.zip_with(probabilities, factors, lambda p, w: p / w)
    raise ValueError(f"op must be multiply or divide, not {op}")


def class_weights_list(weights: dict[str, float], labels: list[str]) -> list[float]:
    """Weights in label order; a label without one gets 1."""
    return [float(weights.get(label, 1.0)) for label in labels]


def ensemble(
    first: DataFrame, second: DataFrame, weights: tuple[float, float] = K.ENSEMBLE_WEIGHTS, column: str = "probabilities"
) -> DataFrame:
    """Weighted mean of two models' probabilities for the rows both scored, matched by id."""
    other = second.select(K.ID, F.col(column).alias("__other"))
    mixed = F.zip_with(column, "__other", lambda a, b: a * F.lit(weights[0]) + b * F.lit(weights[1]))
    return first.join(other, K.ID).withColumn(column, mixed).drop("__other")


def to_long(df: DataFrame, column: str = "probabilities") -> DataFrame:
    """One row per id and class position."""
    return df.select(K.ID, F.posexplode(column).alias("k", "p"))
