"""Vector distances as column expressions; a missing dimension counts as 0."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(a: Column, b: Column, f) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(F.coalesce(x.cast("double"), zero), F.coalesce(y.cast("double"), zero))), zero, lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Smaller is nearer: 1 - cosine, the negated dot product, or the Euclidean distance."""
    return {"cosine": lambda: 1 - cosine(a, b), "dot_product": lambda: -dot(a, b), "euclidean": lambda: euclidean(a, b)}[metric]()


def score(dist: Column, metric: str) -> Column:
    return {"cosine": lambda: 1 - dist, "dot_product": lambda: -dist, "euclidean": lambda: 1 / (1 + dist)}[metric]()


def knn(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "values", offset: int = 0) -> DataFrame:
    """The exact ``k`` nearest rows: (id, distance, score, rank). One scan, then a top-k on each partition."""
    if k <= 0:
        raise ValueError("k is positive")
    d = df.select(F.col(id_col), distance(F.col(vec_col), literal(query), metric).alias("distance"))
    top = d.orderBy("distance", id_col).limit(offset + k)
    from pyspark.sql import Window

    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))
    return ranked.where(F.col("rank") > offset).withColumn("score", score(F.col("distance"), metric))


def merge_knn(parts: Sequence[DataFrame], k: int, id_col: str = "id") -> DataFrame:
    """The lists of several shards ranked again: best score first, then by distance and id."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.asc("distance"), F.asc(id_col)]
    top = reduce(DataFrame.unionByName, [p.drop("rank") for p in parts]).orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
