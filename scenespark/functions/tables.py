"""Table functions for SQL."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="split_id int, members array<int>")
class PermutationSplits:
    """permutation_splits(n, k): every way to choose k of n places, from 0. More than a million ways are
    refused; draw at random instead (inference.monte_carlo_medians)."""

    def eval(self, n: int, k: int):
        if n is None or k is None or not 0 <= k <= n:
            return
        if math.comb(n, k) > 1_000_000:
            raise ValueError(f"{n} over {k} is more than a million splits")
        for i, c in enumerate(itertools.combinations(range(n), k)):
            yield i, list(c)


def register(spark: SparkSession) -> None:
    spark.udtf.register("permutation_splits", PermutationSplits)
    from scenespark.functions import special

    spark.udf.register("erf", special.erf)
    spark.udf.register("normal_two_sided", special.normal_two_sided)
    spark.udf.register("student_two_sided", special.student_two_sided)
