import math

import pytest

from scenespark import sql
from scenespark.functions import tables


def test_views_and_functions(spark):
    tables.register(spark)
    names = sql.register_views(spark, "/root/testdata/sf0.001")
    assert {"scene", "share_of", "purchases", "cells", "grid"} <= set(names)
    assert spark.sql("SELECT count(*) n FROM scene").first().n == spark.sql("SELECT count(*) n FROM lineitem").first().n
    got = spark.sql("SELECT count(*) n, count(DISTINCT members) m, min(size(members)) k FROM permutation_splits(10, 4)").first()
    assert tuple(got) == (210, 210, 4)
    assert spark.sql("SELECT erf(1D) e").first().e == pytest.approx(math.erf(1))
    assert spark.sql("SELECT * FROM permutation_splits(2, 5)").count() == 0
    with pytest.raises(Exception, match="million"):
        spark.sql("SELECT * FROM permutation_splits(40, 20)").collect()
