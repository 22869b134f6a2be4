import random

import pytest

from scenespark.llm import jaccard as jc
from scenespark.llm import simhash as sh


@pytest.mark.parametrize("grouped", [sh.near_groups, jc.similar_groups])
def test_one_row_of_each_group_whatever_the_ids(spark, grouped):
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(40)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0]), (3, texts[1]), (4, texts[1])]  # one of the six has a document
    rows += [(7, t) for t in texts[6:10]] + [(7, texts[6]), (8, texts[7]), (9, texts[10]), (None, texts[11])]
    kept = sh.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), grouped=grouped)
    want = [(None, texts[i]) for i in (0, 2, 3, 4, 5, 11)] + [(3, texts[1])] + [(7, t) for t in texts[6:10]] + [(9, texts[10])]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
