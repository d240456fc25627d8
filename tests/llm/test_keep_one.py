from __future__ import annotations

import random

from assay.llm import simhash
from tests.llm.conftest import prose


def test_distinct_texts_of_null_or_repeated_keys_stay(spark):
    rng = random.Random(4)
    texts = [prose(rng, "en", 60) for _ in range(9)]
    given = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(8, texts[7]), (-1, texts[8])]
    copies = [(None, texts[7]), (None, texts[0]), (9, texts[4]), (7, texts[5]), (6, texts[6].upper())]
    df = spark.createDataFrame(given + copies, "doc_id long, text string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in simhash.keep_one(df).collect())))
    want = {str(x) for x in given} - {str((7, texts[6]))} | {str((6, texts[6].upper()))}  # the smaller key of the group
    assert got == sorted(want)
