"""Ids and control samples against plain Python, on uneven spellings."""

import re

from cohortloom.functions import text
from pyspark.sql import functions as F

IDS = ["DP3-0000012B", " dp3 0000012b\t", "DP3_0000012/B", "dp3–0000012b", "é1", "", " - ", None, "a\x00b", "ß9", "ﬁ7", "x" * 3000 + "-1", "A.B,C;D:E'F\"G(H)I[J]K{L}M<N>O|P\\Q~R`S!T@U#V$W%X^Y&Z*0+1=2?3"]


def test_ids_keep_ascii_letters_and_digits(spark):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(IDS)], "i int, v string").select("i", text.norm_id(F.col("v")).alias("n"), text.is_control_sample(F.col("v")).alias("c")).orderBy("i").collect()
    assert [r["n"] for r in got] == [None if v is None else re.sub("[^A-Za-z0-9]", "", v).upper() or None for v in IDS]
    assert not any(r["c"] for r in got)


def test_control_samples(spark):
    v = [" control_1", "NEG-2", "\nPlate", "negative", "uncontrolled", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v string").select(text.is_control_sample(F.col("v"))).collect()]
    assert got == [True, True, True, True, False, False, False]
