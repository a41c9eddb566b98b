"""The join that carries the winner back tells texts apart whatever the digest's length."""

import pytest
from pyspark.sql import functions as F

from sourcetrust.llm import exact_dedup


@pytest.mark.parametrize("bits", [256, 4, 0])
def test_second_hash_collides(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *columns: F.lit(0).cast("long"))
    rows = spark.createDataFrame([(i, f"t{i % 40:02}") for i in range(200)], "doc_id long, text string")
    got = exact_dedup.mark_duplicates(rows, digest_bits=bits).select("doc_id", "dedup.*").collect()
    assert len(got) == 200 and {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: (i % 40, 5) for i in range(200)}
