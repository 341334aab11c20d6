import numpy as np
from pyspark.sql import functions as F

from corvia.llm import shingles as S


def test_sketches_lose_no_pair(spark):
    rng, rows = np.random.default_rng(4), []
    for n in (5, 40, 300, 3000, 20_000):
        for share in (0.5, 0.7, 0.88, 0.889, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 1 << 63, n - int(share * n), dtype=np.uint64)]))
            rows.append((len(a), len(b), S.odd_of(a).tolist(), S.odd_of(b).tolist(), bool(S.alike(a, b)), len(np.setxor1d(a, b))))
    frame = spark.createDataFrame(rows, "n long, m long, x array<long>, y array<long>, alike boolean, differ long")
    found = frame.withColumn("may", S._may_by_sketch("n", "m", "x", "y")).collect()
    assert all(r["may"] for r in found if r["alike"])
    assert not any(r["may"] for r in found if r["n"] <= 300 and r["differ"] > 0.3 * r["n"])
    bits = frame.select(sum((F.bit_count(F.get("x", F.lit(i)).bitwiseXOR(F.get("y", F.lit(i)))) for i in range(S.ODD)), F.lit(0)).alias("d"), "differ").collect()
    assert all(r["d"] <= r["differ"] for r in bits)
