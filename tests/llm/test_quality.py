import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvia.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_statistics(spark, odd_docs):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b", " ", "  ", "\n", "\t", "c#", "é", "𝄞 ", " "], k=rng.randint(0, 80))) for _ in range(400)] + [None, "", "a a a", "a a a a", "x y z x y z", "a b c " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r[c] for c in Q.STATS) for r in Q.with_statistics(docs).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}
    for r in Q.with_statistics(odd_docs.select("doc_id", "text")).collect():
        assert tuple(r[c] for c in Q.STATS) == brute(r["text"])


def brute_mcd(x, steps=Q.STEPS):
    """Concentration steps on one group from both starts, with the operator's bins; rows that are rejected."""
    n, p = x.shape
    floor = (np.array(Q.FLOORS) * Q.STEP) ** 2

    def estimate(rows):
        m = rows.mean(axis=0)
        return m, (rows.T @ rows) / len(rows) - np.outer(m, m) + np.diag(floor)

    def d2(m, s):
        z = np.linalg.solve(np.linalg.cholesky(s), (x - m).T)
        return (z**2).sum(axis=0)

    bins = lambda d: np.maximum(np.floor(np.log2(np.maximum(d, 1e-6)) * 16), -160).astype(int)
    middle = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), np.sqrt(floor))
    best = None
    for m, s in ((middle, np.diag(spread**2)), estimate(x)):
        for _ in range(steps):
            b = bins(d2(m, s))
            order = np.sort(b)
            limit = next(v for v in np.unique(b) if 2 * (order <= v).sum() >= n)
            m, s = estimate(x[b <= limit])
        d = d2(m, s)
        b = bins(d)
        half = next(v for v in np.unique(b) if 2 * (b <= v).sum() >= n)
        scale = min(1.0, Q.CHI_MEDIAN / 2 ** ((half + 1) / 16))
        volume = np.log(np.diag(np.linalg.cholesky(s))).sum() - p / 2 * np.log(scale)
        if best is None or volume < best[0] - 1e-9:
            best = volume, d * scale
    return best[1]


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.multivariate_normal([180, 90, 5, 3], np.diag([900, 30, 4, 2]), 900), rng.normal(400, 5, size=(60, 4))]).round().astype(int)
    rows = spark.createDataFrame([("0en", "0s", *map(int, r)) for r in x], "_lang string, _source string, x0 long, x1 long, x2 long, x3 long")
    groups, few = Q.robust(rows, ["_lang", "_source"])
    found = Q.distance2(rows.join(groups, ["_lang", "_source"])).withColumn("d", F.col("d2") * F.col("scale")).select(*Q.VECTOR, "d").collect()
    want = Counter((*map(int, r), round(float(d), 4)) for r, d in zip(x, brute_mcd(x.astype(float)), strict=True))
    assert few and Counter((r["x0"], r["x1"], r["x2"], r["x3"], round(r["d"], 4)) for r in found) == want


def test_clean_stays_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = Q.query(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in found}
    assert kept[1] >= 0.98 and kept[0] <= 0.1


def test_odd_rows(odd_docs, no_docs):
    found = Q.judge(odd_docs.drop("n_words", "kept", "distance"))
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert Q.query(no_docs).count() == 0
