import random

from pyspark.sql import functions as F

from corvia.plans import knowledge


def test_five_hundred_scopes_in_one_plan(spark):
    """The answers are those of each scope on its own."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"d{i}", f"name{i % 700}", f"api{i}", " ".join(rng.choices(words, k=12)), f"n{i % 320}", "v1", rng.choice(["en", "de", None]), i % 17 == 0, [rng.gauss(0, 1) for _ in range(4)]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id string, name string, api_id string, text string, namespace string, version string, language string, deprecated boolean, dense_embedding array<double>").cache()
    asked = [(q, rng.choice([" ".join(rng.choices(words, k=3)), f"name{q % 700}", f"api{q}"]), f"n{q % 320}", "v1", rng.choice(["en", None, ""])) for q in range(960)]
    asked += [(2000, "", "n1", "v1", None), (2001, "w1", "", "v1", None), (2002, "w1", "nowhere", "v1", None), (2003, None, "n1", "v1", None)]
    queries = spark.createDataFrame(asked, "query_id long, text string, namespace string, version string, language string").cache()
    assert queries.select("namespace", "version", F.when(F.col("language") != "", F.col("language"))).distinct().count() > 500
    answers, audit = knowledge.query_batch(docs, queries, 3)
    got: dict = {}
    for r in answers.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["route"], None if r["score"] is None else round(r["score"], 7)))
    for ns, lang in (("n1", "en"), ("n7", None), ("n33", "en"), ("n200", None)):
        own = queries.where((F.col("namespace") == ns) & F.col("language").eqNullSafe(F.lit(lang)) & (F.col("text") != ""))
        want: dict = {}
        for r in knowledge.query_documents(docs, own.select("query_id", "text"), ns, "v1", lang, 3).collect():
            want.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["route"], None if r["score"] is None else round(r["score"], 7)))
        for q in [r["query_id"] for r in own.collect()]:
            assert sorted(got.get(q, [])) == sorted(want.get(q, [])), q
    said = {r["query_id"]: (r["error"], r["documents"]) for r in audit.collect()}
    assert said[2000][0] == said[2003][0] == "EMPTY_QUERY" and said[2001][0] == "SCOPE_REQUIRED" and said[2002] == (None, 0) and len(said) == 964
    dense, _ = knowledge.query_batch(docs, queries.where("query_id < 20"), 3, lambda _: F.array(*[F.lit(x) for x in (0.3, -1.0, 0.2, 0.7)]))
    one = next(r for r in dense.where("route = 'semantic'").collect())
    scope = queries.where(F.col("query_id") == one["query_id"]).first()
    alone = knowledge.query_documents(docs, queries.where(F.col("query_id") == one["query_id"]).select("query_id", "text"), scope["namespace"], "v1", scope["language"], 3, lambda _: F.array(*[F.lit(x) for x in (0.3, -1.0, 0.2, 0.7)]))
    key = lambda df: sorted((r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert key(dense.where(F.col("query_id") == one["query_id"])) == key(alone)
