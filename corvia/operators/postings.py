"""An inverted index for sparse search: postings in blocks of documents, with the largest weight of each token in a block.

Documents are dealt into blocks along their number of tokens, since inner products grow with it: blocks of long documents have high
bounds and those of short ones low bounds, so that few blocks can hold a query's best. The postings are clustered by
token; a search reads bounds only, takes the blocks of the highest bounds first, and then those whose bound reaches the
k-th score that it has by then. No block that could enter is left out, so the result is that of scoring everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvia.functions.text import token_id, tokens
from corvia.operators import retrieval
from corvia.operators.ranking import top_per
from corvia.sources.log import create_once, read_text
from corvia.tables import durable

#: Documents in a block, and blocks that a query reads first.
BLOCK, FIRST = 256, 4
#: What sums of the same products may differ by, as a share.
SLACK = 1e-9
#: Query tokens up to which the scan of the index is told their ids.
FEW_IDS = 2000


def blocks_of(docs: DataFrame, id_col: str, length: str, size: int = BLOCK) -> DataFrame:
    """(id, block) of all documents: blocks of about so many, in order of their length.

    Rows are sorted into ranges over many tasks; a task numbers its own, and no two tasks share a block.
    """
    order = [F.desc(length), F.col(id_col)]
    placed = docs.select(id_col, length).repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # task in the upper bits, place in its range in the lower 33
    return placed.select(id_col, F.floor(number / size).cast("long").alias("block"))


class Postings:
    """The index of one corpus, below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, docs: DataFrame, df: DataFrame, n_docs: int, id_col: str = "doc_id", text_col: str = "text") -> Postings:
        """Write the index of documents with the frequencies (token, df) of a corpus of n_docs, once."""
        lengths = docs.groupBy(id_col).agg(F.sum(F.size(tokens(F.col(text_col)))).alias("length")).where("length > 0")
        placed = durable(blocks_of(lengths, id_col, "length")).withColumnRenamed(id_col, "_id")
        # The block goes with the text: texts are far smaller than their tokens, and are shuffled in their place.
        own = docs.select(id_col, F.col(text_col).alias("_own")).join(placed, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
        vectors = retrieval.sparse_vectors(own, id_col, F.col("_own"), df, n_docs, ["block"])
        vectors = durable(vectors.sortWithinPartitions("token_id", "block"))  # neighbours alike take half the room
        # Ranges come first, so that postings are put together where they are written.
        dealt = vectors.repartitionByRange("token_id", "block")
        packed = dealt.groupBy("token_id", "block").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col("weight").alias("w"))).alias("postings"), F.max("weight").alias("most"))
        packed.sortWithinPartitions("token_id", "block").write.parquet(f"{self.folder}/postings")
        df.write.parquet(f"{self.folder}/frequencies")
        create_once(self.spark, f"{self.folder}/built", str(n_docs))
        return self

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        """(query_id, token_id, q): the queries' sparse vectors with the index's frequencies."""
        n = int(read_text(self.spark, f"{self.folder}/built"))
        asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("tf"))
        weighed = asked.join(self.spark.read.parquet(f"{self.folder}/frequencies"), "token")
        weighed = weighed.withColumn("q", F.col("tf") * F.log1p(F.lit(float(max(n, 1))) / F.col("df")))
        return weighed.groupBy("query_id", token_id(F.col("token")).alias("token_id")).agg(F.max("q").alias("q"))

    def _scores(self, wanted: DataFrame, vectors: DataFrame, ids: list[int] | None) -> DataFrame:
        """(query_id, id, score) of all documents in wanted (query_id, block): postings are read for wanted pairs of block and
        token only, and summed up before anything is shuffled a second time."""
        lists = self._lists() if ids is None else self._lists().where(F.col("token_id").isin(ids))
        asked = wanted.join(vectors, "query_id")
        read = lists.select("token_id", "block", "postings").join(asked, ["token_id", "block"])
        return read.select("query_id", "q", F.explode("postings").alias("p")).groupBy("query_id", F.col("p.id").alias("id")).agg(F.sum(F.col("q") * F.col("p.w")).alias("score"))

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, score, rank), the k best documents of each query (query_id, text); and (query_id, blocks, read):
        how many blocks hold one of its tokens, and how many were read."""
        vectors = durable(self.query_vectors(queries))
        asked = vectors.select("token_id").distinct().limit(FEW_IDS + 1).collect()
        ids = [r["token_id"] for r in asked] if len(asked) <= FEW_IDS else None
        maxima = self._lists().select("token_id", "block", "most")
        maxima = maxima if ids is None else maxima.where(F.col("token_id").isin(ids))
        bounds = maxima.join(vectors, "token_id").groupBy("query_id", "block").agg(F.sum(F.col("q") * F.col("most")).alias("bound"))
        bounds = durable(bounds)
        lead = bounds.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).where(F.col("_r") <= first)
        lead = durable(lead.select("query_id", "block"))
        some = durable(top_per(self._scores(lead, vectors, ids), ["query_id"], k, [F.desc(F.round("score", 9)), F.col("id")]))
        # The k-th score so far; a query that has fewer must read all.
        kth = some.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        reach = F.col("bound") * (1 + SLACK) >= F.coalesce(F.col("kth"), F.lit(0.0)) * (1 - SLACK)
        rest = bounds.join(kth, "query_id", "left").where(reach).select("query_id", "block").join(lead, ["query_id", "block"], "left_anti")
        rest = durable(rest)
        more = self._scores(rest, vectors, ids).where("score > 0")
        both = some.select("query_id", "id", "score").unionByName(more)
        found = top_per(both, ["query_id"], k, [F.desc(F.round("score", 9)), F.col("id")])
        read = lead.union(rest).groupBy("query_id").agg(F.count(F.lit(1)).alias("read"))
        return found, bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(read, "query_id")
