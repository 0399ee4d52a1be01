"""Retrieval that doesn't look at everything: cells of vectors, postings by blocks, ranks in a time window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab
from ..functions import text as X
from ..sources.io import durable
from .joins import drawn_share, vector_topk
from .nearest import nearest_in_cells

#: Rows that the cells' centres are fitted on, at most about so many, and the most cells there are.
FIT_ROWS, MOST_CELLS = 50_000, 4096
#: Rows of a cell, and documents of a block of postings, that meet queries in one task.
CELL_ROWS, BLOCK_DOCS = 50_000, 2048


@dataclass(frozen=True)
class Cells:
    """An index: centres (cell, centre, parts), and every row of the corpus with its cell and part."""

    centres: DataFrame
    rows: DataFrame


def build_cells(corpus: DataFrame, cells: int | None = None, seed: int = 42) -> Cells:
    """Each row of corpus (vec_id, embedding, ...) under the nearest of `cells` centres, about a root of their number.

    Centres are k-means of a seeded draw of FIT_ROWS rows or so; all rows are put into cells. A cell with many rows is kept in parts. Rows without
    a vector are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = corpus.filter(F.col("embedding").isNotNull()).withColumn("__v", array_to_vector(F.col("embedding").cast("array<double>")))
    n = rows.count()
    k = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    if not n:
        empty = rows.select(*corpus.columns, F.lit(0).alias("cell"), F.lit(0).cast("long").alias("part"))
        return Cells(empty.select("cell", F.col("embedding").cast("array<double>").alias("centre"), F.lit(1).cast("long").alias("parts")), empty)
    drawn = rows.filter(drawn_share(F.col("vec_id"), FIT_ROWS / n, seed)) if n > FIT_ROWS else rows
    model = KMeans(featuresCol="__v", predictionCol="cell", k=k, seed=seed, maxIter=10).fit(drawn)
    spark = corpus.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    placed = durable(model.transform(rows).drop("__v"))
    sizes = placed.groupBy("cell").agg((F.floor(F.count("*") / CELL_ROWS) + 1).alias("parts"))
    centres = centres.join(F.broadcast(sizes), "cell")  # cells without a row are no use
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
    return Cells(centres, placed)


def _distance(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def _nearest(pairs: DataFrame, k: int, within: list[str]) -> DataFrame:
    """The k nearest rows of each query, first of each query in `within`, so that no query's rows meet in one task."""
    order = ["distance", "vec_id"]
    local = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", *within).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def _cells_in_order(queries: DataFrame, index: Cells, columns: list[str]) -> DataFrame:
    """columns of queries with each cell, its parts, and its place in the order of nearness to q."""
    near = queries.join(F.broadcast(index.centres)).withColumn("far", _distance("q", "centre"))
    return near.select(*columns, "cell", "parts", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "cell")).alias("place"))


def probes_for(index: Cells, k: int, recall: float = 0.95, rows: int = 200, seed: int = 7) -> int:
    """So many of the nearest cells hold a share `recall` of the exact k nearest of a seeded draw of about `rows` rows of the index."""
    n = index.rows.count()
    drawn = index.rows.filter(drawn_share(F.col("vec_id"), rows / n, seed)) if n > rows else index.rows
    drawn = durable(drawn.select(F.col("vec_id").alias("query_id"), "embedding"))
    pairs = vector_topk(drawn, index.rows, k).select("query_id", "vec_id").join(index.rows.select("vec_id", "cell"), "vec_id")
    order = _cells_in_order(drawn.withColumnRenamed("embedding", "q"), index, ["query_id"])
    got = pairs.join(order, ["query_id", "cell"]).agg(F.percentile("place", F.lit(recall)).alias("p")).first()["p"]
    return max(1, math.ceil(got or 1))


def search_cells(queries: DataFrame, index: Cells, k: int, probes: int, where: Column | None = None, about: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by squared L2 among the rows of each query's `probes` nearest cells.

    where compares columns about of the rows and, as q_ and the name, of the queries; it holds before rows are ranked. A query that finds fewer
    than k rows so is answered from all rows, exactly. What is sent to all tasks is the centres, MOST_CELLS at most.
    """
    if where is None:
        met = nearest_in_cells(queries, index.centres, index.rows, k, probes).withColumn("distance", F.round("distance", 6))
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        found = durable(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    else:
        found = _found_where(queries, index, k, probes, where, about)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    rest = durable(queries.join(full, "query_id", "left_anti"))
    if rest.isEmpty():
        return found
    exact = vector_topk(rest, index.rows, k, where=where, about=about).select("query_id", "vec_id", "distance", "rank")
    return found.join(full, "query_id", "left_semi").select("query_id", "vec_id", "distance", "rank").unionByName(exact)


def _found_where(queries: DataFrame, index: Cells, k: int, probes: int, where: Column, about: tuple[str, ...]) -> DataFrame:
    """The k nearest rows of each query's cells that fit it, or fewer."""
    q = queries.select("query_id", F.col("embedding").alias("q"), *[F.col(c).alias(f"q_{c}") for c in about])
    near = _cells_in_order(q, index, q.columns).filter(F.col("place") <= probes)
    asked = near.select("query_id", "q", *[f"q_{c}" for c in about], "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = asked.join(index.rows.select("vec_id", F.col("embedding").alias("v"), "cell", "part", *about), ["cell", "part"])
    met = met.filter(where)
    return durable(_nearest(met.select("query_id", "vec_id", F.round(_distance("q", "v"), 6).alias("distance"), "cell", "part"), k, ["cell", "part"]).select("query_id", "vec_id", "distance", "rank"))


@dataclass(frozen=True)
class Postings:
    """An index of words: about (N, mean), and a row (t, block, doc_id, impact) for each word of a document."""

    rows: DataFrame
    df: DataFrame


def build_postings(corpus: DataFrame, k1: float = 1.5, b: float = 0.75) -> Postings:
    """Okapi impacts of the words of corpus (doc_id, text): what stands between white space, in lower case, of three characters and more, without stop words.

    Texts are parted into words once. Documents are dealt into blocks of about BLOCK_DOCS, so a word that each has is many small groups.
    """
    w = F.filter(X.words(F.lower("text")), lambda x: (F.length(x) > 2) & ~x.isin(*vocab.STOP_RETRIEVAL))
    d = corpus.select("doc_id", w.alias("w")).withColumn("len", F.size("w")).filter("len > 0")
    tf = durable(d.select("doc_id", "len", F.explode("w").alias("t")).groupBy("t", "doc_id", "len").agg(F.count("*").alias("tf")))
    own = tf.groupBy("doc_id").agg(F.first("len").alias("len"))
    about = own.agg(F.count("*").alias("N"), F.avg("len").alias("mean"))
    df = durable(tf.groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(about)).withColumn("idf", F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    block = F.pmod(F.xxhash64("doc_id"), F.floor(F.col("N") / BLOCK_DOCS) + 1)
    impact = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return Postings(tf.join(df, "t").select("t", block.alias("block"), "doc_id", impact.alias("impact")), df)


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, t) of queries (query_id, text)."""
    w = F.filter(X.words(F.lower("text")), lambda x: (F.length(x) > 2) & ~x.isin(*vocab.STOP_QUERY))
    return queries.select("query_id", F.explode(F.array_distinct(w)).alias("t"))


def search_postings(queries: DataFrame, index: Postings, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents for each query, the same as if all were scored.

    The k greatest impacts of each word give documents with a part of their score, and the k-th best of these is a floor: no document below it is
    among the k best. The greatest impacts of a query's words in a block are a ceiling for its documents. Only blocks whose ceiling
    reaches the floor are scored, each by its own rows, so a word in every document is no hot key.
    """
    q = durable(query_words(queries))
    post = durable(index.rows.join(q.select("t").distinct(), "t", "left_semi"))
    tops = post.withColumn("__r", F.row_number().over(Window.partitionBy("t", "block").orderBy(F.desc("impact")))).filter(F.col("__r") <= k)
    tops = tops.withColumn("__r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("impact"), "doc_id"))).filter(F.col("__r") <= k)
    part = q.join(tops.select("t", "doc_id", "impact"), "t").groupBy("query_id", "doc_id").agg(F.sum("impact").alias("s"))
    floor = part.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))).filter(F.col("__r") == k).select("query_id", F.col("s").alias("floor"))
    ceiling = q.join(post.groupBy("t", "block").agg(F.max("impact").alias("most")), "t").groupBy("query_id", "block").agg(F.sum("most").alias("ceiling"))
    # Scores are rounded to four digits, and of equals the smaller number is first.
    open_ = ceiling.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("ceiling") >= F.col("floor") - 0.001)).select("query_id", "block")
    hits = open_.join(q, "query_id").join(post, ["t", "block"]).groupBy("query_id", "block", "doc_id").agg(F.round(F.sum("impact"), 4).alias("score"))
    order = [F.desc("score"), "doc_id"]
    local = hits.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).filter(F.col("__r") <= k)
    return local.select("query_id", "doc_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank")).filter(F.col("rank") <= k)


def latest_in_window(articles: DataFrame, stories: DataFrame, n: int, cell: int = 60) -> DataFrame:
    """(doc_id, story_id, place): of each article's category the n latest stories first seen from seven days before to six hours after its publication.

    A category's stories are numbered in order of time, by cells of `cell` seconds, and each article finds the numbers where its window begins and ends
    among them; then it meets its last n numbers and no others. So nothing is paired before the cut, and no category's or day's rows meet in one task.
    Place 1 is the latest; of stories of one time that with the greater number comes first. Rows without a category or time have none.
    articles: doc_id, category, published_at; stories: story_id, category, first_seen.
    """
    us = F.unix_micros
    week, hours = 7 * 86_400_000_000, 6 * 3_600_000_000
    s = stories.select("category", us("first_seen").alias("t"), F.lit(0).alias("kind"), F.col("story_id").alias("id"))
    a = articles.select("category", us("published_at").alias("p"), F.col("doc_id").alias("id"))
    begin, end = a.select("category", (F.col("p") - week).alias("t"), F.lit(-1).alias("kind"), "id"), a.select("category", (F.col("p") + hours).alias("t"), F.lit(1).alias("kind"), "id")
    every = s.unionByName(begin).unionByName(end).filter("category is not null and t is not null").withColumn("cell", F.floor(F.col("t") / (cell * 1_000_000)))
    counts = every.groupBy("category", "cell").agg(F.count_if(F.col("kind") == 0).alias("c"))
    counts = counts.select("category", "cell", F.coalesce(F.sum("c").over(Window.partitionBy("category").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(Window.partitionBy("category", "cell").orderBy("t", "kind", "id").rowsBetween(Window.unboundedPreceding, 0))
    numbered = every.withColumn("own", running).join(counts, ["category", "cell"]).select("category", "kind", "id", (F.col("before") + F.col("own")).alias("i"))
    numbered = durable(numbered)
    span = numbered.filter("kind <> 0").groupBy("category", "id").agg(F.max(F.when(F.col("kind") == -1, F.col("i"))).alias("lo"), F.max(F.when(F.col("kind") == 1, F.col("i"))).alias("hi")).filter("hi > lo")
    wanted = span.select("category", F.col("id").alias("doc_id"), "hi", F.explode(F.sequence(F.greatest(F.col("lo"), F.col("hi") - n) + 1, F.col("hi"))).alias("i"))
    return wanted.join(numbered.filter("kind = 0").select("category", "i", F.col("id").alias("story_id")), ["category", "i"]).select("doc_id", "story_id", (F.col("hi") - F.col("i") + 1).cast("int").alias("place"))
