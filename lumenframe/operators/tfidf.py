"""TF-IDF weights of frames in long form (id, term, weight), search, likeness and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.runtime import materialize, stored
from lumenframe.functions.terms import frame_terms, terms

DIGITS = 12


def term_counts(frames: DataFrame) -> DataFrame:
    """``id, term, n, size``: occurrences of each term and number of terms of each frame, from title and text.

    Frames without any term don't come out. Rows of one id are one document.
    """
    tokens = frames.select("id", F.explode(frame_terms(F.col("window_title"), F.col("text"))).alias("term"))
    counts = tokens.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("size", F.sum("n").over(Window.partitionBy("id")))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weights(frames: DataFrame) -> DataFrame:
    """``id, term, weight``: share of the term in the frame times ln((N + 1) / (df + 1)) + 1; N counts all frames."""
    counts = term_counts(frames)
    total = frames.agg(F.count(F.lit(1)).alias("total"))
    frequency = document_frequency(counts).join(F.broadcast(total))  # one row
    frequency = frequency.select("term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return counts.join(frequency, "term").select("id", "term", (F.col("n") / F.col("size") * F.col("idf")).alias("weight"), "idf")


def _cosine(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Top k of ``vectors`` by cosine with ``query`` (term, q, position), whose terms are those of one text."""
    norms = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    shared = vectors.join(query, "term").groupBy("id").agg(
        F.sum(F.col("weight") * F.col("q")).alias("dot"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("shared_terms"),
    )
    size = query.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("query_norm"))
    scored = shared.where(F.col("dot") > 0).join(norms, "id").join(F.broadcast(size))  # one row
    similarity = F.round(F.col("dot") / (F.col("norm") * F.col("query_norm")), DIGITS)
    return scored.select("id", similarity.alias("similarity"), "shared_terms").orderBy(F.desc("similarity"), "id").limit(k)


def search(frames: DataFrame, query: str, k: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """``id, similarity, shared_terms`` of the frames likest to ``query``; unknown terms only lengthen the query."""
    vectors = stored(weights(frames)) if vectors is None else vectors  # read three times, computed once
    asked = frames.sparkSession.createDataFrame([(query,)], "query string").select(F.posexplode(terms(F.col("query"))).alias("position", "term"))
    asked = asked.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"))
    idf = vectors.join(F.broadcast(asked.select("term")), "term", "left_semi").groupBy("term").agg(F.first("idf").alias("idf"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # the terms of one query
    asked = asked.join(idf, "term", "left").select("term", (share * F.coalesce("idf", F.lit(1.0))).alias("q"), "position")
    return _cosine(vectors, asked, k)


def similar(frames: DataFrame, frame_id: int, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """Frames likest to one frame, itself left out; an unknown id gives no rows."""
    vectors = stored(weights(frames)) if vectors is None else vectors
    own = vectors.where(F.col("id") == frame_id).select("term", F.col("weight").alias("q"))
    own = own.withColumn("position", F.row_number().over(Window.partitionBy().orderBy("term")))  # the terms of one frame
    return _cosine(vectors.where(F.col("id") != frame_id), own, k)


def top_terms(vectors: DataFrame, n: int = 30) -> DataFrame:
    sums = vectors.groupBy("term").agg(F.round(F.sum("weight"), DIGITS).alias("score"))
    return sums.orderBy(F.desc("score"), "term").limit(n)


def coherence(vectors: DataFrame, members: DataFrame, sample: int = 20) -> DataFrame:
    """Mean cosine of all pairs among the first ``sample`` members by id; 1 for fewer than two. One row."""
    first = members.select("id").distinct().orderBy("id").limit(sample)
    own = vectors.join(F.broadcast(first), "id")  # at most ``sample`` rows
    own = own.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id"))))
    a = own.select("term", F.col("id").alias("i"), F.col("weight").alias("u"))
    b = own.select("term", F.col("id").alias("j"), F.col("weight").alias("v"))
    total = a.join(b, "term").where("i < j").agg(F.coalesce(F.sum(F.col("u") * F.col("v")), F.lit(0.0)).alias("dot"))
    n = first.agg(F.count(F.lit(1)).alias("n"))
    mean = F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.col("dot") / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1)))
    return total.join(n).select(F.round(mean, 2).alias("coherence"))


def discover_topics(frames: DataFrame, n_topics: int = 8) -> DataFrame:
    """Topics by peeling: the heaviest term of what remains takes all remaining frames that hold it.

    ``topic_id, label, keywords, frame_count, apps, time_range, coherence``. Clusters of one frame are left out but
    use up their number. At most ``n_topics`` passes over the checkpointed weights; per pass one term reaches the
    driver. Ties go to the first term in alphabetical order.
    """
    spark = frames.sparkSession
    vectors = materialize(weights(frames).drop("idf"))
    remaining, out = vectors, None
    for topic in range(n_topics):
        seed = top_terms(remaining, 1).head()
        if seed is None:
            break
        members = materialize(remaining.where(F.col("term") == seed[0]).select("id").distinct())
        count = members.count()
        mine = remaining.join(members, "id", "left_semi")
        remaining = materialize(remaining.join(members, "id", "left_anti"))
        if count < 2:
            continue
        words = [row[0] for row in top_terms(mine, 8).collect()]
        about = frames.join(members, "id", "left_semi").agg(
            F.slice(F.array_sort(F.collect_set(F.coalesce("app_name", F.lit("")))), 1, 5).alias("apps"),
            F.struct(F.min("timestamp").alias("min"), F.max("timestamp").alias("max")).alias("time_range"),
        )
        row = about.join(coherence(mine, members)).select(
            F.lit(topic).alias("topic_id"),
            F.lit(" / ".join(words[:3])).alias("label"),
            F.array(*map(F.lit, words)).alias("keywords"),
            F.lit(count).cast("long").alias("frame_count"),
            "apps",
            "time_range",
            "coherence",
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        return spark.createDataFrame([], "topic_id int, label string, keywords array<string>, frame_count long, apps array<string>, time_range struct<min:double,max:double>, coherence double")
    return out
