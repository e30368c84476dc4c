"""Topics: vectors, clusters, folding of small ones, keywords, labels, confidence."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from voxtally import constants as K
from voxtally.functions import vectors as V
from voxtally.functions.text import TOKEN, bind, tokens
from voxtally.operators import vector_index
from voxtally.sources.checkpoints import settle


# -- vectors and clusters -------------------------------------------------------

def _encoder_stages(text: str, features: int) -> tuple[list, list]:
    """What counts a text's words, and what weighs the counts."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=TOKEN, gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
    ], [
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
    ]


def fit_encoder(texts: DataFrame, text: str = "text", features: int = 1 << 18) -> PipelineModel:
    """Hashed TF-IDF scaled to length 1: text in, ``features`` vector out, which stays sparse:
    it has as many numbers as the text has different words."""
    count, weigh = _encoder_stages(text, features)
    return Pipeline(stages=count + weigh).fit(texts)


def fit_encode(
    texts: DataFrame, id_: str, text: str = "text", features: int = 1 << 18
) -> tuple[PipelineModel, DataFrame]:
    """``fit_encoder`` and the settled ``(id, features)`` of the texts it was fitted on, whose words
    are read once for both."""
    count, weigh = _encoder_stages(text, features)
    counted = PipelineModel(stages=count).transform(texts).select(id_, "_tf").persist()
    try:
        weights = Pipeline(stages=weigh).fit(counted)
        vectors = settle(weights.transform(counted).select(id_, "features"))
    finally:
        counted.unpersist()
    return PipelineModel(stages=count + weights.stages), vectors


def encode(encoder: PipelineModel, texts: DataFrame) -> DataFrame:
    return encoder.transform(texts).drop("_words", "_tf", "_tfidf")


def as_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """An array column as the ``features`` vector column of length 1."""
    return df.withColumn("features", array_to_vector(V.unit(V.doubles(F.col(vector)))))


def fit_clusters(
    vectors: DataFrame, n_topics: int = K.N_TOPICS, seed: int = 42, max_iter: int = 20
) -> KMeansModel:
    """At most ``n_topics`` clusters by cosine distance, of the vectors that have a length."""
    features = vectors.filter(_has_length()).select("features").persist()
    try:
        return KMeans(
            k=n_topics, seed=seed, maxIter=max_iter, distanceMeasure="cosine",
            featuresCol="features", predictionCol="cluster",
        ).fit(features)
    finally:
        features.unpersist()


def _has_length() -> Column:
    """Whether ``features`` is not all zeros, as that of a text without a word is: it has no cosine."""
    return F.exists(F.unwrap_udt("features")["values"], lambda x: x != 0)


def clustered(model: KMeansModel, vectors: DataFrame) -> DataFrame:
    """Adds ``cluster``, null for vectors without a length."""
    none = vectors.filter(~_has_length()).withColumn("cluster", F.lit(None).cast("int"))
    return model.transform(vectors.filter(_has_length())).unionByName(none)


def density(
    vectors: DataFrame, path: str, k: int = 5, compared: int = 300
) -> DataFrame:
    """``(id, density)`` of ``vectors`` (id, vec): the mean cosine to the ``k`` nearest other rows, found
    in a vector index written to ``path``, a new shared folder. A row compares itself with the rows of
    the lists nearest to it, as many as hold about ``compared`` rows, so work grows with the rows as
    long as the index has lists for them."""
    vector_index.write_index(vectors, path)
    asked = vectors.select(F.col("id").alias("query_id"), "vec")
    share = min(1.0, compared / max(1, vectors.count()))
    near = vector_index.search(vectors.sparkSession, path, asked, k + 1, share)
    order = Window.partitionBy("query_id").orderBy("rank")
    others = near.filter(F.col("query_id") != F.col("id")).withColumn("_nth", F.row_number().over(order))
    return settle(others.filter(F.col("_nth") <= k).groupBy(F.col("query_id").alias("id")).agg(
        F.round(F.avg("score"), 6).alias("density")
    ))


def sparse_rows(found: DataFrame, width: float = 3.0) -> DataFrame:
    """Adds ``sparse`` to ``density``'s rows: whether a row lies farther from its neighbours than the
    median by more than ``width`` times the median distance from it (at least 0.001)."""
    middle = found.agg(F.round(F.percentile("density", 0.5), 6).alias("m")).scalar()
    from_it = found.select(F.round(F.abs(F.col("density") - middle), 6).alias("d"))
    spread = F.greatest(from_it.agg(F.percentile("d", 0.5).alias("s")).scalar(), F.lit(0.001))
    return found.withColumn("sparse", F.round(middle - F.col("density"), 6) > F.round(width * spread, 6))


def fold_sparse(topics: DataFrame, sparse: DataFrame, id_: str = "id") -> DataFrame:
    """``topics`` (``id_``, topic_id, ...) with topic -1 for the rows that are ``sparse``."""
    marks = sparse.select(F.col("id").alias(id_), "sparse")
    topic = F.when(F.coalesce("sparse", F.lit(False)), -1).otherwise(F.col("topic_id"))
    return topics.join(marks, id_, "left").withColumn("topic_id", topic).drop("sparse")


def fold_small(
    assigned: DataFrame,
    cluster: str = "cluster",
    min_size: int = K.MIN_TOPIC_SIZE,
    n_topics: int = K.N_TOPICS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Adds ``topic_id``: clusters of at least ``min_size`` rows numbered from 0 by size,
    at most ``n_topics`` of them; all other rows, those without a cluster too, are -1. ``counted`` may give
    the same clusters in rows that are read sooner."""
    sizes = (assigned if counted is None else counted).filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.filter(F.col("n") >= min_size).orderBy(F.desc("n"), cluster).limit(n_topics)
    numbered = largest.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(cluster))))
        .alias("kept")
    ).select(F.posexplode("kept").alias("topic_id", "k")).select(
        F.col("k")[cluster].alias(cluster), "topic_id"
    )
    # n_topics rows at most, by the limit above.
    return assigned.join(F.broadcast(numbered), cluster, "left").withColumn(
        "topic_id", F.coalesce("topic_id", F.lit(K.NO_TOPIC))
    )


# -- keywords and labels --------------------------------------------------------

def term_scores(docs: DataFrame, topic: str = "topic_id", text: str = "text") -> DataFrame:
    """Class-based TF-IDF, tf·ln(1 + A/f): words in a topic, mean words per topic, and
    words overall. ``(topic, term, tf, score)``.

    The tokens are combined before the first shuffle; afterwards a term's rows number
    no more than the topics. They are settled, so that the mean does not count all words again.
    """
    counted = settle(
        docs.select(topic, F.explode(tokens(F.col(text))).alias("term"))
        .filter(F.length("term") >= 2)
        .groupBy(topic, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    mean_words = counted.groupBy(topic).agg(F.sum("tf").alias("w")).agg(F.avg("w"))
    overall = F.sum("tf").over(Window.partitionBy("term"))
    return counted.withColumn("f", overall).withColumn(
        "score", F.round(F.col("tf") * F.log(1 + mean_words.scalar() / F.col("f")), 6)
    ).drop("f")


def keywords(
    docs: DataFrame, topic: str = "topic_id", text: str = "text", n: int = K.TOPIC_KEYWORDS
) -> DataFrame:
    """The n best terms of each topic: ``(topic, rank, term, score)``."""
    best = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return (
        term_scores(docs, topic, text)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n)
        .select(topic, "rank", "term", "score")
    )


def keywords_by_similarity(
    docs: DataFrame,
    topic: str = "topic_id",
    text: str = "text",
    vector: str = "embedding",
    candidates: int = 30,
    n: int = K.TOPIC_KEYWORDS,
) -> DataFrame:
    """Keywords re-ranked by likeness to their topic: ``(topic, rank, term, similarity)``.

    A term's vector is the mean vector of the texts it occurs in, a topic's that of its own texts;
    texts without a vector count for the terms only, and terms without one are not ranked. The
    ``candidates`` best terms of each topic are ranked anew, which is what re-ranking means; with topics
    from ``fold_small`` the broadcast list has at most (n_topics + 1) × candidates rows.
    """
    listed = settle(keywords(docs, topic, text, candidates).select(topic, "term"))
    words = docs.filter(F.col(vector).isNotNull()).select(
        V.doubles(F.col(vector)).alias("v"),
        F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"),
    ).join(F.broadcast(listed.select("term").distinct()), "term")
    term_vectors = words.groupBy("term").agg(
        Summarizer.mean(array_to_vector("v")).alias("m")
    ).select("term", vector_to_array("m").alias("tv"))
    topic_vectors = centroids(docs, topic, vector)
    best = Window.partitionBy(topic).orderBy(F.desc("similarity"), "term")
    return (
        listed.join(term_vectors, "term")
        .join(topic_vectors, topic)
        .withColumn("similarity", F.round(V.cosine(F.col("tv"), F.col("centroid")), 4))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n)
        .select(topic, "rank", "term", "similarity")
    )


def labels(keywords: DataFrame, topic: str = "topic_id") -> DataFrame:
    """``(topic, topic_label, topic_keywords)``: the label is the first three keywords."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]
    )
    return keywords.groupBy(topic).agg(ordered.alias("topic_keywords")).select(
        topic,
        F.array_join(F.slice("topic_keywords", 1, K.TOPIC_LABEL_WORDS), " / ").alias("topic_label"),
        "topic_keywords",
    )


def describe(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Label and keywords for ``topic_id``; unknown ids are called ``Topic {id}`` and the
    outlier topic has no keywords. ``labels`` has a row per topic, n_topics + 1 at most."""
    return assigned.join(F.broadcast(labels), "topic_id", "left").withColumns({
        "topic_label": F.coalesce("topic_label", F.format_string("Topic %d", "topic_id")),
        "topic_keywords": F.when(
            F.col("topic_id") != K.NO_TOPIC, F.col("topic_keywords")
        ).otherwise(F.array().cast("array<string>")),
    }).withColumn(
        "topic_keywords", F.coalesce("topic_keywords", F.array().cast("array<string>"))
    )


# -- assignment -----------------------------------------------------------------

def centroids(df: DataFrame, topic: str = "topic_id", vector: str = "embedding") -> DataFrame:
    """Mean vector of each topic, outliers left out."""
    return (
        df.filter((F.col(topic) != K.NO_TOPIC) & F.col(vector).isNotNull())
        .groupBy(topic)
        .agg(Summarizer.mean(array_to_vector(V.doubles(F.col(vector)))).alias("m"))
        .select(topic, vector_to_array("m").alias("centroid"))
    )


def _with_similarities(df, centres, vector):
    """Adds ``_near``: (cosine, -topic) for every topic, in topic order. The centres are
    one small array (n_topics vectors), so there is no join."""
    listed = centres.select("topic_id", V.unit(F.col("centroid")).alias("c")).agg(
        F.array_sort(F.collect_list(F.struct("topic_id", "c")))
    )
    return (
        df.withColumn("_centres", listed.scalar())
        .withColumn("_near", bind(
            V.unit(V.doubles(F.col(vector))),
            lambda v: F.transform("_centres", lambda c: F.struct(
                V.dot(v, c["c"]).alias("cos"), (-c["topic_id"]).alias("minus")
            )),
        ))
        .drop("_centres")
    )


def predict(df: DataFrame, centres: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``topic_id``, the topic with the nearest centre."""
    return _with_similarities(df, centres, vector).withColumn(
        "topic_id", -F.array_max("_near")["minus"]
    ).drop("_near")


def confidence(df: DataFrame, centres: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``topic_confidence``: the softmax share of the row's own topic over the cosines
    to all topics, at most 1; 0 for outliers."""
    return _with_similarities(df, centres, vector).withColumn(
        "topic_confidence", _own_share(F.col("_near"), F.col("topic_id"))
    ).drop("_near")


def _similarities(vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds ``_near``: (cosine, -topic) for every topic to rows with ``features`` of length 1,
    sparse or dense. The centres are n_topics vectors in one value, so there is no join."""
    listed = topics.filter(F.col("topic_id") != K.NO_TOPIC).select(
        "topic_id", V.unit(vector_to_array("centroid")).alias("c")
    ).agg(F.array_sort(F.collect_list(F.struct("topic_id", "c"))))
    raw = F.unwrap_udt("features")
    places = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))

    def cosine(centre):
        return F.aggregate(
            F.arrays_zip(F.col("_at").alias("i"), F.col("_values").alias("x")), F.lit(0.0),
            lambda a, s: a + s["x"] * F.get(centre, s["i"]),
        )

    return (
        vectors.withColumns({"_at": places, "_values": raw["values"], "_centres": listed.scalar()})
        .withColumn("_near", F.transform("_centres", lambda c: F.struct(
            cosine(c["c"]).alias("cos"), (-c["topic_id"]).alias("minus")
        )))
        .drop("_at", "_values", "_centres")
    )


def _own_share(near: Column, topic: Column) -> Column:
    """Softmax share of a row's topic, at most 1; 0 for outliers."""
    own = F.aggregate(
        F.arrays_zip(
            F.transform(near, lambda s: s["minus"]).alias("minus"),
            V.softmax(F.transform(near, lambda s: s["cos"])).alias("p"),
        ),
        F.lit(0.0),
        lambda acc, s: F.when(s["minus"] == -topic, s["p"]).otherwise(acc),
    )
    return F.when(topic == K.NO_TOPIC, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), own), 4))


def enough_rows(df: DataFrame, least: int = K.MIN_ROWS_FOR_TOPICS) -> bool:
    return df.limit(least).count() >= least


class NoTopics(ValueError):
    """The vectors give no clusters: there are none, or none that differ."""


def fit(
    texts: DataFrame, vectors: DataFrame, id_: str = "response_id", n_topics: int = K.N_TOPICS
) -> tuple[DataFrame, DataFrame]:
    """``(members, topics)`` of texts whose ``features`` are given: ``(id, topic_id, features)``, and
    ``(topic_id, centroid, topic_label, topic_keywords)`` with a row per topic. Outliers have a
    label and no centroid."""
    if vectors.filter(_has_length()).isEmpty():
        raise NoTopics("no vector has a length")
    assigned = clustered(fit_clusters(vectors, n_topics), vectors)
    # Small rows: sizes and keywords read them, not the vectors, and no broadcast waits for these.
    own = settle(assigned.select(id_, "cluster"))
    members = fold_small(assigned, n_topics=n_topics, counted=own).select(id_, "topic_id", "features")
    centres = members.filter(F.col("topic_id") != K.NO_TOPIC).groupBy("topic_id").agg(
        Summarizer.mean(F.col("features")).alias("centroid")
    )
    named = labels(keywords(fold_small(own, n_topics=n_topics).select(id_, "topic_id").join(texts, id_)))
    # A row per topic, which several later steps read.
    return members, settle(named.join(centres, "topic_id", "left").select(
        "topic_id", "centroid", "topic_label", "topic_keywords"
    ))


def _described(near: DataFrame, topics: DataFrame, id_: str) -> DataFrame:
    share = _own_share(F.col("_near"), F.col("topic_id")).alias("topic_confidence")
    return describe(
        near.select(id_, "topic_id", share), topics.select("topic_id", "topic_label", "topic_keywords")
    )


def members_described(members: DataFrame, topics: DataFrame, id_: str = "response_id") -> DataFrame:
    """Topic table of the texts a model was fitted on:
    ``(id, topic_id, topic_label, topic_keywords, topic_confidence)``."""
    return _described(_similarities(members, topics), topics, id_)


def assign_new(vectors: DataFrame, topics: DataFrame, id_: str = "response_id") -> DataFrame:
    """The same table for other vectors: each goes to the topic with the nearest centre, the first
    of equal ones. Without any topic all are outliers."""
    near = _similarities(vectors, topics)
    nearest = F.coalesce(-F.array_max("_near")["minus"], F.lit(K.NO_TOPIC))
    return _described(near.withColumn("topic_id", nearest), topics, id_)


def assign(texts: DataFrame, vectors: DataFrame, id_: str = "response_id") -> DataFrame:
    """Topic table for texts whose ``features`` are given."""
    return members_described(*fit(texts, vectors, id_), id_)
