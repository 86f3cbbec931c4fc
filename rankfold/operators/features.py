"""Item content features: tokens, TF-IDF, class-collapsed cosine (C-1..C-4, B-9).

Tokenisation follows the usual word-vectoriser defaults: lower case, tokens
are maximal runs of >= 2 word characters (letters, digits, underscore).
The same pattern is used by the SQL oracle, so both sides agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS
from rankfold.functions.exprs import popularity_bucket

I = "item_id"
MAX_LITERALS = 1000  # tokens of a vocabulary that a filter names

# fixed value: token pattern (runs of two or more Unicode word characters)
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokenize(text_col) -> "F.Column":
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def item_features(items: DataFrame, categories: DataFrame | None, pop: DataFrame,
                  high: int | None = None, medium: int | None = None) -> DataFrame:
    """B-9 / C-3: (item_id, text) = 'cat_<category>' (if any) + popularity bucket."""
    high = DEFAULTS.bucket_high if high is None else high
    medium = DEFAULTS.bucket_medium if medium is None else medium
    it = items.select(I).distinct().join(pop.select(I, "popularity"), I, "left")
    if categories is not None:
        it = it.join(categories.select(I, "category"), I, "left")
    else:
        it = it.withColumn("category", F.lit(None).cast("string"))
    cat_tok = F.when(F.col("category").isNotNull() & (F.col("category") != ""),
                     F.concat(F.lit("cat_"), F.col("category")))
    bucket = popularity_bucket(F.coalesce(F.col("popularity"), F.lit(0)), high, medium)
    return it.select(I, F.concat_ws(" ", cat_tok, bucket).alias("text"))


def term_stats(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(doc, token, tf) long table — explode once, aggregate with map-side combine."""
    t = docs.select(F.col(id_col).alias("doc"), F.explode(tokenize(text_col)).alias("token"))
    return t.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, max_features: int | None = None) -> DataFrame:
    """C-1: all tokens; with ``max_features``, those of highest corpus frequency (ties: token)."""
    max_features = DEFAULTS.tfidf_max_features if max_features is None else max_features
    v = tf.groupBy("token").agg(F.sum("tf").alias("total_tf"), F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        v = v.orderBy(F.desc("total_tf"), F.asc("token")).limit(max_features)
    return v


def tfidf(docs: DataFrame, id_col: str, text_col: str = "text",
          max_features: int | None = None) -> DataFrame:
    """C-2: smooth idf = ln((1+n)/(1+df)) + 1, tf*idf, each document L2-normalised.

    Output (doc, token, tf, value); documents without any kept token have no rows
    (a zero vector). The planner broadcasts the vocabulary only while it is small.

    With at most ``MAX_LITERALS`` features, the tokens are found first, by counts
    alone; then a document sends the words it has of them, once, to the
    task that counts them and takes the norm. Rows that repeat an id are one document.
    """
    max_features = DEFAULTS.tfidf_max_features if max_features is None else max_features
    n_docs = docs.agg(F.count(F.lit(1)).alias("_n"))
    if max_features is not None and max_features <= MAX_LITERALS:
        words = docs.select(F.explode(tokenize(text_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("total_tf"))
        named = [r["token"] for r in words.orderBy(F.desc("total_tf"), F.asc("token")).limit(max_features).collect()]
        kept = F.filter(tokenize(text_col), lambda t: t.isin(named))
        dealt = docs.select(F.col(id_col).alias("doc"), kept.alias("_kept")).where(F.size("_kept") > 0).repartition("doc")
        tf = dealt.select("doc", F.explode("_kept").alias("token")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"))
        voc = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(n_docs)  # one-row side
    else:
        tf = term_stats(docs, id_col, text_col)
        voc = vocabulary(tf, max_features).crossJoin(n_docs)  # one-row side
    voc = voc.select("token", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(voc, "token").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc")))
    return w.select("doc", "token", "tf", (F.col("x") / norm).alias("value"))


def item_classes(tfidf_long: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse items with identical TF-IDF vectors into classes.

    Returns (item_class: item_id, cls) and (class_vec: cls, token, value). A
    class key is the item's sorted tokens, each as often as the text has it:
    equal keys are equal vectors.
    """
    words = F.transform(F.array_sort(F.collect_list(F.struct("token", F.col("tf").cast("int").alias("tf")))),
                        lambda t: F.array_repeat(t["token"], t["tf"]))
    vec = tfidf_long.groupBy(F.col("doc").alias(I)).agg(F.array_join(F.flatten(words), " ").alias("cls"))
    item_class = items.select(I).distinct().join(vec, I, "left").fillna({"cls": ""})
    class_vec = (tfidf_long.join(vec, tfidf_long.doc == vec[I]).select("cls", "token", "value")
                 .dropDuplicates(["cls", "token"]))
    return item_class, class_vec


def similarity_of(pairs: DataFrame, class_vec: DataFrame) -> DataFrame:
    """C-4 for the asked pairs alone: (cls_a, cls_b, sim), no row where it is 0."""
    a = class_vec.select(F.col("cls").alias("cls_a"), "token", F.col("value").alias("va"))
    b = class_vec.select(F.col("cls").alias("cls_b"), "token", F.col("value").alias("vb"))
    both = pairs.select("cls_a", "cls_b").distinct().join(a, "cls_a").join(b, ["cls_b", "token"])
    return both.groupBy("cls_a", "cls_b").agg(F.sum(F.col("va") * F.col("vb")).alias("sim"))


def class_similarity(class_vec: DataFrame) -> DataFrame:
    """C-4: cosine between all classes that share a token, by a join on tokens; a
    pair that is not there has cosine 0. The table grows with the square of a
    token's classes: it is the report; lists and explanations do not use it."""
    a = class_vec.select(F.col("cls").alias("cls_a"), "token", F.col("value").alias("va"))
    b = class_vec.select(F.col("cls").alias("cls_b"), "token", F.col("value").alias("vb"))
    return a.join(b, "token").groupBy("cls_a", "cls_b").agg(F.sum(F.col("va") * F.col("vb")).alias("sim"))
