"""Explanations (X-*) for a DataFrame of (user_id, item_id) pairs.

Every explainer is a join of the pairs with model tables and a per-pair
aggregate; unknown users / items become error rows (X-7), never exceptions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.functions.exprs import clip01, round4
from rankfold.operators.ease import Weights
from rankfold.operators.features import similarity_of
from rankfold.session import materialize

U, I = "user_id", "item_id"

# fixed values: error texts of the explanation output
ERR_COLD = "User not found in training data (cold-start user)"
ERR_USER = "User not found in training data"
ERR_ITEM = "Product not found in training data"
ERR_ACTIVE = "Product is outside the EASE active item set"
ERR_NO_OVERLAP = ("None of the user's history items overlap with the EASE active item set. "
                  "Recommendation may use popularity fallback.")

# fixed values: explanation texts of the content explainer
TXT_CONTENT = "This item is similar to {} product(s) you've previously viewed"
TXT_SAME_CATEGORY = ", and shares the same product category."
TXT_PROPERTIES = " based on shared properties."


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(U, I).distinct()


def _error(pairs, known_users, known_items, user_msg=ERR_COLD):
    p = (_pairs(pairs)
         .join(known_users.select(U).distinct().withColumn("_ku", F.lit(True)), U, "left")
         .join(known_items.select(I).distinct().withColumn("_ki", F.lit(True)), I, "left"))
    return p.withColumn("error", F.when(F.col("_ku").isNull(), F.lit(user_msg))
                        .when(F.col("_ki").isNull(), F.lit(ERR_ITEM))).drop("_ku", "_ki")


def _ordered(*cols) -> Column:
    """The evidence rows of a pair (at most top_k) as structs, in the order of ``pos``."""
    rows = F.sort_array(F.collect_list(F.struct("pos", F.struct(*cols).alias("e"))))
    return F.transform(rows, lambda x: x["e"])


def ease_contributions(pairs: DataFrame, train: DataFrame, B: Weights, top_k: int = 5) -> DataFrame:
    """X-1 evidence: the user's history items ranked by |B(h, target)| (top_k)."""
    h = train.select(U, F.col(I).alias("src"))
    j = B.at(_pairs(pairs).join(h, U).withColumnRenamed(I, "dst")).withColumnRenamed("dst", I)
    w = Window.partitionBy(U, I).orderBy(F.desc(F.abs("weight")), F.asc("src"))
    return j.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top_k)


def explain_ease(pairs: DataFrame, train: DataFrame, B: Weights, catalog: DataFrame,
                 top_k: int = 5, categories: DataFrame | None = None) -> DataFrame:
    """X-1: history items checked, contribution = sum of the top_k raw B
    (user weights not applied), confidence = clip(total, 0, 1), and the top_k
    contributing history items themselves."""
    pairs = materialize(_pairs(pairs))  # read by every part below
    base = _error(pairs, train, catalog)
    active = B.items.select(I).withColumn("_act", F.lit(True))
    act_src = B.items.select(F.col(I).alias("src"))
    checked = (train.select(U, F.col(I).alias("src")).join(act_src, "src", "left_semi")
                    .groupBy(U).agg(F.count(F.lit(1)).alias("history_items_checked")))
    ev = ease_contributions(pairs, train, B, top_k)
    cats = F.lit(None).cast("string")
    if categories is not None:
        ev, cats = ev.join(categories.select(F.col(I).alias("src"), "category"), "src", "left"), F.col("category")
    ev = ev.groupBy(U, I).agg(
        F.sum("weight").alias("_tot"), F.count(F.lit(1)).alias("n_supporting"),
        _ordered(F.col("src").alias("item_id"), F.round("weight", 6).alias("ease_weight"), cats.alias("category")).alias("_items"))
    r = base.join(active, I, "left").join(checked, U, "left").join(ev, [U, I], "left")
    err = (F.when(F.col("error").isNotNull(), F.col("error"))
            .when(F.col("_act").isNull(), F.lit(ERR_ACTIVE))
            .when(F.coalesce("history_items_checked", F.lit(0)) == 0, F.lit(ERR_NO_OVERLAP)))
    tot = F.coalesce("_tot", F.lit(0.0))
    ok = err.isNull()
    return r.select(U, I, F.lit("ease_cooccurrence").alias("method"), err.alias("error"),
                    F.when(ok, F.col("history_items_checked")).cast("bigint").alias("history_items_checked"),
                    F.when(ok, F.round(tot, 6)).alias("ease_score_contribution"),
                    F.when(ok, round4(F.when(tot > 0, clip01(tot)).otherwise(F.lit(0.0)))).alias("confidence"),
                    F.when(ok, F.col("n_supporting")).cast("bigint").alias("n_supporting"),
                    F.when(ok, F.col("_items")).alias("top_contributing_history_items"))


def explain_neighbors(pairs: DataFrame, user_factors: DataFrame, train: DataFrame,
                      n_neighbors: int = 5, n_items: int = 5) -> DataFrame:
    """X-2: top-n users by factor dot product (self excluded); share of them that
    interacted with the item; up to 5 supporting items (first 5 items of each such
    neighbour, target excluded, sorted)."""
    from rankfold.operators.factors import top_k_dot
    pairs = materialize(_pairs(pairs))  # read by every part below
    users = pairs.select(U).distinct()
    model_users = user_factors.join(train.select(F.col(U).alias("id")).distinct(), "id", "left_semi")
    model_users = materialize(model_users.select("id", "factor"))
    uf = model_users.join(users.withColumnRenamed(U, "id"), "id", "left_semi")
    self_mask = uf.select(F.col("id").alias(U), F.col("id").alias(I))
    nb = top_k_dot(uf, model_users, n_neighbors, seen=self_mask).select(U, F.col(I).alias("nb"))
    t = train.select(F.col(U).alias("nb"), F.col(I).alias("nb_item"))
    pn = _pairs(pairs).join(nb, U)
    has = pn.join(t.withColumnRenamed("nb_item", I).withColumn("_has", F.lit(True)), ["nb", I], "left")
    cnt = has.groupBy(U, I).agg(F.count_if(F.col("_has").isNotNull()).alias("similar_user_count"))
    w5 = Window.partitionBy("nb").orderBy("nb_item")
    first5 = t.withColumn("_r", F.row_number().over(w5)).where(F.col("_r") <= n_items).drop("_r")
    sup = (has.where(F.col("_has").isNotNull()).select(U, I, "nb").join(first5, "nb")
              .where(F.col("nb_item") != F.col(I)).select(U, I, "nb_item").distinct())
    ws = Window.partitionBy(U, I).orderBy("nb_item")
    sup = (sup.withColumn("_r", F.row_number().over(ws)).where(F.col("_r") <= n_items)
              .groupBy(U, I).agg(F.array_join(F.sort_array(F.collect_list("nb_item")), ",").alias("supporting_items")))
    base = _error(pairs, train, train)
    r = base.join(cnt, [U, I], "left").join(sup, [U, I], "left")
    ok = F.col("error").isNull()
    c = F.coalesce("similar_user_count", F.lit(0))
    return r.select(U, I, F.lit("collaborative_neighbors").alias("method"), "error",
                    F.when(ok, c).cast("bigint").alias("similar_user_count"),
                    F.when(ok, F.round(c / F.lit(float(n_neighbors)), 3)).alias("confidence"),
                    F.when(ok, F.coalesce("supporting_items", F.lit(""))).alias("supporting_items"))


def content_evidence(pairs: DataFrame, train: DataFrame, item_class: DataFrame, class_vec: DataFrame) -> DataFrame:
    """X-3 evidence rows: the history items by similarity to the target (``pos``)."""
    h = train.select(U, F.col(I).alias("seen"))
    ic = item_class.select(I, "cls")
    j = (_pairs(pairs).join(h, U)
         .join(ic.withColumnRenamed(I, "seen").withColumnRenamed("cls", "cls_a"), "seen")
         .join(ic.withColumnRenamed("cls", "cls_b"), I))
    j = j.join(similarity_of(j, class_vec), ["cls_a", "cls_b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    w = Window.partitionBy(U, I).orderBy(F.desc(F.round("sim", 9)), F.asc("seen"))
    return j.withColumn("pos", F.row_number().over(w))


def explain_content(pairs: DataFrame, train: DataFrame, item_class: DataFrame, class_vec: DataFrame,
                    categories: DataFrame, top_k: int = 3) -> DataFrame:
    """X-3: category match, mean similarity to the whole history, and the top_k
    most similar history items."""
    ev = content_evidence(pairs, train, item_class, class_vec)
    agg = ev.groupBy(U, I).agg(F.avg("sim").alias("_avg"), F.count_if(F.col("pos") <= top_k).alias("n_similar"))
    cats = categories.select(I, "category")
    items = (ev.where(F.col("pos") <= top_k).join(cats.withColumnRenamed(I, "seen"), "seen", "left").groupBy(U, I).agg(
        _ordered(F.col("seen").alias("item_id"), round4("sim").alias("similarity"), "category").alias("_items")))
    agg = agg.join(items, [U, I], "left")
    ucats = (train.select(U, I).join(cats, I).select(U, "category").distinct()
                  .withColumn("_m", F.lit(True)))
    base = _error(pairs, train, item_class, ERR_USER)
    r = (base.join(agg, [U, I], "left").join(cats.withColumnRenamed("category", "product_category"), I, "left")
             .join(ucats.withColumnRenamed("category", "product_category"), [U, "product_category"], "left"))
    ok = F.col("error").isNull()
    match = F.col("product_category").isNotNull() & F.col("_m").isNotNull()
    return r.select(U, I, F.lit("content_similarity").alias("method"), "error",
                    F.when(ok, F.col("product_category")).alias("product_category"),
                    F.when(ok, match).alias("category_match"),
                    F.when(ok, round4(F.coalesce("_avg", F.lit(0.0)))).alias("average_similarity_to_history"),
                    F.when(ok, F.col("n_similar")).cast("bigint").alias("n_similar"),
                    F.when(ok, F.col("_items")).alias("most_similar_seen_items"),
                    F.when(ok, F.concat(F.lit(TXT_CONTENT.format(top_k)), F.when(match, F.lit(TXT_SAME_CATEGORY)).otherwise(
                        F.lit(TXT_PROPERTIES)))).alias("explanation_text"))


def dimension_items(item_factors: DataFrame, n: int = 3) -> DataFrame:
    """(dim, representative item ids) — the n items with the largest factor per dimension."""
    e = item_factors.select(F.col("id").alias(I), F.posexplode("factor").alias("dim", "x"))
    w = Window.partitionBy("dim").orderBy(F.desc("x"), F.asc(I))
    top = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy("dim").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", I))),
                                                           lambda s: s[I]), ",").alias("representative_items"))


def shap_values(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """X-4 evidence: shap_j = u_j * i_j; dimensions by |shap| (``pos``; ties: dim)."""
    uf = user_factors.select(F.col("id").alias(U), F.col("factor").alias("_u"))
    vf = item_factors.select(F.col("id").alias(I), F.col("factor").alias("_v"))
    j = _pairs(pairs).join(uf, U).join(vf, I)
    s = j.select(U, I, F.posexplode(F.zip_with("_u", "_v", lambda a, b: a * b)).alias("dim", "shap"))
    w = Window.partitionBy(U, I).orderBy(F.desc(F.abs("shap")), F.asc("dim"))
    return s.withColumn("pos", F.row_number().over(w))


def explain_shap(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame, top_k: int = 5) -> DataFrame:
    """X-4: total score (= sum of shap), top dimension, and the top_k dimensions
    with their direction and representative items."""
    s = shap_values(pairs, user_factors, item_factors)
    way = F.when(F.col("shap") >= 0, F.lit("positive")).otherwise(F.lit("negative"))
    dims = s.where(F.col("pos") <= top_k).join(dimension_items(item_factors), "dim", "left").groupBy(U, I).agg(
        _ordered(F.col("dim").alias("dimension"), F.round("shap", 6).alias("shap_value"), way.alias("direction"),
                 "representative_items").alias("_dims"))
    agg = s.groupBy(U, I).agg(F.sum("shap").alias("_tot"), F.count(F.lit(1)).alias("n_components"),
                              F.max_by("dim", F.when(F.col("pos") == 1, F.lit(1)).otherwise(F.lit(0))).alias("top_dimension"))
    base = _error(pairs, user_factors.withColumnRenamed("id", U), item_factors.withColumnRenamed("id", I))
    r = base.join(agg, [U, I], "left").join(dims, [U, I], "left")
    ok = F.col("error").isNull()
    return r.select(U, I, F.lit("shap_latent").alias("method"), "error",
                    F.when(ok, F.round("_tot", 6)).alias("total_score"),
                    F.when(ok, F.col("n_components")).cast("bigint").alias("n_components"),
                    F.when(ok, F.col("top_dimension")).cast("int").alias("top_dimension"),
                    F.when(ok, F.col("_dims")).alias("top_dimensions"))


def lime_matrices(dim: int, n_samples: int = 50, sigma: float = 0.1, bandwidth: float = 0.5,
                  alpha: float = 0.01, seed: int = 42):
    """Constant d x d matrices of the closed-form weighted-ridge LIME.

    The perturbations are seeded noise around the item vector; the weighted
    centring removes the item vector, so coef = M u with M = (A + alpha I)^-1 A,
    A = Nc^T W Nc, and R^2 = 1 - z^T A z / u^T A u with z = u - M u.
    """
    rng = np.random.default_rng(seed=seed)
    noise = rng.normal(0, sigma, (n_samples, dim))
    w = np.exp(-(np.linalg.norm(noise, axis=1) ** 2) / bandwidth)
    mean = (w[:, None] * noise).sum(0) / w.sum()
    nc = noise - mean
    A = nc.T @ (w[:, None] * nc)
    M = np.linalg.solve(A + alpha * np.eye(dim), A)
    return M, A


def explain_lime(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame, dim: int,
                 n_samples: int = 50, top_k: int = 5) -> DataFrame:
    """X-5: LIME coefficients and local fidelity, closed form (no per-pair fitting)."""
    M, A = lime_matrices(dim, n_samples)
    Ml = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in M])   # d x d constant
    Al = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in A])

    def matvec(mat, v):
        return F.transform(mat, lambda row: F.aggregate(F.zip_with(row, v, lambda a, b: a * b), F.lit(0.0),
                                                        lambda s, x: s + x))

    def quad(mat, v):
        mv = matvec(mat, v)
        return F.aggregate(F.zip_with(mv, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    uf = user_factors.select(F.col("id").alias(U), F.col("factor").alias("_u"))
    base = _error(pairs, user_factors.withColumnRenamed("id", U), item_factors.withColumnRenamed("id", I))
    j = base.join(uf, U, "left")
    coef = matvec(Ml, F.col("_u"))
    z = F.zip_with(F.col("_u"), F.col("_coef"), lambda a, b: a - b)
    j = j.withColumn("_coef", coef).withColumn("_r2", F.lit(1.0) - quad(Al, z) / quad(Al, F.col("_u")))
    top = F.slice(F.array_sort(F.transform(F.col("_coef"), lambda c, i: F.struct((-F.abs(c)).alias("k"), i.alias("dim"), c.alias("coef")))),
                  1, top_k)
    ok = F.col("error").isNull()
    return j.select(U, I, F.lit("lime_latent").alias("method"), "error",
                    F.when(ok, F.lit(n_samples)).alias("n_samples"),
                    F.when(ok, round4("_r2")).alias("local_fidelity"),
                    F.when(ok, F.transform(top, lambda s: s["dim"])).alias("top_dimensions"),
                    F.when(ok, F.transform(top, lambda s: F.round(s["coef"], 6))).alias("importances"))


def explain_all(pairs: DataFrame, bundle, top_k: int = 5) -> DataFrame:
    """X-6: all explainers joined on (user, item) into one row per pair."""
    cols = [U, I]
    out = _pairs(pairs)
    if bundle.B is not None:
        e = explain_ease(pairs, bundle.train, bundle.B, bundle.items, top_k, bundle.categories)
        out = out.join(e.select(*cols, F.struct(*[c for c in e.columns if c not in cols]).alias("ease")), cols, "left")
    if bundle.class_vec is not None:
        c = explain_content(pairs, bundle.train, bundle.item_class, bundle.class_vec, bundle.categories)
        out = out.join(c.select(*cols, F.struct(*[x for x in c.columns if x not in cols]).alias("content")), cols, "left")
    if bundle.user_factors is not None and bundle.item_factors is not None:
        s = explain_shap(pairs, bundle.user_factors, bundle.item_factors, top_k)
        out = out.join(s.select(*cols, F.struct(*[x for x in s.columns if x not in cols]).alias("shap")), cols, "left")
        dim = bundle.item_factors.select(F.size("factor").alias("d")).first()["d"]
        lm = explain_lime(pairs, bundle.user_factors, bundle.item_factors, dim, top_k=top_k)
        out = out.join(lm.select(*cols, F.struct(*[x for x in lm.columns if x not in cols]).alias("lime")), cols, "left")
    return out


def explain(pairs: DataFrame, bundle, method: str = "auto", top_k: int = 5) -> DataFrame:
    """X-6 dispatcher; unknown methods raise instead of silently falling back."""
    if method == "auto":
        method = "shap" if bundle.user_factors is not None else "collaborative"
    if method == "collaborative":
        if bundle.B is not None:
            return explain_ease(pairs, bundle.train, bundle.B, bundle.items, top_k, bundle.categories)
        return explain_neighbors(pairs, bundle.user_factors, bundle.train)
    if method == "content_based":
        return explain_content(pairs, bundle.train, bundle.item_class, bundle.class_vec, bundle.categories)
    if method == "shap":
        return explain_shap(pairs, bundle.user_factors, bundle.item_factors, top_k)
    if method == "lime":
        dim = bundle.item_factors.select(F.size("factor").alias("d")).first()["d"]
        return explain_lime(pairs, bundle.user_factors, bundle.item_factors, dim, top_k=top_k)
    if method == "all":
        return explain_all(pairs, bundle, top_k)
    raise ValueError(f"unknown explanation method {method!r}")
