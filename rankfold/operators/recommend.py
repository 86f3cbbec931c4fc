"""Bulk recommendation operators (R-*): every user of a DataFrame at once.

Output of every recommender: (user_id, rank, item_id, score[, source]) with a
1-based rank and a deterministic order (score desc, item_id asc).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS
from rankfold.functions.exprs import BUCKET_TOKENS, clip01
from rankfold.operators.ease import Weights
from rankfold.operators.ranking import global_rank
from rankfold.operators.split import top_k
from rankfold.session import materialize, ship_package

U, I = "user_id", "item_id"
HEAD = 100_000          # rows of a ranked list's head that are broadcast
CLASS_CELLS = 1 << 20   # classes x (tokens + classes) that one row holds

# fixed values: reason strings of the recommendation output
REASON_COLLAB = "Users with similar behavior also interacted with this item"
REASON_CONTENT = "Similar item features to products you've viewed"
REASON_HYBRID = "Recommended based on your browsing patterns and similar item features"
REASON_POPULAR = "Trending item"


def _popular_ranked(pop: DataFrame, categories: DataFrame | None, category):
    """Popularity table with fallback score and a global rank (pop desc, item asc)."""
    mx = pop.agg(F.max("popularity").alias("_mx"))  # global max, even when filtered
    p = pop
    if category is not None:
        p = p.join(categories.where(F.col("category") == F.lit(str(category))).select(I), I, "left_semi")
    p = p.crossJoin(F.broadcast(mx))  # one-row side
    p = p.withColumn("score", F.least(F.lit(1.0), F.log1p("popularity") / F.log1p("_mx"))).drop("_mx")
    return p


def recommend_popular(users: DataFrame, pop: DataFrame, n: int, seen: DataFrame | None = None,
                      categories: DataFrame | None = None, category=None) -> DataFrame:
    """R-7 (+ optional J-4 mask): popularity list per user.

    Without ``seen`` every user gets the same global top-n: that list has at
    most ``n <= max_recommendations`` rows, so broadcasting it is bounded.
    With ``seen`` the j-th unseen item of a user is the item of global rank
    r_j = j + #{seen items i : s_i - i < j} (s_i = ascending global ranks of
    the user's seen items). Only the user's history is joined, never the catalog, and
    of both only the head of the list that the longest history can reach.
    """
    p = _popular_ranked(pop, categories, category)
    users = users.select(U).distinct()
    if seen is None:
        # the global top-n list has <= n rows: a bounded broadcast
        top = top_k(p.withColumn("_g", F.lit(1)), n, F.desc("popularity"), partition="_g").drop("_g")
        return users.crossJoin(F.broadcast(top)).select(U, "rank", I, "score")
    ranked = global_rank(p, [F.desc("popularity"), F.asc(I)], "rank")
    mine = seen.select(U, I)
    # no list reaches further than n entries past as many as a user has seen
    reach = n + (mine.groupBy(U).count().join(users, U, "left_semi").agg(F.max("count")).first()[0] or 0)
    head = ranked.where(F.col("rank") <= reach)
    if reach <= HEAD:  # ``reach`` rows are broadcast; users are looked up for the rows in the head alone
        head = F.broadcast(materialize(head))
        seen_r = mine.join(head.select(I, "rank"), I).select(U, "rank").join(users, U, "left_semi")
    else:
        seen_r = mine.join(users, U, "left_semi").join(head.select(I, "rank"), I).select(U, "rank")
    want = users.withColumn("_want", F.lit(n))
    slots = first_unseen(want, seen_r, [U], n)
    out = slots.join(head.select(F.col("rank").alias("_pos"), I, "score"), "_pos")
    return out.select(U, F.col("slot").cast("int").alias("rank"), I, "score")


def first_unseen(want: DataFrame, seen_ranks: DataFrame, keys, n: int) -> DataFrame:
    """Positions of the first ``_want`` (<= n) unseen entries of a ranked list.

    ``want``: keys + ``_want``; ``seen_ranks``: keys + ``rank`` (1-based
    positions of already-seen entries). With s_1 < s_2 < ... the seen
    positions and g_i = s_i - i, the j-th unseen position is
    j + #{i : g_i < j}. Only g < n matters, so the per-key state is a map of
    at most n entries — the list itself is never expanded per key.
    Returns keys + ``slot`` (j) + ``_pos`` (position in the ranked list).
    """
    from rankfold.operators.ranking import rank_within
    keys = list(keys)
    # i = position of the seen entry among the key's seen entries (no per-key window)
    seen_i = rank_within(seen_ranks, keys, [F.asc("rank")], "_i")
    gaps = (seen_i.withColumn("_g", F.col("rank") - F.col("_i"))
                      .where(F.col("_g") < n)
                      .groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_c"))
                      .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_g", "_c"))).alias("_m")))
    slots = want.join(gaps, keys, "left").select(
        *keys, F.explode(F.sequence(F.lit(1), F.least(F.col("_want"), F.lit(n)))).alias("slot"), "_m")
    before = F.aggregate(F.sequence(F.lit(0), F.col("slot") - 1), F.lit(0).cast("long"),
                         lambda a, g: a + F.coalesce(F.element_at(F.col("_m"), g.cast("long")),
                                                     F.lit(0).cast("long")))
    pos = F.col("slot") + F.when(F.col("_m").isNull(), F.lit(0)).otherwise(before)
    return slots.select(*keys, "slot", pos.cast("long").alias("_pos"))


def output_projection(recs: DataFrame, reason: str | None = None,
                      categories: DataFrame | None = None) -> DataFrame:
    """B-14: product_id, product_name, score (6 dp), reason, category, price."""
    r = recs
    if categories is not None:
        r = r.join(categories.select(I, "category"), I, "left")
    else:
        r = r.withColumn("category", F.lit(None).cast("string"))
    rs = F.lit(reason) if reason is not None else F.col("reason")
    return r.select(U, "rank", F.col(I).alias("product_id"),
                    F.format_string("Product %s", F.col(I)).alias("product_name"),
                    F.round("score", 6).alias("score"), rs.alias("reason"),
                    "category", F.lit(None).cast("double").alias("price"))


def normalise_scores(recs: DataFrame, raw: str = "raw") -> DataFrame:
    """B-13: raw / max(raw) per user; max <= 0 -> 0.5; clip to [0, 1]."""
    mx = F.max(raw).over(Window.partitionBy(U))
    return recs.withColumn("score", clip01(F.when(mx > 0, F.col(raw) / mx).otherwise(F.lit(0.5))))


def cold_users(users: DataFrame, inter: DataFrame) -> DataFrame:
    """R-8: users without any training interaction."""
    return users.select(U).distinct().join(inter.select(U), U, "left_anti")


def warm_users(users: DataFrame, inter: DataFrame) -> DataFrame:
    return users.select(U).distinct().join(inter.select(U), U, "left_semi")


DEFAULT_N = DEFAULTS.default_recommendations


# ---------------------------------------------------------------- R-1..R-3

def recommend_scored(users: DataFrame, scores: DataFrame, seen: DataFrame | None, n: int,
                     categories: DataFrame | None = None, category=None) -> DataFrame:
    """R-3 core: raw scores -> mask seen (J-4) -> category (B-10) -> top-n (W-4)
    -> normalise by the user's best score (B-13). ``seen`` is None where the scores
    are of these users and without what they have seen already (``score_ease_topk``)."""
    s = scores
    if seen is not None:
        s = s.join(users.select(U).distinct(), U, "left_semi").join(seen.select(U, I), [U, I], "left_anti")
    if category is not None:
        s = s.join(categories.where(F.col("category") == F.lit(str(category))).select(I), I, "left_semi")
    top = top_k(s, n, F.desc("raw"))
    return normalise_scores(top).select(U, F.col("rank").cast("int").alias("rank"), I, "score")


def recommend_collaborative(users: DataFrame, train: DataFrame, pop: DataFrame, n: int,
                            B: Weights | None = None, user_factors: DataFrame | None = None,
                            item_factors: DataFrame | None = None, categories: DataFrame | None = None,
                            category=None) -> DataFrame:
    """R-1/R-2/R-3/R-8: EASE scores when B is given, else factor dot products;
    users without training history get the popularity list."""
    from rankfold.operators import ease, factors as FX
    users = users.select(U).distinct()
    warm = materialize(warm_users(users, train))
    if B is None and (user_factors is None or item_factors is None):
        raise ValueError("collaborative recommendations need EASE weights or latent factors")
    if B is not None:
        # column blocks of B with the seen and category masks inside, and a per-block top-n
        allowed = None if category is None else categories.where(F.col("category") == F.lit(str(category)))
        raw = ease.score_ease_topk(train.join(warm, U, "left_semi"), B, n, allowed)
        recs = recommend_scored(warm, raw, None, n)
    else:
        items = item_factors
        if category is not None:
            items = items.join(categories.where(F.col("category") == F.lit(str(category)))
                               .select(F.col(I).alias("id")), "id", "left_semi")
        uf = user_factors.join(warm.withColumnRenamed(U, "id"), "id", "left_semi")
        top = FX.top_k_dot(uf, items, n, seen=train.join(warm, U, "left_semi"))
        recs = normalise_scores(top).select(U, F.col("rank").cast("int").alias("rank"), I, "score")
    if B is not None:
        recs = recs.unionByName(_idle_lists(warm, train, B, n, categories, category))
    cold = recommend_popular(cold_users(users, train), pop, n, categories=categories, category=category)
    return recs.withColumn("source", F.lit("collaborative")).unionByName(
        cold.withColumn("source", F.lit("popular")))


def _idle_lists(warm: DataFrame, train: DataFrame, B: Weights, n: int, categories, category) -> DataFrame:
    """R-3 for known users without any active item: every active item scores 0,
    so the list is the first n by item_id, each with the B-13 value 0.5."""
    act = B.items.select(I)
    idle = warm.join(train.select(U, I).join(act, I, "left_semi"), U, "left_anti")
    if category is not None:
        act = act.join(categories.where(F.col("category") == F.lit(str(category))).select(I), I, "left_semi")
    top = top_k(act.withColumn("_g", F.lit(1)), n, F.asc(I), partition="_g")  # n rows: a bounded broadcast
    return idle.crossJoin(F.broadcast(top.select(F.col("rank").cast("int").alias("rank"), I))).select(
        U, "rank", I, F.lit(0.5).alias("score"))


# ---------------------------------------------------------------- R-4

def _scores_of(weights: np.ndarray, sizes: np.ndarray, names: list, n: int):
    """Users as rows (user_id, _nh, _c, _n, _seen: classes, items of the history in them, items that are taken): the
    classes with a score above 0 that fewer than ``n`` available items beat."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lists = [part.column(c) for c in ("_c", "_n", "_seen")]
                row = np.repeat(np.arange(part.num_rows), np.diff(lists[0].offsets.to_numpy()))
                cls, have, gone = (x.flatten().to_numpy() for x in lists)
                q, left = np.zeros((part.num_rows, len(weights))), np.repeat(sizes[None, :].astype(np.float64), part.num_rows, axis=0)
                q[row, cls], left[row, cls] = have, left[row, cls] - gone
                raw = (q @ weights) @ weights.T / part.column("_nh").to_numpy()[:, None]
                order = np.argsort(-raw, axis=1, kind="stable")
                s = np.take_along_axis(raw, order, axis=1)
                before = np.cumsum(np.take_along_axis(left, order, axis=1), axis=1)
                for r in range(part.num_rows):
                    # classes that beat another one by more than the rounding to 9 decimals
                    enough = np.searchsorted(before[r], n)
                    s[r, enough + 1:][s[r, enough + 1:] < (s[r, enough] if enough < s.shape[1] else 0.0) - 2e-9] = 0.0
                at, pos = np.nonzero((s > 0) & (np.take_along_axis(left, order, axis=1) > 0))
                yield pa.RecordBatch.from_arrays([part.column(U).take(pa.array(at)), names.take(pa.array(order[at, pos])), pa.array(s[at, pos])],
                                                 names=[U, "cls", "raw"])
    return run


def small_classes(class_vec: DataFrame, sizes: DataFrame) -> tuple | None:
    """(classes, vectors, sizes) where all of them fit into ``CLASS_CELLS`` numbers, else None."""
    kinds = class_vec.select("cls").union(sizes.select("cls")).distinct()
    n_cls, n_tok = kinds.count(), class_vec.select("token").distinct().count()
    if not n_cls or not n_tok or n_cls * (n_tok + n_cls) > CLASS_CELLS:
        return None
    names = sorted(r["cls"] for r in kinds.collect() if r["cls"] is not None)  # at most CLASS_CELLS numbers, here and below
    tokens = sorted(r["token"] for r in class_vec.select("token").distinct().collect() if r["token"] is not None)
    at, col = {c: k for k, c in enumerate(names)}, {t: k for k, t in enumerate(tokens)}
    weights, size = np.zeros((len(names), len(tokens))), np.zeros(len(names))
    for r in class_vec.collect():
        if r["cls"] is not None and r["token"] is not None:
            weights[at[r["cls"]], col[r["token"]]] += r["value"]
    for r in sizes.collect():
        if r["cls"] is not None:
            size[at[r["cls"]]] = r["_size"]
    return names, weights, size


def best_of_small(uc: DataFrame, seen_c: DataFrame, n_hist: DataFrame, small: tuple, n: int) -> DataFrame:
    """``best_classes`` where the class table is small: a user is one row of class counts, scored against all classes at once."""
    names, weights, size = small
    spark = uc.sparkSession
    ship_package(spark)
    number = F.broadcast(spark.createDataFrame([*zip(names, range(len(names)), strict=True)], "cls string, _c int"))  # the class table
    rows = uc.join(seen_c, [U, "cls"], "left").join(number, "cls").groupBy(U).agg(
        F.collect_list(F.struct("_c", F.col("_cnt").cast("double").alias("_n"), F.coalesce("_seen", F.lit(0)).cast("double").alias("_seen"))).alias("_r"))
    rows = rows.join(n_hist, U).select(U, F.col("_nh").cast("double").alias("_nh"), *[F.col(f"_r.{c}").alias(c) for c in ("_c", "_n", "_seen")])
    found = rows.mapInArrow(_scores_of(weights, size, pa.array(names, pa.string()), n), f"{U} string, cls string, raw double")
    return materialize(found.withColumn("_s9", F.round("raw", 9)))


def best_classes(q: DataFrame, n_hist: DataFrame, class_vec: DataFrame, sizes: DataFrame, seen: DataFrame, n: int,
                 depth: int = 64, exclusive=BUCKET_TOKENS) -> DataFrame:
    """(user_id, cls, raw, _s9): for each user, classes that hold the best ``n``
    available items by q . v / |history| (score above 0), and maybe others below.

    ``q`` (user_id, token, q): the sum of the vectors of a user's history; a class's
    mean cosine is one product with it, so no table of class pairs is made.
    Posting lists of the tokens are read in the order of their impact, the
    first ``depth`` entries each; the classes found are scored in full. What
    is further down any list scores at most the sum of q times the next impacts
    (of ``exclusive`` tokens, one of which an item has, the greatest). Users with n
    available items above that bound are done; so are, where one list alone goes on,
    those with n items above it or tied with it and before the next entry's
    first item, as ties go by item. The others read four times as deep.
    """
    q = materialize(q)
    pending, found = q, []
    postings = class_vec.join(sizes, "cls").select("token", "cls", "value", "_first")
    order = Window.partitionBy("token").orderBy(F.desc(F.round("value", 9)), F.asc("_first"))
    while True:
        # at most depth + 1 entries a token pass the limit of each partition
        lists = materialize(postings.withColumn("_pos", F.row_number().over(order)).where(F.col("_pos") <= depth + 1))
        on = lists.where(F.col("_pos") == depth + 1).select("token", F.col("value").alias("_next"), F.col("_first").alias("_after"))
        cand = pending.join(lists.where(F.col("_pos") <= depth).select("token", "cls"), "token").select(U, "cls").distinct()
        raw = cand.join(class_vec.select("cls", "token", "value"), "cls").join(q, [U, "token"]).groupBy(U, "cls").agg(
            F.sum(F.col("q") * F.col("value")).alias("_s"))
        scored = raw.join(n_hist, U).select(U, "cls", (F.col("_s") / F.col("_nh")).alias("raw")).withColumn("_s9", F.round("raw", 9))
        if on.isEmpty():  # every list was read to its end
            found.append(scored)
            break
        scored = materialize(scored)
        impact = F.col("q") * F.col("_next")
        alone = F.col("token").isin(*exclusive)
        bound = pending.join(on, "token").groupBy(U).agg(
            (F.coalesce(F.sum(F.when(~alone, impact)), F.lit(0.0)) + F.coalesce(F.max(F.when(alone, impact)), F.lit(0.0))).alias("_t"),
            F.count(F.lit(1)).alias("_open"), F.max("_after").alias("_after"))
        bound = bound.join(n_hist, U).select(U, F.round(F.col("_t") / F.col("_nh") + 1e-12, 9).alias("_t9"), "_open", "_after")
        left = scored.join(sizes, "cls").join(seen.groupBy(U, "cls").agg(F.count(F.lit(1)).alias("_seen"), F.min(I).alias("_least")), [U, "cls"], "left")
        over = F.when(F.col("_s9") > F.col("_t9"), F.col("_size") - F.coalesce("_seen", F.lit(0)))
        # of a tied class, its first item counts if it is free and before the next entry's
        tied = F.when((F.col("_s9") == F.col("_t9")) & (F.col("_open") == 1) & (F.col("_first") < F.col("_after"))
                      & F.coalesce(F.col("_least") > F.col("_first"), F.lit(True)), 1)
        enough = left.join(bound, U).groupBy(U).agg(F.sum(F.coalesce(over, tied, F.lit(0))).alias("_have")).where(F.col("_have") >= n)
        more = materialize(bound.select(U).join(enough, U, "left_anti"))
        found.append(scored.join(more, U, "left_anti"))
        if more.isEmpty():
            break
        pending, depth = pending.join(more, U, "left_semi"), 4 * depth
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def recommend_content(users: DataFrame, train: DataFrame, pop: DataFrame, item_class: DataFrame,
                      class_vec: DataFrame, n: int, categories: DataFrame | None = None,
                      category=None, depth: int | None = None) -> DataFrame:
    """R-4: mean cosine of each unseen item to the user's history, top-n.

    Items with the same TF-IDF vector share a class, so a user's score for an
    item is a class score: of all classes at once where their table is small
    (``best_of_small``, unless a ``depth`` is given), else by ``best_classes``. Inside a class all items tie, so
    the list takes each class's first unseen items by item_id: among the first
    n + (the user's items in the class). Only classes that can still reach the top-n
    (fewer than n available items in strictly better classes) are expanded.
    Classes that share no token with the user's history score 0 and tie: users
    with fewer than n items above 0 get the first others by item_id. A user
    for whom nothing is left gets the popularity list.
    Scores are ranked on 9 decimals so float noise cannot split exact ties.
    """
    users = users.select(U).distinct()
    ic = item_class
    if category is not None:
        ic = ic.join(categories.where(F.col("category") == F.lit(str(category))).select(I), I, "left_semi")
    warm = warm_users(users, train)
    h = materialize(train.select(U, I).join(warm, U, "left_semi").join(item_class, I))
    n_hist = h.groupBy(U).agg(F.count(F.lit(1)).alias("_nh"))
    uc = materialize(h.groupBy(U, "cls").agg(F.count(F.lit(1)).alias("_cnt")))
    q = uc.join(class_vec, "cls").groupBy(U, "token").agg(F.sum(F.col("_cnt") * F.col("value")).alias("q"))
    # catalog-sized and read several times below: ranked once and materialised
    ranked = global_rank(ic.select(I, "cls"), [F.asc("cls"), F.asc(I)], "_gr")
    starts = ranked.groupBy("cls").agg(F.min("_gr").alias("_st"), F.count(F.lit(1)).alias("_size"), F.min(I).alias("_first"))
    starts = materialize(starts)
    sizes = starts.select("cls", "_size", "_first")
    seen = h.select(U, I, "cls").join(ic.select(I), I, "left_semi") if category is not None else h.select(U, I, "cls")
    seen_c = uc.withColumnRenamed("_cnt", "_seen") if category is None else materialize(seen.groupBy(U, "cls").agg(F.count(F.lit(1)).alias("_seen")))
    small = small_classes(class_vec, sizes) if depth is None else None
    cs = best_of_small(uc, seen_c, n_hist, small, n) if small else best_classes(q, n_hist, class_vec, sizes, seen, n, depth or 64)
    cand = (cs.join(sizes, "cls").join(seen_c, [U, "cls"], "left").fillna({"_seen": 0})
              .withColumn("_avail", F.col("_size") - F.col("_seen")))
    w_incl = Window.partitionBy(U).orderBy(F.desc("_s9")).rangeBetween(Window.unboundedPreceding, 0)
    w_tie = Window.partitionBy(U, "_s9")
    better = F.sum("_avail").over(w_incl) - F.sum("_avail").over(w_tie)
    kept = cand.withColumn("_better", better).where((F.col("_better") < n) & (F.col("_avail") > 0) & (F.col("_s9") > 0))
    last = F.col("_st") - 1 + F.least(F.col("_size"), F.col("_seen") + n)
    slots = kept.join(starts.select("cls", "_st"), "cls").select(U, "raw", "_s9", F.explode(F.sequence("_st", last)).alias("_gr"))
    # a list reaches n entries past as many of a class as a user has seen of it
    reach = n + (seen_c.agg(F.max("_seen")).first()[0] or 0)
    heads, mine = ranked, seen.select(U, I)
    if reach * starts.count() <= HEAD:
        heads = ranked.join(F.broadcast(starts.select("cls", "_st")), "cls").where(F.col("_gr") < F.col("_st") + reach).select("_gr", I)
        heads = F.broadcast(materialize(heads))
        mine = mine.join(heads.select(I).distinct(), I, "left_semi")
    items = slots.join(heads.select("_gr", I), "_gr").join(mine, [U, I], "left_anti")
    top = materialize(top_k(items, n, F.desc("_s9")).select(U, F.col("rank").cast("int").alias("rank"), I, clip01("raw").alias("score")))
    # score 0: the first items by item_id that are neither seen nor in the list; a
    # short user's list and history are all that is excluded
    count = top.groupBy(U).agg(F.count(F.lit(1)).alias("_have"))
    short = warm.join(count, U, "left").fillna({"_have": 0}).where(F.col("_have") < n)
    short = materialize(short.join(h.select(U).distinct(), U, "left_semi"))  # a history without any catalog item scores nothing
    recs = top
    if not short.isEmpty():
        order = global_rank(ic.select(I).distinct(), [F.asc(I)], "rank")
        taken = h.select(U, I).union(top.select(U, I)).join(short.select(U), U, "left_semi").distinct()
        fill = first_unseen(short.select(U, F.lit(n).alias("_want")), taken.join(order, I).select(U, "rank"), [U], n)
        fill = fill.join(order.select(F.col("rank").alias("_pos"), I), "_pos").join(short, U)
        fill = fill.select(U, (F.col("slot") + F.col("_have")).cast("int").alias("rank"), I, F.lit(0.0).alias("score")).where(F.col("rank") <= n)
        recs = materialize(top.unionByName(fill))
    rest = users.join(recs.select(U), U, "left_anti")  # cold users, and those whose candidates are exhausted
    cold = recommend_popular(rest, pop, n, categories=categories, category=category)
    return recs.withColumn("source", F.lit("content")).unionByName(cold.withColumn("source", F.lit("popular")))


# ---------------------------------------------------------------- R-6

def blend(collab: DataFrame, content: DataFrame, n: int, wa: float | None = None,
          wb: float | None = None) -> DataFrame:
    """R-6: weighted sum of the two (already normalised, 6 dp) scores, missing = 0.

    Ties keep the collaborative list first (in its rank order), then the
    content-only items in content rank order.
    """
    wa = DEFAULTS.hybrid_collab_weight if wa is None else wa
    wb = DEFAULTS.hybrid_content_weight if wb is None else wb
    a = collab.select(U, I, F.round("score", 6).alias("_sa"), F.col("rank").alias("_ra"))
    b = content.select(U, I, F.round("score", 6).alias("_sb"), F.col("rank").alias("_rb"))
    j = a.join(b, [U, I], "full_outer")
    j = j.withColumn("score", clip01(F.lit(wa) * F.coalesce("_sa", F.lit(0.0))
                                     + F.lit(wb) * F.coalesce("_sb", F.lit(0.0))))
    j = j.withColumn("_src", F.when(F.col("_ra").isNotNull(), F.lit(0)).otherwise(F.lit(1)))
    j = j.withColumn("_lr", F.coalesce("_ra", "_rb"))
    top = top_k(j, n, [F.desc("score"), F.asc("_src"), F.asc("_lr")], ties=())
    return top.select(U, F.col("rank").cast("int").alias("rank"), I, "score")


def recommend_hybrid(users: DataFrame, bundle, n: int, category=None) -> DataFrame:
    """R-6 over-fetching 3n from each side."""
    k = 3 * n
    a = recommend_collaborative(users, bundle.train, bundle.pop, k, bundle.B, bundle.user_factors,
                                bundle.item_factors, bundle.categories, category)
    b = recommend_content(users, bundle.train, bundle.pop, bundle.item_class, bundle.class_vec, k,
                          bundle.categories, category)
    return blend(a, b, n, bundle.collab_weight, bundle.content_weight)


def recommend(users: DataFrame, bundle, n: int | None = None, kind: str = "collaborative",
              category=None) -> DataFrame:
    """R-9 / R-10: bulk dispatcher; output is the B-14 projection per user."""
    n = DEFAULTS.default_recommendations if n is None else n
    if not 1 <= n <= DEFAULTS.max_recommendations:
        raise ValueError(f"n must be in [1, {DEFAULTS.max_recommendations}]")
    if kind == "collaborative":
        r = recommend_collaborative(users, bundle.train, bundle.pop, n, bundle.B, bundle.user_factors,
                                    bundle.item_factors, bundle.categories, category)
        reason = F.when(F.col("source") == "popular", F.lit(REASON_POPULAR)).otherwise(F.lit(REASON_COLLAB))
    elif kind == "content_based":
        if bundle.class_vec is None:
            return recommend(users, bundle, n, "collaborative", category)
        r = recommend_content(users, bundle.train, bundle.pop, bundle.item_class, bundle.class_vec, n,
                              bundle.categories, category)
        reason = F.when(F.col("source") == "popular", F.lit(REASON_POPULAR)).otherwise(F.lit(REASON_CONTENT))
    elif kind == "hybrid":
        r = recommend_hybrid(users, bundle, n, category).withColumn("source", F.lit("hybrid"))
        reason = F.lit(REASON_HYBRID)
    else:
        raise ValueError(f"unknown recommendation type {kind!r}")
    return output_projection(r.withColumn("reason", reason), None, bundle.categories)
