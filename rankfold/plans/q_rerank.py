"""Registered re-ranking queries (M-1..M-3) over the EASE lists of table E."""

from __future__ import annotations


from rankfold.operators import rerank as M
from rankfold.plans import sqlfrag as Q
from rankfold.plans.q_eval import _EASE_ALL, ease_recs_all
from rankfold.plans.registry import query
from rankfold.sources import testtables as TT

E = "E"

_MMR = """v AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
lists AS (SELECT r.user_id, list(r.item_id ORDER BY r.rank) AS ids, list(ROUND(r.score, 6) ORDER BY r.rank) AS sc,
                 list(v.f ORDER BY r.rank) AS vs, COUNT(*) AS n, COUNT(v.f) AS nf
          FROM erecs r LEFT JOIN v ON v.id = r.item_id GROUP BY r.user_id),
mmr(user_id, step, sel, ms, ids, sc, vs, n) AS (
  SELECT user_id, 1, [list_position(sc, list_max(sc))],
         list_transform(vs, lambda x: list_inner_product(x, vs[list_position(sc, list_max(sc))])), ids, sc, vs, n
  FROM lists WHERE n > 1 AND nf = n
  UNION ALL
  SELECT user_id, step + 1, list_append(sel, best),
         list_transform(ms, lambda m, i: GREATEST(m, list_inner_product(vs[i], vs[best]))), ids, sc, vs, n
  FROM (SELECT *, list_position(cand, list_max(cand)) AS best FROM (
          SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(sel, i) THEN -1e308
                   ELSE 0.7::DOUBLE * sc[i] - (1 - 0.7::DOUBLE) * ms[i] END) AS cand
          FROM mmr WHERE step < n))),
mfinal AS (SELECT user_id, sel, ids, sc FROM mmr WHERE step = n
           UNION ALL SELECT user_id, range(1, n + 1), ids, sc FROM lists WHERE NOT (n > 1 AND nf = n)),
mout AS (SELECT user_id, unnest(sel) AS idx, generate_subscripts(sel, 1) AS rank, ids, sc FROM mfinal)"""


@query("m1_mmr_rerank_e", Q.with_prep(E, *_EASE_ALL, _MMR, body="""
SELECT user_id, CAST(rank AS INTEGER) AS rank, ids[idx] AS item_id, sc[idx] AS score FROM mout""", recursive=True))
def m1_mmr_rerank_e(spark, sf_dir):
    """M-1: MMR (lambda 0.7) with embeddings as item factors."""
    _, recs = ease_recs_all(spark, sf_dir)
    return M.rerank_mmr(recs, TT.factors(spark, sf_dir))


@query("m2_popularity_penalty_e", Q.with_prep(E, *_EASE_ALL, body="""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ns DESC, rank) AS INTEGER) AS rank, item_id, ns AS score
FROM (SELECT r.user_id, r.rank, r.item_id,
             ROUND(LEAST(1.0, GREATEST(0.0, r.score * (1 - 0.5 * ln(1 + COALESCE(p.popularity, 1))
                                                 / ln(1 + GREATEST((SELECT MAX(popularity) FROM pop), 1))))), 6) AS ns
      FROM erecs r LEFT JOIN pop p ON r.item_id = p.item_id)""", recursive=True))
def m2_popularity_penalty_e(spark, sf_dir):
    p, recs = ease_recs_all(spark, sf_dir)
    return M.penalize_popularity(recs, p.pop)


_CAL = """hcat AS (SELECT t.user_id, COALESCE(c.category, 'unknown') AS category, COUNT(*) AS cnt
         FROM train t LEFT JOIN cat c ON t.item_id = c.item_id GROUP BY 1, 2),
hp AS (SELECT user_id, category, cnt / SUM(cnt) OVER (PARTITION BY user_id) AS p FROM hcat),
tgt AS (SELECT user_id, list(category ORDER BY category) AS tc, list(p ORDER BY category) AS tp FROM hp GROUP BY user_id),
cl AS (SELECT r.user_id, list(r.item_id ORDER BY r.rank) AS ids, list(r.score ORDER BY r.rank) AS sc,
              list(COALESCE(c.category, 'unknown') ORDER BY r.rank) AS cats, COUNT(*) AS n
       FROM erecs r LEFT JOIN cat c ON r.item_id = c.item_id GROUP BY r.user_id),
cal(user_id, step, sel, cnt, tot, ids, sc, cats, tc, tp, n) AS (
  SELECT cl.user_id, 0, CAST([] AS INTEGER[]), list_transform(tgt.tc, lambda x: 0), 0, ids, sc, cats, tgt.tc, tgt.tp, n
  FROM cl JOIN tgt ON cl.user_id = tgt.user_id
  UNION ALL
  SELECT user_id, step + 1, list_append(sel, CAST(best AS INTEGER)),
         list_transform(cnt, lambda c, j: c + CASE WHEN tc[j] = cats[best] THEN 1 ELSE 0 END), tot + 1,
         ids, sc, cats, tc, tp, n
  FROM (SELECT *, list_position(kls, list_min(kls)) AS best FROM (
          SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(sel, i) THEN 1e300 ELSE
                 ROUND(list_reduce(list_transform(range(1, len(tc) + 1), lambda j:
                    tp[j] * ln((tp[j] + 1e-12) / ((cnt[j] + CASE WHEN tc[j] = cats[i] THEN 1 ELSE 0 END) / (tot + 1.0) + 1e-12))),
                    lambda a, b: a + b), 9) END) AS kls
          FROM cal WHERE step < n))),
cfinal AS (SELECT user_id, sel, ids, sc FROM cal WHERE step = n
           UNION ALL SELECT user_id, range(1, n + 1), ids, sc FROM cl WHERE user_id NOT IN (SELECT user_id FROM tgt)),
cout AS (SELECT user_id, unnest(sel) AS idx, generate_subscripts(sel, 1) AS rank, ids, sc FROM cfinal)"""


@query("m3_calibrated_rerank_e", Q.with_prep(E, Q.CATS, *_EASE_ALL, _CAL, body="""
SELECT user_id, CAST(rank AS INTEGER) AS rank, ids[idx] AS item_id, sc[idx] AS score FROM cout""", recursive=True))
def m3_calibrated_rerank_e(spark, sf_dir):
    """M-3: category calibration to the user's train history."""
    p, recs = ease_recs_all(spark, sf_dir)
    return M.rerank_calibrated(recs, p.train, TT.categories(spark, sf_dir))
