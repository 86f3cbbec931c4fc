"""DuckDB SQL fragments (CTEs) mirroring the shared Spark flows.

They restate the same semantics independently in SQL; the driver runs them on
its pre-registered views to check the Spark results.
"""

from __future__ import annotations

E_EVENTS = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
         json_extract_string(props, '$.k') AS item_id,
         event_type AS event, ts, event_id,
         CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3
                              WHEN 'purchase' THEN 5 ELSE 1 END AS DOUBLE) AS weight
  FROM events)"""

L_EVENTS = """ev AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_partkey AS VARCHAR) AS item_id,
         l.l_returnflag AS event, l.l_shipdate AS ts,
         l.l_orderkey * 100 + l.l_linenumber AS event_id,
         CAST(CASE l.l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 3
                                  WHEN 'R' THEN 5 ELSE 1 END AS DOUBLE) AS weight
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

PREP = """inter AS (
  SELECT user_id, item_id, SUM(weight) AS weight, MAX(ts) AS last_ts,
         COUNT(*) AS n_events
  FROM ev GROUP BY user_id, item_id),
act AS (
  SELECT user_id, COUNT(*) AS n_items FROM inter GROUP BY user_id
  HAVING COUNT(*) >= 5),
pairs AS (SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM act)),
pop AS (SELECT item_id, COUNT(*) AS popularity FROM pairs GROUP BY item_id),
sp AS (
  SELECT user_id, item_id, weight, last_ts, n_events,
         (n < 2 OR rn <= GREATEST(1, FLOOR(n * 0.8))) AS is_train
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts, item_id) AS rn,
               COUNT(*) OVER (PARTITION BY user_id) AS n FROM pairs)),
train AS (SELECT user_id, item_id, weight, last_ts, n_events FROM sp WHERE is_train),
test AS (SELECT user_id, item_id, weight, last_ts, n_events FROM sp WHERE NOT is_train)"""


def with_prep(table: str, *ctes: str, body: str, recursive: bool = False) -> str:
    ev = E_EVENTS if table == "E" else L_EVENTS
    parts = [ev, PREP, *ctes]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


# popularity list per test user with the train mask (J-4), k items
def popular_masked(users_cte: str, k: int = 10) -> str:
    return f"""ps AS (
  SELECT item_id, popularity,
         LEAST(1.0, ln(1 + popularity) / ln(1 + (SELECT MAX(popularity) FROM pop))) AS score
  FROM pop),
pcand AS (
  SELECT u.user_id, ps.item_id, ps.score, ps.popularity
  FROM {users_cte} u CROSS JOIN ps
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = ps.item_id)),
precs AS (
  SELECT user_id, item_id, score, CAST(rnk AS BIGINT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY popularity DESC, item_id) AS rnk
    FROM pcand) WHERE rnk <= {k})"""


def ranking_report(recs_cte: str, truth_cte: str, k: int = 10, empty: str = "skip") -> str:
    join = "JOIN" if empty == "skip" else "LEFT JOIN"
    return f"""tr AS (SELECT DISTINCT user_id, item_id FROM {truth_cte}),
tn AS (SELECT user_id, COUNT(*) AS n_truth FROM tr GROUP BY user_id),
per AS (
  SELECT r.user_id,
         COUNT(t.item_id) AS hits,
         SUM(CASE WHEN t.item_id IS NOT NULL THEN 1.0 / log2(r.rank + 1) ELSE 0.0 END) AS dcg,
         MIN(CASE WHEN t.item_id IS NOT NULL THEN r.rank END) AS first_hit
  FROM {recs_cte} r LEFT JOIN tr t ON r.user_id = t.user_id AND r.item_id = t.item_id
  WHERE r.rank <= {k}
  GROUP BY r.user_id),
pu AS (
  SELECT tn.user_id,
         COALESCE(hits, 0) / {float(k)} AS precision,
         COALESCE(hits, 0) / CAST(n_truth AS DOUBLE) AS recall,
         COALESCE(dcg / list_sum(list_transform(range(1, LEAST(n_truth, {k}) + 1), lambda g: 1.0 / log2(g + 1))), 0.0) AS ndcg,
         COALESCE(1.0 / first_hit, 0.0) AS mrr,
         CASE WHEN COALESCE(hits, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit
  FROM tn {join} per ON tn.user_id = per.user_id),
agg AS (SELECT AVG(precision) AS p, AVG(recall) AS r, AVG(ndcg) AS nd, AVG(mrr) AS mr,
               AVG(hit) AS h, COUNT(*) AS n FROM pu)"""


RANKING_SELECT = """SELECT ROUND(COALESCE(p, 0.0), 6) AS precision_at_k,
       ROUND(COALESCE(r, 0.0), 6) AS recall_at_k,
       ROUND(COALESCE(nd, 0.0), 6) AS ndcg_at_k,
       ROUND(COALESCE(mr, 0.0), 6) AS mrr_at_k,
       ROUND(COALESCE(h, 0.0), 6) AS hit_rate_at_k,
       ROUND(CASE WHEN COALESCE(p, 0) + COALESCE(r, 0) > 0
                  THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1_at_k,
       CAST(n AS BIGINT) AS n_eval_users
FROM agg"""


CATS = "cat AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_type AS category FROM part)"

# item texts -> TF-IDF -> item x item cosine (brute force over the catalog)
CONTENT = r"""items AS (SELECT DISTINCT item_id FROM pairs),
itxt AS (
  SELECT i.item_id,
         concat_ws(' ', CASE WHEN c.category IS NOT NULL AND c.category <> '' THEN 'cat_' || c.category END,
                   CASE WHEN COALESCE(p.popularity, 0) > {hi} THEN 'popular_high'
                        WHEN COALESCE(p.popularity, 0) > {md} THEN 'popular_medium' ELSE 'popular_low' END) AS text
  FROM items i LEFT JOIN pop p ON i.item_id = p.item_id LEFT JOIN cat c ON i.item_id = c.item_id),
tok AS (SELECT item_id AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM itxt),
tf AS (SELECT doc, token, COUNT(*) AS tf FROM tok GROUP BY doc, token),
voc AS (SELECT token, SUM(tf) AS total_tf, COUNT(*) AS df FROM tf GROUP BY token),
idf AS (SELECT token, ln((1 + (SELECT COUNT(*) FROM itxt)) / (1.0 + df)) + 1 AS idf FROM voc),
tx AS (SELECT doc, token, tf * idf AS x FROM tf JOIN idf USING (token)),
tfidf AS (SELECT doc, token, x / sqrt(SUM(x * x) OVER (PARTITION BY doc)) AS value FROM tx),
isim AS (SELECT a.doc AS item_a, b.doc AS item_b, SUM(a.value * b.value) AS sim
         FROM tfidf a JOIN tfidf b ON a.token = b.token GROUP BY a.doc, b.doc)"""


def content(hi: int = 100, md: int = 20) -> str:
    return CONTENT.replace("{hi}", str(hi)).replace("{md}", str(md))


# content list for the users of `users_cte` (train history, seen masked), k items
def content_recs(users_cte: str, k: int, name: str = "crecs") -> str:
    return f"""chist AS (SELECT t.user_id, t.item_id FROM train t WHERE t.user_id IN (SELECT user_id FROM {users_cte})),
cnh AS (SELECT user_id, COUNT(*) AS nh FROM chist GROUP BY user_id),
csc AS (SELECT h.user_id, s.item_b AS item_id, SUM(s.sim) AS ssum
        FROM chist h JOIN isim s ON s.item_a = h.item_id GROUP BY h.user_id, s.item_b),
ccand AS (
  SELECT u.user_id, i.item_id, COALESCE(csc.ssum, 0.0) / u.nh AS raw
  FROM cnh u CROSS JOIN items i
  LEFT JOIN csc ON csc.user_id = u.user_id AND csc.item_id = i.item_id
  WHERE NOT EXISTS (SELECT 1 FROM chist h WHERE h.user_id = u.user_id AND h.item_id = i.item_id)),
{name} AS (
  SELECT user_id, item_id, LEAST(1.0, GREATEST(0.0, raw)) AS score, CAST(rk AS BIGINT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ROUND(raw, 9) DESC, item_id) AS rk FROM ccand)
  WHERE rk <= {k})"""


# EASE: active items, Gram, in-place Gauss-Jordan inverse (SPD, no pivoting), B
def ease(l2: float = 500.0, cap: int | None = None) -> str:
    limit = "" if cap is None else f"ORDER BY total DESC, item_id LIMIT {cap}"
    return f"""ai AS (SELECT item_id, SUM(weight) AS total FROM train GROUP BY item_id HAVING SUM(weight) > 0 {limit}),
ix AS (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS idx FROM ai),
th AS (SELECT t.user_id, x.idx, t.weight FROM train t JOIN ix x ON t.item_id = x.item_id),
g AS (SELECT a.idx AS r, b.idx AS c, SUM(a.weight * b.weight) AS v FROM th a JOIN th b ON a.user_id = b.user_id
      GROUP BY a.idx, b.idx),
nn AS (SELECT CAST(COUNT(*) AS INTEGER) AS n FROM ix),
rowsv AS (SELECT r.idx AS r,
                 list(CAST(COALESCE(g.v, 0) + CASE WHEN r.idx = c.idx THEN {float(l2)} ELSE 0 END AS DOUBLE)
                      ORDER BY c.idx) AS row
          FROM ix r CROSS JOIN ix c LEFT JOIN g ON g.r = r.idx AND g.c = c.idx GROUP BY r.idx),
m0 AS (SELECT list(row ORDER BY r) AS m FROM rowsv),
gj(k, m) AS (
  SELECT 0, m FROM m0
  UNION ALL
  SELECT k + 1, list_transform(m, lambda row, i:
      CASE WHEN i = k + 1 THEN list_transform(row, lambda x, j: CASE WHEN j = k + 1 THEN 1.0 / m[k+1][k+1] ELSE x / m[k+1][k+1] END)
      ELSE list_transform(row, lambda x, j: CASE WHEN j = k + 1 THEN -row[k+1] / m[k+1][k+1]
                                                 ELSE x - row[k+1] * m[k+1][j] / m[k+1][k+1] END) END)
  FROM gj WHERE k < (SELECT n FROM nn)),
pinv AS (SELECT m FROM gj WHERE k = (SELECT n FROM nn)),
bw AS (SELECT r.item_id AS src, c.item_id AS dst, -(p.m[r.idx][c.idx]) / p.m[c.idx][c.idx] AS weight
       FROM pinv p CROSS JOIN ix r CROSS JOIN ix c WHERE r.idx <> c.idx)"""


# collaborative EASE list for users of `users_cte`, seen masked, k items, B-13 normalised
def ease_recs(users_cte: str, k: int, name: str = "erecs") -> str:
    return f"""eraw AS (
  SELECT t.user_id, b.dst AS item_id, SUM(t.weight * b.weight) AS raw
  FROM train t JOIN bw b ON t.item_id = b.src
  WHERE t.user_id IN (SELECT user_id FROM {users_cte})
  GROUP BY t.user_id, b.dst
  UNION ALL
  SELECT u.user_id, x.item_id, 0.0 FROM {users_cte} u CROSS JOIN ix x
  WHERE u.user_id IN (SELECT user_id FROM train) AND u.user_id NOT IN (SELECT user_id FROM th)),
etop AS (
  SELECT * FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.raw DESC, e.item_id) AS rk FROM eraw e
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = e.user_id AND t.item_id = e.item_id))
  WHERE rk <= {k}),
{name} AS (
  SELECT user_id, item_id, CAST(rk AS BIGINT) AS rank,
         LEAST(1.0, GREATEST(0.0, CASE WHEN MAX(raw) OVER (PARTITION BY user_id) > 0
                                       THEN raw / MAX(raw) OVER (PARTITION BY user_id) ELSE 0.5 END)) AS score
  FROM etop)"""


def popular_top(k: int, name: str = "ptop", where: str = "") -> str:
    """Unmasked popularity list (global max even when filtered)."""
    return f"""{name} AS (
  SELECT item_id, LEAST(1.0, ln(1 + popularity) / ln(1 + (SELECT MAX(popularity) FROM pop))) AS score,
         CAST(rk AS BIGINT) AS rank FROM (
    SELECT p.item_id, p.popularity, row_number() OVER (ORDER BY p.popularity DESC, p.item_id) AS rk
    FROM pop p {where}) WHERE rk <= {k})"""


REQS = """reqs AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS user_id FROM customer),
warm AS (SELECT user_id FROM reqs WHERE user_id IN (SELECT user_id FROM train)),
cold AS (SELECT user_id FROM reqs WHERE user_id NOT IN (SELECT user_id FROM train))"""


def cold_popular(name: str, top: str = "ptop") -> str:
    return f"""{name} AS (SELECT c.user_id, p.item_id, p.score, p.rank FROM cold c CROSS JOIN {top} p)"""


def project(recs: str, reason: str) -> str:
    return f"""SELECT r.user_id, CAST(r.rank AS INTEGER) AS rank, r.item_id AS product_id,
       'Product ' || r.item_id AS product_name, ROUND(r.score, 6) AS score, {reason} AS reason,
       c.category, CAST(NULL AS DOUBLE) AS price
FROM {recs} r LEFT JOIN cat c ON r.item_id = c.item_id"""


REASON_COLLAB = "CASE WHEN r.src = 'popular' THEN 'Trending item' ELSE 'Users with similar behavior also interacted with this item' END"
REASON_CONTENT = "CASE WHEN r.src = 'popular' THEN 'Trending item' ELSE 'Similar item features to products you''ve viewed' END"
REASON_HYBRID = "'Recommended based on your browsing patterns and similar item features'"


def blend(a: str, b: str, n: int, name: str = "hrecs") -> str:
    return f"""hj AS (
  SELECT COALESCE(a.user_id, b.user_id) AS user_id, COALESCE(a.item_id, b.item_id) AS item_id,
         LEAST(1.0, GREATEST(0.0, 0.6 * COALESCE(ROUND(a.score, 6), 0.0) + 0.4 * COALESCE(ROUND(b.score, 6), 0.0))) AS score,
         CASE WHEN a.item_id IS NOT NULL THEN 0 ELSE 1 END AS src_order,
         COALESCE(a.rank, b.rank) AS lr
  FROM {a} a FULL OUTER JOIN {b} b ON a.user_id = b.user_id AND a.item_id = b.item_id),
{name} AS (
  SELECT user_id, item_id, score, CAST(rk AS BIGINT) AS rank, 'hybrid' AS src FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, src_order, lr) AS rk FROM hj)
  WHERE rk <= {n})"""


def r4(expr: str) -> str:
    """4-dp half-up rounding of the 9-dp value (mirrors ``round4`` in Spark)."""
    return f"CAST(ROUND(CAST(CAST(ROUND({expr}, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE)"
