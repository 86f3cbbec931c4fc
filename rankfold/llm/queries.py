"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from rankfold.llm import bestfit, chat, classifier, decontaminate, divergence, minhash, pack, pii, rules, runs, substrings, urls, warc

QUERIES, ORACLE = {}, {}

#: Tokenizer files, by name in the public tokenizer package; a path may be given instead.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


def sha256_of(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


@query("op1_decontaminate", r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
 wins AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
    FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
 sizes AS (SELECT DISTINCT n FROM wins),
 dw AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
 hits AS (SELECT dw.doc_id, dw.i, dw.n, wins.item FROM dw JOIN wins USING (win, n)),
 hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
 hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""")
def op1_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"), words=10)
    hit = F.col("contamination")
    return found.select("doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"), F.size(hit["items"]).cast("long").alias("n_items"),
                        sha256_of(F.array_join(hit["items"], ",")).alias("items_sha256"), (hit["n_hit"] > 0).alias("contaminated"))


@query("op2_substring_dedup", r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
 win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
 firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE first < doc_id),
 words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
 kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS line FROM words LEFT JOIN gone USING (doc_id, p)
    WHERE gone.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op2_substring_dedup(spark, sf_dir):
    return substrings.drop_repeats(table(spark, sf_dir, "documents"), words=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_pii")
def op3_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.mark_personal(docs, pii.fit(docs))
    p = F.col("pii")
    return found.select("doc_id", *[p[c].alias(c) for c in ("n_email", "n_ip", "n_card", "n_phone")],
                        sha256_of(p["base"]).alias("base_sha256"), p["spans"].alias("spans"), p["n_added"].alias("n_added"))


@query("op4_pack")
def op4_pack(spark, sf_dir):
    path, ranks = tokenizer_paths()
    return pack.pack(table(spark, sf_dir, "documents"), path, ranks, length=1024).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op5_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM d""")
def op5_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    read = warc.read_transactions(spark, warc.write_archives(pages))
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.when(c != "null", c).cast(kind)
    refers = F.col("response.refers_to")
    return read.select(
        page(F.col("metadata.page")).alias("page_id"), F.col("metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"),
        page(F.regexp_extract(refers, "^<urn:page:(.*)>$", 1)).alias("refers_to"))


@query("op6_chat", r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    md5(coalesce('r' || role, '-')) || md5(coalesce('t' || text, '-')) AS h
    FROM conversations WHERE conv_id IS NOT NULL WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
 p AS (SELECT *, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS prefix FROM t),
 whole AS (SELECT pos, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY 1, 2),
 kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = whole.pos AND p.prefix = whole.prefix))
SELECT kept.conv_id, CAST(max(kept.pos) AS BIGINT) AS n_turns, CAST(max(n_copies) AS BIGINT) AS n_copies,
 string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY t.pos) AS rendered
FROM kept JOIN t USING (conv_id) GROUP BY 1""")
def op6_chat(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def quality_model(spark, docs, sf_dir):
    """Learned from the labels outside the held-out fold."""
    return classifier.train(docs, table(spark, sf_dir, "labels").where(~held_out()))


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.add_score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The contract's rules, and words that the method blocks.
HOST_RULES = [urls.host_rule("allow", "org", "/"), urls.host_rule("block", "example.org", "/es/"), urls.host_rule("block", "example.org", "/en/1"),
              urls.host_rule("allow", "com", "/fr/"), urls.host_rule("block", "com", "/de/")]
BLOCKED_WORDS = ("adult", "bet", "betting", "casino", "escort", "gambling", "loan", "pharma", "pills", "poker", "porn", "sex", "slots", "torrent",
                 "viagra", "warez", "xxx")


@query("op8_url_filter", r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r(rule, action, h, pre) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
    ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
 f AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(action, len(rule)) AS action FROM p JOIN r
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY 1)
SELECT p.page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action
    WHEN regexp_matches(host, '(^|[.-])(adult|bet|betting|casino|escort|gambling|loan|pharma|pills|poker|porn|sex|slots|torrent|viagra|warez|xxx)([.-]|$)')
    THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN f USING (page_id)""")
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    v = F.col("verdict")
    judged = urls.judge_urls(pages, [*HOST_RULES, *[urls.word_rule("block", w) for w in BLOCKED_WORDS]])
    return judged.select("page_id", v["host"].alias("host"), v["path"].alias("path"), F.when(v["rank"] == 1, v["rule"]).alias("rule"),
                         v["verdict"].alias("verdict"))


@query("op9_minhash_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS k
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, min(other) = w.doc_id AS kept
FROM w JOIN reach ON reach.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""")
def op9_minhash_dedup(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=5)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def repeated_tail(doc_id, n: int):
    """The contract's reading order: a tenth of the documents repeat a part from word a on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    a = h // 10 % n
    period = 1 + (n - a) // (3 + h // 10 % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % period])


@query("op11_periodic_runs", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x:
        list_reduce(range(8), lambda v, k: xor(v >> 1, (v & 1) * 3988292384), xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents),
 p AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a FROM d),
 q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS per FROM p),
 t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % per END]) ELSE w END AS w FROM q),
 win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM t WHERE n >= 6)),
 pair AS (SELECT x.doc_id, y.i - x.i AS lag, y.i FROM win x JOIN win y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
 isl AS (SELECT doc_id, lag, min(i) AS i0, max(i) + 6 AS i1 FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS g FROM pair) GROUP BY doc_id, lag, g),
 runs AS (SELECT doc_id, i0 - lag AS s, i1 - i0 + lag AS len, min(lag) AS per FROM isl WHERE i1 - i0 >= lag AND i1 - i0 + lag >= 12 GROUP BY 1, 2, 3),
 best AS (SELECT doc_id, count(*) AS n_runs, arg_min((s, len, per), (-len, s, per)) AS b, string_agg(s || ',' || len || ',' || per || chr(10), '' ORDER BY s, per) AS digest
    FROM runs GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(s + per, s + len)) AS i FROM runs),
 words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY words.i) AS line FROM words LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b[1] AS BIGINT) AS start, CAST(b[2] AS BIGINT) AS length, CAST(b[3] AS BIGINT) AS period,
 CAST(1000 * b[2] // b[3] AS BIGINT) AS exponent_milli, sha256(coalesce(digest, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.mark_runs(docs, least=12, order=repeated_tail)
    of = F.col("repeats")
    longest = F.array_min(F.transform(of["runs"], lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform(of["runs"], lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.when(F.size(of["runs"]) > 0, F.concat(lines, F.lit("\n")))
    found = found.select("doc_id", F.size(of["runs"]).cast("long").alias("n_runs"), longest.alias("top"), sha256_of(digest).alias("runs_sha256"),
                         sha256_of(of["collapsed"]).alias("collapsed_sha256"))
    length, period = -F.col("top.l"), F.col("top.p")
    return found.select("doc_id", "n_runs", F.col("top.s").alias("start"), length.alias("length"), period.alias("period"),
                        F.call_function("div", 1000 * length, period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op12_source_divergence", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
 size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
 cnt AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
 grp AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cnt USING (lang, source) GROUP BY 1, 2),
 share AS (SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(cnt.c, 0) + 1)) // (g.n + s.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 1)) // (s.n + s.v) AS q
    FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
 pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM share a JOIN share b
    ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM share WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 200""")
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, k=200)


@query("op13_best_fit")
def op13_best_fit(spark, sf_dir):
    import public_tokenizers
    packed = bestfit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), length=2048)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


__all__ = ["ORACLE", "QUERIES"]
