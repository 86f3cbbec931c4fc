"""Packing, WARC, chat, classifier, URL rules, and the pipeline."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfold.llm import chat, classifier, pack, urls, warc
from tests.llm.conftest import HARD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def paths():
    from rankfold.llm.queries import tokenizer_paths
    return tokenizer_paths()


def test_fast_engine_gives_the_tokenizer_s_ids(paths):
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(paths[0])
    rng = np.random.default_rng(1)
    texts = [t or "" for _, t in HARD] + [f"a {chr(c)} {chr(c)}{chr(c)}b  {chr(c)}1" for c in range(1, 0x250)]
    texts += ["".join(map(chr, rng.choice([9, 10, 13, 32, 32, 39, 115, 65, 49, 46, 0xe9, 0x14d, 0x4e00, 0xa0], 40))) for _ in range(500)]
    for text, ids in zip(texts, pack.encoder(*paths)(texts), strict=True):
        assert ids.tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def check_pieces(rows, docs, paths, length=1024):
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(paths[0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        copies = sum(d[0] == i for d in docs)
        covered = Counter()
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
            covered.update(range(r.start, r.start + r.length))
        assert covered == dict.fromkeys(range(len(ids)), copies)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return by_sequence


@pytest.mark.parametrize("block", [8 << 20, 4000])
def test_packing(hard, nothing, paths, monkeypatch, block):
    monkeypatch.setattr(pack, "BLOCK_BYTES", block)
    rows = pack.pack(hard, *paths).collect()
    sequences = check_pieces(rows, HARD, paths)
    short = sum(sum(r.length for r in s) < 1024 for s in sequences.values())
    assert short <= len({s >> 32 for s in sequences})  # one with padding for each block
    assert pack.pack(nothing, *paths).count() == 0


def test_windows_keep_the_mixture():
    rng = np.random.default_rng(3)
    queues = {s: [(k * 100000 + j, int(n)) for j, n in enumerate(rng.integers(50, 900, 600 * w))] for k, (s, w) in enumerate((("a", 6), ("b", 3), ("c", 1)))}
    total = {s: sum(n for _, n in q) for s, q in queues.items()}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    got, worst, done = Counter(), 0, 0
    name = {d: s for s, q in queues.items() for d, _ in q}
    for doc, _, n, sequence, offset in pack.deal(queues, share, {}, 1024):
        if offset == 0 and sequence < 0.98 * sum(total.values()) / 1024:
            worst = max([worst, *(abs(got[s] - share[s] * done) for s in queues)])
        got[name[doc]] += n
        done += n
    assert got == total and worst < 3 * 1024  # in proportion after every window, up to a few documents


def test_deficits_are_carried_over_blocks():
    queues = {"a": [(0, 5000)], "b": [(1, 5000)]}
    share = {"a": 0.5, "b": 0.5}
    first = [d for d, *_ in pack.deal(queues, share, {"a": -3000.0, "b": 3000.0}, 1024)]
    assert first[:3] == [1, 1, 1]  # the source that is behind comes first


def plain_warc(rows, least=0):
    largest = {}
    for i, _, h in rows:
        h = (h or "").encode()
        largest[h] = max(largest.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        revisit = len(h) >= least and largest[h] != (-1 if i is None else i)
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), revisit, largest[h] if revisit else None))
    return sorted(out, key=str)


PAGES = [(1, "http://a/\r\nX: y", "<p>x</p>\r\n\r\nWARC/1.1\r\n"), (2, "http://b/", "same"), (3, None, "same"), (4, "http://d/", None), (5, "", ""),
         (6, "u", "été 日本 \U0001f600" * 3000), (7, "u", "same"), (7, "u", "same"), (8, "v", "\r\n\r\n"), (9, "v", "a\r\n\r\n"), (None, "n", "alone"), (None, "n", "same")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    back = warc.read_transactions(spark, warc.write_archives(df, least=least), with_payload=True).collect()
    got = [(None if r.metadata.page == "null" else int(r.metadata.page), r.metadata.payload_bytes, r.response.digest, r.response.refers_to is not None,
            int(r.response.refers_to[len("<urn:page:"):-1]) if r.response.refers_to else None) for r in back]
    assert sorted(got, key=str) == plain_warc(PAGES, least)
    texts = {p[0]: p[2] or "" for p in PAGES}
    assert all(r.response.payload == texts[int(r.metadata.page)] for r in back if r.response.payload is not None and r.metadata.page != "null")
    assert all(r.request.record_id and r.request.target == r.response.target for r in back)
    assert [r.request.target for r in back if r.metadata.page == "1"] == ["http://a/%0D%0AX: y"]


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_transactions(spark, warc.write_archives(df)).count() == 0


CHATS = [(1, [("user", "hi")]), (2, [("user", "hi"), ("assistant", "hello")]), (3, [("user", "hi"), ("assistant", "hello"), ("user", "bye")]),
         (4, [("user", "hi"), ("assistant", "hello")]), (5, [("user", "hi"), ("assistant", None)]), (6, [("user", "hi"), ("assistant", "")]),
         (7, [("user", "hi"), ("assistant", "hello"), ("user", "bye")]), (8, [(None, "hi")]), (9, [("user", "hi"), ("user", "hi"), ("user", "hi")])]


def test_chat_snapshots(spark):
    rows = [(c, k * 2, r, t, "x") for c, turns in CHATS for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "hi", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string").repartition(3)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 5, 6, 8, 9} and got[3] == (3, 2, "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nbye\n")
    assert got[5][2] == got[6][2] and got[8][2] == "<||>\nhi\n"
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_runs_no_python(spark):
    plan = chat.format_chats(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classifier_on_held_out_labels(spark):
    from rankfold.llm.queries import op7_quality_classifier
    sf = "/root/testdata/sf0.1"
    rows = op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.99


def test_classifier_on_hard_texts(spark, hard, nothing):
    labels = spark.createDataFrame([(i, int(i not in (13, 14)), "x") for i, _ in HARD] + [(1, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    model = classifier.train(hard, labels)
    rows = classifier.add_score(hard, model).collect()
    assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    alone = classifier.add_score(hard.where("doc_id = 12"), model).first()
    assert alone.score == pytest.approx([r.score for r in rows if r.doc_id == 12][0], abs=1e-12)  # whatever shares its batch
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    prior = classifier.train(hard, labels.where("false"))
    assert {r.score for r in classifier.add_score(hard, prior).collect()} == {0.5}
    assert classifier.add_score(nothing, model).count() == 0


PLAIN = ["The cat, the cat, THE CAT sat!!", "cat 42 a1b Zz", "", None, "  \n", "naïve été -- naïve été", "x " * 30, "A"]


def _plain_features(text):
    """Features of one text as readable keys, with their counts, and its number of tokens."""
    made, toks = Counter(), []
    for m in re.finditer(rb"([0-9A-Za-z\x80-\xff]+)|[^\x09-\x0d\x200-9A-Za-z\x80-\xff]+", (text or "").encode()):
        raw, low = m.group(), m.group().lower()
        upper = sum(65 <= c <= 90 for c in raw)
        case = 0 if upper == 0 else 2 if upper == len(raw) else 1
        shape = (case, any(48 <= c <= 57 for c in raw), min(len(raw), 28) // 4) if m.group(1) else low
        toks.append((low, shape))
    pairs = Counter((a[0], b[0]) for a, b in zip(toks, toks[1:]))
    made.update(("word", w) for w, _ in toks)
    made.update({("pair", *p): c for p, c in pairs.items()})
    made.update(("shape", x) for _, x in toks)
    made.update(("shapes", a[1], b[1]) for a, b in zip(toks, toks[1:]))
    again = sum(c - 1 for c in pairs.values())
    return made + Counter({"again": again}), len(toks)


def test_classifier_features_and_score_equal_plain_ones():
    import pyarrow as pa
    owner, index, count = classifier.features(pa.array(PLAIN, pa.string()))
    plain = [_plain_features(t) for t in PLAIN]
    assert list(count) == [n for _, n in plain]
    keys, cells = defaultdict(lambda: [0] * len(PLAIN)), defaultdict(lambda: [0] * len(PLAIN))
    for row, (made, _) in enumerate(plain):
        for key, c in made.items():
            keys[key][row] = c
    for row, i in zip(owner, index):
        cells[i][row] += 1
    assert sorted(keys.values()) == sorted(cells.values())  # a key has an index of its own, with the same counts in every text
    rng = np.random.default_rng(2)
    model = classifier.Model(np.array(sorted(cells)[::2]), rng.normal(size=len(sorted(cells)[::2])) * 5, 0.3)
    weight = dict(zip(model.index, model.weight))
    for row, score in enumerate(model.scores(pa.array(PLAIN, pa.string()))):
        total = sum(weight.get(i, 0.0) * c[row] for i, c in cells.items())
        assert score == pytest.approx(1 / (1 + np.exp(-(0.3 + total / max(1, count[row])))), abs=1e-9)


def test_classifier_updates_equal_plain_ftrl():
    rng = np.random.default_rng(5)
    examples = []
    for _ in range(120):
        index = np.sort(rng.choice(40, 6, replace=False))
        examples.append((index, rng.random(6), int(index[0] % 3 == 0)))
    model = classifier.fit(examples, epochs=3)
    alpha, beta, l1, l2 = 1.0, 1.0, 0.0002, 0.001
    z, n, ones = defaultdict(float), defaultdict(float), sum(y for *_, y in examples)
    scale = {0: len(examples) / (2 * (len(examples) - ones)), 1: len(examples) / (2 * ones)}

    def weight(i):
        if i == "bias":
            return -z[i] / ((beta + n[i] ** 0.5) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(examples)):
            index, value, y = examples[k]
            row = [*zip(index, value), ("bias", 1.0)]
            old = {i: weight(i) for i, _ in row}
            p = 1 / (1 + np.exp(-sum(old[i] * x for i, x in row)))
            for i, x in row:
                g = (p - y) * scale[y] * x
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * old[i]
                n[i] += g * g
    assert model.bias == pytest.approx(weight("bias"), abs=1e-9)
    got = dict(zip(model.index, model.weight))
    assert all(got.get(i, 0.0) == pytest.approx(weight(i), abs=1e-9) for i in range(40)) and set(got) <= set(range(40))


def test_classifier_sample_stays_bounded_when_one_id_has_very_many_rows(spark, monkeypatch):
    """5,000 documents of one labelled id, and a label given three times."""
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same id text "), (F.col("id") % 50).cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(8, "good words here"), (9, "free money !!!")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 1), (8, 1), (8, 1), (9, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda examples, **k: seen.append(examples))
    classifier.train(docs, labels)
    assert sorted(y for *_, y in seen[0]) == [0, 1, 1, 1, 1]
    classifier.train(docs, labels, most=2)
    assert len(seen[1]) <= 2


URLS = [("http://a.example.org/es/1", "block"), ("https://EXAMPLE.org/en/15?x", "block"), ("http://example.org/en/2", "allow"), ("http://myorg/", "allow"),
        ("http://x.com/de/", "block"), ("http://x.com/DE/", "allow"), ("http://x.com/fr/a", "allow"), (None, "allow"), ("no scheme", "allow"), ("http://org", "allow"),
        ("http://m.casino-win.net/", "block"), ("http://casinowin.net/", "allow"), ("http://casino.org/", "allow"), ("://example.org/es/#f", "block"), ("", "allow")]


def test_url_rules(spark):
    from rankfold.llm.queries import BLOCKED_WORDS, HOST_RULES
    every = [*HOST_RULES, *[urls.word_rule("block", w) for w in BLOCKED_WORDS]]
    df = spark.createDataFrame([(k, u, "x") for k, (u, _) in enumerate(URLS)] * 2, "page_id long, url string, rule string")
    rows = urls.judge_urls(df, every).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert r.verdict.verdict == URLS[r.page_id][1], r
        fits = [x for x in every if __import__("re").match(x.pattern, r.verdict.host + r.verdict.path)]  # all rules, no index
        best = min(fits, key=lambda x: (-x.rank, -len(x.name), x.name), default=None)
        assert r.verdict.rule == (best.name if best else None)
    assert urls.judge_urls(df.where("false"), every).count() == 0
    assert {r.verdict.verdict for r in urls.judge_urls(df, []).collect()} == {"allow"}


def test_rules_are_indexed_by_their_rarest_token():
    rules = [urls.host_rule("block", "example.org", "/es/x"), urls.word_rule("block", "casino")]
    assert rules[0].tokens == ("example", "org", "es")
    assert set(urls.index(rules, {"example": 50, "org": 9, "es": 70, "casino": 1})) == {"org", "casino"}


def test_sql_and_queries_agree(spark):
    import duckdb
    from rankfold.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        want = con.sql(sql).df()
        cols = sorted(want.columns)
        got = QUERIES[name](spark, SF).toPandas()
        assert sorted(got.columns) == cols, name
        key = lambda d: sorted(str([None if v != v or v is pd.NA else v for v in row]) for row in
                               d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None))
        assert key(got) == key(want), name


def test_pipeline(spark, paths):
    """Each stage against a plain version on its own input."""
    import corpus_pipeline as p
    from tests.llm.test_text_operators import plain_decontaminate, plain_near, plain_pii
    from rankfold.session import scratch_path
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in p.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(at := scratch_path(spark, name))
        seen.append(spark.read.parquet(at))
    tables = [{r.doc_id: r for r in d.collect()} if "text" in d.columns else d.collect() for d in seen]
    assert all(d.columns == columns for d in seen[:-1])
    split = lambda t: __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in tables[0]]
    assert sum(i in tables[1] for i in good) >= 0.98 * len(good)
    near = plain_near([(i, r.text) for i, r in tables[1].items()], split, 80, 5)
    assert set(tables[2]) == {i for i, _, c in near if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = plain_decontaminate([(i, r.text) for i, r in tables[2].items()], items)
    assert set(tables[3]) == {h[0] for h in hits if h[2] == 0}
    assert set(tables[4]) == set(tables[3])
    for i, r in tables[4].items():
        assert not plain_pii(r.text) and r.n_chars == len(r.text)
        assert plain_pii(tables[3][i].text) or "<" in r.text or r.text == tables[3][i].text
    rows = seen[-1].withColumnRenamed("doc_id", "id").collect()
    check_pieces(rows, [(i, r.text) for i, r in tables[4].items()], paths)


def test_pipeline_stages_on_hard_texts(spark, hard, nothing):
    """Null, empty, long and repeated texts, null ids, sources and lengths; columns named like the stages' own."""
    import corpus_pipeline as p
    docs = hard.select(
        "doc_id", "text", "source", F.lit("en").alias("lang"), F.length("text").alias("n_chars"), F.lit("keep").alias("_score"),
        F.col("doc_id").alias("_hits"), F.col("text").alias("_pii"), F.lit(1).alias("component_id"), F.lit(2).alias("a.b"))
    docs = docs.union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert rows, name
        if name != "packing":
            assert out.columns == docs.columns, name
            assert all(r["_score"] == "keep" and r["_hits"] == (r.doc_id or 1) and r["a.b"] == 2 and r["component_id"] == 1 for r in rows), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    kept = {r.doc_id for r in p.near_dedup(spark, docs, SF).collect()}
    assert {3, 4, 5, None, 1} <= kept and not {2, 16} & kept
    found = {r.doc_id: r for r in p.personal_data(spark, docs, SF).collect()}
    assert found[3].text is None and found[3].n_chars is None and "<EMAIL>" in found[12].text and found[12].n_chars == len(found[12].text)


def test_prefix_sums_in_two_levels(spark, monkeypatch):
    rows = [(b, s, b * 7 % 5 + len(s)) for b in range(0, 40, 3) for s in ("x", "yy") if (b + len(s)) % 4]
    want = {(b, s): sum(n for b2, s2, n in rows if s2 == s and b2 < b) for b, s, _ in rows}
    df = spark.createDataFrame(rows, "block long, source string, n long")
    for span in (1, 5, 4096):
        monkeypatch.setattr(pack, "SPAN", span)
        assert {(r.block, r.source): r.before for r in pack._before(df, "before", "source").collect()} == want


def test_entry_has_every_operator():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names


def test_packing_spreads_one_row_repeated(spark, paths, monkeypatch):
    monkeypatch.setattr(pack, "BLOCK_BYTES", 1 << 17)
    docs = spark.range(20000).selectExpr("CAST(NULL AS long) AS doc_id", "'the same words in every row, many times over' AS text", "'s' AS source")
    rows = pack.pack(docs, *paths).selectExpr("shiftright(sequence_id, 32) AS block", "length").groupBy("block").sum("length").collect()
    total = sum(r[1] for r in rows)
    assert len(rows) >= 6 and max(r[1] for r in rows) < 1.5 * total / len(rows)
