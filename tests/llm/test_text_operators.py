"""Operators on words against plain versions that follow the contracts letter by letter."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.llm import decontaminate, minhash, pii, rules, substrings
from rankfold.llm import text as words_of
from tests.llm.conftest import HARD

SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_word_hashes_tell_words_apart():
    import pyarrow as pa
    texts = ["a b", "", None, "b a", "ab  a", "é x a"]
    data, offsets = words_of.buffers(pa.array(texts))
    starts, ends, docs = words_of.word_spans(data, offsets)
    assert docs.tolist() == [0, 0, 3, 3, 4, 4, 5, 5]
    h = words_of.word_hashes(data, starts, ends)
    assert h[0] == h[3] == h[5] == h[7] and h[1] == h[2] and len(set(h.tolist())) == 4
    at, two = words_of.window_hashes(h, docs, 2)
    assert at.tolist() == [0, 2, 4, 6] and two[0] != two[1]


def plain_decontaminate(docs, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for item, t in items:
        w = split(t)
        if item is not None:
            for i in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j:j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


ITEMS = [(1, "Quick, brown fox jumps over the lazy dog while seven wise owls!"), (2, "one two"), (3, None), (4, "... !"),
         (None, "lazy"), (10, "naïve 日本語"), (11, "b c d e f g h i j k l m"), (11, "a b c d e f g h i j k l"), (12, "W")]


@pytest.mark.parametrize("block", [512 << 10, 20])
def test_decontamination(spark, hard, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(2)
    rows = decontaminate.mark_contamination(hard, bench).select("doc_id", "text", "contamination").collect()
    got = sorted((r[0], r[2].n_words, r[2].n_hit, len(r[2]["items"]), sha(",".join(r[2]["items"]))) for r in rows)
    assert got == sorted(plain_decontaminate(HARD, ITEMS))
    for r in rows:  # offsets lead back to the original text
        for (lo, hi), (a, b) in zip(r[2].spans, r[2].words, strict=True):
            inside = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1][lo:hi]))
            assert len(inside) == b - a and inside[0] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1]))[a]


def test_a_benchmark_of_many_blocks_is_one_pass_at_a_time(spark, monkeypatch):
    """64 blocks: the driver never has more than one partition's, two tables of passes exist at most, results are those of one block."""
    items = [(i, " ".join(f"w{(7 * i + j) % 500}" for j in range(12))) for i in range(64)]
    docs = [(i, " ".join(f"w{(3 * i + j) % 500}" for j in range(40))) for i in range(50)] + [(None, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("c1", F.lit("kept"))
    bench, alive, most = spark.createDataFrame(items, "item_id long, text string"), set(), []
    whole = decontaminate.mark_contamination(df, bench, words=10)
    write, remove = decontaminate._written, decontaminate.remove_path
    monkeypatch.setattr(decontaminate, "_written", lambda d, path: (alive.add(path), most.append(len(alive)), write(d, path))[-1])
    monkeypatch.setattr(decontaminate, "remove_path", lambda s, path: (alive.remove(path), remove(s, path))[-1])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    cut = decontaminate.mark_contamination(df, bench, words=10)
    assert len(most) == 63 and max(most) == 2
    assert cut.columns == whole.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    assert sum(r.contamination.n_hit > 0 for r in whole.collect()) > 10


def test_decontamination_of_and_by_nothing(spark, hard, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.mark_contamination(nothing, bench).count() == 0
    free = decontaminate.mark_contamination(hard, bench.where("false"), out="score").collect()  # replaces a column
    assert len(free) == len(HARD) and not any(r.score.n_hit for r in free)


def test_long_items_are_cut_without_losing_a_window(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    blocks = [*decontaminate.item_blocks(spark.createDataFrame([(1, long)], "item_id long, text string"), "item_id", "text", 10)]
    found = {" ".join(run.split(" ")[i:i + 10]) for b in blocks for _, run in b for i in range(len(run.split(" ")) - 9)}
    assert len(found) == 8991


def plain_repeats(docs, split, size):
    first = {}
    for i, t in docs:
        w = split(t)
        for j in range(len(w) - size + 1):
            k = tuple(w[j:j + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w, gone = split(t), set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j:j + size])] < i:
                gone.update(range(j, j + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


@pytest.mark.parametrize(("size", "longest"), [(13, False), (13, True), (1, False), (2, False), (30, False)])
def test_substring_dedup(hard, plain_words, size, longest, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20000)
    monkeypatch.setattr(substrings, "RANGE_WINDOWS", 2000)
    docs = [d for d in HARD if d[0] is not None]
    rows = substrings.drop_repeats(hard, words=size, longest=longest).collect()
    assert sorted((r[0], r[1], r[2], r[4]) for r in rows) == sorted(plain_repeats(docs, plain_words, size))
    if longest:
        by = {r.doc_id: r.longest_repeat for r in rows}
        assert by[10] == 832 and by[20] == 13 and by[17] == 0  # 1040 words are shared with the next text


def test_substring_dedup_of_nothing(nothing):
    assert substrings.drop_repeats(nothing).count() == 0


def test_key_blobs_come_back():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (substrings.unplaned(substrings.planes(keys)) == keys).all()
    ids = np.array([-5, 3, 1 << 40])
    assert (substrings.plain_unplaned(substrings.plain_planes(ids)) == ids).all()


def plain_near(docs, split, percent, size):
    sets = []
    for i, t in docs:
        w = [lower(x) for x in split(t)]
        sets.append((i, frozenset(tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def near_documents():
    """Chains: each text links to its neighbours only, so components reach over several links."""
    rng = np.random.default_rng(4)
    out, n = [], 100
    for _ in range(6):
        w = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(9):
            out.append((n, " ".join(w)))
            at = int(rng.integers(0, 119))
            w = [*w]
            w[at] = f"v{n}"
            n += 1
    return out


def test_near_duplicates(spark, hard, plain_words):
    docs = HARD + near_documents()
    df = hard.select("doc_id", "text").union(spark.createDataFrame(near_documents(), "doc_id long, text string"))
    rows = minhash.near_duplicates(df, percent=85, size=5).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == plain_near(docs, plain_words, 85, 5)


def test_near_duplicates_of_the_table(spark, plain_words):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    rows = minhash.near_duplicates(df, percent=80).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == plain_near(docs, plain_words, 80, 5)


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_bands_follow_from_the_threshold(percent):
    """Misses stay under the bound for every size: minimum and maximum are drawn without replacement."""
    bands = minhash.band_count(percent, 6)
    chances = [(math.comb(i, 2) / math.comb(u, 2)) ** 3 for u in range(2, 3000) for i in [-(-percent * u // 100)]]
    assert max((1 - c) ** bands for c in chances) <= minhash.MISS < max((1 - c) ** (bands - 1) for c in chances)
    with pytest.raises(ValueError):
        minhash.band_count(50, 6)
    assert minhash.band_count(50, 1) == 20


def test_small_sets_share_a_permutation_as_often_as_stated():
    """Pairs with 4 of 5 shingles in common: a band of two values agrees in 12 of 20 cases, not in 16 of 25."""
    rng, pairs = np.random.default_rng(3), 400
    union = np.sort(rng.integers(0, 1 << 63, (pairs, 5)).astype(np.uint64), axis=1)
    one = minhash.signatures(union.ravel(), np.arange(0, 5 * pairs + 1, 5), 200, 2)
    drop = rng.integers(0, 5, pairs)
    four = union[np.arange(5)[None, :] != drop[:, None]]
    two = minhash.signatures(four, np.arange(0, 4 * pairs + 1, 4), 200, 2)
    assert abs((one == two).mean() - 0.6) < 0.01


def plain_pii(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{lo}:{hi}" for lo, k, hi in sorted(out))


def test_base_spans_follow_the_patterns():
    rng = np.random.default_rng(2)
    pieces = ["a", "B.c", "@", "x@y.z", ".", "-", " ", "1", "22", "255", "256", "10.0.0.1", "+", "+1", "(", ")", "4111111111111111", "é", "%", "4539 1488 0343 6467"]
    for text in [t for _, t in HARD if t and len(t) < 5000] + ["".join(rng.choice(pieces, 12)) for _ in range(4000)]:
        assert pii.said(pii.base_spans(text)) == plain_pii(text), text


def test_pii_on_documents(hard, nothing):
    model = pii.fit(hard)
    rows = pii.mark_personal(hard, model, mask=True).collect()
    for r in rows:
        base = plain_pii(r.text)
        assert r.pii.base == base
        assert set(filter(None, base.split(","))) <= set(filter(None, r.pii.spans.split(",")))
        assert (r.pii.masked is None) == (r.text is None)
        assert r.pii.spans or r.pii.masked == r.text
    assert [r.pii.masked for r in rows if r.doc_id == 12][0].startswith("mail me at <EMAIL> or <IP>, 10.0.0.256; <PHONE>; <CARD>; 4111")
    assert pii.mark_personal(nothing, pii.fit(nothing)).count() == 0


def test_tagger_learns_spans_it_was_not_shown(spark):
    """Held-out accuracy: most spans of unseen texts are decoded, and few that are none."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(df.where("doc_id % 2 = 0"))
    right = wrong = missed = 0
    for (text,) in df.where("doc_id % 2 = 1").select("text").collect():
        if pii._SIGNAL.search(text):
            want = set(pii.base_spans(text))
            got = set(pii.reconcile([*pii.tagged(model, text, pii.starts_of(text))], len(text), pii.starts_of(text), []))
            right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right > 0.6 * (right + missed) and right > 4 * wrong, (right, wrong, missed)


def test_failed_matches_veto_only_themselves(monkeypatch):
    """The whole path: what the tagger decodes over digits that no base span holds is added."""
    text = "call (132) 555-1352 or 4111111111111112 now"
    monkeypatch.setattr(pii, "tagged", lambda m, t, starts: [(5, 19, 3, 0.99, 0), (23, 39, 2, 0.99, 0)])
    assert pii.find(None, text) == ([], [(5, 19, 3)])


def test_tagger_adds_forms_that_the_patterns_miss(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(df)
    texts = [t for (t,) in df.select("text").collect() if t and len(t) > 200 and not pii._SIGNAL.search(t)][:40]
    for form, kind in (("(132) 555-1352", 3), ("555-123-4567", 3), ("john99@localhost", 0)):
        found = 0
        for t in texts:
            at = t.find(" ", len(t) // 2) + 1
            base, added = pii.find(model, f"{t[:at]}{form} {t[at:]}")
            assert not base
            found += (at, at + len(form), kind) in added
        assert found > 0.6 * len(texts), (form, found, len(texts))


def test_windows_are_reconciled_over_the_text():
    found = [(50, 60, 0, 0.99, 0), (50, 60, 0, 0.99, 48), (90, 96, 1, 0.99, 0), (100, 110, 2, 0.99, 48), (100, 110, 2, 0.5, 96)]
    # (90, 96) touches its only window's edge; the others lie in a second window's margin, which has no say
    assert pii.reconcile(found, 400, [0, 48, 96], []) == [(50, 60, 0), (100, 110, 2)]
    assert pii.reconcile([(60, 70, 0, 0.99, 0), (60, 70, 0, 0.99, 48)], 400, [0, 48], []) == [(60, 70, 0)]
    assert pii.reconcile([(60, 70, 0, 0.99, 0)], 400, [0, 48], []) == []  # the other window doesn't agree
    assert pii.reconcile([(60, 70, 0, 0.99, 0), (60, 70, 0, 0.99, 48)], 400, [0, 48], [(69, 80)]) == []


def plain_rules(t, split):
    w, t = split(t), t or ""
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {p for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for p in range(i, i + 3)}
    lines, dup = [x for x in t.split("\n") if split(x)], 0
    for k, x in enumerate(lines):
        dup += x in lines[:k]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n)


def test_rule_measures(hard, nothing, plain_words):
    rows = rules.judged(hard).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((i, *plain_rules(t, plain_words)) for i, t in HARD)
    assert not any(r.kept and r.base_failed for r in rows)
    assert rules.judged(nothing).count() == 0


def test_posterior_beats_all_must_pass(spark):
    """On the labels: nothing good is lost that all-must-pass loses, nothing bad is kept."""
    df = rules.judged(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).withColumnRenamed("quality", "posterior")
    rows = df.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    passing = lambda r: not r.base_failed and min(r.votes) >= 0
    assert any(r.kept != passing(r) for r in rows)
    assert sum(r.kept for r in good) > 0.99 * len(good) > sum(map(passing, good)) + 20
    assert sum(r.kept for r in bad) <= sum(map(passing, bad)) + 0.01 * len(bad)


def plain_votes(t, split):
    import regex
    w, t = split(t), t or ""
    n, lines = len(w), [x for x in t.split("\n") if split(x)]
    _, chars, symbols, dup, repeats, _ = plain_rules(t, split)
    if not n:
        return [0] * 10

    def vote(x, good, bad):
        return -1 if bad(x) else 1 if good(x) else 0
    return [
        vote(symbols / chars, lambda x: x <= 0.01, lambda x: x > 0.04),
        vote(len(regex.findall(r"[^\p{L}\p{M} \t\n\x0B\f\r]", t)) / chars, lambda x: x <= 0.06, lambda x: x > 0.1),
        vote(sum(x[-1] in "#*$%&|<>" for x in w) / n, lambda x: x <= 0.02, lambda x: x > 0.1),
        vote(dup / len(lines), lambda x: x <= 0.05, lambda x: x > 0.2),
        vote(repeats / n, lambda x: x <= 0.1, lambda x: x > 0.4),
        vote(len(set(w)) / n, lambda x: x >= 0.5, lambda x: x < 0.35),
        vote(len(re.findall("[A-Z]{3,}|!!", t)) / n, lambda x: x <= 0.05, lambda x: x > 0.2),
        vote(n, lambda x: x >= 100, lambda x: x < 60),
        vote(chars / n, lambda x: 3 <= x <= 9, lambda x: x < 2 or x > 14),
        vote(len(re.findall("[.!?\u3002\uff01\uff1f\u0964]", t)) / n, lambda x: 0.02 <= x <= 0.3, lambda x: x < 0.005 or x > 0.6)]


def plain_posterior(votes):
    """EM document by document on an array of one group's votes."""
    total = votes.sum(axis=1)
    good = np.where(total > 0, 0.95, np.where(total < 0, 0.05, 0.5))
    for _ in range(60):
        share = (good.sum() + 1) / (len(good) + 2)
        odds = np.full(len(good), np.log(share / (1 - share)))
        for v in votes.T:
            on_good = max(0.55, (good[v == 1].sum() + 1) / (good[v != 0].sum() + 2))
            on_bad = max(0.55, ((1 - good)[v == -1].sum() + 1) / ((1 - good)[v != 0].sum() + 2))
            odds += np.where(v == 1, np.log(on_good / (1 - on_bad)), np.where(v == -1, np.log((1 - on_good) / on_bad), 0))
        good = 1 / (1 + np.exp(-odds.clip(-50, 50)))
    return good


def test_verdicts_equal_a_plain_version(spark, plain_words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame(HARD, "doc_id long, text string"))
    rows = rules.judged(docs).collect()
    texts = docs.collect()
    votes = np.array([plain_votes(r.text, plain_words) for r in texts])
    quality = plain_posterior(votes[:, :3]) * plain_posterior(votes[:, 3:7]) * plain_posterior(votes[:, 7:])
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 6), x[3])
    plain = [(r.doc_id, v.tolist(), q, bool(not plain_rules(r.text, plain_words)[-1] and q >= 0.5))
             for r, v, q in zip(texts, votes, quality, strict=True)]
    for got, want in zip(sorted([(r.doc_id, list(r.votes), r.quality, r.kept) for r in rows], key=key), sorted(plain, key=key), strict=True):
        assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-6 and got[3] == want[3]


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20000) < 0.8
    votes = np.where(rng.random((20000, 4)) < np.where(truth[:, None], 0.01, 0.6), -1, np.where(rng.random((20000, 4)) < 0.8, 1, 0))
    share, table = rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.8) < 0.08 and all(t[-1][0] < 0.05 and t[-1][1] > 0.45 for t in table)


@pytest.mark.parametrize("junk", [0.2, 0.05, 0.01])
def test_a_lone_false_vote_is_outvoted(junk):
    """One rule votes bad on a tenth of the documents at random; its vote alone drops none, whatever the share of junk."""
    rng = np.random.default_rng(4)
    votes = np.where((rng.random(20000) < junk)[:, None] & (rng.random((20000, 4)) < 0.8), -1, 1)
    votes[rng.random(20000) < 0.1, 3] = -1
    share, table = rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert rules.log_odds((1, 1, 1, -1), share, table) > 0 > rules.log_odds((-1, -1, -1, 1), share, table)


def test_crc_of_ids_marks_the_fold(spark):
    from rankfold.llm.queries import held_out
    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


@pytest.mark.parametrize("block", [2, 256])
def test_dense_group_of_near_copies(spark, plain_words, monkeypatch, block):
    """Variants of one text on both sides of the threshold: every link counts, whatever the blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(150)]
    docs = []
    for i in range(120):
        w = [*base]
        for at in rng.integers(0, 150, rng.integers(1, 5)):
            w[at] = f"e{i}x{at}"
        docs.append((i, " ".join(w)))
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()
    want = plain_near(docs, plain_words, 85, 5)
    assert len({c for _, _, c in want}) > 3
    assert sorted(tuple(r) for r in rows) == want


def test_rows_without_an_id_are_kept(spark, plain_words):
    docs = [(1, "a b c d e f g h i j k l m n o"), (None, "a b c d e f g h i j k l m n o"), (None, None), (None, "x y"), (2, "a b c d e f g h i j k l m n o p")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.drop_repeats(df).collect()), key=key)
    plain = plain_repeats([d for d in docs if d[0] is not None], plain_words, 13)
    assert got == sorted([*plain, *[(None, len(plain_words(t)), 0, sha(" ".join(plain_words(t)))) for i, t in docs if i is None]], key=key)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent=85).collect()), key=key)
    assert got == sorted([(1, 11, 1), (2, 12, 1), (None, 11, None), (None, 0, None), (None, 1, None)], key=key)
    only = df.where("doc_id is null")
    assert substrings.drop_repeats(only).count() == minhash.near_duplicates(only).count() == 3
