"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Rules that speak of the
same kind of fault form a group, since a document of one fault looks good to
the rules of another. For each group, expectation-maximisation estimates
without labels how accurate its rules are on faulty and on faultless documents,
and how many are faultless; a document's quality is the probability that it is
faultless in every group, and replaces all-must-pass filtering: one rule's bad
vote is outvoted where the others of its group are the more accurate ones. EM
needs only how many documents have each pattern of votes in a group: at most
3^4 counts of the whole table, whatever its size.

Defined cases: null, empty and blank texts have no words, abstain where a ratio
has no base, and fail the base rule; rows repeat as they are; other columns
play no part; on an empty table the model is its prior.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm.text import materialize, rows_of

#: Rules by the fault they speak of.
GROUPS = {"symbols": ("symbols", "marks", "symbol_ends"), "repetition": ("dup_lines", "repeats", "distinct", "shouting"),
          "form": ("length", "word_size", "sentences")}
RULES = tuple(r for rules in GROUPS.values() for r in rules)
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_lines, n_symbols, n_dup_lines, n_repeat_words,
    n_shouts, n_marks, n_symbol_ends, n_stops, n_distinct) of every row. Every array is a column of its own before a
    function walks it, so it is made once a row."""
    d = rows_of(docs, id_col, text).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    d = d.select("id", "t", F.array_remove(F.split("t", _BLANKS), "").alias("w"), lines.alias("lines"))
    d = d.select(
        "id", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("word_chars"), F.size("lines").alias("n_lines"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.regexp_count("t", F.lit("[A-Z]{3,}|!!")).alias("n_shouts"),
        F.regexp_count("t", F.lit("[^\\p{L}\\p{M} \\t\\n\\x0B\\f\\r]")).alias("n_marks"),
        F.regexp_count("t", F.lit("[#*$%&|<>](?=[ \\t\\n\\x0B\\f\\r]|\\z)")).alias("n_symbol_ends"),
        F.regexp_count("t", F.lit("[.!?\u3002\uff01\uff1f\u0964]")).alias("n_stops"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    three = F.zip_with(F.zip_with("h", F.slice("h", 2, F.greatest("n", F.lit(1))), lambda a, b: F.xxhash64(a, b)),
                       F.slice("h", 3, F.greatest("n", F.lit(1))), lambda a, b: F.xxhash64(a, b))
    rest = [c for c in d.columns if c != "h"] + ["n_distinct"]
    d = d.select("*", F.size(F.array_distinct("h")).alias("n_distinct")).select(*rest, F.slice(three, 1, F.greatest(F.col("n") - 2, F.lit(0))).alias("k"))
    # texts without any repeated window need no sorting
    d = d.select(*rest, F.when(F.size(F.array_distinct("k")) < F.size("k"), F.sort_array(
        F.transform("k", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    places = F.sort_array(F.array_distinct(F.flatten(F.zip_with("s", F.slice("s", 2, F.size("s")), lambda a, b: F.when(
        a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.expr("array(cast(null as int))"))))))
    d = d.select(*rest, F.filter(places, lambda x: x.isNotNull()).alias("p"))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), lambda a, i: F.struct(
        (i + 3).alias("end"), (a["sum"] + i + 3 - F.greatest(i, a["end"])).alias("sum")), lambda a: a["sum"])
    return d.select("id", *[F.col(c).cast("long").alias(c) for c in (
        "word_chars", "n_lines", "n_symbols", "n_dup_lines", "n_shouts", "n_marks", "n_symbol_ends", "n_stops", "n_distinct")],
                    F.col("n").cast("long").alias("n_words"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """One column for each rule, in the order of RULES: the thresholds say when it speaks."""
    n, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    symbols, marks, ends = F.col("n_symbols") / chars, F.col("n_marks") / chars, F.col("n_symbol_ends") / n
    dup, repeats = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)), F.col("n_repeat_words") / n
    distinct, shouts, size, stops = F.col("n_distinct") / n, F.col("n_shouts") / n, F.col("word_chars") / n, F.col("n_stops") / n
    made = {
        "symbols": _vote(symbols, symbols <= 0.01, symbols > 0.04),
        "marks": _vote(marks, marks <= 0.06, marks > 0.1),
        "symbol_ends": _vote(ends, ends <= 0.02, ends > 0.1),
        "dup_lines": _vote(dup, dup <= 0.05, dup > 0.2),
        "repeats": _vote(repeats, repeats <= 0.1, repeats > 0.4),
        "distinct": _vote(distinct, distinct >= 0.5, distinct < 0.35),
        "shouting": _vote(shouts, shouts <= 0.05, shouts > 0.2),
        "length": _vote(n, n >= 100, n < 60),
        "word_size": _vote(size, (size >= 3) & (size <= 9), (size < 2) | (size > 14)),
        "sentences": _vote(stops, (stops >= 0.02) & (stops <= 0.3), (stops < 0.005) | (stops > 0.6)),
    }
    return [made[r].alias(r) for r in RULES]


#: A rule is better than chance on either class; this alone says which class is which.
LEAST_ACCURACY = 0.55


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, smooth: float = 1.0,
             floor: float = LEAST_ACCURACY) -> tuple[float, list]:
    """EM over (votes, documents) counts of one group. Returns the share of
    faultless documents and, by rule and vote, (probability on faultless, on
    faulty ones) among the documents it votes on.

    It starts from the majority of the votes; abstaining says nothing."""
    rules = len(patterns[0][0]) if patterns else 0
    good = [0.95 if sum(v) > 0 else 0.05 if sum(v) < 0 else 0.5 for v, _ in patterns]
    share, table = 0.5, []
    total = sum(c for _, c in patterns)
    for _ in range(rounds if patterns else 0):
        share = (sum(g * c for g, (_, c) in zip(good, patterns, strict=True)) + smooth) / (total + 2 * smooth)
        table = []
        for j in range(rules):
            right, voted = [smooth, smooth], [2 * smooth, 2 * smooth]
            for g, (v, c) in zip(good, patterns, strict=True):
                if v[j]:
                    for s, weight in enumerate((g * c, (1 - g) * c)):
                        voted[s] += weight
                        right[s] += weight * (v[j] == 1 - 2 * s)
            on_good, on_bad = (max(floor, r / w) for r, w in zip(right, voted, strict=True))
            table.append({1: (on_good, 1 - on_bad), -1: (1 - on_good, on_bad)})
        good = [1 / (1 + math.exp(-max(-50, min(50, log_odds(v, share, table))))) for v, _ in patterns]
    return share, table


def log_odds(pattern, share: float, table) -> float:
    return math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for v, t in zip(pattern, table, strict=True) if v)


def _quality(counts: dict[str, list]) -> Column:
    """The product over the groups of the posterior that a document is faultless there."""
    quality = F.lit(1.0)
    for group, rules in GROUPS.items():
        share, table = estimate(sorted(counts.get(group, [])))
        odds = F.lit(math.log(share / (1 - share)))
        for rule, t in zip(rules, table, strict=False):  # no table without documents
            vote = F.element_at("votes", RULES.index(rule) + 1)
            odds = odds + F.when(vote == 1, math.log(t[1][0] / t[1][1])).when(vote == -1, math.log(t[-1][0] / t[-1][1])).otherwise(0.0)
        quality = quality / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))))
    return quality


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Measures, votes, base_failed, quality (posterior) and kept of every row.
    Measures are made once, written to the shared folder, and read for the
    counts of vote patterns and for the verdicts."""
    d = materialize(measured(docs, id_col, text).select("*", F.array(*votes()).alias("votes")))
    of_group = [F.struct(F.lit(g).alias("g"), F.array(*[F.element_at("votes", RULES.index(r) + 1) for r in rules]).alias("v"))
                for g, rules in GROUPS.items()]
    counts: dict[str, list] = {}
    for r in d.select(F.explode(F.array(*of_group)).alias("x")).groupBy("x").count().collect():  # at most 3^4 rows a group
        counts.setdefault(r["x"]["g"], []).append((tuple(r["x"]["v"]), r["count"]))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    d = d.withColumn("base_failed", failed).withColumn("quality", _quality(counts))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).withColumnRenamed("id", id_col)
