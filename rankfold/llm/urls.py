"""URL filters: pattern rules indexed by their rarest literal token.

A rule has an action, a name, a regular expression over host + path, and its
literal tokens: words of letters and digits that any match holds as whole
tokens. Token counts over all urls choose each rule's rarest token; a url's
tokens fetch candidate rules from that index, and only those run their
expression. Of the rules that match, the one with the highest rank, then the
longest name, then the smallest name decides; with none the verdict is allow.

Defined cases: a null url, or one without ``://``, has empty host and path and
no rule but those without tokens; repeated rows are judged each; other columns
play no part; no rules allow everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.llm.text import add_column, prepare, rows_of

#: Rules that are broadcast at most; a rule is a few hundred bytes.
MAX_RULES = 200_000

_UPPER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    action: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    whole = _TOKEN.findall(host)
    if path:  # the last token of a path may go on in a url
        whole += _TOKEN.findall(path if re.fullmatch(r".*[^A-Za-z0-9]", path, re.S) else re.sub("[A-Za-z0-9]+$", "", path))
    return Rule(action, host + path, r"(?:[^/?#]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?:/|\Z)"),
                tuple(dict.fromkeys(whole)), 1)


def word_rule(action: str, word: str) -> Rule:
    """A host label that is the word or has it as a part set off by hyphens."""
    return Rule(action, word, rf"(?:[^/?#]*[.-])?{re.escape(word)}(?:[.-]|/|\Z)", (word,), 0)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def tokens_of(host: str, path: str) -> set[str]:
    """Tokens of a url; a path keeps its case, and upper case ends a token."""
    return set(_TOKEN.findall(host)) | set(_TOKEN.findall(path))


def token_counts(pages: DataFrame, wanted: set[str], url: str) -> dict[str, int]:
    """Urls that hold each of the rules' tokens; a number for each such token comes back."""
    found = rows_of(pages, url).toDF("u").select(F.explode(F.array_distinct(F.split(F.lower("u"), "[^a-z0-9]+"))).alias("t"))
    return {r["t"]: r["count"] for r in found.where(F.col("t").isin(sorted(wanted))).groupBy("t").count().collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by rarest token; those without tokens under the empty one."""
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=""), []).append(r)
    return out


def judge(host: str, path: str, rules: dict[str, list[Rule]]) -> Rule | None:
    candidates = list(rules.get("", ()))
    for t in tokens_of(host, path):
        candidates += rules.get(t, ())
    fits = [r for r in candidates if re.match(r.pattern, host + path)]
    return min(fits, key=lambda r: (-r.rank, -len(r.name), r.name, r.action), default=None)


VERDICT = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")] + [T.StructField("rank", T.IntegerType())])
_VERDICT = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("rank", pa.int32())])


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", out: str = "verdict") -> DataFrame:
    """``pages`` with a struct column ``out``: host, path, the deciding rule's name and rank, verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    spark = pages.sparkSession
    prepare(spark)
    wanted = {t for r in rules for t in r.tokens}
    shared = spark.sparkContext.broadcast(index(rules, token_counts(pages, wanted, url) if wanted else {}))

    def make(part):
        rows = []
        for u in part.column(url).to_pylist():
            host, path = split_url(u)
            rule = judge(host, path, shared.value)
            rows.append({"host": host, "path": path, "rule": rule.name if rule else None,
                         "verdict": rule.action if rule else "allow", "rank": rule.rank if rule else None})
        return pa.array(rows, _VERDICT)

    return add_column(pages, out, VERDICT, url, make)
