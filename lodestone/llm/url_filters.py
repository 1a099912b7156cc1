"""URL filters (3): pattern rules indexed by their rarest literal token.

A rule is a host suffix with a path prefix, or a pattern over `host || path`. Every rule names literal
tokens that each URL it fits must hold whole; it is filed under the rarest of them, by counts over all URLs.
The tokens of a URL fetch its candidate rules by an equi-join, and only those run their regular expression.
All of it is DataFrame code. The index is broadcast while the rule list is short (`BROADCAST_RULES`, checked);
a longer list is joined by token, which adaptive execution can split where a token is frequent.

Defined cases: null urls and urls without `://` have empty host and path and the default verdict; repeated
rows and null ids are judged one by one; an empty table gives no rows; only page_id and url are read, so
other columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

BROADCAST_RULES = 20_000
TOKEN = r"[^0-9a-z]+"


@dataclass(frozen=True)
class Rule:
    """name: shown for the rule, null if it belongs to the method; rank: the highest fitting rank wins."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    name: str | None = None


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits `host` and its subdomains where the path starts with `path`; longer rules rank higher."""
    tokens = tuple(t for t in re.split(TOKEN, host.lower()) if t)
    return Rule(verdict, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, 1000 + len(host) + len(path), host + path)


def word_rule(verdict: str, words: str) -> Rule:
    """Fits hosts with a label that consists of or is hyphened from the given words."""
    tokens = tuple(words.split("-"))
    return Rule(verdict, rf"^(?:[^/]*[.-])?{re.escape(words)}(?:[.:-][^/]*)?(?:/|\z)", tokens, 1)


#: Words of hosts that are blocked, alone or hyphened, and, for the single ones, together with what such
#: names are made of, before or behind.
BLOCKED = ["spam-farm", "adult-x", "click-bait"]
STEMS = ["casino", "poker", "slots", "roulette", "betting", "jackpot", "porn", "xxx", "escort", "camgirls", "hookup", "viagra", "cialis", "warez", "keygen", "payday", "clickbait", "spamfarm"]
MODIFIERS = ["best", "free", "cheap", "online", "top", "buy", "get", "my", "the", "live", "hot", "vip", "pro", "club", "hub", "zone", "world", "land", "city", "king", "queen", "star", "plus", "max", "mega",
             "super", "ultra", "real", "easy", "fast", "quick", "now", "today", "win", "big", "lucky", "gold", "royal", "euro", "usa", "24", "247", "365", "777", "888"]
#: The contract's host rules; what they leave open is for the words above.
HOST_RULES = [
    host_rule("allow", "com", "/"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/"),
]
WORD_RULES = [word_rule("block", w) for w in (*BLOCKED, *STEMS, *(x for s in STEMS for m in MODIFIERS for x in (m + s, s + m)))]
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def index_rules(judged: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a rule, filed under its rarest token by the number of URLs that hold the token."""
    spark = judged.sparkSession
    rows = [(i, r.verdict, r.pattern, r.rank, r.name, list(r.tokens)) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_id int, verdict string, pattern string, rank int, name string, tokens array<string>")
    wanted = sorted({t for r in rules for t in r.tokens})
    literal = spark.createDataFrame([(t,) for t in wanted], "token string")
    seen = judged.select(F.explode("tokens").alias("token")).join(
        F.broadcast(literal) if len(rules) <= BROADCAST_RULES else literal, "token", "left_semi"
    ).groupBy("token").agg(F.count("*").alias("n"))
    counted = (
        table.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
        .groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    return table.drop("tokens").join(counted, "rule_id")


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every url."""
    rules = HOST_RULES + WORD_RULES if rules is None else rules
    url = F.coalesce(F.col("url"), F.lit(""))
    judged = (
        pages.select("page_id", "url").withColumn("url", url)
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("tokens", F.array_distinct(F.split(lower_ascii(F.concat_ws("/", "host", "path")), TOKEN)))
    )
    index = index_rules(judged, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fits = F.expr("concat(host, path) rlike pattern")
    best = F.max_by(F.struct("name", "verdict"), F.when(fits, F.struct("rank", -F.col("rule_id"))))
    return (
        judged.select("row", "page_id", "host", "path", F.explode("tokens").alias("token")).join(index, "token", "left")
        .groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
        .select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def oracle() -> str:
    host = [(r.name, r.verdict) for r in sorted(HOST_RULES, key=lambda r: -r.rank)]
    fit = lambda n: (lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')")(*(n[: n.index('/')], n[n.index('/'):]))
    stem, more = ("(?:" + "|".join(words) + ")" for words in (STEMS, MODIFIERS))
    words = rf"regexp_matches(host, '(?:^|[.-])(?:{'|'.join(BLOCKED)}|{more}?{stem}|{stem}{more})(?:[.:-]|\z)')"
    return f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case {" ".join(f"when {fit(n)} then '{n}'" for n, _ in host)} end as rule from h)
select page_id, host, path, rule, case {" ".join(f"when rule = '{n}' then '{v}'" for n, v in host)}
  when {words} then 'block' else '{DEFAULT}' end as verdict from r"""
