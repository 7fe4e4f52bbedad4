"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over host + path and the literal tokens that any match must hold
as whole tokens. One count over all urls finds the rarest token of each rule; a url's tokens then
fetch candidate rules from a map, and only those run their expressions. The scan is one narrow
pass; the map is bounded by the rule list, which the caller passes in (at most 10,000 rules).

Edge cases: a null url, or one without ``://``, has an empty host and path, meets no rule and gets
the default verdict. Repeated rows are judged each. Extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains, if the url's path starts with `path`; the longest one wins."""
    name = host + path
    return Rule(name, verdict, rf"^(?:[^/]*\.)?\Q{host}{path}\E", tuple(re.findall("[A-Za-z0-9]+", name)), len(name))


def token_rule(verdict: str, literal: str) -> Rule:
    """Fits any url with this whole token in its host."""
    return Rule(literal, verdict, rf"^[^/]*(?<![A-Za-z0-9]){re.escape(literal)}(?![A-Za-z0-9])", (literal,), 0)


#: The rules in force (verdict, host, path).
HOST_RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)
#: Host tokens that mark unwanted sites where no host rule speaks.
TOKEN_RULES = tuple(token_rule("block", t) for t in ("casino", "poker", "adult", "porn", "xxx", "viagra", "torrent", "warez", "spam", "win"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(text, "[^A-Za-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...], column: str = "url") -> dict[str, list[Rule]]:
    """The index: token -> rules. Counts, over all urls, the tokens that rules name."""
    named = sorted({t for r in rules for t in r.literals})
    token = F.explode(_tokens(F.concat(host(F.col(column)), path(F.col(column))))).alias("token")
    rows = urls.select(token).where(F.col("token").isin(named)).groupBy("token").count().collect()  # a row for each literal of a rule at most
    seen = {r["token"]: r["count"] for r in rows}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.literals, key=lambda t: (seen.get(t, 0), t)), []).append(r)
    return index


def judge(urls: DataFrame, host_rules: tuple[Rule, ...], own_rules: tuple[Rule, ...] = (), default: str = "allow", column: str = "url") -> DataFrame:
    """Adds host, path, rule (the longest host rule that fits, else null) and verdict."""
    rules = (*host_rules, *own_rules)
    if len(rules) > MOST_RULES or any(not r.literals for r in rules):
        raise ValueError(f"at most {MOST_RULES} rules, each with a literal token")
    index = rarest_tokens(urls, rules, column)
    official = set(host_rules)

    def entry(r: Rule) -> Column:
        return F.struct(
            F.lit(int(r in official)).alias("official"), F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex")
        )

    table = F.create_map(*[x for t, own in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, own)))])
    target = F.concat(F.col("_host"), F.col("_path"))
    wanted = F.filter(_tokens(target), lambda t: t.isin(sorted(index)))
    candidates = F.flatten(F.transform(wanted, lambda t: F.element_at(table, t)))
    fits = F.filter(candidates, lambda r: F.call_function("rlike", target, r["regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["official"], r["weight"], r["name"], r["verdict"])))
    clash = {"host", "path", "rule", "verdict"} & set(urls.columns)
    if clash:
        urls = urls.drop(*clash)
    out = urls.withColumns({"_host": host(F.col(column)), "_path": path(F.col(column))}).withColumn("_best", best)
    return out.withColumns(
        {
            "host": F.col("_host"),
            "path": F.col("_path"),
            "rule": F.when(F.col("_best.official") == 1, F.col("_best.name")),
            "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default)),
        }
    ).drop("_host", "_path", "_best")
