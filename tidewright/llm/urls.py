"""Operator 5, URL filters: rules indexed by their rarest literal token.

A rule is a host suffix and a path prefix. Its regular expression runs only on the pages whose
URL holds the rule's rarest token: token frequencies come from the URLs themselves, the index is
joined to the tokens of each URL, and one aggregation keeps the longest rule that matches.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule; equal
rows stay as many rows; the columns read are the two named ones, others are ignored whatever
their names; an empty table gives an empty result. Two rules of equal length cannot both fit one
URL unless they are equal; of equal rules ``block`` wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of these characters are the tokens of a URL.
TOKEN = "[a-z0-9_-]+"
#: An index of at most this many rules is small enough to send to every executor.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def host_regex(self) -> str:
        """The host itself or a subdomain of it."""
        return rf"(?s)\A(?:.*\.)?\Q{self.host}\E\z"

    @property
    def path_regex(self) -> str:
        return rf"(?s)\A\Q{self.path}\E"


#: Production rules.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), A_Z, a_z)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of host labels and of whole path segments, lower-cased.

    Path tokens end where a run of token characters ends, so a rule's last path token counts only
    if the rule's path goes on after it (see ``_literal_tokens``).
    """
    return F.array_distinct(F.regexp_extract_all(F.concat(host, F.lit("/"), F.translate(path, A_Z, a_z)), F.lit(TOKEN), 0))


def _literal_tokens(rule: UrlRule) -> list[str]:
    """Tokens that every matching URL must hold whole.

    A rule that begins a host anywhere but at a label's start, or ends a path inside a token, has
    no claim on that token.
    """
    import re

    path = rule.path.translate(str.maketrans(A_Z, a_z))
    found = re.findall(TOKEN, rule.host)
    found += [m[0] for m in re.finditer(TOKEN, path) if m.end() < len(path)]
    return list(dict.fromkeys(found))


def _index(pages_tokens: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """(token, host and path rule columns): each rule under its rarest literal token."""
    spark = pages_tokens.sparkSession
    rows = [(i, t) for i, r in enumerate(rules) for t in _literal_tokens(r) or [""]]
    wanted = spark.createDataFrame(rows, "rule_no int, token string")
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    # Only tokens that a rule names are counted; each URL counts once a token.
    counts = (
        pages_tokens.select(F.explode("tokens").alias("token"))
        .join(wanted.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    detail = spark.createDataFrame(
        [(i, r.name, r.verdict, r.host_regex, r.path_regex, len(r.name)) for i, r in enumerate(rules)],
        "rule_no int, rule string, verdict string, host_regex string, path_regex string, size int",
    )
    return rarest.join(detail, "rule_no").drop("rule_no")


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``."""
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parsed = parsed.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("tokens", _tokens(F.col("host"), F.col("path")))
    if not rules:
        return parsed.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    index = _index(parsed, rules)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    # A null token stands for the row itself: it finds no rule, keeps the row and counts equal rows.
    # The empty token fetches rules that have no literal token.
    more = [F.lit(None).cast("string")] + [F.lit("")] * any(not _literal_tokens(r) for r in rules)
    probes = parsed.select("id", "host", "path", F.explode(F.concat(F.array(*more), F.col("tokens"))).alias("token"))
    hits = probes.join(index, "token", "left")
    # rlike takes a column as its pattern, so only candidate rules are matched.
    fits = F.expr("host_regex is not null and host rlike host_regex and path rlike path_regex")
    best = F.max(F.when(fits, F.struct(F.col("size"), (F.col("verdict") == "block").alias("block"), F.col("rule"), F.col("verdict"))))
    found = hits.groupBy("id", "host", "path").agg(best.alias("best"), F.sum(F.when(F.col("token").isNull(), 1).otherwise(0)).alias("copies"))
    # Equal rows were counted together: give each its own row again.
    found = found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return found.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )


#: The contract over the whole table, for DuckDB.
SQL = r"""
with parsed as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
fit as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parsed)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from fit
"""
