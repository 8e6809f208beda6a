"""URL filter: pattern rules indexed by their rarest literal token, in DataFrame operations only.

Every rule is a regular expression over ``host + path`` with a set of literal tokens that each url it fits must contain. The
index holds a rule once, under that literal token that fewest urls of the table contain, in lower case. The tokens of a url fetch its
candidate rules, and only those run their expressions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
#: Rule sets up to this many rules are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 20_000
#: A url with more than one in RUNS of all rows is hot; there are fewer than RUNS of them.
RUNS = 64


@dataclass(frozen=True)
class Rule:
    """name is returned; verdict is allow or block; regex is Java's; tokens are literals that it requires; weight decides between fitting rules of a tier, a lower tier first."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int
    tier: int = 0


def prefix_rule(rule: str, verdict: str) -> Rule:
    """A rule ``host/path``: the host and all its subdomains, paths that start with the rule's."""
    host, _, path = rule.partition("/")
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape('/' + path)}"
    # The last token of the path may go on in the url, so only closed ones are literals.
    closed = path[: path.rfind("/") + 1] if "/" in path else ""
    return Rule(rule, verdict, pattern, tuple(t for t in re.split("[^0-9A-Za-z]+", f"{host}/{closed}") if t), len(rule))


def word_rule(verdict: str, *words: str) -> Rule:
    """A rule on lower-case words in the host or path, whatever their case, with one of ``-_.`` between them and no letter or digit beside them."""
    pattern = "[-_.]".join(map(re.escape, words))
    return Rule("*" + "-".join(words) + "*", verdict, f"(?i)(?:^|[^0-9A-Za-z]){pattern}(?:[^0-9A-Za-z]|$)", words, sum(map(len, words)), tier=1)


#: The rules of the query, then the patterns that judge urls which none of them fits.
HOST_RULES = [
    prefix_rule("com/", "allow"),
    prefix_rule("example.com/en/", "block"),
    prefix_rule("www.example.com/en/", "allow"),
    prefix_rule("net/es/", "block"),
    prefix_rule("net/fr/", "block"),
]
WORDS = ["casino", "porn", "xxx", "viagra", "cialis", "jackpot", "warez", "camgirls"]
OFFERS = ["best", "buy", "cheap", "discount", "easy", "fast", "free", "get", "instant", "legal", "live", "no", "online", "order", "real", "safe", "secret", "spam", "top", "win"]
GOODS = ["bets", "betting", "bonus", "cash", "casinos", "credit", "dating", "diet", "drugs", "farm", "followers", "gambling", "keygen", "likes", "loan", "loans", "lottery", "meds", "payday", "pharmacy", "pills", "poker", "replica", "roulette", "sex", "slots", "steroids", "torrents", "traffic", "watches"]
PATTERN_RULES = [word_rule("block", w) for w in WORDS] + [word_rule("block", a, b) for a in OFFERS for b in GOODS] + [word_rule("block", b, a) for a in OFFERS for b in GOODS]


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", named_tiers: int = 1) -> DataFrame:
    """One row per input row: all input columns, then host, path, rule, verdict.

    The fitting rule of the lowest tier, then of the greatest weight, then of the smallest name decides; without one the
    verdict is ``default``. ``rule`` is null for rules of tiers from ``named_tiers`` on. Null urls and urls without ``://``
    have an empty host and path, fit no rule, and get the default. Repeated rows are judged one by one. Input columns with the
    names of result columns are replaced. An empty table gives no rows.
    """
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token can't be indexed: {bare}")
    spark, added = pages.sparkSession, ["host", "path", "rule", "verdict"]
    own = [c for c in pages.columns if c not in added]
    base = pages.select(*own, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # Equal host and path get equal verdicts: each is judged once, whatever the number of its rows.
    urls = base.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_rows"))
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.array_remove(F.split(F.translate(target, UPPER, LOWER), "[^0-9a-z]+"), ""))

    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    given = json.dumps([{"rule_id": i, "name": r.name, "rule_verdict": r.verdict, "regex": r.regex, "tokens": [t.translate(FOLD) for t in r.tokens], "weight": r.weight, "tier": r.tier} for i, r in enumerate(rules)])
    kind = "array<struct<rule_id int, name string, rule_verdict string, regex string, tokens array<string>, weight int, tier int>>"
    listed = spark.range(1).select(F.inline(F.from_json(F.lit(given), kind)))
    literals = listed.select("rule_id", F.explode("tokens").alias("token"))
    # How many rows contain each literal: counted over all rows, only for tokens that some rule has.
    seen = urls.select("_rows", F.explode(tokens).alias("token")).join(hint(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.sum("_rows").alias("n"))
    rarest = literals.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = listed.drop("tokens").join(rarest, "rule_id")

    fetched = urls.select("host", "path", F.explode(tokens).alias("token")).join(hint(index), "token")
    fitting = fetched.where(F.expr("concat(host, path) rlike regex"))
    best = fitting.groupBy("host", "path").agg(F.min(F.struct("tier", (-F.col("weight")).alias("w"), "name", "rule_verdict")).alias("_best"))
    # Fewer than RUNS urls are hot: their rows meet the verdicts where they are. The others go by url.
    hot = F.broadcast(urls.where(F.col("_rows") * RUNS > base.count()).join(best, ["host", "path"], "left").select("host", "path", "_best"))
    judged = base.join(hot, ["host", "path"]).unionByName(base.join(hot, ["host", "path"], "left_anti").join(best, ["host", "path"], "left"))
    return (
        judged.withColumn("rule", F.when(F.col("_best.tier") < named_tiers, F.col("_best.name")))
        .withColumn("verdict", F.coalesce("_best.rule_verdict", F.lit(default)))
        .select(*own, *added)
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES + PATTERN_RULES).drop("url")


_FITS = " ".join(
    f"WHEN {' AND '.join([f'''(host = '{h}' OR ends_with(host, '.{h}'))''', f'''starts_with(path, '/{p}')'''])} THEN '{r.name}'"
    for r in sorted(HOST_RULES, key=lambda r: -len(r.name))
    for h, _, p in [r.name.partition("/")]
)
_PAIR = f"({'|'.join(OFFERS)})[-_.]({'|'.join(GOODS)})|({'|'.join(GOODS)})[-_.]({'|'.join(OFFERS)})"
_WORDS = f"{'|'.join(WORDS)}|{_PAIR}"
SQL = f"""
WITH parts AS (
  SELECT page_id,
    coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw_host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), hosts AS (SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, path FROM parts),
judged AS (SELECT *, CASE {_FITS} ELSE NULL END AS rule FROM hosts)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)}
    WHEN regexp_matches(host || path, '(?i)(^|[^0-9A-Za-z])({_WORDS})([^0-9A-Za-z]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
