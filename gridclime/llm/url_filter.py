"""URL filter: weighted vocabulary counted by an Aho-Corasick automaton, and host/path rules that override it."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: terms that reject a URL alone, and terms of which several different ones do
STRICT = (
    "porn porno xxx hentai camgirl camgirls escort escorts milf nsfw casino casinos viagra cialis warez torrent torrents "
    "keygen phishing malware spam"
).split()
SOFT = (
    "adult sex sexy nude naked bet bets betting gamble poker slots lottery jackpot win winner free cheap pills pharmacy "
    "loan loans payday credit deal deals discount promo replica crack hack download farm ads ad track tracker click "
    "popup banner affiliate"
).split()
# fixed values: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits the host or a parent of it and starts the path; null if none."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def term_counts(url: Column, strict=tuple(STRICT), soft=tuple(SOFT)) -> Column:
    """struct(strict, soft): distinct terms in the lower-cased URL that no letter or digit adjoins."""

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = ahocorasick.Automaton()
        for weight, terms in ((0, soft), (1, strict)):
            for t in terms:
                found.add_word(t, (t, weight))
        found.make_automaton()
        for urls in batches:
            rows = []
            for u in urls:
                u = (u or "").lower()
                kinds: tuple[set, set] = (set(), set())
                for end, (t, weight) in found.iter(u):
                    start = end - len(t) + 1
                    if (start == 0 or not u[start - 1].isalnum()) and (end + 1 == len(u) or not u[end + 1].isalnum()):
                        kinds[weight].add(t)
                rows.append((len(kinds[1]), len(kinds[0])))
            yield pd.DataFrame(rows, columns=["strict", "soft"])

    return count(url)


def filter_urls(
    df: DataFrame, url_col: str = "url", rules=RULES, strict=tuple(STRICT), soft=tuple(SOFT), least_soft: int = 2
) -> DataFrame:
    """Adds host, path, rule, strict_terms, soft_terms and verdict; columns of these names are replaced.

    The verdict is the rule's action, else block for one strict or ``least_soft`` different soft terms, else allow. A
    null URL, or one without ://, has an empty host and path; a null one has no terms and is allowed. Rows are kept
    as they are, repeated ones too; there is no shuffle.
    """
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    out = df.withColumns({"host": host, "path": path, "_terms": term_counts(url, tuple(strict), tuple(soft))})
    out = out.withColumns({"strict_terms": F.col("_terms.strict"), "soft_terms": F.col("_terms.soft"), "rule": rule})
    bad = (F.col("strict_terms") > 0) | (F.col("soft_terms") >= least_soft)
    verdict = F.coalesce(action, F.when(bad, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("_terms")


def oracle(strict=STRICT, soft=SOFT, rules=RULES) -> str:
    """The same verdicts in DuckDB SQL over pages."""

    def terms(words):
        one = "regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}]){}($|[^\\p{{L}}\\p{{N}}])')::int"
        return " + ".join(one.format(w) for w in words)

    case = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
        for i, (a, h, p) in sorted(enumerate(rules), key=lambda r: -len(r[1][1] + r[1][2]))
    )
    rule = "CASE " + case.format(*(h + p for _, h, p in rules)) + " END"
    act = "CASE " + case.format(*(a for a, _, _ in rules)) + " END"
    return f"""
    WITH parts AS (
      SELECT page_id, url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    counted AS (SELECT *, ({terms(strict)})::int AS strict_terms, ({terms(soft)})::int AS soft_terms FROM parts)
    SELECT page_id, host, path, strict_terms, soft_terms, {rule} AS rule,
      coalesce({act}, CASE WHEN strict_terms > 0 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END) AS verdict
    FROM counted"""
