"""URL filter: host and path rules first, a weighted vocabulary for the rest.

The vocabulary has strict and soft terms.  One Aho-Corasick automaton finds
all terms in the lower-cased url; an occurrence counts if no ASCII letter or
digit stands directly before or after it.  One strict term, or several
distinct soft terms, reject the url.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms that reject a url alone.
STRICT = (
    "spam", "porn", "porno", "pornhub", "xxx", "hentai", "escort", "escorts", "viagra", "cialis", "levitra", "warez", "nude", "nudes", "camgirl", "camgirls", "phishing", "malware", "milf",
    "blowjob", "bdsm", "fetish", "onlyfans", "sexcam", "livesex", "spyware", "botnet", "carding", "ransomware", "stresser",
)
#: Terms of which several distinct ones reject.
SOFT = (
    "cheap", "pills", "pill", "casino", "casinos", "poker", "bet", "bets", "betting", "slots", "jackpot", "roulette", "loan", "loans", "payday", "credit", "sexy", "sex", "adult", "adults", "dating",
    "singles", "crack", "cracked", "keygen", "serial", "torrent", "torrents", "nulled", "free", "win", "winner", "prize", "giveaway", "pharmacy", "drugs", "meds", "replica", "replicas", "hot",
    "discount", "coupon", "hack", "hacks", "cheats", "proxy", "bitcoin", "forex", "rich", "weightloss", "diet", "detox", "tramadol", "xanax", "vape", "kratom",
)
#: Distinct soft terms that reject.
SOFT_LIMIT = 2
#: Terms of a loaded vocabulary at most: the automaton goes to every worker.
MAX_TERMS = 200_000
#: (host, path, verdict): fits the host and its subdomains where the path starts so.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Aho-Corasick automaton whose values are (length, is strict, term)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (len(term), False, term))
    for term in strict:
        found.add_word(term, (len(term), True, term))
    found.make_automaton()
    return found


def _alnum(c: str) -> bool:
    return "0" <= c <= "9" or "a" <= c <= "z"


def count_terms(url: str | None, found) -> tuple[int, int]:
    """Distinct strict and distinct soft terms of a lower-cased url that stand between boundaries."""
    strict, soft = set(), set()
    if url and len(found):
        for end, (size, is_strict, term) in found.iter(url):
            start = end - size + 1
            if (start == 0 or not _alnum(url[start - 1])) and (end + 1 == len(url) or not _alnum(url[end + 1])):
                (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def load_vocabulary(table: DataFrame, term_col: str = "term", class_col: str = "class") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table of terms and their class (``strict`` or ``soft``), as ``judge_urls`` takes them.

    Terms are lower-cased; a term of both classes is strict; rows with a null
    or empty term or another class take no part.  Over ``MAX_TERMS`` terms are
    an error: the size is checked before anything is collected.
    """
    term, kind = F.translate(F.trim(term_col), _UPPER, _LOWER).alias("t"), F.lower(F.trim(class_col)).alias("c")
    rows = table.select(term, kind).where("t != '' and c in ('strict', 'soft')").groupBy("t").agg(F.max(F.col("c") == "strict").alias("strict"))
    if (n := rows.count()) > MAX_TERMS:
        raise ValueError(f"a vocabulary of {n} terms; at most {MAX_TERMS} go to the workers")
    known = rows.orderBy("t").collect()
    return tuple(r["t"] for r in known if r["strict"]), tuple(r["t"] for r in known if not r["strict"])


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Iterable[tuple[str, str, str]] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict, n_strict, n_soft``.

    ``rule`` is the longest rule that fits, as host + path, or null.  The
    verdict is the rule's, else ``block`` if the vocabulary rejects the url,
    else ``allow``.  A null or empty url has empty host and path, no term and
    the verdict ``allow``; a url without ``://`` has no host but its terms
    count.  Urls of any length are scanned whole.  Of rules of equal length the
    first by name holds.  Equal rows stay; an empty table gives no row; other
    columns are not read.
    """

    @F.pandas_udf("n_strict int, n_soft int")
    def terms(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(strict, soft)
        for batch in urls:
            yield pd.DataFrame([count_terms(u, found) for u in batch], columns=["n_strict", "n_soft"]).astype("int32")

    out = df.select(F.col(id_col), F.translate(F.col(url_col), _UPPER, _LOWER).alias("_low"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, decided = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    out = out.withColumn("_t", terms("_low"))
    rejected = (F.col("_t.n_strict") > 0) | (F.col("_t.n_soft") >= soft_limit)
    return out.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(decided, F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_t.n_strict").alias("n_strict"), F.col("_t.n_soft").alias("n_soft"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge_urls`` over all of ``pages``; odd rows as described there."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    def some(terms):
        return " + ".join(f"regexp_matches(low, '(^|[^0-9a-z]){t}([^0-9a-z]|$)')::INT" for t in terms)

    def fits(host, path):
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"

    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered)
    return f"""
    WITH a AS (SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS low,
                      translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
                      coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
               FROM pages),
         b AS (SELECT *, ({some(STRICT)})::INT AS n_strict, ({some(SOFT)})::INT AS n_soft FROM a)
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
           CASE {verdict} WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
           n_strict, n_soft
    FROM b"""


ORACLE = _oracle()
