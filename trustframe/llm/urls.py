"""URL filter: host rules first, then a weighted vocabulary.

The vocabulary has strict terms (one is enough) and soft terms (``SOFT_HITS``
distinct ones are).  An Aho-Corasick automaton finds all terms of a URL in one
read; a find counts if no ASCII letter or digit stands directly before or after
it.  A-Z are lower-cased first.

A rule names a host and the start of a path.  It fits the host itself and all
its subdomains; the longest fitting rule decides, and only without one the
vocabulary does.  Null urls and urls without ``://`` have empty host and path
and no hits beyond those of their text; null has none.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

SOFT_HITS = 2

# ---- fixed values: the vocabulary -----------------------------------------
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "sexcam", "nsfw", "warez", "phishing",
          "malware", "viagra", "cialis", "escorts", "xvideos", "keygen")
SOFT = ("sex", "adult", "nude", "casino", "poker", "betting", "slots", "jackpot", "loan",
        "payday", "pills", "pharmacy", "crack", "torrent", "serial", "dating", "hot", "free",
        "bonus", "cheap", "replica", "hack")
# ---------------------------------------------------------------------------

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for terms, kind in ((soft, 1), (strict, 0)):      # a term in both lists is strict
        for t in terms:
            a.add_word(t, (t, kind))
    if len(a):
        a.make_automaton()
    return a


def hits(url: bytes, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[set, set]:
    """Distinct strict and soft terms that stand alone in the url."""
    a, text = automaton(strict, soft), url.lower().decode("utf-8", "replace")
    found: tuple[set, set] = (set(), set())
    for end, (term, kind) in a.iter(text) if len(a) else ():
        start = end + 1 - len(term)
        if (start == 0 or not _is_word(text[start - 1])) and (
                end + 1 == len(text) or not _is_word(text[end + 1])):
            found[kind].add(term)
    return found


def _is_word(c: str) -> bool:
    return c.isascii() and ord(c) in _WORD


def vocabulary(df: DataFrame, keep: list[str], url: str = "url", strict=STRICT, soft=SOFT,
               soft_hits: int = SOFT_HITS) -> DataFrame:
    """``keep`` plus the distinct terms found and whether they reject the url."""
    strict, soft = tuple(strict), tuple(soft)

    def rows(urls):
        got = [hits(u, strict, soft) for u in urls]
        return [[sorted(a) for a, _ in got], [sorted(b) for _, b in got],
                [bool(a) or len(b) >= soft_hits for a, b in got]]

    terms = T.ArrayType(T.StringType())
    return append_columns(df, keep, url, [
        T.StructField("strict_terms", terms), T.StructField("soft_terms", terms),
        T.StructField("rejected", T.BooleanType())], rows)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER,
                                  UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(df: DataFrame, rules: list[tuple[str, str, str]], keep: list[str], url: str = "url",
          **vocab) -> DataFrame:
    """``keep``, host, path, rule, verdict and the terms found.

    ``rules``: (verdict, host, start of the path).
    """
    found = vocabulary(df, list(dict.fromkeys([*keep, url])), url, **vocab)
    found = found.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = (((F.col("host") == h) | F.endswith("host", F.lit(f".{h}")))
                & F.startswith("path", F.lit(p)))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    words = F.when(F.col("rejected"), "block").otherwise("allow")
    return found.select(*keep, "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, words).alias("verdict"),
                        "strict_terms", "soft_terms")
