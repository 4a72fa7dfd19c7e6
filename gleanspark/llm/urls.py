"""URLs judged by rules and patterns.

Rules and patterns become regular expressions over host and path. Each is indexed by the rarest of
its literal tokens, as counted over all URLs; the tokens of a URL fetch the few expressions that
can fit, and only those are run. The list of rules is given by the caller and sent to the
executors, so it has to be a list the driver can hold; the URLs are never moved.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import map_rows

ALLOW, BLOCK = "allow", "block"
TOKEN = re.compile(r"[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
LIST_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains and the start of a path, like ``example.org/en/``."""

    verdict: str
    text: str

    def expression(self) -> str:
        host, slash, path = self.text.partition("/")
        return rf"\A(?:[^/]*\.)?{re.escape(host)}{slash}{re.escape(path)}"

    def tokens(self) -> list[str]:
        """Tokens a fitting URL surely has: the last one of the path may go on in the URL."""
        whole = [m for m in TOKEN.finditer(self.text.translate(TO_LOWER)) if m.end() < len(self.text)]
        return [m[0] for m in whole]


@dataclass(frozen=True)
class Pattern:
    """Words that stand as whole tokens, ``*`` for anything between them."""

    verdict: str
    text: str

    def expression(self) -> str:
        middle = ".*".join(re.escape(p) for p in self.text.split("*"))
        return rf"(?s)(?<![a-z0-9]){middle}(?![a-z0-9])"

    def tokens(self) -> list[str]:
        size, text = len(self.text), self.text
        touches = lambda m: text[m.start() - 1 : m.start()] == "*" or text[m.end() : m.end() + 1] == "*"
        return [m[0] for m in TOKEN.finditer(text) if size and not touches(m)]


# The rules every page is judged by.
RULES = (
    Rule(ALLOW, "org/"),
    Rule(BLOCK, "example.org/es/"),
    Rule(BLOCK, "example.org/en/1"),
    Rule(ALLOW, "com/fr/"),
    Rule(BLOCK, "com/de/"),
)
# For pages without a rule: words of gambling, adult and pill sites.
PATTERNS = tuple(
    Pattern(BLOCK, word)
    for word in ("adult", "bet", "bets", "casino", "escort", "jackpot", "pills", "poker", "porn", "slots", "viagra", "xxx")
)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    place = re.match(r"([^/?#]*)([^?#]*)", rest)
    return place[1].translate(TO_LOWER), place[2]


def token_list(url: Column) -> Column:
    """Distinct tokens of host and path, as :func:`parts` cuts them."""
    place = F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^?#]*)", 1), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(place, F.lit("[a-z0-9]+"), F.lit(0)))


def token_counts(pages: DataFrame, url: Column, wanted: Iterable[str]) -> dict[str, int]:
    """URLs that have each of the ``wanted`` tokens; as many numbers as tokens come back."""
    spark = pages.sparkSession
    known = spark.createDataFrame([(t,) for t in sorted(set(wanted))], "token string")
    tokens = pages.select(F.explode(token_list(url)).alias("token"))
    counted = tokens.join(F.broadcast(known), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


class RuleIndex:
    """Rules by their rarest token; those without a token are tried on every URL."""

    def __init__(self, rules: Sequence[Rule], patterns: Sequence[Pattern], counts: dict[str, int]):
        self.by_token, self.always = defaultdict(list), []
        # Longest first, so the first that fits wins; of equal length, the first given.
        ranked = sorted(rules, key=lambda r: -len(r.text))
        for rank, rule in enumerate([*ranked, *patterns]):
            entry = rank, re.compile(rule.expression()), rule
            tokens = rule.tokens()
            if tokens:
                self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def first(self, host: str, path: str) -> Rule | Pattern | None:
        """The best rule that fits, or else the first pattern."""
        place = host + path
        lowered = place.translate(TO_LOWER)
        found = list(self.always)
        for token in set(TOKEN.findall(lowered)):
            found += self.by_token.get(token, ())
        for _, expression, rule in sorted(found, key=lambda e: e[0]):
            if expression.search(place if isinstance(rule, Rule) else lowered):
                return rule
        return None


def judged(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[Rule] = RULES, patterns: Sequence[Pattern] = PATTERNS, otherwise: str = ALLOW,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    The longest rule that fits decides; without one ``rule`` is NULL and a fitting pattern, or else
    ``otherwise``, gives the verdict. NULL, empty and odd URLs have an empty host and path.
    """
    if sum(len(r.text) for r in [*rules, *patterns]) > LIST_BYTES:
        raise ValueError("split the rules: every executor holds the whole list")
    plain = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"))
    counts = token_counts(plain, F.col("url"), [t for r in [*rules, *patterns] for t in r.tokens()])
    given = [(r.verdict, r.text) for r in rules], [(p.verdict, p.text) for p in patterns], counts
    shared = pages.sparkSession.sparkContext.broadcast(given)

    def work():
        listed, words, counts = shared.value
        index = RuleIndex([Rule(*r) for r in listed], [Pattern(*p) for p in words], counts)

        def step(batch: pa.RecordBatch) -> dict:
            out = {"host": [], "path": [], "rule": [], "verdict": []}
            for url in batch.column("url"):
                host, path = parts(url.as_py())
                rule = index.first(host, path)
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(rule.text if isinstance(rule, Rule) else None)
                out["verdict"].append(rule.verdict if rule else otherwise)
            return out

        return step

    found = map_rows(plain, work, "host string, path string, rule string, verdict string", ["page"])
    return found.withColumnRenamed("page", id_col)
