"""URL filter: a weighted vocabulary of strict and soft terms, found by an Aho-Corasick automaton, below explicit host rules.

A hit counts when neither neighbour of the term is a letter or digit. One strict hit, or SOFT_LIMIT distinct
soft terms, rejects a url; a rule for its host and path overrides that verdict.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import bounded_batches, record

#: Fixed values of the contract: (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Weights from which one hit rejects, and terms of usual block lists by their weight; a real list has thousands and is read from a table.
STRICT_WEIGHT = 2
TERMS = {
    2: (
        "adult-x", "adultfriend", "bangbros", "bestiality", "blowjob", "camgirls", "camsex", "casino-win", "cheap-pills", "creampie", "cumshot", "escort-service", "fuck", "gangbang", "hardcore-sex", "hentai",
        "keygen", "livesex", "malware", "milf", "onlinecasino", "phishing", "porn", "porno", "pornhub", "redtube", "sexcam", "sexchat", "sexvideos", "slots-bonus", "spam-farm", "spyware", "warez", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
    ),
    1: (
        "adult", "ads", "baccarat", "bet", "bets", "betting", "bitcoin-bonus", "blackjack", "bonus", "cam", "cams", "casino", "cheap", "cialis", "click", "coupon", "crack", "cracked", "dating", "discount", "download-free", "drugs", "erotic", "escort",
        "escorts", "forex", "free", "gambling", "girls", "hack", "hot", "jackpot", "lingerie", "loan", "loans", "lottery", "naked", "nude", "nudes", "payday", "pharmacy", "pills", "pirate", "poker", "prize", "replica", "roulette", "serial", "sex",
        "sexy", "slots", "spam", "steroids", "teen", "torrent", "torrents", "track", "tracker", "viagra", "webcam", "weed", "win", "winner", "xanax",
    ),
}
SOFT_LIMIT = 2

_ORDINARY = re.compile(r"[a-z0-9]")
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Vocabulary:
    """Terms by weight: STRICT_WEIGHT or more is strict, less is soft."""

    strict: tuple[str, ...] = TERMS[2]
    soft: tuple[str, ...] = TERMS[1]
    soft_limit: int = SOFT_LIMIT

    @classmethod
    def of(cls, terms: DataFrame, *, strict_weight: float = STRICT_WEIGHT, soft_limit: int = SOFT_LIMIT, most: int = 1_000_000) -> Vocabulary:
        """From a table (term, weight): the greatest weight of a repeated term counts; terms are lower-cased in A-Z; null, empty and weightless ones are left out; more than most terms are an error."""
        rows = terms.filter("term <> '' AND weight > 0").groupBy(F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term")).agg(F.max("weight").alias("weight")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the vocabulary has over {most} terms")
        strict = lambda r: r["weight"] >= strict_weight
        return cls(tuple(sorted(r["term"] for r in rows if strict(r))), tuple(sorted(r["term"] for r in rows if not strict(r))), soft_limit)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for hard, terms in ((False, self.soft), (True, self.strict)):
            for term in terms:
                machine.add_word(term, (term, hard))
        machine.make_automaton()
        return machine


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: after the first "://" up to "/", "?", "#" or the end, then up to "?", "#" or the end; without "://" both are empty."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def terms_found(machine: ahocorasick.Automaton, url: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand in the url between non-alphanumeric characters."""
    low, strict, soft = url.translate(_UPPER), set(), set()
    for last, (term, hard) in machine.iter(low) if len(machine) else ():
        first = last - len(term) + 1
        if (first == 0 or not _ORDINARY.match(low[first - 1])) and (last + 1 == len(low) or not _ORDINARY.match(low[last + 1])):
            (strict if hard else soft).add(term)
    return strict, soft


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule whose host is this host or a parent domain and whose path begins this path."""
    labels = host.split(".")
    fitting = [(text, verdict) for k in range(len(labels)) for start, verdict, text in rules.get(".".join(labels[k:]), ()) if path.startswith(start)]
    return max(fitting, key=lambda x: len(x[0]), default=None)


def url_filter(
    pages: DataFrame, *, vocabulary: Vocabulary = Vocabulary(), rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict, n_strict and n_soft (distinct terms).

    A null url has empty host and path, no terms and the verdict allow; very long urls are read whole; repeated rows and
    ids are judged one by one, ids may be null; of rules of equal length the first given wins; other columns, whatever
    their names, are not looked at; an empty table gives no rows. One pass without a shuffle.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, text in rules:
        host, slash, path = text.partition("/")
        by_host.setdefault(host.lower(), []).append((slash + path, verdict, text))
    token = uuid.uuid4().hex
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("n_strict", pa.int32()), ("n_soft", pa.int32())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.machine(("vocabulary", token), vocabulary.automaton)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                strict, soft = terms_found(machine, url or "")
                found = rule_for(host, path, by_host)
                verdict = found[1] if found else "block" if strict or len(soft) >= vocabulary.soft_limit else "allow"
                rows.append((host, path, found and found[0], verdict, len(strict), len(soft)))
            yield record(schema, batch.column(0), *([list(x) for x in zip(*rows, strict=True)] or [[]] * 6))

    bounded_batches(pages.sparkSession)
    return pages.select(id_col, url_col).mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    """The same verdicts in DuckDB: boundary checks as regular expressions, rules as a VALUES table."""
    hit = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)"
    count = lambda terms: " + ".join(hit(t) for t in terms)
    rules = ", ".join("('{}', '{}', '/{}', '{}')".format(v, *t.split("/", 1), t) for v, t in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (
  SELECT page_id, coalesce({lower.format("url")}, '') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, low, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM cut),
counted AS (
  SELECT *, CAST({count(TERMS[2])} AS INTEGER) AS n_strict, CAST({count(TERMS[1])} AS INTEGER) AS n_soft FROM named),
ruled AS (
  SELECT c.*, r.verdict AS by_rule, r.rule,
         row_number() OVER (PARTITION BY c.page_id, c.host, c.path, c.low ORDER BY length(r.rule) DESC NULLS LAST) AS nth
  FROM counted c LEFT JOIN (VALUES {rules}) r(verdict, h, p, rule)
    ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p))
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM ruled WHERE nth = 1"""
