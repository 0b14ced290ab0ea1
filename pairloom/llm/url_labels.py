"""A small labelled table of URLs: what the filter's regression learns from unless a table is given.

The table is written by hand as words and built by rule: names of blocked kinds of sites (gambling, adult, pharmacy
spam, dubious trade, pirated software, tracking) and of ordinary ones, each with the same second words, prefixes, endings and paths.
So neither a top-level domain, a language in the path nor a query tells a verdict, only what the host is called. Ordinary hosts
include invented names, and are more frequent, as in any crawl.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.operators.sizing import local_table

#: Words of hosts that are blocked.
BLOCKED_WORDS = (
    "casino poker slots bets betting jackpot roulette lottery bingo gamble "
    "adult porn xxx sex escort nude webcams "
    "pills viagra cialis pharma steroids "
    "spam cheap replica payday loans backlinks "
    "warez crack keygen torrent phish malware "
    "ads adserver track tracker popup clickbait"
).split()

#: Words of ordinary hosts.
ORDINARY_WORDS = (
    "news wiki school library garden recipes travel music museum weather health science history books sports city "
    "forum docs project research university gallery photo film poetry cooking cycling railway bakery hotel council "
    "parish ocean forest mountain river bridge village theatre orchestra chess physics maths language archive journal "
    "review studio design software code data maps nature birds family kitchen"
).split()

#: Second words, parts of invented names, and what stands around the names.
_SECOND = "win free best online farm hub zone now deals x club top live king".split()
_PARTS = "ba do ki lu me no pa ri sa te vo zu ner tal mor sti ght and ing ent the ous".split()
_PREFIXES = ("", "www.", "m.", "blog.")
_ENDINGS = (".com", ".net", ".org", ".example.com", ".example.net", ".example.org", ".co.uk", ".de", ".info")
_PATHS = ("/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/index.html", "/a/{n}?page=2", "/{n}#top")


def _url(name: str, i: int) -> str:
    path = _PATHS[i * 5 % 8].format(n=100 + i * 37 % 9000)
    return f"{('http', 'https')[i % 2]}://{_PREFIXES[i * 3 % 4]}{name}{_ENDINGS[i * 7 % 9]}{path}"


def url_labels(spark: SparkSession) -> DataFrame:
    """``url, host_name, verdict`` (block or allow)."""
    rows = []
    for i in range(14 * len(BLOCKED_WORDS)):
        first, second = BLOCKED_WORDS[i % len(BLOCKED_WORDS)], _SECOND[i // len(BLOCKED_WORDS)]
        name = (f"{first}-{second}", f"{second}-{first}", f"{first}{second}")[i % 3]
        rows.append((_url(name, i), name, "block"))
    for i in range(12 * len(ORDINARY_WORDS)):
        first, second = ORDINARY_WORDS[i % len(ORDINARY_WORDS)], _SECOND[i // len(ORDINARY_WORDS)]
        name = (f"{first}-{second}", f"{second}-{first}", f"{first}{second}", first)[i % 4]
        rows.append((_url(name, i), name, "allow"))
    for i in range(800):
        name = "".join(_PARTS[i * k % len(_PARTS)] for k in (1, 3, 7)[: 2 + i % 2])
        rows.append((_url(name, i), name, "allow"))
    schema = spark.createDataFrame([], "url string, host_name string, verdict string").schema
    return local_table(spark, rows, schema)
