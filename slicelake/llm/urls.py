"""URL filters: rules indexed by their rarest literal token, regular expressions only for the rules that a URL's tokens fetch.

A rule is one of two kinds. A host rule (host, path) fits its host and all subdomains where the URL's path starts with
the rule's. A pattern is matched against the whole URL with A-Z lower-cased, in the widespread notation of filter lists:
``*`` is any run of characters, ``^`` a separator (no letter, digit, ``_``, ``-``, ``.`` or ``%``) or the end, ``|`` at either
end the URL's start or end, ``||`` at the front the start of a label of the host. Each rule becomes a regular expression
and a set of literal tokens, runs of a-z and 0-9, that any URL that it fits must have as whole tokens. How many URLs
have each such token is counted over the whole table; the index holds each rule once, under its rarest one. A rule
without a sure token is tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.llm.common import small

#: Host rules (verdict, host, path) and patterns (verdict, pattern) of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
PATTERNS = [("block", p) for p in ("||ad.", "||ads.", "||ads-", "||adult-", "-adult.", "||casino-", "-casino.", "||spam-", "-spam.", "-pills.", "-bets.", "||tracker.", "-track.", "/popup/", "/banner/", "^affiliate_id=")]
#: Index rows that a broadcast may hold; longer lists of rules are joined by token.
MOST_BROADCAST = 50_000
#: Parts that a token's URLs and rules are dealt to where they are joined.
SALT = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = r"(?![\s\S])"
RUN = re.compile("[a-z0-9]+")
INDEX = "token string, rule string, pattern boolean, verdict string, regex string"


def lowered(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _escaped(text: str) -> str:
    """Literal for Java's regular expressions and Python's alike."""
    return "".join(x if x.isalnum() or x in "/_-%=&" and x != "-" else f"\\{x}" if x.isascii() and x.isprintable() and x != " " else x for x in text)


def host_rule(host: str, path: str) -> tuple[str, list[str]]:
    """The regular expression over host and path together, and the sure tokens: all of the host's, and the path's that it can't cut short."""
    text = lowered(host + path)
    tokens = [m[0] for m in RUN.finditer(text) if m.end() < len(text)]
    return rf"^(?:[^/]*\.)?{_escaped(lowered(host))}{_escaped(path)}", tokens


def pattern_rule(pattern: str) -> tuple[str, list[str]]:
    """The regular expression over a lower-cased URL and the sure tokens: runs with a sign, a separator or an anchor on either side."""
    body, front, back = lowered(pattern), "", ""
    if body.startswith("||"):
        body, front = body[2:], r"^[^:/?#]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, front = body[1:], "^"
    if body.endswith("|"):
        body, back = body[:-1], END
    # a star at an open end says nothing, and costs the square of a URL's length
    body = body if front else body.lstrip("*")
    body = body if back else body.rstrip("*")
    sign = {"*": r"[\s\S]*", "^": rf"(?:[^a-z0-9_.%\-]|{END})"}
    whole = lambda m: (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and bool(front)) and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and bool(back))
    return front + "".join(sign.get(x) or _escaped(x) for x in body) + back, [m[0] for m in RUN.finditer(body) if whole(m)]


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"), lambda x: x != ""))


def rule_table(spark, rules: list[tuple[str, str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """(verdict, host, path, pattern) of both kinds; a larger list is read from a table of these columns."""
    return spark.createDataFrame([(v, h, p, None) for v, h, p in rules] + [(v, None, None, p) for v, p in patterns], "verdict string, host string, path string, pattern string")


def compiled(rules: DataFrame) -> DataFrame:
    """(id, rule, pattern, verdict, regex, tokens) of each different rule; one of a null verdict, or of neither a host nor a pattern, is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                of_pattern = r["pattern"] is not None
                regex, tokens = pattern_rule(r["pattern"]) if of_pattern else host_rule(r["host"], r["path"] or "")
                rule = r["pattern"] if of_pattern else lowered(r["host"]) + (r["path"] or "")
                rows.append({"rule": rule, "pattern": of_pattern, "verdict": r["verdict"], "regex": regex, "tokens": sorted(set(tokens))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("rule", pa.string()), ("pattern", pa.bool_()), ("verdict", pa.string()), ("regex", pa.string()), ("tokens", pa.list_(pa.string()))]))

    whole = rules.where("verdict is not null and (pattern is not null or host is not null)").select("verdict", "host", "path", "pattern").distinct()
    return whole.mapInArrow(run, "rule string, pattern boolean, verdict string, regex string, tokens array<string>").withColumn("id", F.xxhash64("rule", "pattern", "verdict"))


def rarest_token_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule, pattern, verdict, regex): each rule under that of its tokens which the fewest rows of ``urls`` (url) have, ties to the first; token '' where it has none."""
    own = compiled(rules)
    asked = own.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(asked, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = own.select("id", "rule", "pattern", "verdict", "regex", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    best = ranked.groupBy("id", "rule", "pattern", "verdict", "regex").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return best.select(F.coalesce("token", F.lit("")).alias("token"), "rule", "pattern", "verdict", "regex")


def _better(pattern: bool, rule: str, verdict: str) -> tuple:
    """The order in which fitting rules win: host rules before patterns, longer host rules before shorter ones, allow before block among patterns, then by text."""
    return (not pattern, 0 if pattern else len(rule), verdict == "allow" if pattern else verdict == "block", rule)


class Index:
    """Candidate rules by token, tried by their regular expressions."""

    def __init__(self, rows: list[tuple[str, str, bool, str, str]]):
        self.by_token: dict[str, list[tuple]] = {}
        for token, rule, pattern, verdict, regex in rows:
            self.by_token.setdefault(token, []).append((pattern, rule, verdict, re.compile(regex)))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """(host, path, rule, verdict)."""
        host, path = parts_of(url)
        low = lowered(url or "")
        tokens = {"", *RUN.findall(low)} if url is not None else ()
        fits = [(pattern, rule, verdict) for t in tokens if t in self.by_token for pattern, rule, verdict, regex in self.by_token[t] if regex.search(low if pattern else host + path)]
        if not fits:
            return host, path, None, "allow"
        pattern, rule, verdict = max(fits, key=lambda x: _better(*x))
        return host, path, None if pattern else rule, verdict


def filter_urls(pages: DataFrame, rules: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rule`` is the longest host rule that fits; without one it is null and patterns decide: allow where an allowing one
    fits, else block where a blocking one does, else allow. Equal host rules with both verdicts block. A null URL, or
    one without ``://``, has neither host nor path and is fitted by no host rule; a null one is allowed. Repeated rows give
    repeated rows, a URL of any length is read whole, an empty table gives no rows; other columns are ignored. Up to
    ``most_broadcast`` rules the index is broadcast and pages are not shuffled; beyond, tokens and rules are joined.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    index = rarest_token_index(rules, rows)
    held = index.select("token", "rule", "pattern", "verdict", "regex").limit(most_broadcast + 1).collect()
    if len(held) > most_broadcast:
        return joined_urls(rows, index)
    shared = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in held])  # most_broadcast rules at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(shared.value)
        for b in (x for batch in batches for x in small([batch], 4096)):
            found = [own.judge(u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([x[i] for x in found], pa.string()) for i in range(4))], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def joined_urls(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The same verdicts by joins: distinct URLs meet rules by token, salted, and what fits is summed up for each URL."""
    url = F.col("url")
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    each = rows.select("url").where("url is not null").distinct().withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})
    asks = each.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALT)).cast("int")).withColumn("token", F.explode(F.array_union(url_tokens(url), F.array(F.lit("")))))
    dealt = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    fits = asks.join(dealt, ["token", "salt"]).where(F.expr("rlike(case when pattern then translate(url, '%s', '%s') else concat(host, path) end, regex)" % (UPPER, LOWER)))
    rank = F.struct(~F.col("pattern"), F.when(F.col("pattern"), 0).otherwise(F.length("rule")), F.when(F.col("pattern"), F.col("verdict") == "allow").otherwise(F.col("verdict") == "block"), "rule")
    best = fits.groupBy("url").agg(F.max_by(F.struct(F.when(~F.col("pattern"), F.col("rule")).alias("rule"), "verdict"), rank).alias("best"))
    judged = rows.join(best, "url", "left")
    whole = F.coalesce(url, F.lit(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    return judged.select("page_id", text(F.translate(host, UPPER, LOWER)).alias("host"), text(F.when(whole == "", "").otherwise(path)).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def _sql() -> str:
    """SQL of the verdicts under RULES and PATTERNS, by a case for each."""
    host = "regexp_matches(host || path, '{}')"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(host.format(host_rule(h, p)[0]), h + p, v) for v, h, p in rules]
    rule = " ".join(f"WHEN {x} THEN '{r}'" for x, r, _ in fits)
    verdict = " ".join(f"WHEN {x} THEN '{v}'" for x, _, v in fits)
    # RE2 has no look-ahead: an end is an empty string's
    blocked = "|".join(pattern_rule(p)[0].replace(END, "$") for _, p in PATTERNS)
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, url, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN regexp_matches(translate(url, '{UPPER}', '{LOWER}'), '{blocked}') THEN 'block' ELSE 'allow' END AS verdict FROM p
"""


SQL = _sql()
