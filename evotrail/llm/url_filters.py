"""URL filters: pattern rules found by their rarest literal token.

A rule names hosts and the beginning of a path, ``example.org/docs/``: it fits the host
and all its subdomains. A ``*`` in a rule stands for any characters (in the host: but a
slash). Every rule is also a regular expression over the address, host and path of a url.

Index: the literal tokens of a rule are its runs of ASCII letters and digits that must
stand alone in any address the rule fits. A rule is filed under the one of them that the
fewest urls of the whole table hold, so a rule about a common domain waits under its path
or its name, not under ``com``. The tokens of a url fetch the rules filed under them;
only those run their expression. Rules without such a token run for every url.

Only DataFrame functions, and one narrow pass: the index is a hash table of buckets in a
literal, so a lookup reads one bucket and no row is moved. A literal holds the rules of
one block (``BLOCK_RULES``); more rules make more blocks, all of them looked up.

Defined results: a null url or one without ``://`` has an empty host and path, which
only a rule of any host (``*/``) without tokens could fit; an empty path fits no rule
whose path begins with a slash; user names and ports belong to the host; only A-Z of the
host are lower-cased; of fitting rules the longest wins, then that with the longer host,
then the first; rows are judged each by itself, so repeated rows, null keys and very long
urls change nothing; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

ALLOW, BLOCK = "allow", "block"
#: Rules in one literal; about 200 bytes each.
BLOCK_RULES = 10_000
TOKEN = "[A-Za-z0-9]+"
#: The seed of Spark's xxhash64.
HASH_SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RULE = "struct<size:int,host_size:int,place:int,rule:string,verdict:string,regex:string>"
_INDEX = f"array<array<struct<token:string,rules:array<{_RULE}>>>>"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host and the beginning of a path; without a path, any path."""

    verdict: str
    pattern: str

    def __post_init__(self):
        if self.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"{self.verdict!r} is neither {ALLOW} nor {BLOCK}")
        if not self.host:
            raise ValueError(f"{self.pattern!r} names no host; use *")

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]

    def regex(self) -> str:
        host = "[^/]*".join(map(re.escape, self.host.split("*")))
        path = ".*".join(map(re.escape, self.path.split("*")))
        return rf"(?s)\A(?:[^/]*\.)?{host}{path or r'(?=/|\z)'}"

    def tokens(self) -> list[str]:
        """The tokens that every address the rule fits holds as its own tokens."""
        whole = self.host + (self.path or "/")
        return [
            found.group()
            for found in re.finditer(TOKEN, whole)
            if whole[found.start() - 1 : found.start()] != "*"
            and whole[found.end() : found.end() + 1] not in ("", "*")
        ]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def address_tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(address, F.lit(TOKEN), F.lit(0)))


def token_counts(tokens: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """In how many rows of the whole table each wanted token occurs."""
    if not wanted:
        return {}
    each = tokens.select(F.explode("tokens").alias("token")).where(F.col("token").isin(*wanted))
    return dict(each.groupBy("token").count().collect())


def filed(rules: Sequence[UrlRule], counts: dict[str, int]) -> list[tuple[str | None, dict]]:
    """(rarest token or None, what the index holds) of every rule."""
    found = []
    for place, rule in enumerate(rules):
        token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)
        found.append(
            (
                token,
                {
                    "size": len(rule.pattern),
                    "host_size": len(rule.host),
                    "place": -place,
                    "rule": rule.pattern,
                    "verdict": rule.verdict,
                    "regex": rule.regex(),
                },
            )
        )
    return found


def best_rule(
    address: str,
    tokens: str,
    rules: Sequence[UrlRule],
    counts: dict[str, int],
    block: int = BLOCK_RULES,
) -> Column:
    """The winning rule for the address, a struct, or null."""
    entries = filed(rules, counts)
    found = [F.lit(None).cast(_RULE)]
    for start in range(0, len(entries), block):
        part = entries[start : start + block]
        candidates = _always(part)
        if index := _buckets(part):
            candidates = F.concat(candidates, _fetched(tokens, index))
        fits = F.filter(candidates, lambda rule: F.regexp_like(F.col(address), rule["regex"]))
        found.append(F.array_max(fits))
    return F.array_max(F.array_compact(F.array(*found)))


def _literal(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _always(entries) -> Column:
    return _literal([entry for token, entry in entries if token is None], f"array<{_RULE}>")


def _buckets(entries) -> list[list[dict]]:
    """Tokens with their rules, in twice as many buckets as tokens, by the token's hash."""
    by_token: dict[str, list[dict]] = {}
    for token, entry in entries:
        if token is not None:
            by_token.setdefault(token, []).append(entry)
    buckets: list[list[dict]] = [[] for _ in range(2 * len(by_token))]
    for token, rules in by_token.items():
        code = xxh64_intdigest(token, HASH_SEED)
        signed = code - (code >> 63 << 64)
        buckets[signed % len(buckets)].append({"token": token, "rules": rules})
    return buckets


def _fetched(tokens: str, buckets: list[list[dict]]) -> Column:
    """The rules filed under any of the tokens."""
    index = _literal(buckets, _INDEX)

    def under(token: Column) -> Column:
        place = F.pmod(F.xxhash64(token), F.lit(len(buckets))).cast("int")
        return F.filter(F.get(index, place), lambda entry: entry["token"] == token)

    entries = F.flatten(F.transform(F.col(tokens), under))
    return F.flatten(F.transform(entries, lambda entry: entry["rules"]))


def judge_urls(
    pages: DataFrame,
    key: str,
    url: str,
    rules: Sequence[UrlRule],
    patterns: Sequence[UrlRule] = (),
    default: str = ALLOW,
) -> DataFrame:
    """One row per page: key, host, path, rule, pattern, verdict.

    ``rules`` decide first; ``patterns``, found the same way, decide the urls that no rule
    fits; ``default`` the rest. The page's other columns are not read. Both lists are the
    caller's and travel as literals; the table is read twice, only its urls the first time,
    to count the tokens of the rules.
    """
    wanted = sorted({token for rule in (*rules, *patterns) for token in rule.tokens()})
    whole = F.coalesce(F.col(url), F.lit(""))
    parts = pages.select(F.col(key), host_of(whole).alias("host"), path_of(whole).alias("path"))
    addressed = parts.select(key, "host", "path", F.concat("host", "path").alias("address_"))
    tokened = addressed.select("*", address_tokens(F.col("address_")).alias("tokens"))
    counts = token_counts(tokened.select("tokens"), wanted)
    judged = tokened.select(
        key,
        "host",
        "path",
        best_rule("address_", "tokens", rules, counts).alias("rule_"),
        best_rule("address_", "tokens", patterns, counts).alias("pattern_"),
    )
    return judged.select(
        key,
        "host",
        "path",
        F.col("rule_.rule").alias("rule"),
        F.when(F.col("rule_").isNull(), F.col("pattern_.rule")).alias("pattern"),
        F.coalesce("rule_.verdict", "pattern_.verdict", F.lit(default)).alias("verdict"),
    )
