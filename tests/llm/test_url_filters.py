from __future__ import annotations

import random
import re

import pytest

from evotrail.llm.url_filters import TOKEN, UrlRule, best_rule, filed, judge_urls

SCHEMA = "page_id long, url string, host int, rule string, tokens string"
RULES = [
    UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"), UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/"),
    UrlRule("block", "a.b"), UrlRule("allow", "x.a.b/p"), UrlRule("block", "b/p+(q)/"),
]
PATTERNS = [UrlRule("block", p) for p in ("ad*.net/", "*/*/login", "*/a*z", "net/*.exe")]


def plain_parts(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    address = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = address.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def plain_fit(rule, host, path):
    if "*" not in rule.pattern:
        named = host == rule.host or host.endswith("." + rule.host)
        return named and path.startswith(rule.path)
    hosts = ".*".join(map(re.escape, rule.host.split("*")))
    paths = ".*".join(map(re.escape, rule.path.split("*")))
    return bool(re.fullmatch(rf"(?s)(.*\.)?{hosts}", host) and re.match(f"(?s){paths}", path))


def plain(url):
    host, path = plain_parts(url)

    def best(rules):
        fit = [r for r in rules if plain_fit(r, host, path)]
        return max(fit, key=lambda r: (len(r.pattern), len(r.host), -rules.index(r)), default=None)

    rule, pattern = best(RULES), best(PATTERNS)
    first = rule or pattern
    return (
        host, path, rule and rule.pattern, None if rule else pattern and pattern.pattern,
        first.verdict if first else "allow",
    )


def judged(spark, urls, rules=RULES, patterns=PATTERNS):
    rows = [(i, url, 7, "clash", None) for i, url in enumerate(urls)]
    found = judge_urls(spark.createDataFrame(rows, SCHEMA), "page_id", "url", rules, patterns)
    assert found.columns == ["page_id", "host", "path", "rule", "pattern", "verdict"]
    return [tuple(r)[1:] for r in sorted(found.collect())]


def test_equals_plain_rules(spark):
    rng = random.Random(3)
    parts = [
        "org", "com", "net", "example", "a", "b", "x", "ad", "ad9", ".", ".", "/", "/", "en", "es",
        "fr", "de", "1", "p", "p+(q)", "login", ".exe", "?", "#", ":8080", "é", "\n", "A", "Z",
    ]
    urls = ["https://" + "".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(2000)]
    for rule in (*RULES, *PATTERNS):
        for _ in range(60):
            middle = rule.pattern.replace("*", rng.choice(["", "7", "a.b", "/x/"]))
            start, end = rng.choice(["", "www.", "x", "."]), "".join(rng.choices(parts, k=2))
            urls.append(f"http://{start}{middle}{end}")
    urls += [
        None, "", "no scheme", "://", "://org/", "a://b://org/", "http://EXAMPLE.org/ES/", "x://a.b",
        "http://example.org/es/", "http://example.org?/es/", "http://notorg/", "http://x.org",
        "http://ÀB.org/", "http://y.org/" + "long/" * 50_000, "http://x.org/", "http://x.org/",
    ]
    found = judged(spark, urls)
    for url, one in zip(urls, found):
        assert one == plain(url), url
    assert len({one[2] for one in found}) > 6 and len({one[3] for one in found}) > 4


def test_tokens_hold_wherever_the_rule_fits():
    assert UrlRule("allow", "Example.org/en/1").tokens() == ["example", "org", "en"]
    assert UrlRule("allow", "a.b").tokens() == ["a", "b"]
    assert UrlRule("allow", "ad*.net/x*y/z").tokens() == ["net"]
    assert UrlRule("allow", "*/").tokens() == []
    for rule in (*RULES, *PATTERNS):
        for start in ("", "www."):
            address = start + rule.pattern.replace("*", "7") + ("" if rule.path else "/")
            for end in ("", "x", "/x"):
                if re.match(rule.regex().replace(r"\z", r"\Z"), address + end):
                    assert set(rule.tokens()) <= set(re.findall(TOKEN, address + end))


def test_rules_are_filed_under_their_rarest_token():
    counts = {"org": 90, "example": 50, "es": 3, "en": 60}
    tokens = [token for token, _ in filed(RULES[:3], counts)]
    assert tokens == ["org", "es", "example"]


def test_many_rules_in_blocks_agree_with_one(spark):
    rules = [UrlRule("block" if n % 2 else "allow", f"h{n % 50}.com/p{n}/") for n in range(700)]
    urls = [f"http://www.h{n % 50}.com/p{n}/x" for n in range(0, 800, 7)]
    rows = spark.createDataFrame(
        [(u[7:], re.findall(TOKEN, u[7:])) for u in urls], "a string, t array<string>"
    )
    one, many = (
        [
            r.best.rule if r.best else None
            for r in rows.select(best_rule("a", "t", rules, {"com": 800}, n).alias("best")).collect()
        ]
        for n in (1000, 64)
    )
    assert one == many == [f"h{n % 50}.com/p{n}/" if n < 700 else None for n in range(0, 800, 7)]


def test_no_rules_and_no_rows(spark):
    assert judged(spark, ["http://a.org/x"], [], []) == [("a.org", "/x", None, None, "allow")]
    assert judged(spark, []) == []
    with pytest.raises(ValueError):
        UrlRule("block", "/path/only")
    with pytest.raises(ValueError):
        UrlRule("deny", "org/")


def test_no_python_and_no_shuffle_on_the_main_path(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = judge_urls(pages, "page_id", "url", RULES, PATTERNS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "html" not in plan
