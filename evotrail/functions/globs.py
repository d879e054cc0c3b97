"""Subject filters: exact names and ``*`` patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[\w\-.:/* ]*", re.ASCII)


def glob_regex(glob: str) -> str:
    """The regular expression of a pattern: ``.`` is literal and ``*`` is any text.

    Other regular-expression characters keep their meaning.
    """
    return glob.replace(".", r"\.").replace("*", ".*")


def _whole(body: str) -> str:
    # rlike searches inside the text, so the match is tied to both ends.
    return rf"\A(?:{body})\z"


def subject_regexes(filters: Sequence[str]) -> list[str]:
    """Regexes that cover every filter with a ``*``.

    Plain patterns share one regex. A pattern with live regex characters gets
    its own, so that its groups cannot mix with those of another pattern.
    """
    globs = [f for f in filters if "*" in f]
    plain = [glob_regex(g) for g in globs if _PLAIN.fullmatch(g)]
    special = [glob_regex(g) for g in globs if not _PLAIN.fullmatch(g)]
    joined = ["|".join(plain)] if plain else []
    return [_whole(body) for body in joined + special]


def matches_any(subject: Column, filters: Sequence[str]) -> Column:
    """True where the subject equals an exact filter or fully matches a pattern.

    A null subject matches nothing. Without filters everything else matches.
    """
    if not filters:
        return F.lit(True)
    exact = [f for f in filters if "*" not in f]
    hit = subject.isin(exact) if exact else F.lit(False)
    for regex in subject_regexes(filters):
        hit = hit | subject.rlike(regex)
    return subject.isNotNull() & hit


def check_globs(spark: SparkSession, filters: Sequence[str]) -> None:
    """Raise now, on the driver and without a job, if a pattern is not a valid regex."""
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    for glob in filters:
        if "*" in glob:
            try:
                pattern.compile(_whole(glob_regex(glob)))
            except IllegalArgumentException as error:
                raise ValueError(f"subject filter {glob!r} is not a valid pattern") from error
