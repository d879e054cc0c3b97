"""Subject filters that come as a table, for lists too long for one expression.

A subject is compared only with filters that share a key with it. An exact name is its
own key. A pattern is filed under one stretch of its literal text: its beginning or end,
whichever is longer, or else a piece from between two stars. Every distinct subject
offers its own beginnings, ends and short pieces, an equality join brings the two
together, and only the filters found are tested as regular expressions.

The rules are those of ``functions.globs``: ``.`` is literal, ``*`` is any text, other
regular-expression characters keep their meaning. A pattern that holds such characters,
or only stars, has no literal text to be filed under and meets every distinct subject;
those should be few. Null filters are ignored; null subjects match nothing; an empty
table matches nothing. A broken pattern fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a beginning or end that make a key; longer ones are cut.
KEY_LENGTH = 32

#: Characters of a key from between two stars. A piece is of this length or, if the
#: pattern has none as long, of fewer.
PIECE_LENGTH = 3

_PLAIN = r"\A[A-Za-z0-9_\-.:/* ]*\z"


def _key(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def filter_index(filters: DataFrame, column: str = "filter") -> DataFrame:
    """Distinct filters with their key (kind, text) and, for patterns, their regex."""
    name = F.col(column)
    literals = F.split(name, r"\*")
    first = F.left(F.get(literals, F.lit(0)), F.lit(KEY_LENGTH))
    last = F.right(F.get(literals, F.size(literals) - 1), F.lit(KEY_LENGTH))
    sized = F.transform(literals, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    longest = F.array_max(sized)
    piece = F.left(longest["x"], F.lit(PIECE_LENGTH))
    key = (
        F.when(~name.contains("*"), _key("exact", name))
        .when(~name.rlike(_PLAIN) | (longest["n"] == 0), _key("any", F.lit("")))
        .when((F.length(first) >= F.length(last)) & (first != ""), _key("first", first))
        .when(last != "", _key("last", last))
        .otherwise(_key("piece", piece))
    )
    body = F.replace(F.replace(name, F.lit("."), F.lit(r"\.")), F.lit("*"), F.lit(".*"))
    regex = F.when(name.contains("*"), F.concat(F.lit(r"\A(?:"), body, F.lit(r")\z")))
    distinct = filters.where(name.isNotNull()).select(column).distinct()
    return distinct.select(key.alias("key"), regex.alias("regex")).select("key.*", "regex")


def _offered(subject: Column) -> Column:
    """The keys a subject offers."""
    length = F.length(subject)

    def numbers(stop: Column) -> Column:
        return F.when(stop > 0, F.sequence(F.lit(1), stop)).otherwise(F.array().cast("array<int>"))

    def pieces_of(size: int) -> Column:
        starts = numbers(length - (size - 1))
        return F.transform(starts, lambda i: _key("piece", F.substring(subject, i, F.lit(size))))

    ends = numbers(F.least(length, F.lit(KEY_LENGTH)))
    pieces = [pieces_of(size) for size in range(1, PIECE_LENGTH + 1)]
    return F.concat(
        F.array(_key("exact", subject), _key("any", F.lit(""))),
        F.transform(ends, lambda n: _key("first", F.left(subject, n))),
        F.transform(ends, lambda n: _key("last", F.right(subject, n))),
        F.array_distinct(F.concat(*pieces)),
    )


def matched_subjects(subjects: DataFrame, filters: DataFrame, column: str = "filter") -> DataFrame:
    """The distinct subjects (``subject``) that a filter of the table matches."""
    index = filter_index(filters, column)
    distinct = subjects.where("subject IS NOT NULL").select("subject").distinct()
    keys = distinct.select("subject", F.explode(_offered(F.col("subject"))).alias("key"))
    found = keys.select("subject", "key.kind", "key.text").join(index, ["kind", "text"])
    hit = F.col("regex").isNull() | F.rlike(F.col("subject"), F.col("regex"))
    return found.where(hit).select("subject").distinct()


def in_filter_table(events: DataFrame, filters: DataFrame, column: str = "filter") -> DataFrame:
    """The events whose event_subject a filter of the table matches.

    No hint: Spark broadcasts the matched subjects if their size allows; otherwise a hot
    subject's events are split at run time.
    """
    subjects = events.select(F.col("event_subject").alias("subject"))
    matched = matched_subjects(subjects, filters, column).withColumnRenamed("subject", "event_subject")
    return events.join(matched, "event_subject", "left_semi").select(*events.columns)
