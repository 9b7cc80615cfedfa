"""Context labels (controller, action, job tag) from comments in the statement."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload_lens.config import CONTEXT_PATTERNS

# Only a line feed ends a line, so that "." also crosses the rarer Unicode line ends.
_LINE_FEED_ONLY = "(?d)"
# A last group that is one or more of a character class is never empty.
_NEVER_EMPTY = re.compile(r"\(\[(?:\\.|[^\]\\])+\]\+\)(?!.*\((?!\?))")
_END_OF_COMMENT = r"\*/"
# A pattern that begins like this can match from the first comment of a line if it can from a
# later one, so the others need not be tried: else every comment would walk the same line.
_ANY_COMMENT = r"/\*.*"
_FIRST_COMMENT = r"(?<![^\n])(?:(?!/\*)[^\n])*+/\*.*"


def _in_java(pattern: str) -> str:
    if pattern.startswith(_ANY_COMMENT) and not pattern.startswith(_ANY_COMMENT + "?"):
        pattern = _FIRST_COMMENT + pattern[len(_ANY_COMMENT) :]
    return _LINE_FEED_ONLY + pattern.replace("(?P<", "(?<")


def _usable(pattern: str) -> bool:
    return bool(pattern) and re.compile(pattern).groups > 0


def extract_context(
    df: DataFrame, text: str = "query", patterns: dict[str, str] | None = None
) -> DataFrame:
    """Add one nullable label column per pattern; the text must still have its comments.

    A label is the last capture group of the first match: NULL without a match or without a
    group, and the empty string if the group matched nothing. The number of groups is known
    when the plan is built.
    """
    patterns = CONTEXT_PATTERNS if patterns is None else patterns
    usable = {label: p for label, p in patterns.items() if _usable(p)}
    # A match that ends with the end of a comment cannot reach past the last one, so the
    # patterns need not search the statement behind it.
    comments, whole = "context_comments", F.col(text)
    behind = F.length(F.substring_index(text, "*/", -1))
    df = df.withColumn(comments, F.left(text, F.length(text) - behind))
    subject = {
        label: F.col(comments) if p.endswith(_END_OF_COMMENT) else whole
        for label, p in usable.items()
    }
    df = df.withColumns(
        {
            label: F.regexp_extract(subject[label], _in_java(p), re.compile(p).groups)
            if label in usable
            else F.lit(None).cast("string")
            for label, p in patterns.items()
        }
    )
    labels = {}
    for label, p in usable.items():
        labels[label] = F.when(F.col(label) != "", F.col(label))
        if not _NEVER_EMPTY.search(p):
            matched = F.rlike(subject[label], F.lit(_in_java(p)))
            labels[label] = labels[label].when(matched, F.lit(""))
    return (df.withColumns(labels) if labels else df).drop(comments)
