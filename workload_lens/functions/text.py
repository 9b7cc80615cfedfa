"""Statement texts: placeholders for constants, and fingerprints that ignore accidents.

Everything is a chain of ``regexp_replace`` over a Spark column. Two rules keep the chain
safe on texts of any length: closures over alternatives are possessive (the JVM runs those
in a loop, not by recursion), and no pattern can restart inside a run it has just walked.

The chain never looks at a parse tree, so it is the grouping that matters, not the hash:
comments, case, white space, constants, schema names, role names, fetch counts, cursor
numbers, temp-table suffixes and generated index or table names do not change it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- lexical elements ---------------------------------------------------------------------
_QUOTED_NAME = r'"(?:[^"]++|"")*+"'
_COMMENT = (
    r"--[^\n\x01]*+"
    r"|/\*(?:[^*/]++|\*(?!/)|/(?!\*)|/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/)*+\*/"
)
_ESCAPE_BODY = r"(?:[^'\\]++|\\.|'')*+"
_PLAIN_BODY = r"(?:[^']++|'')*+"
_NUMBER = (
    r"(?<![\w$.])(?:0[xX][0-9a-fA-F_]++|(?:\d[\d_]*+(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?)(?!\w)"
)
_PARAMETER = r"\$\d++"
_NAME = r'(?:[\w$]++|"(?:[^"]++|"")*+")'

# Every element that can hide another one, in one left-to-right pass. Only quoted names
# keep their text; a string literal leaves its two quotes, a dollar-quoted one two dollars,
# a comment nothing. What is left of an unterminated element is an odd quote or "/*".
_HIDING = (
    r"(?s)(?=[-/$'\"bBeEnNuUxX])(?:"
    rf"({_QUOTED_NAME})"
    rf"|(?<![\w$])[eE](')(?:{_ESCAPE_BODY})(')"
    rf"|(?:(?<![\w$])(?:[bBxXnN]|[uU]&))?(')(?:{_PLAIN_BODY})(')"
    # One that is not closed hides all that follows, so no later tag walks the same text again.
    r"|(?<![\w$])(\$)((?:[A-Za-z_]\w*+)?)\$(?:.*?\$\7(\$)|.*+)"
    rf"|{_COMMENT})"
)
_HIDING_KEEP = "$1$2$3$4$5$6$8 "

_WELL_FORMED = (
    rf"(?s)\A(?:[^'\"/$]++|''|\$\$|\$(?=\d)|(?<=[\w$])\$|{_QUOTED_NAME}|/(?!\*))*+\z"
)
_BLANK = r"\A[\s;]*+\z"
_CONSTANT = rf"''|\$\$|{_PARAMETER}|{_NUMBER}"

_SPACE_AT_PUNCTUATION = r' (?:(?=[^\w\s"$?])|(?<=[^\w\s"$?] ))'

# --- names that differ from run to run -----------------------------------------------------
_TEMP_TABLE = r"(?i)(?<![\w$])([\w$]+)_temp_table_[0-9a-z]{6,}+([\w$]*+)"
_CURSOR = r"(?i)(?<![\w$-])([\w$-]+)[_-]cursor_[0-9a-z]++([\w$]*+)"

# Words that end a FROM list, and words before FROM that make it something
# other than the start of a list of relations.
_AFTER_FROM_LIST = (
    "where group order having limit offset fetch union intersect except window for on using "
    "set values returning join left right full inner cross natural"
).split()
_NOT_A_LIST = (
    "distinct both leading trailing epoch century decade year quarter month week day dow doy "
    "hour minute second"
).split()

_FROM = rf"\bfrom (?<!\b(?:{'|'.join(_NOT_A_LIST)}) from )"
_LIST_WORD = rf'(?:(?!(?:{"|".join(_AFTER_FROM_LIST)})\b)[\w$."?]++ ?)'
_FROM_LIST_COMMA = rf"(?i)({_FROM}|(?!\A)\G)({_LIST_WORD}++),"
# Statements on a list of relations without FROM.
_STATEMENT_LIST_COMMA = (
    r"(?i)(\A(?:truncate|lock|analyze|vacuum) (?:table )?(?:only )?|(?!\A)\G)"
    rf"({_LIST_WORD}++),"
)
_LIST_MARK = "\x02"
_SCHEMA = rf"(?:{_NAME}\.){{1,2}}"
_SCHEMA_BEFORE_RELATION = (
    rf'(?i)((?:{_FROM}|\bjoin |\busing |{_LIST_MARK})(?:only )?){_SCHEMA}(?=[\w"])(?!{_NAME}\()'
    r"|(\b(?:(?:into|update|table|truncate|lock|copy|analyze|vacuum|references|view|cluster|sequence)"
    r'|index \S++ on) (?:if (?:not )?exists )?(?:only )?)'
    rf'{_SCHEMA}(?=[\w"])'
)
# Names that tools generate count only where a relation or an index stands.
_GENERATED_TABLE = (
    rf"(?i)((?:{_FROM}|\b(?:join|using|into|update|table|truncate|lock|copy|analyze|vacuum|references|cluster) "
    rf"|\bindex \S++ on |{_LIST_MARK})(?:if (?:not )?exists )?(?:only )?(?:some_schema\.)?)table_\d++(?![\w$])"
)
_GENERATED_INDEX = (
    rf"(?i)(\bindex (?:concurrently )?(?:if (?:not )?exists )?(?:{_NAME}\.)?)index_\d++(?![\w$])"
)

_UNARY_MINUS = (
    r"(?i)([=<>(,*/%|\[+]|\b(?:select|when|then|else|and|or|between|limit|offset|in|like|by) )-\?"
)
_ROLE_LIST = rf"{_NAME}(?:,{_NAME})*+"
_ROLE_STATEMENT = r"\A(?:set|grant|revoke|alter|create|drop|reassign)\b"
_ROLE = (
    r"(\A(?:set (?:session |local )?(?:role|authorization)|(?:alter|drop) (?:role|user|group)"
    rf"(?: if exists)?) |\b(?:owner to|authorization|owned by) ){_ROLE_LIST}"
)
_GRANTEE = rf"\A((?:grant\b.* to|revoke\b.* from|reassign\b.* to) ){_ROLE_LIST}"
_FETCH = (
    r"\A(fetch|move)(?: next| forward)?(?: all| -?\?)?(?: from| in)? "
    r"(?!backward|prior|absolute|relative|first|last|forward|next|all|from|in)"
)
_FETCH_STATEMENT = r"\A(?:fetch|move)\b"
_FETCH_BACK = r"\A(fetch|move) (?:prior|backward)(?: all| -?\?)?(?: from| in)? "
_FETCH_ABSOLUTE = r"\A(fetch|move) (?:first|last|absolute -?\?)(?: from| in)? "

_IN_LIST = r"\bin\((\?)(?:,\?)++\)"
_VALUES_LIST = r"\bvalues(\([^()]*+\))(?:,\([^()]*+\))++"


def _chain(col: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def add_canonical_text(
    df: DataFrame, text: str = "query", name: str = "canonical", collapse_lists: bool = False
) -> DataFrame:
    """Add the lower-case statement in which nothing is left that may differ by accident.

    Also adds ``<name>_bare``, the statement without comments and literals. Each stage is a
    projection of its own: a column that later ones read several times is computed once.
    """
    bare, masked, plain = f"{name}_bare", f"{name}_masked", f"{name}_plain"
    df = df.withColumn(bare, F.regexp_replace(text, _HIDING, _HIDING_KEEP))
    df = df.withColumn(
        masked,
        _chain(
            F.col(bare),
            (r'"([a-z_][a-z0-9_]*+)"', "$1"),
            (_CONSTANT, "?"),
            (r"\s++", " "),
            (_SPACE_AT_PUNCTUATION, ""),
            (r"\A[ ;]++|[ ;]++\z", ""),
            (_UNARY_MINUS, "$1?"),
            (_FROM_LIST_COMMA, f"$1$2,{_LIST_MARK}"),
            (_STATEMENT_LIST_COMMA, f"$1$2,{_LIST_MARK}"),
            (_SCHEMA_BEFORE_RELATION, "$1$2some_schema."),
            (_GENERATED_TABLE, "$1some_table"),
            (_GENERATED_INDEX, "$1some_index"),
            (_LIST_MARK, ""),
            (_TEMP_TABLE, "$1_temp_table_x$2"),
            (_CURSOR, "$1_cursor_x$2"),
        ),
    )
    # Quoted names that need their quotes keep their case, so they also go to the end.
    names = F.regexp_extract_all(masked, F.lit(f"({_QUOTED_NAME})"))
    df = df.withColumns({plain: F.lower(masked), name: F.array_join(names, ",")})
    roles = _chain(F.col(plain), (_ROLE, "$1some_role"), (_GRANTEE, "$1some_role"))
    fetch = _chain(
        F.col(plain),
        (_FETCH_BACK, "$1 backward ? from "),
        (_FETCH_ABSOLUTE, "$1 absolute ? from "),
        (_FETCH, "$1 ? from "),
    )
    final = (
        F.when(F.rlike(plain, F.lit(_ROLE_STATEMENT)), roles)
        .when(F.rlike(plain, F.lit(_FETCH_STATEMENT)), fetch)
        .otherwise(F.col(plain))
    )
    if collapse_lists:
        final = _chain(final, (_IN_LIST, "in($1)"), (_VALUES_LIST, "values$1"))
    return df.withColumn(name, F.concat_ws(" ", final, F.nullif(name, F.lit("")))).drop(
        masked, plain
    )


def add_fingerprint(
    df: DataFrame,
    text: str = "query",
    collapse_lists: bool = False,
) -> DataFrame:
    """Add ``fingerprint`` and ``reject_reason``; exactly one of the two is NULL.

    Empty statements are rejected. One that cannot be split into lexical elements falls
    back to the key of its raw text, unless it names a cursor or a temp table: those would
    add one key per use.
    """
    df = add_canonical_text(df, text, "canonical", collapse_lists)
    bare = F.col("canonical_bare")
    blank = F.coalesce(F.rlike(bare, F.lit(_BLANK)), F.lit(True))
    well_formed = F.rlike(bare, F.lit(_WELL_FORMED))
    grows_with_use = F.rlike(text, F.lit(f"{_TEMP_TABLE}|{_CURSOR}"))
    df = df.withColumn("well_formed", well_formed).withColumn(
        "reject_reason",
        F.when(blank, "empty").when(~F.col("well_formed") & grows_with_use, "unfingerprintable"),
    )
    key = F.md5(F.when(F.col("well_formed"), F.col("canonical")).otherwise(F.col(text)))
    return df.withColumn("fingerprint", F.when(F.col("reject_reason").isNull(), key)).drop(
        "canonical", "canonical_bare", "well_formed"
    )


_PLACEHOLDER_MARK = "\x01"
_KEPT = rf"{_QUOTED_NAME}|{_COMMENT}"
_KEPT_OR_CONSTANT = (
    rf"(?s)({_KEPT})"
    rf"|(?<![\w$])[eE]'(?:{_ESCAPE_BODY})'"
    rf"|(?:(?<![\w$])(?:[bBxXnN]|[uU]&))?'(?:{_PLAIN_BODY})'"
    r"|(?<![\w$])\$((?:[A-Za-z_]\w*+)?)\$(?:.*?\$\2\$|.*+)"
    rf"|{_PARAMETER}|{_NUMBER}"
)


def normalized_text(text: Column | str) -> Column:
    """The statement as it was written, with a ``?`` for every constant and parameter."""
    raw = F.col(text) if isinstance(text, str) else text
    return _chain(
        raw,
        (_KEPT_OR_CONSTANT, f"$1{_PLACEHOLDER_MARK}"),
        (rf"({_KEPT}){_PLACEHOLDER_MARK}", "$1"),
        (_PLACEHOLDER_MARK, "?"),
    )


def statement_preview(text: Column | str, length: int = 250) -> Column:
    """One line of at most ``length`` characters."""
    raw = F.col(text) if isinstance(text, str) else text
    return F.left(F.translate(raw, "\n", " "), F.lit(length))
