"""Text cleaning, hashing, tokens, sentences and extractive summaries."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words the analyzer drops.
STOPWORDS = """
a an the is are was were be been being
have has had do does did will would could
should may might shall can need dare ought
used to of in for on with at by from
as into through during before after above below
between out off over under again further then
once and but or nor not so yet both either
neither each every all any few more most other
some such no only own same than too very
just because if when where how what which who
whom this that these those it its i me my
we our you your he him his she her they
them their
""".split()

# The JVM's Unicode whitespace lacks the four C0 separators that text here also splits on.
SPACE = r"[\s\x1C-\x1F]"


def strip(c: Column) -> Column:
    """Trim every Unicode whitespace character, not just blanks."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


@F.pandas_udf(StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Replace HTML entities. Only rows with an ampersand carry their text to Python."""
    return F.coalesce(_decode_entities(F.when(c.contains("&"), c)), c)


def decode_utf8(c: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def clean_html(c: Column) -> Column:
    """Plain text of a page: no scripts, styles or tags, entities decoded, whitespace collapsed."""
    bare = F.regexp_replace(c, r"(?isu)<(script|style)[^>]*>.*?</\1>", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    return strip(F.regexp_replace(unescape(bare), rf"(?U){SPACE}+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def title(c: Column, width: int = 100) -> Column:
    """First line, trimmed and cut."""
    return F.substring(strip(F.substring_index(c, "\n", 1)), 1, width)


def analyze(c: Column) -> Column:
    """Lower-cased ASCII alphanumeric tokens without stopwords, in order."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?``; a terminator never stands as a sentence's first character's end."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(.[^.!?]*[.!?]|.+)"), 1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def token_count(c: Column) -> Column:
    """Estimated model tokens: a word up to six characters is one, a longer one a quarter of its length."""
    per_word = F.transform(
        words(c), lambda w: F.when(F.length(w) <= 6, F.lit(1)).otherwise(F.floor(F.length(w) / 4).cast("int"))
    )
    total = F.aggregate(per_word, F.lit(0), lambda acc, n: acc + n)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), total))


def valid_summary(c: Column) -> Column:
    return F.coalesce(token_count(c).between(1, 512), F.lit(False))


def summary(c: Column, max_tokens: int = 512) -> Column:
    """Leading sentences that fit four characters per token; NULL for blank text."""
    budget = max(1, min(max_tokens, 512)) * 4
    start = F.struct(
        F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"), F.lit(0).alias("taken")
    )

    def add(acc, s):
        fits = acc["used"] + F.length(s) + 1 <= budget
        first = acc["taken"] == 0
        grown = F.when(first, s).otherwise(F.concat(acc["text"], F.lit(" "), s))
        return F.when(acc["full"], acc).otherwise(
            F.struct(
                F.when(fits, grown)
                .when(first, F.substring(s, 1, budget))
                .otherwise(acc["text"])
                .alias("text"),
                F.when(fits, acc["used"] + F.length(s) + 1).otherwise(acc["used"]).alias("used"),
                (~fits).alias("full"),
                (acc["taken"] + 1).alias("taken"),
            )
        )

    return F.when(F.length(strip(c)) > 0, F.aggregate(sentences(c), start, add, lambda acc: acc["text"]))
