"""Text kernel: shared normalisation, names, dates and tokens as columns.

`norm` has two forms. `norm_ascii` stays in the JVM and is exact for text whose only non-ASCII
characters need no compatibility folding; `norm` is an Arrow UDF with full NFKC and case folding.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# Typographic marks and what they are compared as.
_FOLDED = {"’": "'", "‘": "'", "“": '"', "”": '"', "—": "-", "–": "-"}


def norm_text(text: str) -> str:
    if not text.isascii():  # else there is nothing to fold but case
        text = unicodedata.normalize("NFKC", text)
        for mark, plain in _FOLDED.items():  # a mark that does not occur costs a scan, not a look at each character
            text = text.replace(mark, plain)
    return " ".join(text.casefold().split())


@F.pandas_udf(StringType())
def norm(texts: pd.Series) -> pd.Series:
    return texts.map(norm_text, na_action="ignore")


def norm_ascii(c: Column) -> Column:
    c = F.lower(F.translate(c, "".join(_FOLDED), "".join(_FOLDED.values())))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def contains_verbatim(haystack: Column, needle: Column) -> Column:
    """Both sides already normalised; the empty needle is contained in everything."""
    return F.contains(haystack, needle)


@F.pandas_udf(StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    strip = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return texts.map(strip, na_action="ignore")


def name_key(c: Column) -> Column:
    """Order- and accent-insensitive key of a name."""
    return F.array_join(F.array_sort(F.filter(F.split(fold_accents(norm(c)), " "), lambda w: w != "")), " ")


@F.pandas_udf(ArrayType(BooleanType()))
def holds(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Whether each of a row's needles stands verbatim in its text, both normalised; an empty one does, a null text holds none."""

    def held(text: str | None, asked) -> list[bool] | None:
        normed = None if text is None else norm_text(text)
        return None if asked is None else [normed is not None and n is not None and norm_text(n) in normed for n in asked]

    return pd.Series([held(text, asked) for text, asked in zip(texts, needles, strict=True)], dtype=object)


# Elements whose content is not shown, and all else that is no text; of nested hidden elements the innermost first.
_HIDDEN = re.compile(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_HIDDEN_TREE = re.compile(r"(?is)<(noscript|template)\b[^>]*>(?:(?!<(?:noscript|template)\b).)*?(?:</\1\s*>|\Z)")
_TAG = re.compile(r"(?s)</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>")


def shown_text(page: str) -> str:
    """What a page shows, words between single spaces: all else is cut out, then references are resolved."""
    left = _HIDDEN.sub(" ", page)
    while _HIDDEN_TREE.search(left):
        left = _HIDDEN_TREE.sub(" ", left)
    return " ".join(html.unescape(_TAG.sub(" ", left)).split())


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """`shown_text` of each page."""
    return pages.map(shown_text, na_action="ignore")


def readable_text(c: Column) -> Column:
    """Visible text of what starts like HTML; anything else as it is."""
    return F.when(F.ltrim(c).startswith("<"), html_to_text(c)).otherwise(c)


@F.pandas_udf(ArrayType(StringType()))
def standing(pages: pd.Series, quotes: pd.Series) -> pd.Series:
    """A document's quotes, normalised, in their order; null where one is blank or not in the document's readable text.

    One pass over document and quotes in one worker: the normalised text never comes back, only quotes do.
    """

    def held(page: str | None, asked) -> list[str | None] | None:
        if asked is None:
            return None
        shown = "" if page is None else norm_text(shown_text(page) if page.lstrip(" ").startswith("<") else page)
        normed = ["" if q is None else norm_text(q) for q in asked]
        return [q if q and q in shown else None for q in normed]

    return pd.Series([held(page, asked) for page, asked in zip(pages, quotes, strict=True)], dtype=object)


def words(c: Column) -> Column:
    """Non-empty words between Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def claim_tokens(normed: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normed, " "), lambda w: w != ""))


def story_tokens(normed: Column) -> Column:
    """Tokens without edge punctuation, longer than one character."""
    bare = F.transform(F.split(normed, " "), lambda w: F.regexp_replace(w, r"(?U)^[^\w]+|[^\w]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def specificity(c: Column) -> Column:
    """Numeric tokens plus dollar and per cent signs."""
    return (F.regexp_count(c, F.lit(r"\d[\d.,]*")) + F.regexp_count(c, F.lit("[$%]"))).cast("double")


def term_pattern(term: str) -> str:
    """Java pattern of a phrase: any white space between words, and a boundary at an end that is a word character."""
    edge = lambda c: r"\b" if c.isalnum() or c == "_" else ""
    return "(?iU)" + edge(term[0]) + r"\s+".join(map(re.escape, term.split())) + edge(term[-1]) if term.strip() else "(?!)"


# Where pages state their publication date.
_STATED = (
    r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})',
    r'property="article:published_time"\s+content="(\d{4}-\d{2}-\d{2})',
    r'<time[^>]+datetime="(\d{4}-\d{2}-\d{2})',
)
# A date in words, and how far from the first heading it may stand.
_BYLINE = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},\s+(?:19|20)\d{2})"
_NEAR_HEADING = 400


def page_published(html: Column) -> Column:
    """yyyy-MM-dd that the page states, else a date shown shortly after its first heading."""
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in _STATED]
    at = F.regexp_instr(html, F.lit(r"<h1[\s>]"))
    shown = F.when(at > 0, F.regexp_extract(F.substr(html, at, F.lit(_NEAR_HEADING)), _BYLINE, 1))
    day = F.concat_ws(" ", F.substring(shown, 1, 3), F.regexp_extract(shown, r"(\d{1,2}),", 1), F.regexp_extract(shown, r"(\d{4})$", 1))
    return F.coalesce(*found, F.date_format(F.try_to_date(F.when(shown != "", day), "MMM d yyyy"), "yyyy-MM-dd"))


def recency(published: Column, as_of: Column, scale_days: float = 30.0, neutral: float = 0.5) -> Column:
    """exp(-whole days / scale), not above 1; neutral if there is no date."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(published)) / 86_400_000_000)
    return F.when(days.isNull(), neutral).otherwise(F.exp(-F.greatest(F.lit(0), days) / scale_days))


def first_line_title(c: Column, most: int = 120) -> Column:
    return F.substring(F.substring_index(c, "\n", 1), 1, most)


def parse_rfc822(c: Column) -> Column:
    """RFC 822 dates as ISO text, anything else unchanged."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\s+(?:GMT|UTC?|Z)$", " +0000")
    at = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"), c)


def parse_iso_any(c: Column) -> Column:
    """Full ISO, Z or bare date; UTC where no offset is given."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]")), F.try_to_timestamp(c))


def paragraph_index(c: Column, quote: Column, head: int = 40) -> Column:
    """Place, from 0, of the first block between empty lines that holds the quote's first characters; null if none does."""
    holds = F.transform(F.split(c, "\n\n"), lambda p: F.contains(p, F.substring(quote, 1, head)))
    return F.nullif(F.array_position(holds, True), F.lit(0)) - 1


def repo_slug(url: Column) -> Column:
    """owner/repository of a repository's url, or of a bare path; null without both."""
    return F.nullif(F.regexp_extract(url, r"(?s)^(?:.*?github\.com/)?+([^/]*/[^/]*)", 1), F.lit(""))


def append_absent(array: Column, value: Column) -> Column:
    """The array with the value at its end if it lacks it; a null array is empty, a null value adds nothing."""
    has = F.coalesce(F.array_contains(array, value), F.lit(False))
    return F.when(value.isNull() | has, array).when(array.isNull(), F.array(value)).otherwise(F.array_append(array, value))
