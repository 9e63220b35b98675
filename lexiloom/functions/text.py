"""Text functions as column expressions.

Everything here is a composition of built-in Spark SQL functions, so it stays
in the JVM and inside the scan stage: none of it moves a row.

Regular expressions spell out Unicode classes instead of relying on ``\\b`` and
``\\w``, whose meaning differs between JDK versions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import STOP_WORDS

# White space as Unicode defines it, plus the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class; an explicit class is much faster than (?U).
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_SPACE = SPACE.replace("[", "[^", 1)
_WORD = r"[\p{L}\p{N}_]"
_BEFORE = rf"(?<!{_WORD})"
_AFTER = rf"(?!{_WORD})"

# What counts as a token in each of the four vocabularies.
WORD_TOKEN = rf"{_BEFORE}[a-zA-Z0-9]+(?:[-'][a-zA-Z0-9]+)*{_AFTER}"
KEYWORD_TOKEN = rf"{_BEFORE}[a-zA-Z]{{3,}}(?:-[a-zA-Z]{{3,}})*{_AFTER}"
SEARCH_TOKEN = rf"{_BEFORE}[a-zA-Z0-9]{{2,}}{_AFTER}"
CLASSIFIER_TOKEN = rf"{_WORD}{{2,}}"

# Patterns of cleaning, paragraphs and sentences.
# The controls \x00-\x08, \x0b-\x1f and \x7f-\x9f (but CR, long gone), as what is none: usual characters leave at the first range.
CONTROLS = r"[^\x20-\x7e\xa0-\x{10ffff}\t\n\r]"
SPACE_RUNS = r"[ \t]+"
BLANK_LINE_RUNS = r"\n{3,}"
PARAGRAPH_BREAK = rf"\n{SPACE}*\n+"
SENTENCE_END, SENTENCE_START = "[.!?]", """[A-Z0-9"']"""
SENTENCE_BREAK = rf"(?<={SENTENCE_END}){SPACE}+(?={SENTENCE_START})"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes only U+0020)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_text(text: Column) -> Column:
    """ASCII quotes and dashes, LF line ends, no controls, collapsed space."""
    return strip(clean_inner(text))


def clean_inner(text: Column) -> Column:
    """``clean_text`` with the white space at both ends left on."""
    c = F.coalesce(text, F.lit(""))
    for raw, plain in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", " - "), ("—", " - "), ("\r\n", "\n"), ("\r", "\n")):
        c = F.replace(c, F.lit(raw), F.lit(plain))
    c = F.regexp_replace(c, CONTROLS, "")
    c = _mended(c, lambda t: t.contains("  ") | t.contains("\t"), lambda t: F.regexp_replace(t, SPACE_RUNS, " "))
    return _mended(c, lambda t: t.contains("\n\n\n"), lambda t: F.regexp_replace(t, BLANK_LINE_RUNS, "\n\n"))


def _mended(text: Column, needed: Callable[[Column], Column], mend: Callable[[Column], Column]) -> Column:
    """``mend`` for the texts that need it, which a cheap search tells; ``text`` is computed once."""
    return F.get(F.transform(F.array(text), lambda t: F.when(needed(t), mend(t)).otherwise(t)), F.lit(0))


def _pieces(cleaned: Column, boundary: str) -> Column:
    parts = F.transform(F.split(cleaned, boundary, -1), strip)
    return F.filter(parts, lambda p: p != "")


def paragraphs(cleaned: Column) -> Column:
    """Paragraphs of an already cleaned text: blank lines separate them."""
    return _pieces(cleaned, PARAGRAPH_BREAK)


def sentences(cleaned: Column) -> Column:
    """Sentences of an already cleaned text.

    A boundary is white space after ``. ! ?`` and before an ASCII capital,
    a digit or a quote. Abbreviations are not special.
    """
    return _pieces(cleaned, SENTENCE_BREAK)


def word_tokens(text: Column, lower: bool = True) -> Column:
    """ASCII words with inner hyphens or apostrophes."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(WORD_TOKEN), F.lit(0))


def keyword_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(KEYWORD_TOKEN), F.lit(0))


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SEARCH_TOKEN), F.lit(0))


def classifier_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CLASSIFIER_TOKEN), F.lit(0))


def has_plain_keyword(text: Column) -> Column:
    """True only if the text surely has a keyword token that is no stop word.

    A cheap test that stops at the first hit. It does not look at hyphen
    compounds, so False means "look closer".
    """
    stops = "|".join(STOP_WORDS)
    return text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_-])(?!(?:{stops}){_AFTER})[a-z]{{3,}}(?![\p{{L}}\p{{N}}_-])")


def stop_word_list(extra: Iterable[str] | None = None) -> list[str]:
    """The default stop words, plus the caller's own."""
    return sorted(set(STOP_WORDS) | {w.lower() for w in extra or ()})


def without_stop_words(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def preprocess_for_ml(text: Column, extra_stop_words: Iterable[str] | None = None) -> Column:
    """Lower-case words of the raw text without stop words, short words and numbers."""
    kept = F.filter(
        without_stop_words(word_tokens(text), stop_word_list(extra_stop_words)),
        lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$"),
    )
    return F.array_join(kept, " ")


def terms(tokens: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """All n-grams of a token array, repeats kept; n-grams are joined by a space.

    Longer n-grams come from one look-ahead scan over the joined tokens, which
    is several times faster than building them with array lambdas.
    """
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError(f"bad ngram_range {ngram_range}")
    joined = F.array_join(tokens, " ")
    grams = [
        tokens if n == 1 else F.regexp_extract_all(
            joined, F.lit(r"(?<!\S)(?=(\S+" + r" \S+" * (n - 1) + r"))"), F.lit(1)
        )
        for n in range(low, high + 1)
    ]
    return F.concat(*grams)


def regex_quote(text: Column) -> Column:
    """Escape a literal for use inside a pattern."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}_\s])", r"\\$1")


def whole_word_count(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in the text between non-word characters.

    The literal comes first and the look-behind after it, so the scan tests
    its boundaries only where the phrase already matched.
    """
    literal = regex_quote(phrase)
    pattern = F.concat(literal, F.lit(rf"(?<!{_WORD}"), literal, F.lit(f"){_AFTER}"))
    return F.size(F.regexp_extract_all(text, pattern, F.lit(0)))


def highlight_tokens(query: Column) -> Column:
    """Query words to mark: no stop words, no single characters.

    If nothing is left, all words of the query are marked.
    """
    words = word_tokens(query)
    kept = F.filter(without_stop_words(words), lambda t: F.length(t) > 1)
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def _token_pattern(tokens: Column) -> Column:
    quoted = F.array_join(F.transform(tokens, regex_quote), "|")
    return F.concat(F.lit(rf"(?iu){_BEFORE}("), quoted, F.lit(rf"){_AFTER}"))


def _html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlight(text: Column, tokens: Column) -> Column:
    """HTML-safe text with every token occurrence in a mark tag.

    Matches are put between two control characters first (cleaned text holds
    none), then the text is escaped and the control characters become tags, so
    unmatched text is escaped as well.
    """
    marked = F.when(
        F.size(tokens) > 0, F.regexp_replace(text, _token_pattern(tokens), F.lit("\u0001$1\u0002"))
    ).otherwise(text)
    safe = _html_escape(marked)
    safe = F.replace(safe, F.lit("\u0001"), F.lit('<mark class="search-match">'))
    return F.replace(safe, F.lit("\u0002"), F.lit("</mark>"))


def matched_terms(text: Column, tokens: Column) -> Column:
    """Sorted distinct lower-cased matches of the tokens in the text."""
    found = F.regexp_extract_all(text, _token_pattern(tokens), F.lit(1))
    return F.when(
        F.size(tokens) > 0, F.sort_array(F.array_distinct(F.transform(found, F.lower)))
    ).otherwise(F.array().cast("array<string>"))
