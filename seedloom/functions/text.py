"""Text rules as Column expressions; all run inside the JVM.

White space, word characters and line ends are those of Unicode, spelt out as classes because regular expression
engines differ in what their shorthands mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends of Unicode, the label domain, prompt wording, function words.
SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: the same white space as characters
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
WORD = r"\p{L}\p{N}_"
LABELS = ("Non-sensitive", "Sensitive")
PARSE_FAILED = "__PARSE_FAILED__"
LABEL_PREFIX = f"(?i)^[{SPACE}]*(?:Sensitive|Non-sensitive)[{SPACE}]*:[{SPACE}]*"
MARKER_PREFIX = f"(?i)^[{SPACE}]*(?:(?:Sensitive|Non-sensitive)[{SPACE}]*:[{SPACE}]*|:[{SPACE}]*)?<<<[{SPACE}]*"
ARTIFACT = f"(?i)(?:<<<|>>>|^[{SPACE}]*(?:Sensitive|Non-sensitive)[{SPACE}]*:|Classify one PII-detection text|Respond with exactly one label)"
DANGLING_WORDS = "a an and at because but by for from in of on or that the to with".split()
FIRST_PERSON = "I my me mine myself we our ours ourselves".split()
FIRST_PERSON_SINGULAR = "I my me mine myself".split()
SHORTEST, LONGEST = 10, 500


def squash(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def normalise(c: Column) -> Column:
    """Key of exact comparison: white space squashed and stripped, lower case."""
    return F.lower(strip(squash(c)))


def tokens(c: Column) -> Column:
    """Lower-case words, and single characters that are neither word nor white space."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD}]+|[^{WORD}{SPACE}]"), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, although ``body`` may name it inside lambdas or repeatedly.

    Rules that name their text in several branches bind it this way; else every use would repeat the whole expression,
    and nested rules would outgrow what the JVM compiles.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trigrams(c: Column) -> Column:
    """Distinct 3-character strings of the lower-cased, squashed text."""

    def cut(text: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))
        return F.when(F.length(text) >= 3, F.array_distinct(grams)).when(text.isNotNull(), F.array().cast("array<string>"))

    return let(F.lower(squash(c)), cut)


def has_word(c: Column, words: list[str]) -> Column:
    """Does a word of the list stand in the text, in any case and between word boundaries?"""
    return c.rlike(f"(?i)(?:^|[^{WORD}])(?:{'|'.join(words)})(?:$|[^{WORD}])")


def has_artifact(c: Column) -> Column:
    return c.rlike(ARTIFACT)


def fits(c: Column) -> Column:
    return F.length(c).between(SHORTEST, LONGEST)


def _kept(c: Column) -> Column:
    return let(c, lambda x: F.when(fits(x) & ~has_artifact(x), x))


def clean_generated(c: Column) -> Column:
    """A completion's text: up to the closing marker or the first line, without markers, labels and quotes around it;
    null if artefacts remain or the length is off."""
    text = strip(let(c, lambda x: F.when(x.contains(">>>"), F.substring_index(x, ">>>", 1)).otherwise(F.regexp_extract(x, f"^[^{LINE_END}]*", 0))))
    for _ in range(3):
        text = strip(F.regexp_replace(F.regexp_replace(text, MARKER_PREFIX, ""), LABEL_PREFIX, ""))
    return _kept(strip(strip_chars(text, "\"'<>")))


def clean_pair_text(c: Column) -> Column:
    """A text of a generated pair: squashed, unquoted and unwrapped; null if artefacts remain or the length is off."""

    def unwrapped(x: Column) -> Column:
        inner = strip(strip_chars(strip(F.regexp_extract(x, "^<<<(.*)>>>$", 1)), "\"'"))
        return F.when(x.startswith("<<<") & x.endswith(">>>"), inner).otherwise(x)

    text = strip(strip_chars(strip(squash(c)), "\"'"))
    for _ in range(2):
        text = let(text, unwrapped)
    return _kept(text)


def clean_instruction(c: Column) -> Column:
    text = strip(strip_chars(strip(squash(c)), "\"'"))
    return let(text, lambda x: F.when(F.length(x).between(20, 300) & F.lower(x).startswith("decide whether"), x))


def short_value(c: Column, most: int = 700) -> Column:
    """Squashed text; what exceeds ``most`` characters is cut and ends in three dots."""

    def cut(x: Column) -> Column:
        head = F.rtrim(F.substring(x, 1, most - 3), F.lit(SPACES))
        return F.when(F.length(x) <= most, x).otherwise(F.concat(head, F.lit("...")))

    return let(strip(squash(c)), cut)


def _times(c: Column, text: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))


def incomplete_reason(c: Column) -> Column:
    """The first rule by which a text looks cut off, or null."""

    def reason(text: Column) -> Column:
        last = F.right(text, F.lit(1))
        words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
        opens = _times(text, "(") + _times(text, "[")
        closes = _times(text, ")") + _times(text, "]")
        last_word = let(words, lambda w: F.when(F.size(w) == 0, "").otherwise(F.element_at(w, -1)))
        by_word = let(last_word, lambda w: F.when(w == "", "no_word").when(w.isin(DANGLING_WORDS), "dangling_word"))
        return (
            F.when(text == "", "blank")
            .when(text.endswith("..."), "ellipsis")
            .when(_times(text, '"') % 2 == 1, "open_quote")
            .when(last.isin(*",;:-(["), "open_end")
            .when(~last.isin(*".?!\"')]"), "no_end")
            .when(opens > closes, "open_bracket")
            .otherwise(by_word)
        )

    return let(strip(c), reason)


def strict_label(c: Column) -> Column:
    """The label that a response consists of, but for white space; else null."""
    return let(strip(c), lambda x: F.when(x.isin(*LABELS), x))


def scrubbed_line(key: Column, c: Column) -> Column:
    """'id: <<<text>>>' with markers inside the text removed."""
    inner = strip(F.replace(F.replace(c, F.lit("<<<"), F.lit("")), F.lit(">>>"), F.lit("")))
    return F.concat(key, F.lit(": <<<"), inner, F.lit(">>>"))
