"""Text functions: Column to Column, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import pyregex as R

CHARS_PER_TOKEN = 3.5
#: Marks where a joined text is cut again; control characters that normalised text does not hold in this order.
CUT = "\u0001\u0002"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: expressions inside lambdas would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(R.WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, without any at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{R.WS}]+", " "))


def normalize(c: Column) -> Column:
    """Unify line breaks and blanks, join hyphenated words, trim lines, collapse blank lines and runs of blanks."""
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\f", "\n"), ("\u00a0", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    # The sign comes first, as it is rare; a letter joins one line at most, so a match never begins where one ended.
    c = F.regexp_replace(c, rf"-\n(?<!\G-\n)(?<=[{R.WORD}]-\n)([{R.WORD}])", "$1")
    c = F.regexp_replace(c, rf"[{R.BLANK}]++(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def fingerprint(c: Column) -> Column:
    """A line without its numbers: lines that differ in the page number only are equal."""
    return F.regexp_replace(F.lower(strip(c)), rf"{R.DIGIT}+", "#")


def tokens_of_length(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / F.lit(CHARS_PER_TOKEN)).cast("int"))


def estimate_tokens(c: Column) -> Column:
    return tokens_of_length(F.length(c))


def is_heading_line(c: Column) -> Column:
    return F.rlike(c, F.lit(R.HEADING))


def is_heading(paragraph: Column) -> Column:
    """A stripped paragraph of one line that reads like a heading."""
    return ~F.contains(paragraph, F.lit("\n")) & is_heading_line(strip(paragraph))


def sentences(c: Column) -> Column:
    return F.split(c, R.SENTENCE_END, -1)


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"[{R.WS}]+", -1), lambda x: x != "")


def normal_form(c: Column) -> Column:
    """Lower case, signs as spaces, single spaces: the form in which questions and answers are compared."""
    return F.trim(F.regexp_replace(F.lower(c), rf"[^{R.WORD}]+", " "))


def paragraphs(c: Column) -> Column:
    """Parts between blank lines; a text without any is cut into groups of lines, each from a heading on."""

    def groups(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.when((i > 0) & is_heading_line(x), F.concat(F.lit(CUT), x)).otherwise(x))
        return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(F.split(F.array_join(marked, "\n"), f"\n{CUT}", -1))

    filled = lambda sign: F.filter(F.transform(F.split(c, sign, -1), strip), lambda x: x != "")
    return let(filled("\n\n"), lambda parts: F.when(F.size(parts) > 1, parts).otherwise(let(filled("\n"), groups)))


def heading_blocks(paras: Column) -> Column:
    """Paragraphs with the headings before them: headings joined by a line break, then a blank line and the text.
    Headings at the end are a block of their own."""

    def blocks(paras: Column) -> Column:
        after = lambda x, i: F.when(i == F.size(paras) - 1, "").when(~is_heading(x), CUT).when(is_heading(F.get(paras, i + 1)), "\n").otherwise("\n\n")
        joined = F.transform(paras, lambda x, i: F.concat(x, after(x, i)))
        return F.when(F.size(paras) == 0, F.array().cast("array<string>")).otherwise(F.split(F.array_join(joined, ""), CUT, -1))

    return let(paras, blocks)


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("-"), end.cast("string")))


def quoted(c: Column, separator: str) -> Column:
    """A field as minimal quoting writes it: quoted, with doubled quotes, if it holds the separator, a quote or a line break."""
    sign = {"\t": r"\t"}.get(separator, separator)
    return F.when(F.rlike(c, F.lit(f'[{sign}"\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def card_tags(card_type: Column, difficulty: Column, topic: Column) -> Column:
    return F.concat(card_type, F.lit(" "), difficulty, F.lit(" "), F.replace(strip(topic), F.lit(" "), F.lit("_")))


def thousands(c: Column) -> Column:
    """A count as reports show it, with commas."""
    return F.format_number(c, 0)


def percent(c: Column) -> Column:
    """A share in percent as reports show it, without decimals."""
    return F.concat(F.format_number(c, 0), F.lit("%"))


def suffix(path: Column) -> Column:
    """The lower-cased extension of a file name, with its point; a leading point starts none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
