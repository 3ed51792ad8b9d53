"""Column functions over text.

Everything here is a composition of built-in functions, so it stays on the JVM
and takes part in column pruning and filter pushdown.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped
# or split.  This is the Unicode White_Space set plus the four ASCII information
# separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS_RUN = r"(?U)[\s\x1c-\x1f]+"

# Characters with a meaning of their own in a full-text query.
_QUERY_OPERATORS = r'["*()\-+^:]'

# Code points of the combining marks a full-text token drops.
_DROPPED_MARKS = "".join(
    chr(c)
    for c in (
        *range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B,
        *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331,
    )
)
_TOKEN_CHAR = r"\p{L}\p{N}\p{Co}"


def strip_ws(text: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip_ws(text)) == 0


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, _WS_RUN), lambda w: w != "")


def norm_name(name: Column) -> Column:
    """Lookup key of an entity name."""
    return F.lower(strip_ws(name))


def quoted_phrases(query: Column) -> Column:
    """The phrases of a full-text query: operators become blanks, every word left is a phrase."""
    return words(F.regexp_replace(query, _QUERY_OPERATORS, " "))


@cache
def _fold_pairs() -> tuple[str, str]:
    """Single-character foldings applied after lower-casing.

    Two rules: a Latin letter that decomposes into an ASCII letter and one mark
    loses the mark, and a Latin or Greek letter whose case folding is another
    single letter takes the folding.
    """
    source, target = [], []
    for cp in (*range(0x80, 0x400), *range(0x1E00, 0x1F00)):
        ch = chr(cp)
        if ch.lower() != ch or not ch.isalpha():
            continue
        parts = unicodedata.normalize("NFD", ch)
        folded = ch.casefold()
        if len(parts) == 2 and parts[0].isascii():
            source.append(ch)
            target.append(parts[0])
        elif folded != ch and len(folded) == 1:
            source.append(ch)
            target.append(folded)
    return "".join(source), "".join(target)


def fts_tokens(text: Column) -> Column:
    """Case- and accent-folded full-text tokens in text order."""
    source, target = _fold_pairs()
    # A capital dotted I lower-cases to two characters; fold it beforehand.
    # Characters of the source without a counterpart in the target are deleted.
    lowered = F.lower(F.translate(text, "\u0130", "i"))
    joined = F.translate(lowered, source + _DROPPED_MARKS, target)
    return F.filter(F.split(joined, f"[^{_TOKEN_CHAR}]+"), lambda t: t != "")


def chunk_starts(n_words: Column, size: int, overlap: int) -> Column:
    """Numbers of the chunks a text of ``n_words`` words falls into, from 0 on."""
    step = size - overlap
    last = F.when(n_words <= size, F.lit(0)).otherwise(
        F.ceil((n_words - size) / F.lit(step)).cast("int")
    )
    return F.sequence(F.lit(0), last)


def chunk_at(word_array: Column, chunk_no: Column, size: int, overlap: int) -> Column:
    """Text of one chunk: ``size`` words starting at ``chunk_no * (size - overlap)``."""
    return F.array_join(
        F.slice(word_array, chunk_no * F.lit(size - overlap) + F.lit(1), F.lit(size)), " "
    )


def text_md5(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def edge_text(subject: Column, predicate: Column, obj: Column) -> Column:
    """A graph edge as a sentence; underscores in the relation become blanks."""
    return F.concat_ws(" ", subject, F.replace(predicate, F.lit("_"), F.lit(" ")), obj)


def triplet_text(subject: Column, description: Column, obj: Column) -> Column:
    return F.concat(F.lit("["), subject, F.lit("] "), description, F.lit(" ["), obj, F.lit("]"))


def triplet_embed_text(subject: Column, description: Column) -> Column:
    return F.concat_ws(" ", subject, description)


def paragraph(title: Column, sentences: Column) -> Column:
    return F.concat(title, F.lit(": "), F.array_join(sentences, " "))


def context_block(passages: Column) -> Column:
    """Retrieved passages as one block, or a notice that there are none."""
    return F.when(F.array_join(passages, "\n") == "", F.lit("No context available.")).otherwise(
        F.array_join(passages, "\n")
    )


def user_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def numbered_block(names: Column) -> Column:
    """Candidate names as a numbered list, counted from one."""
    lines = F.transform(
        names,
        lambda n, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit('. "'), n, F.lit('"')),
    )
    return F.array_join(lines, "\n")


def choice_index(reply: Column, n_choices: Column) -> Column:
    """A reply read as a 1-based choice; NULL unless it is an integer from 1 to ``n_choices``."""
    digits = strip_ws(reply)
    number = F.when(digits.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(digits, F.lit("_"), F.lit("")))
    number = number.try_cast("int")
    return F.when((number >= 1) & (number <= n_choices), number)


def bare_model_id(model: Column) -> Column:
    return F.regexp_replace(model, "^huggingface/", "")
