"""Yes-or-no questions about words, lines and paragraphs; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def has_word(text: Column, term: str) -> Column:
    """Whether a term stands by itself: no letter, digit or hyphen before it, nor one of these or a bracket behind it."""
    escaped = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in term)
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_-]){escaped}(?![\p{{L}}\p{{N}}_(-])")


def name_only(text: Column, caps_words: list[str] = ()) -> Column:
    """One name: a word of 30 characters at most with two capitals, in brackets or quotes or not, and no mark in it.

    Words in capitals only have six letters at most; ``caps_words`` are none.
    """
    word = F.regexp_replace(F.trim(text), r"^[\[\]()«»⟪⟫\"' .:]+|[\[\]()«»⟪⟫\"' .:]+$", "")
    long_caps = (F.upper(word) == word) & (F.length(word) > 6)
    return ~text.contains("⟦") & (F.length(F.trim(text)) <= 30) & word.rlike("^[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$") & ~F.upper(word).isin(list(caps_words)) & ~long_caps


def is_variable(text: Column, emphasis: list[str] = (), indexed: bool = False) -> Column:
    """At most three characters or no four letters in a row, and, unless it has an index, none of the words that stress a phrase."""
    t = F.trim(text)
    shape = (t != "") & ((F.length(t) <= 3) | ~t.rlike("[A-Za-z]{4}"))
    return shape if indexed else shape & ~F.lower(t).isin(list(emphasis))


def numeric_cell(text: Column) -> Column:
    """Digits, white space and signs only."""
    return text.rlike(r"^[0-9\s.,:;%±≥≤<>=+\-–—−×/()]+$")


def ad_line(text: Column) -> Column:
    return text.rlike(r"(?i)(?<![\p{L}\p{N}_])t\.me/|telegram|телеграм|(?<![\p{L}\p{N}_])vk\.com/")


def option_letters(text: Column) -> Column:
    """How often an answer's option is named by a Cyrillic letter."""
    return F.regexp_count(text, F.lit(r"[Вв]ариант[\p{L}\p{N}_]*\s+[А-ЕЖЗИ](?![\p{L}\p{N}_])")).cast("long")


def glued_code(html: Column) -> Column:
    """How often code touches a Cyrillic letter."""
    return F.regexp_count(html, F.lit(r"</code>[А-Яа-яЁё]|[А-Яа-яЁё]<code(?![\p{L}\p{N}_])")).cast("long")


def answer_letters(text: Column) -> Column:
    """The letters that a paragraph begins with as the answer to a question, null without."""
    return F.nullif(F.regexp_extract(text, r"^\s*([A-J](?:, [A-J])*)\.\s", 1), F.lit(""))


def balanced(html: Column) -> Column:
    """Whether every tag that opens is closed in order; tags without content don't count."""
    tags = F.regexp_extract_all(html, F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*[^<>/])?>"), 1)
    void = ["br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"]

    def step(stack: Column, tag: Column) -> Column:
        # A null stack has met an end that fits no start.
        name = F.lower(F.regexp_replace(tag, "^/", ""))
        top = F.try_element_at(stack, F.lit(-1))
        closed = F.when(top == name, F.slice(stack, 1, F.size(stack) - 1))
        return F.when(stack.isNull() | name.isin(void), stack).when(tag.startswith("/"), closed).otherwise(F.concat(stack, F.array(name)))

    left = F.aggregate(tags, F.array().cast("array<string>"), step)
    return F.coalesce(F.size(left) == 0, F.lit(False)) & left.isNotNull()


def interesting(char: Column) -> Column:
    """Characters of the format category and spaces other than the common one."""
    return char.rlike(r"[\p{Cf}\u00A0\u202F\u2009\u200A\u2007\u2002\u2003]")
