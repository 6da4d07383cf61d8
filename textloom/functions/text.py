"""Column functions over texts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before and after a whole word, in ASCII terms.
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def whole_word(term: str) -> str:
    """The pattern of a term that is matched as a whole word."""
    escaped = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in term)
    return _BEFORE + escaped + _AFTER


def count_word(text: Column, term: str) -> Column:
    return F.regexp_count(text, F.lit(whole_word(term))).cast("long")


def collapsed(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def paragraph_key(text: Column) -> Column:
    """Only the letters a-z of a lower-cased text: what joins versions of a paragraph."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def heading_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def sentences(text: Column) -> Column:
    """Cuts after . ! ? and white space before a capital letter."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def words(text: Column) -> Column:
    """Lower-case runs of letters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), 1)


def ngrams(tokens: Column, n: int, glue: str = " ") -> Column:
    """All runs of n tokens, joined.

    Shifted slices are zipped, so that the tokens are computed n times and not
    anew for every run.
    """
    m = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    runs = F.slice(tokens, F.lit(1), m)
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(k + 1), m), lambda a, b: F.concat(a, F.lit(glue), b))
    return runs


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams of a text without white space."""
    plain = F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", "")
    return ngrams(F.filter(F.split(plain, ""), lambda c: c != ""), n, "")


#: Plurals that follow no rule, and words without one.
IRREGULAR = {
    "matrix": ["matrices"], "index": ["indexes", "indices"], "vertex": ["vertices"], "hypothesis": ["hypotheses"],
    "analysis": ["analyses"], "axis": ["axes"], "criterion": ["criteria"], "leaf": ["leaves"], "child": ["children"],
    "basis": ["bases"], "datum": ["data"], "appendix": ["appendices"], "phenomenon": ["phenomena"],
}
UNCOUNTABLE = [
    "data", "software", "hardware", "feedback", "information", "knowledge", "research", "evidence",
    "code", "middleware", "malware", "ransomware", "overhead", "metadata", "bandwidth", "throughput",
]


def plurals(term: Column, irregular: dict[str, list[str]] = IRREGULAR, uncountable: list[str] = UNCOUNTABLE) -> Column:
    """Plural forms of a term by a table of exceptions; only its last word changes, and only if it is lower-case letters, three or more."""
    word = F.element_at(F.split(term, " "), -1)
    stem = F.substring(term, F.lit(1), F.length(term) - F.length(word))
    none = F.array().cast("array<string>")
    exceptions = F.create_map(*[x for k, v in irregular.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    form = (
        F.when(~word.rlike(r"^\p{Ll}{3,}$") | word.isin(uncountable), none)
        .when(word.rlike("s$") & ~word.rlike("(ss|us|is|as)$"), none)
        .when(F.map_contains_key(exceptions, word), F.try_element_at(exceptions, word))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.array(F.concat(word, F.lit("es"))))
        .when(word.rlike("[^aeiou]y$"), F.array(F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))))
        .otherwise(F.array(F.concat(word, F.lit("s"))))
    )
    return F.transform(form, lambda f: F.concat(stem, f))


def acronym_plural(term: Column) -> Column:
    """The plural of an acronym that doesn't end in S, else null."""
    return F.when(term.rlike("^[A-Z][A-Z0-9]{1,5}$") & ~term.endswith("S"), F.concat(term, F.lit("s")))


def marks(text: Column) -> Column:
    """Placeholders ⟦name_n⟧ of a text, sorted, repeats kept: equal lists mean equal multisets."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"(⟦[^⟧]*⟧)"), 1))


def acronyms(text: Column, most: int = 8) -> Column:
    """The first distinct upper-case tokens of a text that isn't itself mostly upper case."""
    letters, upper = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9]{1,5})(?![A-Za-z0-9_])"), 1))
    return F.when((letters >= 8) & (upper * 10 > letters * 7), F.array().cast("array<string>")).otherwise(F.slice(found, 1, most))


NEGATIONS = r"(?<![A-Za-z0-9_])(not|no|never|without|cannot|nor)(?![A-Za-z0-9_])"


def negations(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(NEGATIONS)).cast("long")


def is_heading(text: Column) -> Column:
    """2 to 79 characters, three Latin letters in a row, no closing mark."""
    return F.length(text).between(2, 79) & text.rlike("[A-Za-z]{3}") & ~text.rlike(r"[.:;?!,]\s*$")


def case_policy(term: str) -> str:
    """The pattern for a term: in lower case it matches any case, else as written or with a capital first letter."""
    if term == term.lower():
        return "(?i)" + whole_word(term)
    return "(?:" + whole_word(term) + "|" + whole_word(term[:1].upper() + term[1:]) + ")"


def dot(a: Column, b: Column) -> Column:
    """The sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def is_subsequence(inner: Column, outer: Column) -> Column:
    """Whether the characters of one text appear in order in another."""

    def step(rest: Column, char: Column) -> Column:
        at = F.instr(rest, char)
        return F.when(rest.isNotNull() & (at > 0), F.substring(rest, at + 1, F.length(rest)))

    chars = F.filter(F.split(inner, ""), lambda c: c != "")
    return F.aggregate(chars, outer, step).isNotNull()


def singulars(word: Column) -> Column:
    """What a plural may be of: without s, es, or with y for ies."""
    return F.array_compact(F.array(F.when(word.rlike("ies$"), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y"))), F.when(word.rlike("es$"), F.regexp_replace(word, "es$", "")), F.when(word.rlike("s$") & ~word.rlike("ss$"), F.regexp_replace(word, "s$", ""))))


def chunks(text: Column) -> Column:
    """Stretches between marks of punctuation, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.,;:!?()\[\]\"|]+"), lambda c: F.trim(c)), lambda c: c != "")


def snippet(text: Column, needle: Column, width: int) -> Column:
    """The text ``width`` characters to either side of the first match, null without one."""
    at = F.instr(text, needle)
    return F.when(at > 0, F.substring(text, F.greatest(at - width, F.lit(1)), F.length(needle) + F.least(at - 1, F.lit(width)) + width))


def script_language(text: Column) -> Column:
    """ru if Cyrillic letters outnumber Latin ones, else en; null without letters."""
    cyrillic, latin = F.regexp_count(text, F.lit("[А-Яа-яЁё]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(cyrillic + latin == 0, F.lit(None)).when(cyrillic > latin, F.lit("ru")).otherwise(F.lit("en"))


def code_shape(word: Column) -> Column:
    """What makes a word look like code: call, dotted, snake, flag, annotation, camel or Pascal case; else null."""
    return (
        F.when(word.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\(\)$"), "call")
        .when(word.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+$"), "dotted")
        .when(word.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(word.rlike(r"^--?[a-z][a-z-]*$"), "flag")
        .when(word.rlike(r"^@[A-Z][A-Za-z]*$"), "annotation")
        .when(word.rlike(r"^[a-z]+([A-Z][a-z0-9]*)+$"), "camel")
        .when(word.rlike(r"^([A-Z][a-z0-9]+){2,}$"), "pascal")
    )


def salvaged(reply: Column) -> tuple[Column, Column]:
    """A model's reply as (text, whether it was good JSON): the field, else what stands behind "text", else the reply."""
    whole = F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.text")
    behind = F.nullif(F.regexp_extract(reply, r'(?s)"text"\s*:\s*"(.*?)"?\s*\}?\s*$', 1), F.lit(""))
    return F.coalesce(whole, behind, F.trim(reply)), whole.isNotNull()


def prompt(*lines: tuple[Column, Column]) -> Column:
    """Lines whose condition holds, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(condition, line) for condition, line in lines])), "\n")


def font_family(name: Column) -> Column:
    """A font's name without the prefix of a subset."""
    return F.regexp_replace(name, r"^[^+]*\+", "")


def heading_number(text: Column) -> Column:
    """The number a heading begins with, such as 5.4.1 or A.2; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*((?:[A-Z]|[0-9]+)(?:\.[0-9]+)+|[0-9]+)\b", 1), F.lit(""))


def page_references(entry: Column) -> Column:
    """Page numbers and ranges at the end of an index entry."""
    return F.regexp_extract_all(F.regexp_extract(entry, r",\s*([0-9][0-9,\s\-–]*)$", 1), F.lit(r"([0-9]+(?:[-–][0-9]+)?)"), 1)


def invisible_removed(text: Column) -> Column:
    """Without characters of the format category."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def unquoted(text: Column) -> Column:
    """Without one pair of quotes around the whole."""
    return F.regexp_replace(text, r'^\s*["“«](.*)["”»]\s*$', "$1")


def packed_logprobs(tokens: Column, floor: float = 0.5) -> Column:
    """(token, logp, alt) lists of which the alternative stays only where the token's probability is below the floor."""
    return F.transform(tokens, lambda t: F.struct(t["token"].alias("token"), F.round(t["logp"], 3).alias("logp"), F.when(F.exp(t["logp"]) < floor, t["alt"]).alias("alt")))


def term_tokens(text: Column) -> Column:
    """Words as terms are made of: letters and digits, parts joined by - or ', and trailing + or #."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9]*(?:[-'’][A-Za-z0-9]+)*(?:[+#]+)?)"), 1)


def without_tags(html: Column) -> Column:
    """Without blocks of code, and with a space for every tag."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<pre\b.*?</pre>", " "), "<[^>]*>", " ")


def escaped_tags(html: Column, names: list[str]) -> Column:
    """Tags of the given names, without attributes, in other brackets."""
    return F.regexp_replace(html, f"<(/?)({'|'.join(names)})>", "‹$1$2›")


def unescaped_tags(text: Column, names: list[str]) -> Column:
    return F.regexp_replace(text, f"‹(/?)({'|'.join(names)})›", "<$1$2>")


def without_last_sentence(text: Column) -> Column:
    """Without the last sentence, if at least 40 per cent of the text stays."""
    parts = F.split(text, "[.] ")
    kept = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ". ")
    return F.when((F.size(parts) > 1) & (F.length(kept) * 10 >= F.length(text) * 4), F.concat(kept, F.lit("."))).otherwise(text)


def other_number(text: Column) -> Column:
    """With the first number changed: two more if it is below ten, else twice."""
    digits = F.regexp_extract(text, "([0-9]{1,9})", 1)
    value = F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999")).cast("long")
    at = F.instr(text, digits)
    changed = F.when(value < 10, value + 2).otherwise(value * 2).cast("string")
    return F.when(digits != "", F.concat(F.substring(text, F.lit(1), at - 1), changed, F.substring(text, at + F.length(digits), F.length(text)))).otherwise(text)


def page_run(name: Column) -> tuple[Column, Column, Column]:
    """book, first and last page of a folder's name such as name_epub_p12-40."""
    pattern = r"^(.+)_epub_p([0-9]+)-([0-9]+)$"
    return F.regexp_extract(name, pattern, 1).alias("book"), F.regexp_extract(name, pattern, 2).cast("long").alias("first"), F.regexp_extract(name, pattern, 3).cast("long").alias("last")


def mean_of(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.size(numbers)


#: Ligatures and odd characters of printed pages, and circled numbers.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "\u00a0": " ", "\u00ad": "-"}
CIRCLED = "❶❷❸❹❺❻❼❽❾❿⓫⓬⓭⓮⓯⓰⓱⓲⓳⓴"


def without_ligatures(text: Column) -> Column:
    for old, new in LIGATURES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def folded_yo(text: Column) -> Column:
    """With one spelling of the Cyrillic letter that has two."""
    return F.translate(text, "ёЁ", "еЕ")


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, "⟦[^⟧]*⟧", " ")


def italics(text: Column) -> Column:
    """Brackets for italics as tags."""
    return F.regexp_replace(text, "⟪([^⟫]*)⟫", "<em>$1</em>")


def italics_marked(html: Column) -> Column:
    return F.regexp_replace(html, r"<em(?:\s[^>]*)?>([^<]*)</em>", "⟪$1⟫")


def circled(number: Column) -> Column:
    """A circled number from 1 to 20, others in brackets."""
    return F.when(number.between(1, len(CIRCLED)), F.substring(F.lit(CIRCLED), number.cast("int"), F.lit(1))).otherwise(F.concat(F.lit("("), number.cast("string"), F.lit(")")))


def translated(word: Column, dictionary: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in dictionary.items()], word)


def context_after(rest: Column) -> Column:
    """What a text goes on with: footnote, tag, space (or its end) or text."""
    note = rest.rlike(r"^<sup(?:[^\p{L}]|$)|^<a(?:[^\p{L}>][^>]*)?>\s*<sup")
    return F.when(note, "footnote").when(rest.startswith("<"), "tag").when((rest == "") | rest.rlike(r"^\s"), "space").otherwise("text")
