"""Message and template functions as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "<*>"
#: Characters that word tokens may hold besides letters and digits.
WORD_MARKS = "-_/."


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_ws(c: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def is_single(c: Column) -> Column:
    """Whether a message is one token."""
    return F.instr(c, " ") == 0


def heuristic_template(c: Column) -> Column:
    """Every run of word characters that holds a digit becomes a wildcard."""
    parts = F.regexp_extract_all(c, F.lit(r"(?U)\W+|\w+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"(?U)\d"), WILD).otherwise(p)), "")


def digit_fallback(c: Column) -> Column:
    """Every run of digits becomes a wildcard."""
    return F.regexp_replace(c, r"(?U)\d+", WILD)


def unwrap_response(c: Column) -> Column:
    """The text between the tags of a provider's answer; null stays null.

    A missing end tag is added. With one pair of tags it is what they enclose (null if
    they enclose nothing on one line), else the last piece that holds an end tag.
    """
    ended = F.when(F.contains(c, F.lit("<END>")), c).otherwise(F.concat(c, F.lit("<END>")))
    times = lambda tag: F.size(F.split(ended, tag, -1)) - 1
    one = F.nullif(F.regexp_extract(ended, "<START>(.+)<END>", 1), F.lit(""))
    pieces = F.filter(F.split(ended, "<START>", -1), lambda p: F.contains(p, F.lit("<END>")))
    last = F.replace(F.element_at(pieces, -1), F.lit("<END>"), F.lit(""))
    return F.when((times("<START>") == 1) & (times("<END>") == 1), one).otherwise(last)


def is_yes(c: Column) -> Column:
    """Whether an answer agrees."""
    return F.contains(F.lower(c), F.lit("yes"))


def has_constant(template: Column) -> Column:
    """Whether a template has any character besides wildcards and spaces."""
    return template.rlike("[^<>* ]")


def char_units(c: Column) -> Column:
    """Characters, where a wildcard, whole or broken, is one unit."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)<\*>|<\*|\*>|."), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.isin("<*", "*>"), WILD).otherwise(p))


def word_units(c: Column, keep: str = WORD_MARKS) -> Column:
    """Wildcards, runs of letters, digits and ``keep``, and every other character by itself."""
    kept = "".join("\\" + k for k in keep)
    return F.regexp_extract_all(c, F.lit(r"<\*>|[\p{L}\p{N}" + kept + r"]+|(?s:.)"), F.lit(0))


def alpha_tokens(c: Column) -> Column:
    """Word units made of letters only: what template similarity counts."""
    return F.filter(word_units(c), lambda t: t.rlike(r"^\p{L}+$"))


def lettered_tokens(c: Column) -> Column:
    """Word units with an ASCII letter: what the similarity of pending messages counts."""
    return F.filter(word_units(c), lambda t: t.rlike("[a-zA-Z]"))


def example_tokens(c: Column, glue_digits: bool = True) -> Column:
    """Alphanumeric runs with a letter. With ``glue_digits`` runs without one are put before the next run."""
    spaced = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    if glue_digits:
        found = F.regexp_extract_all(spaced, F.lit(r"(?:\p{N}+ )*\p{N}*\p{L}[\p{L}\p{N}]*"), F.lit(0))
        return F.transform(found, lambda t: F.replace(t, F.lit(" "), F.lit("")))
    return F.regexp_extract_all(spaced, F.lit(r"\p{N}*\p{L}[\p{L}\p{N}]*"), F.lit(0))


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def has_alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def char_class(c: Column) -> Column:
    """Sorted characters that a wildcard's content stands for: all digits, all letters, or the character itself."""
    digits = F.when(c.rlike(r"\p{Nd}"), F.split(F.lit("0123456789"), "")).otherwise(F.array().cast("array<string>"))
    letters = F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    alphas = F.when(c.rlike(r"\p{L}"), F.split(letters, "")).otherwise(F.array().cast("array<string>"))
    others = F.regexp_extract_all(c, F.lit(r"(?s)[^\p{L}\p{Nd}]"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(digits, alphas, others)))


def merge_stars(c: Column) -> Column:
    """Eleven or more wildcards, each after one space, become one."""
    return F.regexp_replace(c, r"(?:<\*>\s){10,}<\*>", WILD)


def merge_wilds(c: Column) -> Column:
    """Wildcards with nothing between them but marks become one; then long runs, by ``merge_stars``."""
    whole = F.array_join(char_units(c), "")
    return merge_stars(F.regexp_replace(whole, r"<\*>(?:[^\p{L}\p{N} ]*?<\*>)+", WILD))


def template_to_regex(template: Column) -> Column:
    """The anchored Java expression that a template stands for."""
    escaped = F.regexp_replace(template, r"([\\()\[\]{}.+?|^$])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit(WILD), F.lit("(.+)")), F.lit("*"), F.lit(r"\*")), F.lit("$"))


def strip_common(a: Column, b: Column) -> Column:
    """Struct (a, b) without the common beginning, which stops at ``<``, and the common end, which stops at ``>``."""
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    same = lambda x, y, stop: F.zip_with(x, y, lambda p, q: F.coalesce((p == q) & (p != stop), F.lit(False)))
    run = lambda flags: F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0).cast("long")) - 1, F.size(flags).cast("long"))
    head = run(same(chars(a), chars(b), "<"))
    tail = run(same(F.reverse(chars(a)), F.reverse(chars(b)), ">"))
    cut = lambda s: F.substring(s, head + 1, F.greatest(F.length(s) - head - tail, F.lit(0)))
    return F.struct(cut(a).alias("a"), cut(b).alias("b"))


def lcs_similarity(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of tokens, a wildcard equal to any, over the longer length."""
    tokens = lambda s: F.filter(F.split(s, r"\s+"), lambda t: t != "")
    x, y = tokens(a), tokens(b)
    zero = F.transform(y, lambda _: F.lit(0))

    def row(previous: Column, token: Column) -> Column:
        """The next row of lengths, from left to right."""
        state = F.struct(F.lit(0).alias("left"), F.lit(0).alias("diagonal"), F.array().cast("array<int>").alias("done"))

        def step(s: Column, at: Column) -> Column:
            matches = (at["t"] == token) | (at["t"] == WILD) | (token == WILD)
            best = F.when(matches, s["diagonal"] + 1).otherwise(F.greatest(s["left"], at["up"]))
            return F.struct(best.alias("left"), at["up"].alias("diagonal"), F.concat(s["done"], F.array(best)).alias("done"))

        return F.aggregate(F.arrays_zip(y.alias("t"), previous.alias("up")), state, step, lambda s: s["done"])

    longest = F.aggregate(x, zero, row, lambda r: F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0)))
    top = F.greatest(F.size(x), F.size(y))
    return F.when(top == 0, F.lit(1.0)).otherwise(longest / top)
