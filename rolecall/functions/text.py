"""Strings, identity keys and lines."""

from pyspark.sql import Column, functions as F

# The characters stripped from both ends of a string, and the
# line breaks a text is split at (all Unicode blanks and breaks, not just ASCII).
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
          "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LINE_BREAK = "\r\n?|[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`, also inside another lambda.

    A column used twice in an expression is otherwise evaluated twice, and nested
    uses multiply.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def fold(c: Column) -> Column:
    """Lower-cased and stripped, null when blank: the form names and e-mails match in."""
    return blank_to_null(F.lower(strip(c)))


def handle_key(c: Column) -> Column:
    """A handle as it is matched: no leading @, lower case, null when empty."""
    return blank_to_null(F.lower(F.regexp_replace(c, "^@+", "")))


def matches(c: Column, pattern: str) -> Column:
    """Null-safe regular-expression test."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none or it is empty."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, LINE_BREAK, "\n")


def lines(c: Column) -> Column:
    """Text as an array of lines."""
    return F.split(unix_lines(c), "\n")


def drop_blank(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull() & (strip(x) != ""))


def name_tokens(c: Column) -> Column:
    """Distinct lower-cased name tokens, split at blanks and dots."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[\s.]+"), lambda t: t != ""))


def looks_like_name(c: Column) -> Column:
    """A query is a full name rather than a handle when it has an inner space."""
    return F.coalesce(strip(c).contains(" "), F.lit(False))


def name_matches(query: Column, name: Column) -> Column:
    """Every token of the query occurs among the tokens of the name."""
    q, n = name_tokens(query), name_tokens(name)
    return F.coalesce((F.size(q) > 0) & (F.size(F.array_except(q, n)) == 0), F.lit(False))


def _relaxed_tokens(name: Column) -> Column:
    spaced = F.lower(F.translate(name, ".,", "  "))
    return F.filter(F.split(spaced, r"(?U)\s+"), lambda t: t != "")


def first_last(name: Column) -> Column:
    """'first last' with middle names and punctuation dropped.

    Null unless first and last differ, because one token is too weak to match on.
    """
    toks = _relaxed_tokens(name)
    first, last = F.try_element_at(toks, F.lit(1)), F.try_element_at(toks, F.lit(-1))
    return F.when(first != last, F.concat_ws(" ", first, last))


def is_full_name(c: Column) -> Column:
    """Shape of a person's full name: long enough, two words, no placeholder word."""
    from ..fixed import NOT_A_PERSON
    return (F.length(c) > 5) & c.contains(" ") & ~matches(c, "(?U)" + NOT_A_PERSON)


def percent_decode(c: Column) -> Column:
    """Percent-decoding that leaves '+' alone; the text as it is if it is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def percent_encode_path(c: Column) -> Column:
    """Percent-encoding for a URL path: '/', '~' kept, a space becomes %20."""
    enc = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc
