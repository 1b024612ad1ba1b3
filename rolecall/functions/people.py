"""People named in role documents, as structs of name, e-mail and handle."""

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import blank_to_null, first_match, let, matches, strip

PERSON = "struct<name:string,email:string,handle:string>"
PEOPLE = f"array<{PERSON}>"


def person(name=None, email=None, handle=None) -> Column:
    null = F.lit(None).cast("string")
    pick = lambda c: null if c is None else c
    return F.struct(pick(name).alias("name"), pick(email).alias("email"),
                    pick(handle).alias("handle"))


def no_people() -> Column:
    return F.array().cast(PEOPLE)


def is_named(p: Column) -> Column:
    return p["name"].isNotNull() | p["email"].isNotNull() | p["handle"].isNotNull()


def from_person_string(s: Column) -> Column:
    """'Jane Doe <jane@x.org> (https://x)' as a person."""
    def read(t):
        shaped = matches(t, fixed.PERSON_STRING)
        name = F.when(shaped, strip(F.regexp_extract(t, fixed.PERSON_STRING, 1))).otherwise(t)
        email = F.when(shaped, strip(F.regexp_extract(t, fixed.PERSON_STRING, 2)))
        return person(blank_to_null(name), blank_to_null(email))
    return let(strip(s), read)


def from_maintainer_line(raw: Column) -> Column:
    """One line of a free-form maintainer list, or null when it names nobody."""
    def content(line):
        """The line without its bullet; null for headings, rules, tables and comments."""
        text = F.when(matches(line, r"^[-*]\s+\S") & matches(line, r"^(#|<!--|-->|=|-)"),
                      F.regexp_replace(line, r"^[-*]\s+", "")) \
                .when(~matches(line, r"^(#|<!--|-->|=|-|$)"), line)
        return let(text, lambda t: F.when(~matches(t, r"^(\||\+--|[-=| ]*$)"), t))

    def read(line):
        email = strip(F.coalesce(first_match(line, fixed.ANY_EMAIL, 1),
                                 first_match(line, fixed.ANY_EMAIL, 2)))
        rest = F.regexp_replace(line, rf"^(.*?)(?:{fixed.ANY_EMAIL})", "$1 ")
        return F.struct(blank_to_null(email).alias("email"), rest.alias("rest"))

    def named(p):
        rest = F.regexp_replace(p["rest"], fixed.WRAPPED_MENTION, " ")
        name = F.regexp_replace(F.regexp_replace(rest, "[|*`]", " "), r"\s+", " ")
        return person(blank_to_null(F.btrim(name, F.lit(" -|*<>()"))), p["email"],
                      first_match(p["rest"], fixed.WRAPPED_MENTION))

    somebody = lambda p: (p["handle"].isNotNull() | p["email"].isNotNull()
                          | F.coalesce(p["name"].contains(" "), F.lit(False)))
    return let(let(strip(raw), content), lambda line: F.when(
        line.isNotNull(), let(let(let(line, read), named), lambda p: F.when(somebody(p), p))))


def from_author_token(raw: Column) -> Column:
    """One author of a proposal header: 'Jane Doe <j@x.org> (@jane)'."""
    def read(tok):
        rest = F.replace(tok, F.regexp_extract(tok, fixed.ANGLE_EMAIL, 0), F.lit(" "))
        return F.struct(blank_to_null(strip(first_match(tok, fixed.ANGLE_EMAIL))).alias("email"),
                        rest.alias("rest"))

    def named(p):
        name = F.regexp_replace(F.regexp_replace(p["rest"], fixed.WRAPPED_MENTION, " "), r"\s+", " ")
        return person(blank_to_null(F.btrim(name, F.lit(" ()<>"))), p["email"],
                      first_match(p["rest"], fixed.WRAPPED_MENTION))
    return let(let(strip(raw), read), named)


def from_author_field(value: Column) -> Column:
    """All authors of a header value, split at commas, semicolons and line ends."""
    return from_author_tokens(F.split(value, r"[,;\n]+"))


def from_author_tokens(tokens: Column) -> Column:
    people = F.transform(F.filter(tokens, lambda t: strip(t) != ""), from_author_token)
    return F.coalesce(F.filter(people, is_named), no_people())


def zip_names_emails(name: Column, email: Column) -> Column:
    """Names and e-mails of two delimited fields, paired by position."""
    split = lambda c: F.transform(F.split(c, "[;,]"), strip)
    names, emails = split(blank_to_null(name)), split(blank_to_null(email))
    by_name = F.transform(names, lambda n, i: person(
        blank_to_null(n), blank_to_null(F.get(emails, i))))
    by_email = F.transform(emails, lambda e: person(email=blank_to_null(e)))
    return F.filter(F.coalesce(by_name, by_email, no_people()), is_named)
