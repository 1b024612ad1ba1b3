"""Line grammars, evaluated inside the row that holds the text.

A role document is one value, so sections, header continuations and sliding
windows are found by splitting that value where a block starts.  No grammar here
needs a window function, hence none of them shuffles document text.
"""

from pyspark.sql import Column, functions as F

from .. import fixed
from .people import from_author_field, from_author_tokens, no_people
from .text import blank_to_null, drop_blank, let, lines, matches, strip, unix_lines

_BLANK = r"[^\S\n]*"


def _tail(arr: Column) -> Column:
    return F.slice(arr, F.lit(2), F.size(arr))


def codeowner_rules(text: Column) -> Column:
    """Rules of a CODEOWNERS file in order: pattern, owners, section.

    A comment opens a section, a blank line closes it, so splitting in front of
    both leaves blocks whose first line decides the section of the others.
    """
    blocks = F.split(unix_lines(text), rf"\n(?={_BLANK}(?:#|\n|\z))")

    def opened(ls):
        head = strip(F.element_at(ls, 1))
        return F.struct(
            F.when(head.startswith("#"), blank_to_null(strip(F.regexp_replace(head, "^#+", ""))))
             .alias("section"),
            F.when(head.startswith("#") | (head == ""), _tail(ls)).otherwise(ls).alias("body"))

    def rules_of(block):
        return let(let(F.split(block, "\n"), opened), lambda b: F.transform(b["body"], lambda ln: F.struct(
            F.split(strip(F.substring_index(ln, "#", 1)), r"(?U)\s+").alias("parts"),
            b["section"].alias("section"))))

    rules = F.filter(F.flatten(F.transform(blocks, rules_of)), lambda r: F.size(r["parts"]) >= 2)
    return F.transform(rules, lambda r: F.struct(
        F.element_at(r["parts"], 1).alias("pattern"), _tail(r["parts"]).alias("owners"),
        r["section"].alias("section")))


def all_owners(rules: Column) -> Column:
    """Distinct owners of a rule list in first-seen order."""
    return F.array_distinct(F.flatten(F.transform(rules, lambda r: r["owners"])))


def owns_ownership_file(pattern: Column) -> Column:
    """A rule about the CODEOWNERS file itself, which is no ownership of code."""
    base = F.element_at(F.split(F.btrim(strip(pattern), F.lit("/")), "/"), -1)
    return F.upper(base) == "CODEOWNERS"


def rule_scope(pattern: Column, section: Column) -> Column:
    return F.coalesce(section, F.nullif(pattern, F.lit("*")))


def owner_kind(owner: Column) -> Column:
    return (F.when(matches(owner, fixed.TEAM_OWNER), "team")
             .when(matches(owner, fixed.USER_OWNER), "handle")
             .when(matches(owner, fixed.EMAIL_OWNER), "email")
             .otherwise("unknown"))


def owners_list(text: Column, key: str) -> Column:
    """Handles listed under approvers: or reviewers: of an OWNERS file.

    A key that occurs twice starts over, so its last block counts.
    """
    blocks = F.split(unix_lines(text), r"\n(?=(?:approvers|reviewers)\s*:)")
    mine = F.filter(blocks, lambda b: b.rlike(rf"^{key}\s*:"))
    items = F.filter(F.split(F.try_element_at(mine, F.lit(-1)), "\n"),
                     lambda ln: ln.rlike(r"^\s*-\s+"))
    handles = F.transform(items, lambda ln: F.ltrim(
        strip(F.substring(ln, F.instr(ln, "-") + 1, F.length(ln))), F.lit("@")))
    return F.coalesce(F.filter(handles, lambda h: h != ""), F.array().cast("array<string>"))


def line_windows(text: Column, size: int = 3) -> Column:
    """Each line joined with the ones after it, so a name and its role may be lines apart."""
    return let(lines(text), lambda ls: F.transform(
        ls, lambda _, i: strip(F.array_join(F.slice(ls, i + 1, size), " "))))


def _header(text: Column) -> Column:
    """The header of a document: the first paragraphs that hold fields, up to one without."""
    paragraphs = F.split(unix_lines(text), rf"\n(?:{_BLANK}\n)+")

    def fields(ps):
        held = F.transform(ps, lambda p: p.rlike(r"(?m)^:?[A-Za-z][\w\- ]*?:(?:\s|$)"))
        return let(held, lambda hs: let(F.array_position(hs, True).cast("int"), lambda first: F.when(first > 0, let(
            F.array_position(F.slice(hs, first, F.size(hs)), False).cast("int"),
            lambda end: F.slice(ps, first, F.when(end > 0, end - 1).otherwise(F.size(ps))))).otherwise(
                F.array().cast("array<string>"))))

    return F.array_join(let(paragraphs, fields), "\n\n")


def _header_authors(text: Column) -> Column:
    """Author value of a field-list or mail-style header, continuation lines joined."""
    head = _header(text)
    blocks = F.split(head, rf"\n(?=\S|{_BLANK}(?:\n|\z))")

    def field(block):
        ls = F.split(block, "\n")
        first = strip(F.element_at(ls, 1))
        value = F.array_join(F.array_append(
            F.array(strip(F.regexp_extract(first, fixed.HEADER_FIELD, 2))),
            F.array_join(F.transform(_tail(ls), strip), " ")), " ")
        key = F.lower(strip(F.regexp_extract(first, fixed.HEADER_FIELD, 1)))
        return F.struct(F.when(block.rlike(r"^\S"), key).alias("key"), strip(value).alias("value"))

    last = lambda fields, k: blank_to_null(F.try_element_at(
        F.filter(fields, lambda f: f["key"] == k), F.lit(-1))["value"])
    value = let(F.transform(blocks, field),
                lambda fs: F.coalesce(last(fs, "author"), last(fs, "authors")))
    return from_author_field(value)


def _front_matter_authors(text: Column) -> Column:
    """Author value of a front-matter block: a scalar, a flow list or '- item' lines."""
    front = F.regexp_extract(
        unix_lines(text),
        rf"(?ms)\A{_BLANK}---{_BLANK}\n(.*?)^{_BLANK}(?:---|\.\.\.){_BLANK}$", 1)
    blocks = F.split(front, r"\n(?=[^\s#-][^\n]*:)")
    unquote = lambda c: F.regexp_replace(strip(c), r"""^(['"])(.*)\1$""", "$2")

    def field(block):
        ls = F.split(block, "\n")
        first = F.element_at(ls, 1)
        colon = F.instr(first, ":")
        value = strip(F.substring(first, colon + 1, F.length(first)))
        items = F.transform(
            F.filter(_tail(ls), lambda ln: ln.rlike(r"^\s*- ")),
            lambda ln: unquote(F.regexp_replace(ln, r"^\s*- ", "")))
        flow = F.transform(F.split(F.regexp_replace(value, r"^\[(.*)\]$", "$1"), ","), unquote)
        return F.struct(
            F.lower(strip(F.substring(first, 1, colon - 1))).alias("key"),
            F.when(value.rlike(r"^\[.*\]$"), flow)
             .when(value != "", F.split(unquote(value), r"[,;\n]+"))
             .otherwise(items).alias("tokens"))

    last = lambda fields, k: F.try_element_at(F.filter(
        fields, lambda f: (f["key"] == k) & (F.size(drop_blank(f["tokens"])) > 0)),
        F.lit(-1))["tokens"]
    tokens = let(F.transform(F.filter(blocks, lambda b: b.contains(":")), field),
                 lambda fs: F.coalesce(last(fs, "author"), last(fs, "authors")))
    return from_author_tokens(tokens)


def proposal_authors(text: Column, header_format: Column) -> Column:
    """People in the author field of a proposal document."""
    return F.coalesce(
        F.when(header_format == "yaml", _front_matter_authors(text))
         .otherwise(_header_authors(text)), no_people())
