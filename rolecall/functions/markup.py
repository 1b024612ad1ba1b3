"""HTML pages and wiki markup."""

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import all_matches, first_match, is_full_name, let, unix_lines

# Named entities resolved when a page is reduced to text.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
    "&eacute;": "é", "&egrave;": "è", "&ecirc;": "ê", "&agrave;": "à",
    "&acirc;": "â", "&ccedil;": "ç", "&ouml;": "ö", "&uuml;": "ü",
    "&auml;": "ä", "&szlig;": "ß", "&oslash;": "ø", "&aring;": "å",
    "&ntilde;": "ñ", "&copy;": "©", "&reg;": "®", "&mdash;": "—",
    "&ndash;": "–", "&hellip;": "…", "&middot;": "·", "&rsquo;": "’",
    "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€",
}


def page_handles(html: Column) -> Column:
    """Distinct lower-cased handles a page links to."""
    return F.array_distinct(F.transform(all_matches(html, fixed.PAGE_HANDLE), F.lower))


def _numeric_entities(text: Column) -> Column:
    """Resolve &#NN; and &#xHH;: split at each entity, decode, glue together."""
    parts = F.split(text, r"&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)")

    def decode(part, i):
        code = F.regexp_extract(part, r"^([xX]?[0-9a-fA-F]{1,7});", 1)
        rest = F.substring(part, F.length(code) + 2, F.length(part))
        number = F.when(F.lower(F.substring(code, 1, 1)) == "x",
                        F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code)
        n = number.try_cast("int")
        # One code point, big-endian; the plane above the first needs a surrogate pair.
        low = F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
        pair = F.decode(F.unhex(F.concat(
            F.hex(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)),
            F.hex(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))), "UTF-16BE")
        ch = (F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF) | (n == 0), "�")
               .when(n > 0xFFFF, pair).otherwise(low))
        return F.when(i == 0, part).otherwise(F.concat(ch, rest))

    return F.when(text.contains("&#"), F.array_join(F.transform(parts, decode), "")) \
            .otherwise(text)


def page_text(html: Column) -> Column:
    """Visible text: tags to blanks, entities resolved, blanks collapsed, lower case."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.replace(_numeric_entities(text), F.lit("&amp;"), F.lit("&"))
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_markup(wikitext: Column) -> Column:
    """Wiki markup without references and templates; links reduced to their label."""
    t = F.regexp_replace(wikitext, r"<ref[^>]*/>", "")
    t = F.regexp_replace(t, r"(?is)<ref[^>]*>.*?</ref>", "")
    t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1")
    return F.regexp_replace(t, r"(?i)</?br\s*/?>", ",")


def _trim_name(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t'\"·•"))


def infobox_authors(wikitext: Column) -> Column:
    """Full names in the infobox author field, in order."""
    value = first_match(unix_lines(wikitext), fixed.INFOBOX_AUTHOR)
    toks = F.split(clean_markup(value), r"(?U),|;|\band\b")
    names = F.filter(F.transform(toks, _trim_name), is_full_name)
    return F.coalesce(names, F.array().cast("array<string>"))


def prose_founders(wikitext: Column) -> Column:
    """Names the prose credits with creating the project ("started by X", "X created")."""
    by = rf"(?U)\b{fixed.CREATE_VERB}\s+by\s+({fixed.CAPITALISED_NAME})"
    subject = rf"(?U)\b({fixed.CAPITALISED_NAME})\s+{fixed.CREATE_VERB}\b"
    found = let(clean_markup(wikitext), lambda t: F.concat(all_matches(t, by), all_matches(t, subject)))
    return F.coalesce(F.array_distinct(F.filter(F.transform(found, _trim_name), is_full_name)),
                      F.array().cast("array<string>"))


def article_authors(wikitext: Column) -> Column:
    return F.array_union(infobox_authors(wikitext), prose_founders(wikitext))
