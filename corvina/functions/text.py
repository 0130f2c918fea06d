"""Text scalars, Column -> Column: normalising, hashing, tokens, slugs, detectors.  All run inside whole-stage code."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicon

#: Letters whose canonical decomposition is one letter and marks, by rule (Latin, Greek, Cyrillic and their extensions).
_FOLD = {chr(c): d[0] for c in range(0xC0, 0x2000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isalpha() and all(unicodedata.category(m) == "Mn" for m in d[1:])}
ACCENTED, PLAIN = "".join(_FOLD), "".join(_FOLD.values())


def strip_accents(c: Column) -> Column:
    """Letters without their marks; marks of their own go."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")


def md5_key(*parts: Column) -> Column:
    """The key of a cached answer: md5 of its parts."""
    return F.md5(F.concat(*parts))


def prompt_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def normalise(c: Column) -> Column:
    """Lower case, one apostrophe, no trailing punctuation, single spaces."""
    c = F.regexp_replace(F.translate(F.lower(c), "’‘ʼ", "'''"), "[ \\t\\n\\r]+", " ")
    return F.trim(F.regexp_replace(F.trim(c), "[?!.,;:… ]+$", ""))


def tokens(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """Sorted distinct tokens of two characters or more, without stop words; hyphens stay within them.

    What ``normalise`` changes beyond case lies between tokens, so it is left out.
    """
    flat = F.regexp_replace(strip_accents(F.lower(c)), r"[^\p{L}\p{N}_-]+", " ")
    words = F.filter(F.split(flat, " "), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in lex.stop_words]))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


#: The letters that a slug writes without their marks.
SLUG_LETTERS = ("àáâãèéêëìíîïòóôõùúûüç", "aaaaeeeeiiiioooouuuuc")


def slug(c: Column, most: int = 60) -> Column:
    """Lower case; all but a-z and 0-9 is dashes, none at the ends before the cut; of accented letters the SLUG_LETTERS are kept."""
    flat = F.regexp_replace(F.translate(F.lower(c), *SLUG_LETTERS), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(flat, "^-+|-+$", ""), 1, most)


def language(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """Two-way: source text is en; else en where its markers lead and over nine tenths are ASCII; else fr."""
    low = F.lower(c)
    ascii_share = F.length(F.regexp_replace(c, "[^\\x00-\\x7F]", "")) / F.greatest(F.length(c), F.lit(1))
    leads = F.regexp_count(low, F.lit(lex.english)) > F.regexp_count(low, F.lit(lex.french))
    return F.when(c.rlike(lex.source_text), "en").when(leads & (ascii_share > 0.9), "en").otherwise("fr")


def domain(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """The first rule that matches."""
    out, low = F, F.lower(c)
    for label, pattern in lex.domains:
        out = out.when(low.rlike(pattern), label)
    return out.otherwise("general")


def category(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """The first label of which a part occurs."""
    out, low = F, F.lower(c)
    for label, parts in lex.categories:
        hit = F.contains(low, F.lit(parts[0]))
        for p in parts[1:]:
            hit = hit | F.contains(low, F.lit(p))
        out = out.when(hit, label)
    return out.otherwise(lex.default_category)


def header_field(c: Column, name: str, within: int = 1000) -> Column:
    """The value of ``**name** : value`` in the head of a note; empty where there is none."""
    return F.trim(F.regexp_extract(F.substring(c, 1, within), rf"\*\*{name}\*\* *: *([^\n]*)", 1))


def heading(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?m)^# ([^\n]+)$", 1))


def bullets(c: Column) -> Column:
    """Texts of lines that begin with a dash, star or dot."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x).rlike("^[-*•] "))
    return F.transform(lines, lambda x: F.regexp_replace(F.trim(x), "^[-*•] +", ""))


def without_thinking(c: Column, tag: str = "think") -> Column:
    return F.trim(F.regexp_replace(c, f"(?s)<{tag}>.*?</{tag}>", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1))


def url_class(url: Column, lex: Lexicon = DEFAULT) -> Column:
    """The medium of an address, by its host without ``www.``; else web."""
    h, out = F.regexp_replace(host(url), "^www[.]", ""), F
    for label, hosts in lex.media_hosts:
        out = out.when(h.isin(*hosts), label)
    return out.otherwise("web")


#: Named characters of HTML 4, from the standard library's table.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
#: An entity after its ampersand: a name, a decimal or a hexadecimal number.
_ENTITY = "(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescaped(c: Column) -> Column:
    """Entities of a text as characters, once; numbers that name no character are U+FFFD, unknown names stay."""
    pieces = F.split(c, f"&(?={_ENTITY})")
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def char(name: Column) -> Column:
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")
        named = digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        code = F.decode(F.unhex(F.lpad(F.hex(F.when(named, digits).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(name.startswith("#"), code).otherwise(F.coalesce(F.try_element_at(names, name), F.concat(F.lit("&"), name, F.lit(";"))))

    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.concat(char(F.substring_index(p, ";", 1)), F.substring(p, F.instr(p, F.lit(";")) + 1, F.length(p))))
    return F.when(F.size(pieces) > 1, F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(c)


def main_text(html: Column) -> Column:
    """Text of a page without script, style, navigation, footer and header parts; tags in any case, entities as characters, single spaces."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header"):
        out = F.regexp_replace(out, f"(?is)<{tag}(?:[\\s/][^>]*)?>.*?</{tag}\\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(out), "[ \\t\\n\\r\u00a0]+", " "))


def flag(c: Column, pattern: str) -> Column:
    return F.lower(c).rlike(pattern)


def count_flags(c: Column, patterns: tuple[str, ...]) -> Column:
    return sum((flag(c, p).cast("int") for p in patterns), F.lit(0))


def fast_or_deep(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """deep has one point beforehand and wins ties."""
    words = F.size(F.filter(F.split(c, "[ \\t\\n\\r]+"), lambda w: w != ""))
    deep = count_flags(c, lex.deep) + 1 + F.when(words > 20, 2).when(words > 12, 1).otherwise(0) + (F.regexp_count(c, F.lit("[?]")) > 1).cast("int")
    fast = count_flags(c, lex.fast) + (words < 5).cast("int")
    return F.when(deep >= fast, "deep").otherwise("fast")


def ioc(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """{kind, value}: an IPv4 (not private, unless the text says so), else a 64-digit hash in a short text or with a keyword."""
    ip = F.regexp_extract(c, "([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})", 1)
    told = flag(c, lex.threats)
    digest = F.regexp_extract(F.lower(c), "(?:^|[^0-9a-f])([0-9a-f]{64})(?:[^0-9a-f]|$)", 1)
    kind = F.when((ip != "") & (told | ~ip.rlike("^(?:127[.]|192[.]168[.]|10[.])")), "ip").when((digest != "") & (told | (F.length(F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))) < 80)), "hash")
    return F.struct(kind.alias("kind"), F.when(kind == "ip", ip).when(kind == "hash", digest).alias("value"))


def csv_path(c: Column, lex: Lexicon = DEFAULT) -> Column:
    found = F.regexp_extract(c, lex.csv, 1)
    if not lex.csv.endswith("[.]csv)") or "|" in lex.csv or "(?" in lex.csv:
        return found
    # a path's pattern is tried at every letter: only where a text has the end of one
    return F.when(F.contains(c, F.lit(".csv")), found).when(c.isNotNull(), "")


def pages(spec: Column, total: Column) -> Column:
    """Sorted distinct pages of a spec such as 1-5,8, within 1..total."""
    parts = F.filter(F.split(F.regexp_replace(spec, " ", ""), ","), lambda p: p.rlike("^[0-9]+(-[0-9]+)?$"))

    def span(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.split_part(p, F.lit("-"), F.lit(-1)).cast("int")
        return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, span)), lambda p: p.between(1, total))))
