"""Scalar text functions as Column expressions; all run inside the JVM but the decoding of
character references, which Arrow batches do."""

from __future__ import annotations

import html
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The words that a query's lexical form drops.
STOPWORDS = tuple(
    "a an and are as at be by can do does for from get how i in is it me my of on or that the then there this to up want was what when where which why will with you your".split()
)
# The further words that content terms drop.
MORE_STOPWORDS = ("during", "some", "any", "make", "see")
# Words of an opening phrase that say nothing of what a thing does.
FRAMING_WORDS = tuple(
    "open opens launch launches start starts run runs go to the a an and or for of in on with your this it console management settings setting page app application tool program window utility snap applet".split()
)
# Function words that tell prose from listings.
FUNCTION_WORDS = tuple(
    "the a an of to in on for with by from as at into is are was were be been it its this that these those and or but if when which who whose you your their them can will would should may not than then there such each any all more most other between about over up out".split()
)


def words(text: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"))


def normalize_name(text: Column) -> Column:
    """Lower-cased, runs of anything but letters and digits to one blank."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{Nd}]+", " "))


def squash_name(text: Column) -> Column:
    """Letters and digits alone, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]", "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text, r"[\p{L}\p{Nd}]+"))


def restates_name(text: Column, name: Column) -> Column:
    """Whether a text says nothing beyond the name and framing words."""
    known = F.array_union(word_set(name), F.array(*map(F.lit, FRAMING_WORDS)))
    return F.size(F.array_except(word_set(text), known)) == 0


def indexable_summary(summary: Column, name: Column) -> Column:
    return F.when(restates_name(summary, name), F.lit(None)).otherwise(summary)


def indexable_tasks(tasks: Column, name: Column) -> Column:
    known = F.array_union(word_set(name), F.array(*map(F.lit, FRAMING_WORDS)))
    return F.filter(tasks, lambda t: F.size(F.array_except(word_set(t), known)) > 0)


def embedding_text(name: Column, category: Column, summary: Column, tasks: Column, synonyms: Column, details: Column, publisher: Column) -> Column:
    """The text that is embedded: blank parts left out, features never in it."""
    parts = [name, category, indexable_summary(summary, name), F.array_join(indexable_tasks(tasks, name), ". "), F.array_join(synonyms, ", "), details, publisher]
    return F.concat_ws(". ", *(F.when(F.trim(p) != "", F.trim(p)) for p in parts))


def content_terms(text: Column, most: int = 12) -> Column:
    """The first distinct words of three letters or more that are no stop words."""
    stop = F.array(*map(F.lit, STOPWORDS + MORE_STOPWORDS))
    return F.slice(F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))), 1, most)


def lexical_terms(text: Column, most: int = 16) -> Column:
    """Terms of a lexical query: stop words go, except at the end; all stay if none is left."""
    stop = F.array(*map(F.lit, STOPWORDS))
    every = F.slice(words(text, r"[\p{L}\p{Nd}_]+"), 1, most)
    kept = F.filter(every, lambda w, i: (i == F.size(every) - 1) | ~F.array_contains(stop, w))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression that a lambda uses is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def firsts_ignoring_case(values: Column) -> Column:
    """The first spelling of each value in the values' order, by sorting (not by looking each up among all)."""
    marked = F.array_sort(F.transform(values, lambda x, i: F.struct(F.upper(x).alias("u"), i.alias("i"), x.alias("x"))))
    kept = let(marked, lambda s: F.filter(s, lambda e, j: (j == 0) | (F.get(s, F.greatest(j - 1, F.lit(0)))["u"] != e["u"])))
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])


def fold_compounds(text: Column) -> Column:
    """The text and, after it, its hyphenated compounds without their hyphens."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+)")), lambda x: F.replace(x, F.lit("-"), F.lit("")))
    # distinct regardless of case, the first spelling kept
    return let(firsts_ignoring_case(found), lambda firsts: F.when(F.size(firsts) > 0, F.concat_ws(" ", text, F.array_join(firsts, " "))).otherwise(text))


def adjacent_pairs(terms: Column) -> Column:
    """Neighbouring content terms, as typed."""
    n = F.size(terms)
    return F.when(n < 2, F.array().cast("array<struct<a:string,b:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at(terms, i).alias("a"), F.element_at(terms, F.least(i + 1, n)).alias("b")))
    )


# What is scrubbed from harvested text, in order.
SCRUB = (
    (r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://\S+", " "),
    (r"\b[\w.+\-]+@[\w\-]+\.[\w.\-]+\b", " "),
    (r"\{?\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b\}?", " "),
    (r"(?i)\bHKEY_[A-Z_]+(?:\\[^\s]+)?", " "),
    (r"(?i)\b(?:HKLM|HKCU|HKCR|HKU)\\[^\s]+", " "),
    (r"\b[a-zA-Z]:\\[^\s]*", " "),
    (r"%[A-Za-z_][A-Za-z0-9_()]*%[^\s]*", " "),
    (r"\b[0-9a-fA-F]{16,}\b", " "),
    (r"(?<![\w-])[a-z][a-z0-9+.\-]{1,20}:[^\s]{2,}", " "),
    (r"\(\s*\)|\[\s*\]|\{\s*\}", " "),
    (r"(?:\s*[|·•>/-]\s*){2,}", " "),
    (r"\s+([.,;:])", "$1"),
    (r"(?:\.\s*){2,}", ". "),
)
# Mark-up removed from pages, in order.
HTML = (
    (r"(?is)<!--.*?-->", " "),
    (r"(?is)<(script|style|svg|noscript|template|head|iframe|canvas)[^>]*>.*?</\1>", " "),
    (r"(?is)<!doctype[^>]*>", " "),
    (r"(?i)</?(p|div|section|article|main|header|footer|nav|aside|table|tr|td|th|li|ul|ol|br|h[1-6])\b[^>]*>", ". "),
    (r"(?is)<[^>]+>", " "),
)
# Marks removed from Markdown, in order.
MARKDOWN = (
    (r"```[\s\S]*?```", " "),
    (r"`([^`]+)`", "$1"),
    (r"!\[[^\]]*\]\([^\)]+\)", " "),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"(?m)^[#>*\-\s]+", ""),
)
# Phrases of page furniture.
FURNITURE = ("Skip to main content", "Summarize this article for me", "In this article", r"Was this page helpful\??", "Feedback", "Additional resources", "Previous Versions")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));")


def _chain(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def scrub(text: Column) -> Column:
    """Tokens that say nothing (addresses, ids, paths, keys) taken out."""
    return squeeze(_chain(text, SCRUB))


def _decoded(text: str) -> str:
    """Character references by number, and those that HTML 4 and XML name; others stay."""

    def one(m: re.Match) -> str:
        if m[3]:
            code = html.entities.name2codepoint.get(m[3], 39 if m[3] == "apos" else 0)
        else:
            code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return _REFERENCE.sub(one, text)


def decode_entities(text: Column, times: int = 1) -> Column:
    def decode(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            for _ in range(times if x and "&" in x else 0):
                x = _decoded(x)
            out.append(x)
        return pa.array(out, pa.string())

    return arrow_udf(decode, "string")(text)


def strip_html(page: Column, decode: bool = True) -> Column:
    bare = _chain(page, HTML)
    return squeeze(decode_entities(bare, 2) if decode else bare)


def strip_markdown(text: Column) -> Column:
    return plain_text(_chain(text, MARKDOWN))


def looks_like_html(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?is)<!DOCTYPE|<html|</|<(?:p|div|span|body|head|script|style|meta|title|h[1-6]|br|ul|ol|li|table)\b"))


def _finish(bare: Column, most: int) -> Column:
    bare = F.regexp_replace(bare, r"(?im)^\s*(html|xml)\s*:\s*", " ")
    bare = F.regexp_replace(bare, rf"(?i)\b({'|'.join(FURNITURE)})\b", " ")
    return F.substring(scrub(F.coalesce(bare, F.lit(""))), 1, most)


def plain_text(text: Column, most: int = 12288) -> Column:
    """Plain text of a page or a note, scrubbed and cut."""
    return _finish(F.when(looks_like_html(text), strip_html(text)).otherwise(decode_entities(text)), most)


def plain_texts(texts: Column, most: int = 12288) -> Column:
    """:func:`plain_text` of each text of an array, in one pass through Python."""

    def decode(rows: pa.Array) -> pa.Array:
        said = lambda t: t["x"] if t["x"] is None or "&" not in t["x"] else _decoded(_decoded(t["x"])) if t["page"] else _decoded(t["x"])
        return pa.array([[said(t) for t in row] for row in rows.to_pylist()], pa.list_(pa.string()))

    bare = F.transform(texts, lambda t: F.struct(looks_like_html(t).alias("page"), F.when(looks_like_html(t), _chain(t, HTML)).otherwise(t).alias("x")))
    decoded = arrow_udf(decode, "array<string>")(bare)
    return F.zip_with(decoded, texts, lambda d, t: _finish(F.when(looks_like_html(t), squeeze(d)).otherwise(d), most))


def markup_line(line: Column) -> Column:
    """Whether a line is mark-up or a style rule rather than text."""
    value = F.trim(F.coalesce(line, F.lit("")))
    return (
        F.regexp_like(value, F.lit(r"(?i)^(?:html|xml):"))
        | F.regexp_like(value, F.lit(r"(?i)<\s*(?:!doctype|/?html|/?head|/?body|/?script|/?style|/?div|/?span|/?p|/?a|/?meta|/?link)\b"))
        | (F.regexp_like(value, F.lit(r"(?i)&(?:lt|gt|nbsp|quot|apos|amp);")) & F.regexp_like(decode_entities(value), F.lit(r"<[^>]+>")))
        | F.regexp_like(value, F.lit(r"(?i)^\s*(?:\.|#|body\b|html\b)[\w\s.#:-]*\{.*\}\s*$"))
    )


def _attribute(attributes: Column, name: str) -> Column:
    """Value of an attribute in quotes of either kind or in none; null if it isn't there."""
    pattern = rf"""(?i)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    found = F.concat(*(F.coalesce(F.regexp_extract(attributes, pattern, i), F.lit("")) for i in (1, 2, 3)))
    return F.when(F.regexp_like(attributes, F.lit(pattern)), found)


def meta_description(page: Column) -> Column:
    """The first description with content among the page's meta elements, as plain text."""
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<meta\b([^>]+)>"), 1)
    wanted = F.filter(tags, lambda t: F.lower(F.coalesce(_attribute(t, "name"), _attribute(t, "property"))).isin("description", "og:description", "twitter:description") & (F.length(F.trim(_attribute(t, "content"))) > 0))
    return F.nullif(plain_text(decode_entities(_attribute(F.get(wanted, 0), "content"))), F.lit(""))


def page_title(page: Column, decode: bool = True) -> Column:
    """decode: all character references; otherwise those of mark-up (&lt; &gt; &amp;) alone."""
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    said = decode_entities(title) if decode else reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")), title)
    return F.nullif(F.trim(said), F.lit(""))


def json_ld_description(page: Column, least: int = 25) -> Column:
    """The first description of ``least`` characters in the page's linked data."""
    blocks = F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    raw = F.transform(blocks, lambda b: F.regexp_extract(b, r"""(?i)"description"\s*:\s*"((?:[^"\\]|\\.)*)\"""", 1))
    said = F.transform(raw, lambda d: F.trim(F.from_json(F.concat(F.lit('{"d":"'), d, F.lit('"}')), "d string")["d"]))
    return F.get(F.filter(said, lambda d: F.length(d) >= least), 0)


def meta_content(page: Column, key: str, attribute: str) -> Column:
    """Content of the meta element whose attribute has the key, in either order."""
    first = F.regexp_extract(page, rf"""(?i)<meta\s+[^>]*{attribute}\s*=\s*["']{key}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    other = F.regexp_extract(page, rf"""(?i)<meta\s+[^>]*content\s*=\s*["']([^"']*)["'][^>]*{attribute}\s*=\s*["']{key}["']""", 1)
    return F.nullif(F.trim(decode_entities(F.coalesce(F.nullif(first, F.lit("")), other))), F.lit(""))


def shares_lead(a: Column, b: Column) -> Column:
    """Whether one begins with the other, up to a bar or dash and but for punctuation."""
    bare = lambda x: F.lower(F.trim(F.regexp_replace(F.substring_index(F.substring_index(x, "|", 1), "-", 1), r"\W+", " ")))
    x, y = bare(a), bare(b)
    return (F.length(x) > 0) & (F.length(y) > 0) & (x.startswith(y) | y.startswith(x))


def structured_description(page: Column, least: int = 25) -> Column:
    """What a page says of itself: linked data, then its meta elements; no echo of its title."""
    title = page_title(page)
    good = lambda d: F.when((F.length(d) >= least) & ~F.coalesce(shares_lead(d, title), F.lit(False)), d)
    return F.coalesce(good(json_ld_description(page)), good(meta_content(page, "og:description", "property")), good(meta_content(page, "description", "name")))


def _function_words(text: Column, blank: str) -> Column:
    signs = r"""[.,;:()"'!?]*+"""
    return F.regexp_count(text, F.lit(rf"(?i)(?<![^{blank}]){signs}(?:{'|'.join(FUNCTION_WORDS)}){signs}(?![^{blank}])"))


def is_listing(line: Column) -> Column:
    """Ten tokens or more of which few are function words."""
    line = F.coalesce(line, F.lit(""))
    n = F.regexp_count(line, F.lit(r"[^ \t]+"))
    return (n >= 10) & (100 * _function_words(line, r" \t") < 6 * n)


def is_prose(text: Column) -> Column:
    """Eight tokens or more, few of them like identifiers, enough function words."""
    text = F.coalesce(text, F.lit(""))
    n = F.regexp_count(text, F.lit("[^ ]+"))
    coded = F.regexp_count(text, F.lit(r"(?<![^ ])[^ :_\\]*+[:_\\][^ ]*+")) + F.regexp_count(text, F.lit(r"(?<![^ ])\p{Ll}{15,}+(?![^ ])"))
    return (n >= 8) & (100 * coded < 15 * n) & (100 * _function_words(text, " ") >= 6 * n)


def file_size(size: Column) -> Column:
    kb = size.cast("double") / 1024
    return F.when(kb >= 1048576, F.concat(F.format_number(kb / 1048576, 1), F.lit(" GB"))).when(kb >= 1024, F.concat(F.format_number(kb / 1024, 0), F.lit(" MB"))).otherwise(F.concat(F.format_number(kb, 1), F.lit(" KB")))


def launch_command(kind: Column, target: Column, arguments: Column) -> Column:
    """The command line that opens a thing: host by launch kind, quotes where blanks are; an
    address stands as it is."""
    target = F.trim(F.coalesce(target, F.lit("")))
    quote = lambda v: F.when(v.contains(" "), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    own = F.concat_ws(" ", quote(target), F.nullif(F.trim(arguments), F.lit("")))
    line = (
        F.when(kind == 0, F.concat(F.lit("explorer.exe "), quote(F.concat(F.lit("shell:AppsFolder\\"), target))))
        .when(kind == 3, target)
        .when(kind == 4, F.concat(F.lit("control.exe "), quote(target)))
        .when(kind == 5, F.concat(F.lit("mmc.exe "), quote(target)))
        .otherwise(own)
    )
    return F.when(target == "", F.lit("")).otherwise(line)


def version_parts(version: Column) -> Column:
    """Up to four numbers of a version; what is no number is 0; two at least."""
    parts = F.transform(F.slice(F.split(version, r"[.\-]"), 1, 4), lambda x: F.coalesce(F.try_to_number(F.nullif(x, F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)))
    return F.when(F.size(parts) < 2, F.concat(parts, F.array(F.lit(0)))).otherwise(parts)
