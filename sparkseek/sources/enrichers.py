"""Documents about entities, from text that was harvested beside them.

Each enricher is a plan over harvested tables; what only the machine or the network can give is an
input.  All return the documents schema (entity_id, provider, is_online, text, source_uri,
retrieved_at)."""

from __future__ import annotations

import json
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import firsts_ignoring_case, is_listing, meta_description, normalize_name, page_title, plain_text, squash_name, strip_markdown, word_set
from ..operators.build import first_wins
from ..schema import DOCUMENTS

# Limits of help screens, of notes and of article extracts.
HELP_CHARS, HELP_OK, HELP_FAILED, HELP_LINES = 4096, 120, 300, 2
NOTE_FILES, NOTE_CHARS = 8, 8000
SENTENCE_MIN, SENTENCE_MAX, SENTENCES, EXTRACT = 40, 300, 5, 900
# Tiers of an article's match, and the parts of an encyclopedia match's score.
ARTICLE_TIERS = {"collector": 5, "toc": 4, "slug": 3, "title": 2}
MAX_ARTICLES = 2
VENDOR, QUALIFIER, PUBLISHER, CASING = 4, 2, 2, 1
# Placeholders that a version resource may hold.
PLACEHOLDERS = ("", "unknown", "none", "n/a", "todo", "default", "description", "product name", "company name")


def documents(rows: DataFrame, provider: str, online: bool) -> DataFrame:
    """The documents schema from (entity_id, text[, source_uri, retrieved_at]); blanks go."""
    have = set(rows.columns)
    value = lambda f: F.col(f.name) if f.name in have else F.lit(None)
    out = rows.withColumn("provider", F.lit(provider)).withColumn("is_online", F.lit(online))
    have |= {"provider", "is_online"}
    return out.select(*(value(f).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields)).where(F.length(F.trim("text")) > 0)


def labelled_lines(**fields: Column) -> Column:
    """Lines "Label: value" of what is no placeholder."""
    good = lambda c: F.length(F.trim(c)).isNotNull() & ~F.lower(F.trim(c)).isin(*PLACEHOLDERS)
    return F.concat_ws("\n", *(F.when(good(c), F.concat(F.lit(f"{k.replace('_', ' ').capitalize()}: "), F.trim(c))) for k, c in fields.items()))


def version_resources(rows: DataFrame) -> DataFrame:
    """(entity_id, product_name, file_description, company)."""
    return documents(rows.select("entity_id", labelled_lines(product_name=F.col("product_name"), file_description=F.col("file_description"), company=F.col("company")).alias("text")), "pe-version", False)


def shortcuts(rows: DataFrame) -> DataFrame:
    """(entity_id, comment, folder): the comment, and the place in the menu."""
    places = F.filter(F.split(F.coalesce("folder", F.lit("")), r"[\\/]"), lambda p: F.trim(p) != "")
    shelf = F.when(F.size(places) > 0, F.concat(F.lit("Categorized under "), F.array_join(places, ", "), F.lit(" in the Start Menu.")))
    return documents(rows.select("entity_id", F.concat_ws(" ", F.nullif(F.trim("comment"), F.lit("")), shelf).alias("text")), "shortcut", False)


def local_notes(files: DataFrame) -> DataFrame:
    """(entity_id, file, depth, size, text): read-me and help files beside a program, the
    nearest first; not legal notes, change logs or files of a neighbouring program."""
    name = F.lower("file")
    wanted = name.rlike(r"^(readme|help|doc)") | name.rlike(r"\.(md|chm)$")
    legal = name.rlike(r"^(licen[cs]e|copying|eula|notice|third.?party|change.?log|changes|history|release)")
    stems = files.where(name.rlike(r"\.exe$")).select("entity_id", F.regexp_replace(name, r"\.exe$", "").alias("stem")).distinct()
    own = files.where(wanted & ~legal & (F.col("size") <= 262_144)).withColumn("stem", F.regexp_replace(name, r"\.[^.]+$", "")).join(stems, ["entity_id", "stem"], "left_anti")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("depth", F.lower("file")))
    kept = own.withColumn("place", place).where(F.col("place") <= NOTE_FILES)
    return documents(kept.select("entity_id", F.substring(strip_markdown(F.col("text")), 1, NOTE_CHARS).alias("text")), "local-docs", False)


def help_accepted(text: Column, exit_code: Column) -> Column:
    """Whether a captured help screen says anything: long enough for how it ended, two lines
    at least, no crash."""
    lines = F.size(F.filter(F.split(text, r"[\r\n]+"), lambda x: F.trim(x) != ""))
    crash = F.lower(text).rlike(r"unhandled exception|stack trace|traceback \(most recent|segmentation fault|at [\w.]+\([^)]*\) in ")
    enough = F.length(F.trim(text)) >= F.when(exit_code == 0, F.lit(HELP_OK)).otherwise(F.lit(HELP_FAILED))
    return F.coalesce(enough & (lines >= HELP_LINES) & ~crash, F.lit(False))


def command_help(captured: DataFrame) -> DataFrame:
    """(entity_id, switch_position, text, exit_code): the first accepted screen of a program."""
    clean = captured.withColumn("text", F.replace("text", F.lit("\u0000"), F.lit(""))).where(help_accepted(F.col("text"), F.col("exit_code")))
    best = first_wins(clean, ["entity_id"], ["switch_position"])
    return documents(best.select("entity_id", F.substring("text", 1, HELP_CHARS).alias("text")), "cli-help", False)


def package_matches(entities: DataFrame, packages: DataFrame) -> DataFrame:
    """Entities (id, display_name, publisher) with the newest plausible package (name, publisher,
    version, text): all words of three letters of the name are the package's, and the
    publishers agree.

    Rows meet by one word, the longest of the name, so nothing is compared with everything."""
    tokens = F.filter(word_set(F.col("display_name")), lambda w: F.length(w) >= 3)
    longest = F.element_at(F.array_sort(F.transform(tokens, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    left = entities.select("id", F.col("publisher").alias("own"), tokens.alias("wanted"), F.when(F.size(tokens) > 0, longest).alias("t")).where("t is not null")
    right = packages.select(F.col("name"), F.col("publisher").alias("theirs"), "version", "text", word_set(F.col("name")).alias("have")).withColumn("t", F.explode("have"))
    squash = lambda c: F.regexp_replace(squash_name(F.col(c)), r"(inc|corp|corporation|ltd|llc|gmbh)$", "")
    agree = F.col("own").isNull() | squash("own").contains(squash("theirs")) | squash("theirs").contains(squash("own"))
    numbers = F.transform(F.split("version", r"[.\-]"), lambda x: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, "^([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)))
    both = left.join(right, "t").where((F.size(F.array_except("wanted", "have")) == 0) & F.coalesce(agree, F.lit(False))).withColumn("v", numbers)
    best = both.groupBy("id").agg(F.max_by(F.struct("name", "version", "text"), F.struct("v", "name")).alias("b"))
    return documents(best.select(F.col("id").alias("entity_id"), "b.text"), "winget", True)


def useful_sentences(text: Column) -> Column:
    """Up to five sentences of 40 to 300 characters, 900 in all, that are no listings."""
    every = F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim)
    good = F.slice(F.filter(every, lambda s: F.length(s).between(SENTENCE_MIN, SENTENCE_MAX) & ~is_listing(s)), 1, SENTENCES)
    return F.aggregate(good, F.lit(""), lambda acc, s: F.when(F.length(acc) + F.length(s) + 1 > EXTRACT, acc).otherwise(F.trim(F.concat_ws(" ", acc, s))))


def articles(candidates: DataFrame) -> DataFrame:
    """(entity_id, url, how, html): of each entity the best tier's articles, two at most; hubs
    and pages that say nothing go."""
    tier = F.lit(0)
    for how, n in ARTICLE_TIERS.items():
        tier = F.when(F.col("how") == how, n).otherwise(tier)
    said = useful_sentences(plain_text(F.col("html")))
    rows = candidates.withColumn("tier", tier).where(~F.lower("url").rlike(r"/(index|overview)?/?$")).withColumn("text", F.concat_ws(" ", meta_description(F.col("html")), said)).where("tier > 0 and length(text) > 0")
    w = Window.partitionBy("entity_id").orderBy(F.desc("tier"))
    top = rows.withColumn("r", F.rank().over(w)).where("r = 1")
    kept = top.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("url"))).where(F.col("n") <= MAX_ARTICLES)
    return documents(kept.select("entity_id", "text", F.col("url").alias("source_uri")), "learn", True)


#: Parts of the address of a directory (scheme, host, folders) at least; directories and names tried for an entity.
DIRECTORY_PARTS, DIRECTORIES, SLUGS = 4, 2, 3


def directory_of(url: Column) -> Column:
    """The address up to and with the last slash of its path, without query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    return F.regexp_extract(bare, r"^(.*/)[^/]*$", 1)


def url_templates(pages: DataFrame, support: int = 2, parts: int = DIRECTORY_PARTS) -> DataFrame:
    """(directory, pages): directories in which ``support`` pages or more (url) differ by their last part
    alone, so another article may stand there under its own name."""
    last = F.regexp_extract(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/+$", ""), r"([^/]*)$", 1)
    rows = pages.select(directory_of(F.col("url")).alias("directory"), last.alias("last")).where(F.size(F.filter(F.split("directory", "/"), lambda x: x != "")) >= parts).distinct()
    return rows.groupBy("directory").agg(F.count("*").alias("pages")).where(F.col("pages") >= support)


def slugs(name: Column, *tokens: Column) -> Column:
    """Names under which an article may stand: the words with hyphens, all in one, and other tokens; of four
    letters or more."""
    hyphens = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""))
    every = F.array(hyphens, squash_name(name), *(squash_name(t) for t in tokens))
    return F.slice(F.array_distinct(F.filter(every, lambda s: F.length(s) >= 4)), 1, SLUGS)


def sibling_candidates(entities: DataFrame, neighbours: DataFrame, known: DataFrame, support: int = 1, parts: int = DIRECTORY_PARTS) -> DataFrame:
    """(entity_id, url, position): addresses to try for entities (id, display_name) that no search resolved: the names
    of an entity in the directories of pages that a search found near it (entity_id, url, position), less
    what is known already (url).

    A directory counts if ``support`` of all neighbours' pages stand in it; of each entity the first
    ``DIRECTORIES`` by position are tried, so an entity has six addresses at most."""
    rows = neighbours.withColumn("directory", directory_of(F.col("url"))).join(url_templates(neighbours, support, parts).select("directory"), "directory", "left_semi")
    first = rows.groupBy("entity_id", "directory").agg(F.min("position").alias("position"))
    w = Window.partitionBy("entity_id").orderBy("position", "directory")
    near = first.withColumn("d", F.row_number().over(w)).where(F.col("d") <= DIRECTORIES)
    named = entities.select(F.col("id").alias("entity_id"), F.posexplode(slugs(F.col("display_name"))).alias("s", "slug"))
    tried = near.join(named, "entity_id").select("entity_id", F.concat("directory", "slug").alias("url"), ((F.col("d") - 1) * SLUGS + F.col("s")).cast("int").alias("position"))
    return tried.join(known.select("url").distinct(), "url", "left_anti").select("entity_id", "url", "position")


def probed_articles(entities: DataFrame, fetched: DataFrame) -> DataFrame:
    """(entity_id, url, how, html) of the first probed page (entity_id, url, position, html) whose title names its
    entity: a site may answer any address with some page."""
    title = page_title(F.col("html"))
    words = lambda c: F.concat(F.lit(" "), normalize_name(c), F.lit(" "))
    rows = fetched.join(entities.select(F.col("id").alias("entity_id"), "display_name"), "entity_id").where(words(title).contains(words(F.col("display_name"))))
    return first_wins(rows.select("entity_id", "url", "position", "html"), ["entity_id"], ["position", "url"]).select("entity_id", "url", F.lit("slug").alias("how"), "html")


TOC_ENTRY = "array<struct<title:string,url:string,position:int>>"
# Openings of titles that are left off in a second reading.
TITLE_OPENINGS = r"(?i)^(using|use|about|what is|what's|overview of|overview|introduction to|intro to|working with|get started with|getting started with|the)\s+"


def _toc_entries(trees: pa.Array, bases: pa.Array) -> pa.Array:
    def walk(node, base: str, host: str, out: list) -> None:
        todo = [node]
        while todo:  # in the order of the text, without recursion
            x = todo.pop()
            if isinstance(x, dict):
                title, href = x.get("toc_title"), x.get("href")
                if isinstance(title, str) and isinstance(href, str) and title.strip() and href.strip() and not href.startswith("#") and "://" not in href:
                    url = urlsplit(urljoin(base, href))
                    if url.netloc.lower() == host:
                        out.append({"title": " ".join(title.split()), "url": f"{url.scheme}://{url.netloc}{url.path}", "position": len(out)})
                todo.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                todo.extend(reversed(x))

    rows = []
    for tree, base in zip(trees.to_pylist(), bases.to_pylist(), strict=True):
        out: list = []
        try:
            walk(json.loads(tree or "null"), base, urlsplit(base).netloc.lower(), out)
        except ValueError:
            out = []
        rows.append(out)
    return pa.array(rows, pa.list_(pa.struct([("title", pa.string()), ("url", pa.string()), ("position", pa.int32())])))


def toc_entries(trees: DataFrame) -> DataFrame:
    """(title, url, position) of tables of contents (root, base, json): pages of the base's own site, in
    the order of the roots and of their text; a title counts without its opening, too.  Titles of
    fewer than four letters and digits go."""
    rows = trees.select("root", F.explode(arrow_udf(_toc_entries, TOC_ENTRY)("json", "base")).alias("e")).select("root", "e.*")
    short = F.regexp_replace("title", TITLE_OPENINGS, "")
    both = rows.withColumn("title", F.explode(F.array_distinct(F.array("title", short)))).withColumn("position", F.col("root").cast("long") * 10_000_000 + F.col("position"))
    return both.where(F.length(squash_name(F.col("title"))) >= 4).select("title", "url", "position")


MANIFEST = "struct<name:string,description:string,publisher:string,apps:array<struct<id:string,executable:string,name:string,description:string>>>"


def _manifests(texts: pa.Array) -> pa.Array:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    rows = []
    for text in texts.to_pylist():
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            rows.append(None)
            continue
        first = lambda name, root=root: next((e.text for e in root.iter() if local(e) == name), None)
        apps = []
        for app in (e for e in root.iter() if local(e) == "Application"):
            seen = next((e for e in app.iter() if local(e) == "VisualElements"), None)
            of = (lambda k, seen=seen: None if seen is None else next((v for a, v in seen.attrib.items() if a.rsplit("}", 1)[-1] == k), None))
            apps.append({"id": app.get("Id"), "executable": app.get("Executable"), "name": of("DisplayName"), "description": of("Description")})
        rows.append({"name": first("DisplayName"), "description": first("Description"), "publisher": first("PublisherDisplayName"), "apps": apps})
    app = pa.struct([(k, pa.string()) for k in ("id", "executable", "name", "description")])
    return pa.array(rows, pa.struct([("name", pa.string()), ("description", pa.string()), ("publisher", pa.string()), ("apps", pa.list_(app))]))


def manifest_parts(manifests: DataFrame) -> DataFrame:
    """(family, m) of package manifests (family, xml); what is no XML gives null."""
    return manifests.select("family", arrow_udf(_manifests, MANIFEST)("xml").alias("m"))


def package_manifests(apps: DataFrame, manifests: DataFrame) -> DataFrame:
    """Documents of packaged applications (entity_id, family, app) by their package's manifest (family,
    xml): what the package says, and the application of that id, or the only one.  References
    to resources say nothing."""
    rows = apps.join(manifest_parts(manifests).where("m is not null"), "family")
    every = F.col("m.apps")
    own = F.filter(every, lambda a: F.col("app").isNull() | (F.lower(a["id"]) == F.lower(F.col("app"))))
    scope = F.when(F.size(own) > 0, own).when(F.size(every) == 1, every).otherwise(F.array().cast(dict(rows.select(every.alias("x")).dtypes)["x"]))
    clean = lambda c: F.when(~F.lower(F.trim(c)).startswith("ms-resource:") & (F.trim(c) != ""), F.trim(F.regexp_replace(c, r"\s+", " ")))
    line = lambda label, c: F.when(clean(c).isNotNull(), F.concat(F.lit(f"{label}: "), clean(c)))
    seen = F.flatten(F.transform(scope, lambda a: F.array(line("Application description", a["description"]), line("Application display name", a["name"]))))
    lines = F.concat(F.array(line("Display name", F.col("m.name")), line("Description", F.col("m.description")), line("Publisher", F.col("m.publisher"))), seen)
    lines = F.filter(lines, lambda x: x.isNotNull())
    lines = firsts_ignoring_case(lines)
    return documents(rows.select("entity_id", F.array_join(lines, "\n").alias("text")), "msix-manifest", False)


def toc_lookup(entities: DataFrame, toc: DataFrame) -> DataFrame:
    """(id, url): entries (title, url, position) of a table of contents by plain title; the
    first of equal titles counts."""
    entries = first_wins(toc.withColumn("plain", squash_name(F.col("title"))).where("plain <> ''"), ["plain"], ["position", "url"])
    return entities.select("id", squash_name(F.col("display_name")).alias("plain")).join(entries.select("plain", "url"), "plain").select("id", "url")


def encyclopedia(candidates: DataFrame) -> DataFrame:
    """(entity_id, display_name, publisher, title, lead): the best-scored article about
    software of each entity."""
    software = F.lower("lead").rlike(r"software|program|application|operating system|utility|tool|browser|editor")
    vendor = F.lower("title").startswith(F.concat(F.lower(F.substring_index("publisher", " ", 1)), F.lit(" ")))
    qualified = F.col("title").rlike(r"(?i)\((?:software|computer program|application|web browser|operating system)\)")
    named = F.instr(F.lower("lead"), F.lower(F.substring_index("publisher", " ", 1))) > 0
    bare = F.trim(F.regexp_replace("title", r"\s*\([^)]*\)", ""))
    number = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = number(vendor, VENDOR) + number(qualified, QUALIFIER) + number(named, PUBLISHER) + number(bare == F.col("display_name"), CASING)
    best = first_wins(candidates.where(software).withColumn("score", score), ["entity_id"], [F.desc("score"), "title"])
    return documents(best.select("entity_id", F.col("lead").alias("text")), "wikipedia", True)


def publisher_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """The description of the first web address in an entity's metadata; pages (url, html)."""
    links = F.filter(F.map_entries("raw_metadata"), lambda e: F.lower(e["key"]).rlike("url|website|homepage") & F.lower(e["value"]).rlike("^https?://"))
    asked = entities.select(F.col("id").alias("entity_id"), F.get(F.array_sort(links), 0)["value"].alias("url")).where("url is not null")
    rows = asked.join(pages, "url").select("entity_id", meta_description(F.col("html")).alias("text"), F.col("url").alias("source_uri"))
    return documents(rows.where("text is not null"), "publisher-site", True)


def feature_name(name: Column, known: dict[str, str] | None = None) -> Column:
    """A readable name of an optional feature: the known one, else its parts without noise."""
    noise = ("windows", "microsoft", "feature", "features", "package", "client", "optional", "server", "foundation", "onecore", "capability")
    parts = F.split(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "), r"[\s._-]+")
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*noise))
    out = F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(name)
    for key, said in (known or {}).items():
        out = F.when(squash_name(name) == F.lit("".join(c for c in key.lower() if c.isalnum())), F.lit(said)).otherwise(out)
    return out
