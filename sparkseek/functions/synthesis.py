"""Profiles from metadata and harvested documents: summary, tasks, synonyms, category, details.

All but the caption vocabulary is DataFrame expressions; captions are admitted one after the
other against what was admitted before, which is a fold in an Arrow UDF."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .text import firsts_ignoring_case, is_listing, is_prose, plain_texts, word_set

# Sources of a description, the best first; then those of details.
DESCRIBERS = ("pe-version", "msix-manifest", "winget", "wikipedia", "learn", "publisher-site", "local-docs", "shortcut")
DETAILERS = ("wikipedia", "learn", "winget", "msix-manifest", "publisher-site", "local-docs", "cli-help")
# Words that tell nothing of a program.
UNINFORMATIVE = tuple("the a an and or for of to in on with by from is are app apps application applications display name tool tools utility program software microsoft windows suite package version open run start".split())
# Marks of texts about the shortcut rather than the program.
SHELF = ("categorized under", "in the start menu", "start menu folder", "shortcut to", "installed under", "located in", "this shortcut")
# Vocabulary of a description and the intent it stands for.
INTENTS = (
    ("browser", "search the web"), ("web", "browse websites and search the internet"), ("internet", "connect to the internet"),
    ("microphone", "choose the default microphone"), ("audio input", "set the audio input device"), ("sound", "adjust sound devices"),
    ("battery", "find why battery is draining"), ("energy", "reduce power use"), ("power", "change power settings"),
    ("text size", "make text bigger"), ("font size", "increase font size"), ("accessibility", "make Windows easier to use"),
    ("disk", "manage disks and storage"), ("temporary", "remove temporary files"), ("driver", "manage device drivers"),
    ("device", "manage connected devices"), ("network", "troubleshoot network connections"), ("printer", "manage printers"),
    ("display", "change display settings"), ("security", "review security settings"), ("update", "manage Windows updates"), ("file", "work with files"),
)
# What a kind is for, and the category of a kind, of a file and of an address.
KIND_TASKS = {2: "change Windows settings", 4: "manage Windows components", 3: "configure Control Panel settings", 6: "troubleshoot Windows from the command line"}
KIND_CATEGORIES = {0: "Applications", 1: "Applications", 3: "Control Panel", 4: "Management Consoles", 5: "Windows Features", 6: "System Tools", 7: "Files & Folders"}
FILE_CATEGORIES = {
    "Storage & Disk": ("cleanmgr.exe", "chkdsk.exe", "diskpart.exe", "fsutil.exe", "compact.exe", "cipher.exe", "diskmgmt.msc"),
    "Devices & Hardware": ("devmgmt.msc", "hdwwiz.cpl", "driverquery.exe", "dxdiag.exe"),
    "Networking": ("ipconfig.exe", "ping.exe", "tracert.exe", "netstat.exe", "nslookup.exe", "route.exe", "arp.exe", "netsh.exe"),
    "System Administration": ("regedit.exe", "reg.exe", "services.msc", "taskschd.msc", "eventvwr.msc", "perfmon.msc", "resmon.exe"),
}
LABELS = "Summary|Tasks|Synonyms|Tags|Moniker|Description|Short Description|Application description|Homepage|Publisher|Name|Product name|Company"
MAX_TASKS, MAX_SYNONYMS, MAX_DETAILS, MIN_DETAILS = 10, 24, 600, 40


def coded(word: Column) -> Column:
    """Whether a word is an identifier: 16 letters and digits without a break, or 12 of both
    kinds.  A capital after a small letter is a break."""
    runs = F.split(F.regexp_replace(word, r"(?<=\p{Ll})(?=\p{Lu})", " "), r"[^\p{L}\p{Nd}]+")
    mixed = lambda r: (F.length(r) >= 12) & r.rlike(r"\p{Nd}") & r.rlike(r"\p{L}")
    return (F.length(word) >= 12) & F.exists(runs, lambda r: (F.length(r) >= 16) | mixed(r))


def adds_information(name: Column, candidate: Column) -> Column:
    """Two words at least that are neither the name's nor generic, no identifiers, and nothing
    about shortcuts."""
    known = F.array_union(word_set(name), F.array(*map(F.lit, UNINFORMATIVE)))
    new = F.filter(F.array_except(word_set(candidate), known), lambda w: F.length(w) > 2)
    noisy = F.exists(F.split(candidate, r"[\s,;:()\[\]]+"), coded)
    low = F.lower(candidate)
    shelf = F.exists(F.array(*map(F.lit, SHELF)), lambda m: low.contains(m))
    return F.coalesce((F.size(new) >= 2) & ~noisy & ~shelf, F.lit(False))


def labelled(text: Column, label: str) -> Column:
    """The value after a label, up to the next one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?is)\b{label}\s*:\s*(.*?)(?=\b(?:{LABELS})\s*:|$)", 1)), F.lit(""))


def labelled_phrases(text: Column, label: str) -> Column:
    parts = F.split(F.coalesce(labelled(text, label), F.lit("")), r"[;,|]")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) >= 2)


def useful_line(text: Column) -> Column:
    """A labelled description, else the first line that describes and is no other label."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n.]+"), lambda x: F.trim(F.regexp_replace(x, r"(?i)^\s*(file description|description|short description|summary)\s*:\s*", "")))
    good = F.filter(lines, lambda x: (F.length(x) >= 12) & ~x.rlike(rf"(?i)^(?:{LABELS})\s*:") & ~x.rlike(r"^\d+(?:\.\d+)*\s+\w") & ~x.rlike(r"<[^>]+>"))
    return F.coalesce(labelled(text, "Summary"), labelled(text, "Short Description"), labelled(text, "Description"), F.get(good, 0))


def category(kind: Column, target: Column, file: Column, folder: Column) -> Column:
    leaf = F.element_at(F.filter(F.split(F.coalesce(folder, F.lit("")), r"[\\/]"), lambda p: F.trim(p) != ""), -1)
    leaf = F.when(F.length(F.regexp_replace(F.coalesce(folder, F.lit("")), r"[\\/\s]", "")) > 0, F.trim(leaf))
    by_file = F.lit(None).cast("string")
    for said, files in FILE_CATEGORIES.items():
        by_file = F.when(F.lower(file).isin(*files), F.lit(said)).otherwise(by_file)
    by_kind = F.lit("Utilities")
    for k, said in KIND_CATEGORIES.items():
        by_kind = F.when(kind == k, F.lit(said)).otherwise(by_kind)
    return F.coalesce(leaf, by_file, F.when(F.lower(target).startswith("ms-settings:"), F.lit("Windows Settings")), by_kind)


def intents(text: Column) -> Column:
    rules = F.array(*(F.struct(F.lit(rf"(?i)\b{k}s?\b").alias("k"), F.lit(t).alias("t")) for k, t in INTENTS))
    return F.transform(F.filter(rules, lambda r: F.regexp_like(text, r["k"])), lambda r: r["t"])


def distinctive(phrases: Column, most: int = MAX_TASKS, percent: int = 60) -> Column:
    """Phrases in order without near duplicates: those whose words contain, or are contained
    in, those of one before, or share ``percent`` percent with them."""

    def fresh(kept: Column, p: Column) -> Column:
        mine = word_set(p)

        def near(q: Column) -> Column:
            other = word_set(q)
            both = F.size(F.array_intersect(mine, other))
            return (both == F.size(mine)) | (both == F.size(other)) | (100 * both >= percent * F.size(F.array_union(mine, other)))

        return (F.size(mine) > 0) & (F.size(kept) < most) & ~F.exists(kept, near)

    return F.aggregate(phrases, F.array().cast("array<string>"), lambda kept, p: F.when(fresh(kept, p), F.array_append(kept, p)).otherwise(kept))


def distinct_ignoring_case(values: Column, most: int) -> Column:
    return F.slice(firsts_ignoring_case(F.filter(values, lambda x: F.trim(x) != "")), 1, most)


def action_verbs(words: Column, name: Column) -> Column:
    """Verbs behind agent nouns that the name doesn't have: debugger -> debug; editor -> edit, edite;
    manager -> manag, manage."""
    agents = F.filter(words, lambda w: (F.length(w) >= 6) & w.rlike("(er|or)$") & ~F.array_contains(word_set(name), w))
    stems = F.filter(F.transform(agents, lambda w: F.substr(w, F.lit(1), F.length(w) - 2)), lambda s: F.length(s) >= 3)
    doubled = lambda s: (F.length(s) > 3) & s.rlike(r"([^aeiou])\1$")
    said = F.transform(stems, lambda s: F.when(doubled(s), F.array(F.substr(s, F.lit(1), F.length(s) - 1))).when(s.rlike("[aeiou]$"), F.array(s)).otherwise(F.array(s, F.concat(s, F.lit("e")))))
    return F.array_distinct(F.flatten(said))


def synonyms(name: Column, file: Column, target: Column, documents: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, r"(?i)^(Microsoft Windows|Microsoft|Windows)\s+", ""))
    parts = F.transform(F.filter(F.split(F.regexp_replace(bare, r"(?<=[a-z])(?=[A-Z])", " "), "[^A-Za-z0-9]+"), lambda t: F.length(t) > 1), F.lower)
    initials = F.array_join(F.transform(parts, lambda t: F.substring(t, 1, 1)), "")
    some = F.array(name, bare)
    more = F.array(F.when(F.length(initials).between(2, 6), initials), file, F.regexp_replace(file, r"\.[^.]+$", ""), F.when(F.lower(target).startswith("ms-settings:"), target))
    said = F.flatten(F.transform(documents, lambda d: F.concat(labelled_phrases(d["text"], "Synonyms"), labelled_phrases(d["text"], "Tags"), labelled_phrases(d["text"], "Moniker"))))
    return distinct_ignoring_case(F.filter(F.concat(some, parts, more, said), lambda x: x.isNotNull()), MAX_SYNONYMS)


def cut_sentence(text: Column, most: int = MAX_DETAILS) -> Column:
    """At most so many characters, to the last full stop if it lies past the middle."""
    head = F.substring(text, 1, most)
    last = most - F.instr(F.reverse(head), ".") + 1
    stop = (F.instr(head, ".") > 0) & (last > most / 2)
    return F.when(F.length(text) <= most, text).when(stop, F.substr(head, F.lit(1), last)).otherwise(F.concat(head, F.lit("...")))


def synthesize(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """A profile for each entity (id, display_name, kind, launch_target, raw_metadata) from its
    documents (entity_id, provider, is_online, text); the first text by order of a provider counts."""
    grouped = documents.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("is_online", "provider", "text"))).alias("docs"))
    rows = entities.join(grouped, entities.id == grouped.entity_id, "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<is_online:boolean,provider:string,text:string>>")))
    name, meta = F.col("display_name"), F.col("raw_metadata")
    first = lambda p: F.get(F.filter("docs", lambda d: F.lower(d["provider"]) == p), 0)["text"]
    # candidates in order: each is cleaned and judged as one element, not written out again
    keys = ("description", "fileDescription", "comment")
    rows = rows.withColumn("plain", plain_texts(F.array(*(F.try_element_at(meta, F.lit(k)) for k in keys), *map(first, DETAILERS))))
    own = F.slice("plain", 1, len(keys))
    lines = F.transform(F.array(*map(first, DESCRIBERS)), useful_line)
    described = F.get(F.filter(F.concat(own, lines), lambda c: adds_information(name, c)), 0)
    rows = rows.withColumn("described", described).withColumn("file", F.coalesce(F.try_element_at(meta, F.lit("fileName")), F.nullif(F.regexp_extract("launch_target", r"([^\\/]+)$", 1), F.lit(""))))
    stop = lambda c: F.when(c.rlike(r"[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))
    summary = stop(F.trim(F.regexp_replace(F.coalesce("described", F.concat(F.lit("Open "), name)), r"\s+", " ")))
    by_kind = F.concat(F.lit("open "), F.lower(name))
    for k, said in KIND_TASKS.items():
        by_kind = F.when(F.col("kind") == k, F.lit(said)).otherwise(by_kind)
    told = F.flatten(F.transform("docs", lambda d: labelled_phrases(d["text"], "Tasks")))
    tasks = distinctive(F.concat(told, intents(F.concat_ws(" ", name, "described")), F.array(by_kind)))
    texts = F.slice("plain", len(keys) + 1, len(DETAILERS))
    details = F.get(F.filter(texts, lambda c: F.coalesce((F.length(c) >= MIN_DETAILS) & is_prose(c) & ~is_listing(F.substring(c, 1, 200)), F.lit(False))), 0)
    rows = rows.withColumn("details", details).withColumn("said", summary)
    spoken = F.regexp_extract_all(F.lower("said"), F.lit(r"(\w+)"), 1)
    known = distinct_ignoring_case(F.concat(synonyms(name, F.col("file"), F.col("launch_target"), F.col("docs")), action_verbs(spoken, name)), MAX_SYNONYMS)
    labels = first("ui-resources")
    captions = F.transform(F.split(F.when(F.instr(labels, ":") > 0, F.expr("substring(labels, instr(labels, ':') + 1)")).otherwise(F.col("labels")), ","), lambda c: F.regexp_replace(c, r"^[ .]+|[ .]+$", ""))
    rows = rows.withColumn("labels", labels)
    captions = F.array_distinct(F.filter(captions, lambda c: c != ""))
    return rows.select(
        F.col("id").alias("entity_id"), F.col("said").alias("summary"), tasks.alias("tasks"), known.alias("synonyms"),
        category(F.col("kind"), F.col("launch_target"), F.col("file"), F.try_element_at(meta, F.lit("startMenuFolder"))).alias("category"), cut_sentence(F.col("details")).alias("details"), F.when(F.col("labels").isNotNull(), features(captions, name, F.col("said"))).alias("features"), F.lit("heuristic").alias("generator"),
    )


# --------------------------------------------------------------------------- captions


def admit_captions(captions: list[str], name: str, summary: str, most: int = 550) -> list[str]:
    """Captions in order, each whole, while they bring a word or a pair of words that is new.

    A word is known if it restates the name or the summary (a common beginning of four
    letters) or an admitted caption has it."""
    split = lambda x: [w for w in re.split(r"[\W_]+", x.lower()) if len(w) >= 2]
    stems = {w[:4] for w in split(f"{name} {summary}") if len(w) >= 4} | {w for w in split(f"{name} {summary}") if len(w) < 4}
    used: Counter[str] = Counter()
    pairs: set[tuple[str, str]] = set()
    out: list[str] = []
    total = 0
    for caption in captions:
        words = split(caption)
        if not words or total >= most:
            continue
        fresh = [w for w in words if used[w] < 1 and (w[:4] if len(w) >= 4 else w) not in stems]
        beside = [p for p in zip(words, words[1:], strict=False) if p not in pairs and any((w[:4] if len(w) >= 4 else w) not in stems for w in p)]
        if fresh or beside:
            out.append(caption)
            used.update(words)
            pairs.update(zip(words, words[1:], strict=False))
            total += len(set(words))
    return out


def _features(captions: pa.Array, names: pa.Array, summaries: pa.Array) -> pa.Array:
    rows = zip(captions.to_pylist(), names.to_pylist(), summaries.to_pylist(), strict=True)
    return pa.array([", ".join(admit_captions(c or [], n or "", s or "")) or None for c, n, s in rows], pa.string())


def features(captions: Column, name: Column, summary: Column) -> Column:
    """The caption vocabulary of an entity, as text."""
    return arrow_udf(_features, "string")(captions, name, summary)
