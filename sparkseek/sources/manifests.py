"""Indented manifests of packages: a line-state parser for the part of YAML that they use.

Keys with values, nested mappings, lists of scalars and of mappings, quoted scalars, block texts (``|`` and
``>``), comments.  A value has the path of its keys, with the place in a list in brackets, as in
``Installers[1].Architecture``.  A line that fits nothing gives a row with the path ``?`` and the line; what stands around it is
read on.  Anchors, flow
collections, tags and lists directly in lists are values as they are written."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FIELDS = "array<struct<path:string,value:string>>"
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^\s:#'"-][^:#]*?)\s*:(?:\s+(.*))?$""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def scalar(text: str) -> str | None:
    """A value without quotes and comment; none if it is null."""
    text = text.strip()
    if text.startswith('"') and (m := re.match(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$', text)):
        return re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m[1])
    if text.startswith("'") and (m := re.match(r"'((?:[^']|'')*)'\s*(?:#.*)?$", text)):
        return m[1].replace("''", "'")
    text = re.sub(r"(?:^|\s)#.*$", "", text).strip()
    return None if text in ("", "~", "null") else text


def parse(text: str) -> list[tuple[str, str | None]]:
    """(path, value) of every value, in order."""
    out: list[tuple[str, str | None]] = []
    #: of each open level: its indent, its path, and how many items its list has (none for a mapping)
    levels: list[list] = [[-1, "", None]]
    block: list | None = None  # of an open text: indent of its key, path, its lines, folded

    def close() -> None:
        nonlocal block
        if block is not None:
            lines = block[2]
            while lines and not lines[-1].strip():
                lines.pop()
            least = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
            out.append((block[1], (" " if block[3] else "\n").join(x[least:].rstrip() if not block[3] else x.strip() for x in lines)))
            block = None

    def value(indent: int, path: str, said: str | None) -> None:
        """What follows a key or the dash of a list."""
        nonlocal block
        said = (said or "").strip()
        if re.fullmatch(r"[|>][+-]?\d?\s*(#.*)?", said):
            block = [indent, path, [], said[0] == ">"]
        elif said and not said.startswith("#"):
            out.append((path, scalar(said)))
        else:
            levels.append([indent, path, None])

    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" "))
        if block is not None:
            if not line.strip() or indent > block[0]:
                block[2].append(line)
                continue
            close()
        rest = line.strip()
        if not rest or rest.startswith("#") or rest in ("---", "..."):
            continue
        # a list may stand at the indent of its key
        while len(levels) > 1 and (indent < levels[-1][0] or indent == levels[-1][0] and not (rest.startswith("- ") or rest == "-")):
            levels.pop()
        if rest.startswith("- ") or rest == "-":
            while len(levels) > 1 and levels[-1][2] == "item" and levels[-1][0] >= indent:
                levels.pop()
            top = levels[-1]
            if top[2] == "item":  # deeper than the keys of an item, and under none of them
                out.append(("?", rest))
                continue
            top[2] = 0 if top[2] is None else top[2] + 1
            path, after = f"{top[1]}[{top[2]}]", rest[1:]
            if not KEY.match(after.strip()):
                value(indent, path, after)
                continue
            levels.append([indent, path, "item"])
            indent, rest = indent + 1 + len(after) - len(after.lstrip(" ")), after.strip()
        if not (m := KEY.match(rest)):
            out.append(("?", line.strip()))
            continue
        while len(levels) > 1 and levels[-1][0] >= indent:
            levels.pop()
        name = scalar(m[1]) or ""
        above = levels[-1][1]
        value(indent, f"{above}.{name}" if above else name, m[2])
    close()
    return out


def _parsed(texts: pa.Array) -> pa.Array:
    paths, values, at = [], [], [0]
    for t in texts.to_pylist():
        for path, value in parse(t or ""):
            paths.append(path)
            values.append(value)
        at.append(len(paths))
    each = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], ["path", "value"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), each)


def fields(manifests: DataFrame, text: str = "text") -> DataFrame:
    """The manifests with one row for each value: path, value, position."""
    rest = [c for c in manifests.columns if c != text]
    return manifests.select(*rest, F.posexplode(arrow_udf(_parsed, FIELDS)(text)).alias("position", "f")).select(*rest, "f.path", "f.value", "position")


def installers(found: DataFrame, key: str) -> DataFrame:
    """(key, n, architecture, url, sha256) of the nested installers of each manifest's fields."""
    own = F.regexp_extract("path", r"^Installers\[([0-9]+)\]\.", 1)
    of = lambda name: F.max(F.when(F.col("path").endswith(f".{name}"), F.col("value")))
    rows = found.where(F.col("path").startswith("Installers[")).withColumn("n", own.cast("int"))
    return rows.groupBy(key, "n").agg(of("Architecture").alias("architecture"), of("InstallerUrl").alias("url"), of("InstallerSha256").alias("sha256"))


def packages(found: DataFrame, key: str) -> DataFrame:
    """(key, name, publisher, version, text) of manifests' fields, as ``enrichers.package_matches`` takes them:
    the text is the description, else the short one, and the tags."""
    of = lambda name: F.max(F.when(F.col("path") == name, F.col("value")))
    tags = F.transform(F.array_sort(F.collect_list(F.when(F.col("path").startswith("Tags["), F.struct("position", "value")))), lambda x: x["value"])
    rows = found.groupBy(key).agg(*(of(n).alias(c) for n, c in (("PackageName", "name"), ("Publisher", "publisher"), ("PackageVersion", "version"), ("Description", "long"), ("ShortDescription", "short"))), tags.alias("tags"))
    said = F.concat_ws(" ", F.coalesce("long", "short"), F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "), F.lit("."))))
    return rows.select(key, "name", "publisher", "version", F.regexp_replace(said, r"\s+", " ").alias("text"))


def register(spark: SparkSession) -> None:
    """The rows of one manifest, for SQL: ``LATERAL manifest_fields(text)``.  A table function of SQL over a function of
    batches: one of Python is called, and answers in a batch, for each row."""
    spark.udf.register("manifest_values", arrow_udf(_parsed, FIELDS))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION manifest_fields(text STRING) RETURNS TABLE (path STRING, value STRING, position INT) RETURN SELECT f.path, f.value, position FROM posexplode(manifest_values(text)) AS t(position, f)")
