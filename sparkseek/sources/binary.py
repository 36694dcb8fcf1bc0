"""Shortcut files and executables, read as bytes: links (the published Shell Link format), internet shortcuts,
and the strings of an executable's resource tree (the published Portable Executable format).

Files come through Spark's ``binaryFile`` source, so any store that Spark reads will do, and are parsed in Arrow
batches.  A file that is cut off or is no such file gives one row with an error; what was read before the fault is
not reported; an empty file has no row, since Spark's source lists none.  No offset of a file is trusted: every read is checked against its end, and resource trees that
point into themselves are walked once."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file at most; a larger one is an error row.  Spark holds a file as one value.
LARGEST = 512 << 20
#: Files of a batch that are parsed together.
FILES = 16

LINKS = "path string, folder string, target string, working_directory string, comment string, icon string, arguments string, url string, error string"
RESOURCES = "path string, kind string, name string, text string, subsystem int, error string"

# Fixed values of the formats.
LINK_CLASS = bytes.fromhex("0114020000000000c000000000000046")
HAS_ID_LIST, HAS_LINK_INFO, HAS_NAME, HAS_RELATIVE_PATH, HAS_WORKING_DIR, HAS_ARGUMENTS, HAS_ICON, IS_UNICODE = (1 << i for i in range(8))
MENU, DIALOG, STRING, VERSION = 4, 5, 6, 16
KINDS = {MENU: "menu", DIALOG: "dialog", STRING: "string", VERSION: "version"}
POPUP, LAST, SET_FONT = 0x10, 0x80, 0x40


class Malformed(ValueError):
    """The bytes are not what the format says."""


class Cursor:
    """Little-endian numbers and texts from a place on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at < 0 or self.at + n > len(self.data):
            raise Malformed(f"cut off at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def align(self, base: int = 0) -> None:
        self.at += -(self.at - base) % 4

    def wide(self) -> str:
        """UTF-16 up to a zero."""
        begin = self.at
        while self.number(2):
            pass
        return self.data[begin : self.at - 2].decode("utf-16-le", "replace")

    def narrow(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Malformed(f"text without an end at {self.at}")
        out, self.at = self.data[self.at : end].decode("cp1252", "replace"), end + 1
        return out

    def name(self) -> str | None:
        """A text, or a number in its place (none)."""
        if self.number(2) == 0xFFFF:
            self.take(2)
            return None
        self.at -= 2
        return self.wide()


# --------------------------------------------------------------------------- links


def link(data: bytes) -> dict:
    """target, working_directory, comment, icon and arguments of a Shell Link."""
    c = Cursor(data)
    if c.number(4) != 0x4C or c.take(16) != LINK_CLASS:
        raise Malformed("no shell link")
    flags = c.number(4)
    c.at = 0x4C
    if flags & HAS_ID_LIST:
        c.take(c.number(2))
    out: dict[str, str | None] = {}
    if flags & HAS_LINK_INFO:
        base = c.at
        size = c.number(4)
        info = Cursor(data[base : base + size])
        if len(info.data) < size or size < 0x1C:
            raise Malformed("link info is cut off")
        info.at = 4
        header, what = info.number(4), info.number(4)
        info.take(4)
        local, _, suffix = info.number(4), info.number(4), info.number(4)
        if what & 1:
            wide = header >= 0x24
            if wide:
                info.at = 0x1C
                local, suffix = info.number(4), info.number(4)
            text = lambda at: (Cursor(info.data, at).wide() if wide else Cursor(info.data, at).narrow()) if at else ""
            out["target"] = text(local) + text(suffix)
        c.at = base + size
    for flag, field in ((HAS_NAME, "comment"), (HAS_RELATIVE_PATH, "relative"), (HAS_WORKING_DIR, "working_directory"), (HAS_ARGUMENTS, "arguments"), (HAS_ICON, "icon")):
        if flags & flag:
            n = c.number(2)
            out[field] = c.take(2 * n).decode("utf-16-le", "replace") if flags & IS_UNICODE else c.take(n).decode("cp1252", "replace")
    out["target"] = out.get("target") or out.get("relative")
    return out


def internet_shortcut(data: bytes) -> dict:
    """The URL of the section of that name; keys and sections of any case."""
    text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    section, out = "", {}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("["):
            section = line.strip("[]").lower()
        elif section == "internetshortcut" and "=" in line:
            k, v = line.split("=", 1)
            out.setdefault({"url": "url", "iconfile": "icon", "workingdirectory": "working_directory"}.get(k.strip().lower(), ""), v.strip())
    if not out.get("url"):
        raise Malformed("no url")
    return out


# --------------------------------------------------------------------------- executables


def _sections(data: bytes) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Subsystem, address of the resources, and (address, size, offset) of the sections."""
    c = Cursor(data)
    if c.take(2) != b"MZ":
        raise Malformed("no executable")
    c.at = 0x3C
    c.at = c.number(4)
    if c.take(4) != b"PE\0\0":
        raise Malformed("no portable executable")
    c.take(2)
    n = c.number(2)
    c.take(12)
    size = c.number(2)
    c.take(2)
    optional = c.at
    magic = c.number(2)
    if magic not in (0x10B, 0x20B):
        raise Malformed("unknown optional header")
    c.at = optional + 68
    subsystem = c.number(2)
    directories = optional + (96 if magic == 0x10B else 112)
    c.at = directories - 4
    resources = 0
    if c.number(4) > 2 and size >= directories - optional + 24:
        c.at = directories + 16
        resources = c.number(4)
    c.at = optional + size
    sections = []
    for _ in range(n):
        c.take(8)
        virtual, address, raw, offset = (c.number(4) for _ in range(4))
        c.take(16)
        sections.append((address, max(virtual, raw), offset))
    return subsystem, resources, sections


def resources(data: bytes) -> tuple[int, list[tuple[int, str, bytes]]]:
    """Subsystem and the resources (type, name, bytes) of the kinds that hold texts."""
    subsystem, root, sections = _sections(data)

    def offset(address: int) -> int:
        for begin, size, at in sections:
            if begin <= address < begin + size:
                return address - begin + at
        raise Malformed(f"address {address} lies in no section")

    if not root:
        return subsystem, []
    base, seen, out = offset(root), set(), []

    def walk(at: int, level: int, kind: int, name: str) -> None:
        if at in seen or level > 2:
            return
        seen.add(at)
        c = Cursor(data, base + at)
        c.take(12)
        for _ in range(c.number(2) + c.number(2)):
            id_, to = c.number(4), c.number(4)
            if id_ >> 31:
                text = Cursor(data, base + (id_ & 0x7FFFFFFF))
                said = text.take(2 * text.number(2)).decode("utf-16-le", "replace")
            else:
                said = str(id_)
            if level == 0 and (id_ >> 31 or id_ not in KINDS):
                continue
            here = (id_, said) if level == 0 else (kind, said if level == 1 else name)
            if to >> 31:
                walk(to & 0x7FFFFFFF, level + 1, *here)
            else:
                entry = Cursor(data, base + to)
                address, size = entry.number(4), entry.number(4)
                out.append((*here, Cursor(data, offset(address)).take(size)))

    walk(0, 0, 0, "")
    return subsystem, out


def strings(block: bytes) -> list[str]:
    """The sixteen counted strings of a block."""
    c, out = Cursor(block), []
    for _ in range(16):
        if text := c.take(2 * c.number(2)).decode("utf-16-le", "replace"):
            out.append(text)
    return out


def menu(block: bytes) -> list[str]:
    """Captions of a menu, in order."""
    c, out = Cursor(block), []
    version, header = c.number(2), c.number(2)
    c.at += header
    if version == 0:
        levels: list[bool] = []  # of the open pop-ups: whether each is the last of its level
        while True:
            flags = c.number(2)
            if not flags & POPUP:
                c.take(2)
            if text := c.wide():
                out.append(text)
            if flags & POPUP:
                levels.append(bool(flags & LAST))
            elif flags & LAST:
                while levels:
                    if not levels.pop():
                        break
                else:
                    return out
    while c.at < len(block):
        c.align()
        if c.at >= len(block):
            break
        c.take(12)
        flags = c.number(2)
        if text := c.wide():
            out.append(text)
        if flags & 1:
            c.align()
            c.take(4)
    return out


def dialog(block: bytes) -> list[str]:
    """Title and captions of a dialogue."""
    c = Cursor(block)
    extended = block[2:4] == b"\xff\xff"
    if extended:
        c.take(12)
        style = c.number(4)
    else:
        style = c.number(4)
        c.take(4)
    n = c.number(2)
    c.take(8)
    c.name(), c.name()
    out = [c.wide()]
    if style & SET_FONT:
        c.take(6 if extended else 2)
        c.wide()
    for _ in range(n):
        c.align()
        c.take(24 if extended else 18)
        c.name()
        out.append(c.name() or "")
        c.take(c.number(2))
    return [t for t in out if t]


def version_strings(block: bytes) -> list[tuple[str, str]]:
    """(name, text) of the version's string tables, the first of each name."""
    out: dict[str, str] = {}

    def walk(at: int, end: int, level: int) -> None:
        while at + 6 <= end:
            c = Cursor(block, at)
            size, value, kind = c.number(2), c.number(2), c.number(2)
            if size < 6:
                return
            stop = min(end, at + size)
            key = c.wide()
            c.align()
            if level == 3:
                if value and kind == 1:
                    text = block[c.at : min(stop, c.at + 2 * value)].decode("utf-16-le", "replace").split("\0")[0]
                    if text:
                        out.setdefault(key, text)
            elif level == 0:
                walk(c.at + value + -(c.at + value) % 4, stop, 1)
            elif level > 1 or key == "StringFileInfo":
                walk(c.at, stop, level + 1)
            at = at + size + -(at + size) % 4

    walk(0, len(block), 0)
    return list(out.items())


def texts(data: bytes) -> tuple[int, list[tuple[str, str, str]]]:
    """Subsystem and (kind, name, text) of an executable; captions without their mnemonic signs."""
    subsystem, found = resources(data)
    out = []
    for kind, name, block in found:
        if kind == VERSION:
            out += [("version", k, v) for k, v in version_strings(block)]
        else:
            said = {STRING: strings, MENU: menu, DIALOG: dialog}[kind](block)
            out += [(KINDS[kind], name, t.replace("&&", "\0").replace("&", "").replace("\0", "&").split("\t")[0]) for t in said]
    return subsystem, out


# --------------------------------------------------------------------------- readers


def _parsed(files: DataFrame, rows_of: Callable[[str, bytes], list[tuple]], failed: Callable[[str, str], tuple], schema: str) -> DataFrame:
    kinds = [(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FILES):
                out = []
                for path, size, data in zip(*(batch.column(j).slice(i, FILES) for j in range(3)), strict=True):
                    try:
                        if size.as_py() > LARGEST:
                            raise Malformed(f"larger than {LARGEST} bytes")
                        out += rows_of(path.as_py(), data.as_py() or b"")
                    except (Malformed, struct.error, UnicodeError) as e:
                        out.append(failed(path.as_py(), str(e)))
                cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    return files.mapInArrow(run, schema)


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, size, content) of the files below a folder whose names fit a pattern; too large ones without content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.when(F.col("length") <= LARGEST, F.col("content")).alias("content"))


def read_shortcuts(spark: SparkSession, root: str) -> DataFrame:
    """The links and internet shortcuts below a folder, as ``collectors.start_shortcuts`` takes them, with the
    error of a file that can't be read."""
    top = root.split("://", 1)[-1].split(":", 1)[-1].strip("/")

    def rows_of(path: str, data: bytes) -> list[tuple]:
        got = internet_shortcut(data) if path.lower().endswith(".url") else link(data)
        inside = path.split(top, 1)[-1].strip("/").rsplit("/", 1)
        folder = inside[0] if len(inside) > 1 else None
        return [(path, folder, got.get("target"), got.get("working_directory"), got.get("comment"), got.get("icon"), got.get("arguments"), got.get("url"), None)]

    return _parsed(files(spark, root, "*.{lnk,url,LNK,URL}"), rows_of, lambda path, e: (path, *[None] * 7, e), LINKS)


def read_resources(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, name, text, subsystem) of the texts in the executables below a folder; one without any has a row
    of its subsystem alone."""

    def rows_of(path: str, data: bytes) -> list[tuple]:
        subsystem, found = texts(data)
        return [(path, *x, subsystem, None) for x in found] or [(path, None, None, None, subsystem, None)]

    return _parsed(files(spark, root, "*.{exe,dll,EXE,DLL}"), rows_of, lambda path, e: (path, None, None, None, None, e), RESOURCES)


def captions(found: DataFrame) -> DataFrame:
    """(path, captions): the distinct texts of menus, dialogues and strings of each executable."""
    return found.where("kind in ('menu', 'dialog', 'string')").groupBy("path").agg(F.array_sort(F.collect_set("text")).alias("captions"))
