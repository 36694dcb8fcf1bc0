"""Links and executables, from bytes that the tests write."""

from __future__ import annotations

import random
import struct

import pytest

from sparkseek.sources import binary, collectors


def wide(text, counted=False):
    raw = text.encode("utf-16-le")
    return struct.pack("<H", len(raw) // 2) + raw if counted else raw + b"\0\0"


def link(target="C:\\Tools\\edit.exe", comment="Edits text", arguments="-n 1", icon=None, folder="C:\\Tools", unicode_path=False, ids=b"\x02\x00"):
    flags = binary.HAS_ID_LIST | binary.HAS_LINK_INFO | binary.HAS_NAME | binary.HAS_WORKING_DIR | binary.HAS_ARGUMENTS | binary.IS_UNICODE | (binary.HAS_ICON if icon else 0)
    head = struct.pack("<I", 0x4C) + binary.LINK_CLASS + struct.pack("<I", flags)
    local = target.encode("cp1252", "replace") + b"\0\0"
    if unicode_path:
        info = struct.pack("<9I", 0, 0x24, 1, 0, 0x24, 0, 0x24 + len(local) - 1, 0x24 + len(local), 0x24 + len(local) + len(wide(target)))
        info += local + wide(target) + wide("")
    else:
        info = struct.pack("<7I", 0, 0x1C, 1, 0, 0x1C, 0, 0x1C + len(local) - 1) + local
    info = struct.pack("<I", len(info)) + info[4:]
    texts = [comment, folder, arguments] + ([icon] if icon else [])
    return head.ljust(0x4C, b"\0") + struct.pack("<H", len(ids)) + ids + info + b"".join(wide(t, True) for t in texts)


def menu_bytes():
    item = lambda flags, text, id_=1: struct.pack("<HH", flags, id_) + wide(text)
    popup = lambda flags, text: struct.pack("<H", flags | 0x10) + wide(text)
    return struct.pack("<HH", 0, 0) + popup(0, "&File") + item(0, "&Open\tCtrl+O") + item(0, "") + popup(0x80, "Recent") + item(0x80, "Clear") + popup(0x80, "&Help") + item(0, "Save && close") + item(0x80, "About")


def dialog_bytes(extended):
    def aligned(x, n):
        return x + b"\0" * (-n % 4)

    if extended:
        out = struct.pack("<HHIIIH4h", 1, 0xFFFF, 0, 0, 0x40, 2, 0, 0, 10, 10) + wide("") + wide("") + wide("Load Hive") + struct.pack("<HHBB", 8, 0, 0, 0) + wide("Font")
        for text, cls in (("Key &name:", b"\xff\xff\x82\0"), ("", wide("Edit"))):
            out = aligned(out, len(out)) + struct.pack("<III4hI", 0, 0, 0, 0, 0, 1, 1, 5) + cls + wide(text) + struct.pack("<H", 0)
        return out
    out = struct.pack("<IIH4h", 0x40, 0, 1, 0, 0, 10, 10) + b"\xff\xff\x05\0" + wide("") + wide("Plain") + struct.pack("<H", 8) + wide("Font")
    return aligned(out, len(out)) + struct.pack("<II4hH", 0, 0, 0, 0, 1, 1, 5) + b"\xff\xff\x80\0" + wide("Browse...") + struct.pack("<H", 2) + b"xx"


def version_bytes(**strings):
    def node(key, value, children, text):
        head = wide(key)
        body = head + b"\0" * (-(6 + len(head)) % 4) + value
        for child in children:
            body += b"\0" * (-(6 + len(body)) % 4) + child
        return struct.pack("<HHH", 6 + len(body), len(value) // 2 if text else len(value), text) + body

    table = node("040904b0", b"", [node(k, wide(v), [], 1) for k, v in strings.items()], 1)
    return node("VS_VERSION_INFO", b"\0" * 52, [node("VarFileInfo", b"", [node("Translation", b"\x09\x04\xb0\x04", [], 0)], 1), node("StringFileInfo", b"", [table], 1)], 0)


def executable(tree, subsystem=2, plus=True):
    """tree: {type: {name: bytes}}; one language each."""
    leaves, top = [], sorted(tree)
    size = 16 + 8 * len(top) + sum(16 + 8 * len(tree[t]) + len(tree[t]) * (16 + 8 + 16) for t in top)
    out = bytearray(size + sum(len(b) + 8 for t in top for b in tree[t].values()) + 64 * sum(len(tree[t]) for t in top))
    at = 0

    def directory(ids):
        nonlocal at
        here, at = at, at + 16 + 8 * len(ids)
        struct.pack_into("<HH", out, here + 12, 0, len(ids))
        return here

    here = directory(top)
    for i, t in enumerate(top):
        second = directory(list(tree[t]))
        struct.pack_into("<II", out, here + 16 + 8 * i, t, second | 0x80000000)
        for j, name in enumerate(tree[t]):
            third = directory([1033])
            struct.pack_into("<II", out, second + 16 + 8 * j, name, third | 0x80000000)
            struct.pack_into("<II", out, third + 16, 1033, at)
            leaves.append((at, tree[t][name]))
            at += 16
    for entry, block in leaves:
        struct.pack_into("<II", out, entry, 0x1000 + at, len(block))
        out[at : at + len(block)] = block
        at += len(block) + (-len(block) % 4)
    raw = bytes(out[:at])
    optional = bytearray(240 if plus else 224)
    struct.pack_into("<H", optional, 0, 0x20B if plus else 0x10B)
    struct.pack_into("<H", optional, 68, subsystem)
    directories = 112 if plus else 96
    struct.pack_into("<I", optional, directories - 4, 16)
    struct.pack_into("<II", optional, directories + 16, 0x1000, len(raw))
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0) + bytes(optional)
    begin = len(head) + 40
    return head + b".rsrc\0\0\0" + struct.pack("<4I", len(raw), 0x1000, len(raw), begin) + b"\0" * 16 + raw


def program():
    block = b"".join(wide(t, True) for t in ["Virtual Size", "Memory &History", *[""] * 14])
    return executable({4: {7: menu_bytes()}, 5: {1: dialog_bytes(True), 2: dialog_bytes(False)}, 6: {9: block}, 16: {1: version_bytes(FileDescription="Some Tool", ProductName="Suite", Empty="")}, 3: {1: b"icon"}}, 3)


def test_shortcuts(spark, tmp_path):
    files = {
        "Tools/Edit.lnk": link(), "Tools/Deep er/Ünï.lnk": link("C:\\Ünï\\ß漢.exe", unicode_path=True, icon="C:\\i.ico"), "site.url": b"[DEFAULT]\r\nURL=no\r\n[InternetShortcut]\r\nURL=https://example.com/a=b\r\nIconFile=x.ico\r\n",
        "cut.lnk": link()[:90], "other.lnk": b"MZ not a link", "none.url": b"[InternetShortcut]\nfoo=bar", "empty.lnk": b"", "skip.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = binary.read_shortcuts(spark, f"file://{tmp_path}")
    got = {r["path"].split(str(tmp_path), 1)[1].strip("/"): r for r in found.collect()}
    assert set(got) == set(files) - {"skip.txt", "empty.lnk"} and {p for p, r in got.items() if r["error"]} == {"cut.lnk", "other.lnk", "none.url"}
    edit = got["Tools/Edit.lnk"]
    assert (edit["folder"], edit["target"], edit["working_directory"], edit["comment"], edit["arguments"], edit["icon"]) == ("Tools", "C:\\Tools\\edit.exe", "C:\\Tools", "Edits text", "-n 1", None)
    deep = got["Tools/Deep er/Ünï.lnk"]
    assert (deep["folder"], deep["target"], deep["icon"]) == ("Tools/Deep er", "C:\\Ünï\\ß漢.exe", "C:\\i.ico") and got["site.url"]["url"] == "https://example.com/a=b"
    made = {r["display_name"]: r for r in collectors.start_shortcuts(found.where("error is null").drop("error")).collect()}
    assert set(made) == {"Edit", "Ünï", "site"} and made["Edit"]["raw_metadata"]["targetPath"] == "C:\\Tools\\edit.exe" and made["site"]["raw_metadata"]["url"] == "https://example.com/a=b"


def test_resources(spark, tmp_path):
    files = {"tool.exe": program(), "bare.dll": executable({}, 2, plus=False), "cut.exe": program()[:-200], "text.exe": b"no program"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = binary.read_resources(spark, f"file://{tmp_path}").collect()
    by = {}
    for r in found:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert [(r["kind"], r["text"]) for r in by["tool.exe"] if r["kind"] == "menu"] == [("menu", t) for t in ("File", "Open", "Recent", "Clear", "Help", "Save & close", "About")]
    assert {(r["kind"], r["name"], r["text"]) for r in by["tool.exe"] if r["kind"] != "menu"} == {("dialog", "1", "Load Hive"), ("dialog", "1", "Key name:"), ("dialog", "2", "Plain"), ("dialog", "2", "Browse..."), ("string", "9", "Virtual Size"), ("string", "9", "Memory History"), ("version", "FileDescription", "Some Tool"), ("version", "ProductName", "Suite")}
    assert {r["subsystem"] for r in by["tool.exe"]} == {3} and [(r["text"], r["subsystem"], r["error"]) for r in by["bare.dll"]] == [(None, 2, None)]
    assert all(len(by[n]) == 1 and by[n][0]["error"] for n in ("cut.exe", "text.exe"))
    told = binary.captions(binary.read_resources(spark, f"file://{tmp_path}")).first()["captions"]
    assert "Load Hive" in told and "Suite" not in told and told == sorted(told)


def test_extended_menus():
    item = lambda text, flags: struct.pack("<IIIH", 0, 0, 1, flags) + wide(text)
    pad = lambda x: x + b"\0" * (-len(x) % 4)
    block = pad(pad(struct.pack("<HHI", 1, 4, 0) + item("View", 1)) + struct.pack("<I", 0)) + item("Zoom", 0x80)
    assert binary.menu(block) == ["View", "Zoom"]


@pytest.mark.parametrize("make", [link, program])
def test_damaged_files_end_in_an_error_or_a_row(make):
    """Any bytes changed, any length: a result or a fault that the reader reports, in bounded time."""
    rng = random.Random(1)
    whole = make()
    for _ in range(1500):
        data = bytearray(whole[: rng.randint(0, len(whole))] if rng.random() < 0.5 else whole)
        for _ in range(rng.randint(0, 8)):
            if data:
                data[rng.randrange(len(data))] = rng.choice([0, 1, 0x7F, 0x80, 0xFF, rng.randrange(256)])
        try:
            binary.link(bytes(data)) if make is link else binary.texts(bytes(data))
        except (binary.Malformed, struct.error, UnicodeError):
            pass
