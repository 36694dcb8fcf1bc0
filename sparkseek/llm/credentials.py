"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base spans come from three fixed patterns: assigned values (``assign``), access identifiers (``access``) and
long runs of hexadecimal digits (``hex``).  A credential has three kinds of parts:

* ``identifier``: access (strong); weak ones are tokens of 16 or more capitals and digits, values assigned to names of
  accounts and keys, and addresses with an @,
* ``secret``: assign and hex (strong); weak ones are tokens of 16 or more characters with capitals, small
  letters and digits, shorter hexadecimal tokens (16 to 23), and values assigned to other names of secrets,
* ``endpoint``: always weak: URLs, IP addresses, and values assigned to names of hosts.

A weak part alone is too common to be reported.  It becomes a span only if its complement stands within
``REACH`` code points of it in the same scope (a stretch of text without a blank line): a secret for an
identifier, an identifier or an endpoint for a secret, and both a secret and an identifier for an endpoint.

The interval join: each part's interval, widened by ``REACH``, is cut into buckets of that width; so are
the parts it asks for, of which a bucket keeps the least start and the largest end by kind.  As the widened interval
is at least two buckets long, no bucket holds both of its ends, and these two numbers decide exactly whether any
part of the kind meets it.  So the join gives three rows a bucket at most, however many parts a scope has.

Texts are scanned once.  Only rows with a name that the patterns begin with, or with a long token, are looked at
closely; every pattern is linear in the text.

Defined results.  A null or empty text has no span.  Every row gives its row, repeated ones too.  Weak
parts that overlap a base span, or a weak part that begins earlier (or is longer, or of an earlier kind), are left out.
Offsets are code points, ends exclusive; spans are sorted by start, then kind as listed.  Extra columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, plain, slices, text_buffer

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE, IDENTIFIER, SECRET, ENDPOINT = 3, 3, 4, 5
#: The kind of part that each base kind is.
ROLE = {0: SECRET, 1: IDENTIFIER, 2: SECRET}
REACH = 300

_TO = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){_TO}([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
#: What a text with a base span or a weak secret holds, in small letters: one of these names, or a long token.
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"pwd", b"passphrase", b"private", b"credential", b"bearer")

CODE = re.compile("(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])")
ACCOUNT = re.compile(rf"(?:client|app|application|account|tenant|access|key|user|login)[_-]?(?:id|name|key_?id)?{_TO}([A-Za-z0-9._@-]{{4,}}+)", re.I | re.A)
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
MIXED = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
OTHER = re.compile(rf"(?:pwd|passphrase|private[_-]?key|credentials?|bearer){_TO}([A-Za-z0-9+/_.=-]{{6,}}+)", re.I | re.A)
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]++")
HOST = re.compile(rf"(?:host|hostname|endpoint|server|dsn){_TO}([A-Za-z0-9.:/_-]{{4,}}+)", re.I | re.A)
IP = re.compile(r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])")
BLANK_LINE = re.compile(r"\n[ \t\r]*+\n")

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def _is_mixed(token: str) -> bool:
    small, large, digit = re.search("[a-z]", token), re.search("[A-Z]", token), re.search("[0-9]", token)
    return bool(digit and small and (large or (len(token) < 24 and re.fullmatch("[0-9a-f]+", token))))


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak parts, sorted, none overlapping another or a base span; none
    without a secret, weak or strong, in the text."""
    found = [(m.start(), SECRET, m.end()) for m in MIXED.finditer(text) if _is_mixed(m[0])]
    found += [(m.start(1), SECRET, m.end(1)) for m in OTHER.finditer(text)]
    if not found and not any(ROLE[k] == SECRET for _, k, _ in base):
        return []
    found += [(m.start(), IDENTIFIER, m.end()) for m in CODE.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    found += [(m.start(1), IDENTIFIER, m.end(1)) for m in ACCOUNT.finditer(text)]
    if "@" in text:
        found += [(m.start(), IDENTIFIER, m.end()) for m in ADDRESS.finditer(text)]
    if "://" in text:
        found += [(m.start(), ENDPOINT, m.end()) for m in URL.finditer(text)]
    found += [(m.start(1), ENDPOINT, m.end(1)) for m in HOST.finditer(text)]
    found += [(m.start(), ENDPOINT, m.end()) for m in IP.finditer(text)]
    taken: list[tuple[int, int]] = []  # of base spans, merged
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    out, done, i = [], 0, 0
    for a, k, b in sorted(set(found), key=lambda x: (x[0], -x[2], x[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= done and (i == len(taken) or taken[i][0] >= b):
            out.append((a, k, b))
            done = b
    return out


def worth(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row holds a token of 16 bytes with a digit, or of 24."""
    word = TOKEN[buf]
    edge = np.concatenate(([False], word, [False]))
    first, last = edge[1:-1] & ~edge[:-2], edge[1:-1] & ~edge[2:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= 16
    a, b = a[long], b[long]
    digits = np.array([np.any((buf[x:y] >= 48) & (buf[x:y] < 58)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, a[digits | (b - a >= 24)], "right") - 1] = True
    return out


SPANS = "array<struct<start:int,kind:int,end:int>>"
PARTS = "array<struct<start:int,kind:int,end:int,strong:boolean,scope:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, base_sha256, found, parts) of every row of (doc_id, rid, text): base spans, and
    all parts with their scopes where a text has a weak part and two kinds of parts."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    part = pa.struct([*span, ("strong", pa.bool_()), ("scope", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for batch in slices(whole, "text"):
                col = batch.column(2)
                close = worth(*text_buffer(col))
                hashes, found, told = [], [], []
                for i, value in enumerate(col):
                    hashes.append(empty)
                    found.append([])
                    told.append([])
                    raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                    if not raw or not close[i] and not any(x in (low := raw.lower()) for x in NAMES):
                        continue
                    text = raw.decode("utf-8", "surrogatepass")
                    base = base_spans(text)
                    weak = weak_spans(text, base)
                    if base:
                        hashes[-1] = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
                        found[-1] = [{"start": a, "kind": k, "end": b} for a, k, b in base]
                    parts = [(a, ROLE[k], b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in weak]
                    if weak and len({k for _, k, _, _ in parts}) > 1:
                        cuts = np.array([m.start() for m in BLANK_LINE.finditer(text)], np.int64)
                        scope = np.searchsorted(cuts, [x[0] for x in parts], "right").tolist()
                        told[-1] = [dict(zip(("start", "kind", "end", "strong", "scope"), (*x, s), strict=True)) for x, s in zip(parts, scope, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string()), pa.array(found, pa.list_(span)), pa.array(told, pa.list_(part))], ["doc_id", "rid", "base_sha256", "found", "parts"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(lean(run), f"doc_id {kind}, rid long, base_sha256 string, found {SPANS}, parts {PARTS}")


def link(parts: DataFrame) -> DataFrame:
    """(rid, start, kind, end) of the weak parts whose complements are within reach.
    parts: (rid, start, kind, end, strong, scope)."""
    covers = lambda a, b: F.explode(F.sequence(F.floor(a / REACH), F.floor(b / REACH)))
    place = ["rid", "scope", "bucket"]
    held = parts.withColumn("bucket", covers(F.col("start"), F.col("end"))).groupBy(*place, "kind").agg(F.min("start").alias("least"), F.max("end").alias("most"))
    asked = parts.where("not strong").withColumn("bucket", covers(F.greatest(F.lit(0), F.col("start") - REACH), F.col("end") + REACH))
    met = asked.alias("x").join(held.alias("y"), place).where(f"x.kind <> y.kind and y.least <= x.end + {REACH} and y.most >= x.start - {REACH}")
    by = [F.col(f"x.{c}").alias(c) for c in ("rid", "start", "kind", "end")]
    seen = met.groupBy(*by).agg(*(F.bool_or(F.col("y.kind") == k).alias(KINDS[k]) for k in (IDENTIFIER, SECRET, ENDPOINT)))
    return seen.where(F.when(F.col("kind") == IDENTIFIER, F.col("secret")).when(F.col("kind") == SECRET, F.col("identifier") | F.col("endpoint")).otherwise(F.col("secret") & F.col("identifier"))).select("rid", "start", "kind", "end")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_identifier, n_secret, n_endpoint) of
    every row: counts by kind of base and of added spans, and all spans."""
    scratch = Scratch(docs.sparkSession)
    at = {c: F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text")}
    told = plain(docs).select(at["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("rid"), at["text"].cast("string").alias("text"))
    rows = scratch.write(scan(told), "found")  # from here on a row's rid stays
    parts = rows.where(F.size("parts") > 0).select("rid", F.inline("parts"))
    added = link(parts).groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).cast(SPANS).alias("added"))
    out = rows.join(scratch.write(added, "added"), "rid", "left").withColumn("added", F.coalesce("added", F.array().cast(SPANS)))
    names = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform(F.array_sort(F.concat("found", "added")), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda spans, k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = [count(F.col("found"), k) for k in range(BASE)]
    return out.select("doc_id", *base, "base_sha256", said.alias("spans"), *(count(F.col("added"), k) for k in range(BASE, len(KINDS))))
