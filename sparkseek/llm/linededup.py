"""Fuzzy line deduplication: sketches of normalised lines, a join on pigeonhole blocks, edit
similarity, one occurrence per connected group.

A line is cut at \\n and normalised: lower-cased, ASCII digits to 0, everything but letters, marks
and digits (of any script) to single blanks.  Lines of fewer than ``MIN_WORDS`` normalised words
are structure and never removed.  Equal normalised lines are one node.  Two nodes are linked if
their word edit distance is at most ``EDITS`` percent of the longer line, rounded down.  Of each
connected group the occurrence with the least (doc_id, line number) stays.

Pigeonhole blocks.  A block is a run of ``RUN`` words, and a line shows its first ones, in an order
that is the same for all lines, until more than k edits are needed to break them up (blocks that
share a word fall by one edit).  Of two lines within k edits, the one whose shown blocks end
earlier in the order can't have lost them all, and what is left the other shows too: all such pairs
meet.  The order puts rare blocks first, as rare as the rarer of their pairs of words; how rare those
are is counted over all documents by hash, which decides how many pairs meet in vain and nothing else.

Sketch.  A SimHash keeps the sign of the sum of the words' bits, and one edit of a short line can
turn any number of signs, so a bound on its distance loses links.  The sketch here keeps the
parity of the sum instead, with one bit a word: one edit turns at most two bits, so a bound of
2 k bits loses none and still tells most unlike lines apart before their words are compared.

Defined results.  Null and empty texts have no line to judge and stay as they are.  Rows with
a null doc_id are passed through and neither remove nor lose a line.  Rows that repeat a
doc_id share their occurrences: the same line number of both stays or goes.  A text whose
lines all go becomes the empty text; the row stays.  n_chars, where it is a column, is set to
the new length.  Extra columns, whatever their names, are passed through."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .buckets import link_buckets
from .common import U64, Held, Scratch, Tokens, components, fold_windows, lean, letters, list_array, map_arrow, mix, plain, signed, slices

MIN_WORDS, EDITS, GRAM, RUN = 4, 15, 2, 3
#: Blocks an edit that a line shows at first, at the next attempts, and in the end, which is always enough.
SHOWN = (1.5, 1.75, 2.1, RUN)
#: Blocks that so many lines show give their pairs at once, others those with a centre, and what that
#: leaves goes to :mod:`buckets`; keys whose counter tells of at least 2^(OFTEN - 1) occurrences in the
#: table are spread by line; keys of a packed bucket, and of a flush.
SMALL, OFTEN, BUCKET, FLUSH = 24, 20, 1 << 14, 400_000
#: Bits of a line's word parities, counters of pairs of words, and counters sent in one row.
PARITY, COUNTERS, SLICE = 192, 1 << 20, 1 << 12
MARKS = [f"p{i}" for i in range(PARITY // 64)]
#: Separators of normalised lines: all ASCII but letters and digits; \n ends a line.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48


def _cut(texts: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Words of all lines, and of each line the row and its number there."""
    parts = pc.split_pattern(letters(texts), "\n")
    per = np.diff(np.asarray(parts.offsets))
    doc = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return Tokens.of(parts.flatten(), break_=SEPARATORS, fold=FOLD), doc, number


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h, words) of every line long enough to judge; and, from each task, how many of its
    pairs of words fall into each counter (slot, seen: ``SLICE`` counters a row)."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("words", pa.int64()), ("slot", pa.int32()), ("seen", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                tokens, doc, number = _cut(piece.column(1))
                seen += np.bincount((_grams(tokens) & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                use = np.flatnonzero(tokens.counts >= MIN_WORDS)
                whole = group_hash(tokens.hashes, tokens.first[:-1], tokens.counts)[use]
                ids = piece.column(0).take(pa.array(doc[use]))
                rest = pa.nulls(len(use), pa.int32()), pa.nulls(len(use), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(number[use].astype(np.int32)), pa.array(signed(whole)), pa.array(tokens.counts[use]), *rest], schema=schema)
        parts = seen.reshape(-1, SLICE)
        some = np.flatnonzero(parts.any(axis=1))
        press = zstandard.ZstdCompressor(level=1).compress
        packed = [press(np.ascontiguousarray(parts[i].view(np.uint8).reshape(-1, 8).T).tobytes()) for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), f.type) for f in list(schema)[:4]), pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], schema=schema)

    return _told(docs).mapInArrow(lean(run), "doc_id long, line int, h long, words long, slot int, seen binary")


def _told(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")


def most_edits(words: np.ndarray) -> np.ndarray:
    """The most edits between a line of so many words and any that it can be linked with; 0 if it can be
    linked with equal lines only."""
    out = np.zeros(len(words), np.int64)
    for d in range(int(words.max(initial=0)) * EDITS // (100 - EDITS) + 2):
        k = EDITS * (words + d) // 100
        np.maximum(out, k, out=out, where=k >= d)
    return out


def _grams(tokens: Tokens) -> np.ndarray:
    """Hash of each run of ``GRAM`` words within a line that is long enough to judge."""
    grams, rows = fold_windows(tokens.hashes, GRAM), tokens.rows
    ok = rows[: len(grams)] == rows[GRAM - 1 :] if len(grams) else np.zeros(0, bool)
    return grams[ok & (tokens.counts[rows[: len(grams)]] >= MIN_WORDS)]


def rarity(docs: DataFrame) -> np.ndarray:
    """For each counter the logarithm of how often the pairs of words that fall into it occur in all
    documents, beyond what a counter holds by chance."""
    return levels(line_rows(docs))


def levels(lines: DataFrame) -> np.ndarray:
    """:func:`rarity` by the counters among the rows of :func:`line_rows`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, seen in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.ascontiguousarray(np.frombuffer(unpack(seen.as_buffer()), np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]
                sums[slot] = sums[slot] + n if slot in sums else n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slot", "n"])

    n = np.zeros((COUNTERS // SLICE, SLICE), np.int64)
    for slot, seen in lines.where("slot is not null").select("slot", "seen").repartition("slot").mapInArrow(lean(add), "slot int, n binary").collect():  # 8 MB at most
        n[slot] = np.frombuffer(seen, np.int64)
    n = n.reshape(-1).astype(float)
    chance = float(np.median(n))
    return np.where(n > 0, np.log2(np.maximum(n - chance - 3 * math.sqrt(chance), 0.5)) + 1, 0).astype(np.uint8)


def _edits_needed(at: np.ndarray, rows: np.ndarray, lines: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many edits break up all blocks (the place of their first word, their line; in order) of each of
    ``lines``, counted to ``most`` + 1 only: an edit at the last word of the first one left takes all
    that begin before that word's end."""
    count = np.zeros(len(lines), np.int64)
    now, end = np.searchsorted(rows, lines), np.searchsorted(rows, lines, side="right")
    after = np.searchsorted(at, at + RUN)  # the first block that shares no word with this one's last
    live = np.flatnonzero(now < end)
    while len(live):
        count[live] += 1
        now[live] = after[now[live]]
        live = live[(now[live] < end[live]) & (count[live] <= most[live])]
    return count


def first_grams(tokens: Tokens, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks that each line shows, once each, their line, and whether many lines show them."""
    runs, two, rows = fold_windows(tokens.hashes, RUN), fold_windows(tokens.hashes, GRAM), tokens.rows
    most = most_edits(tokens.counts)
    at = np.flatnonzero((rows[: len(runs)] == rows[RUN - 1 :]) & (most[rows[: len(runs)]] > 0)) if len(runs) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, U64), at, np.zeros(0, bool)
    runs, rows = runs[at], rows[at]
    two = level[(two & U64(COUNTERS - 1)).astype(np.int64)]
    rare = np.minimum(two[at], two[at + RUN - GRAM])
    wide = max(1, len(tokens.counts).bit_length())
    place = rows.astype(U64) << U64(64 - wide)
    place |= rare.astype(U64) << U64(58 - wide)
    order = np.argsort(place | (runs >> U64(6 + wide)))
    line = np.append(True, rows[1:] != rows[:-1])  # a line's blocks stay where they were, in another order
    step = np.arange(len(at))
    rank = np.empty(len(at), np.int64)
    rank[order] = step - np.maximum.accumulate(np.where(line, step, 0))
    shown = np.zeros(len(tokens.counts), np.int64)
    left, mine = np.flatnonzero(most > 0), step
    for each in SHOWN:
        shown[left] = np.ceil(each * most[left]) + 1
        use = mine[rank[mine] < shown[rows[mine]]]
        left = left[_edits_needed(at[use], rows[use], left, most[left]) <= most[left]]
        if not len(left):
            break
        again = np.zeros(len(shown), bool)
        again[left] = True
        mine = mine[again[rows[mine]]]
    order = order[rank[order] < shown[rows[order]]]
    runs, rows, rare = runs[order], rows[order], rare[order]
    fresh = np.append(True, (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1]))
    return runs[fresh], rows[fresh], rare[fresh] >= OFTEN


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``PARITY`` bits of each line: whether the words that fall into a bit are odd in number.  Of the
    words' hashes, side by side, it takes the low 32 bits."""
    out = np.zeros((len(counts), PARITY // 64), U64)
    some = np.flatnonzero(counts)
    if len(some):
        bit = (hashes.astype(np.uint32) >> 8).astype(np.int64) % PARITY
        words = np.zeros((len(bit), PARITY // 64), U64)
        words[np.arange(len(bit)), bit >> 6] = U64(1) << (bit & 63).astype(U64)
        out[some] = np.bitwise_xor.reduceat(words, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def _place(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h.view(U64) ^ mix(doc.view(U64)))


def _places(wanted: DataFrame) -> DataFrame:
    """One column: the places of the lines ``wanted`` (h, doc_id)."""

    def place(h: pa.Array, doc: pa.Array) -> pa.Array:
        return pa.array(signed(_place(np.asarray(h), np.asarray(doc))))

    return wanted.select(arrow_udf(place, "long")("h", "doc_id").alias("p"))


def line_marks(counts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The number of words (16 bits, none beyond) and 48 of the parities in one number."""
    return np.minimum(counts, 65535).astype(U64) | ((bits[:, 0] ^ (bits[:, 1] << U64(7))) << U64(16))


def maybe_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines of these marks can be linked; never false for those that are."""
    x, y = (a & U64(65535)).astype(np.int64), (b & U64(65535)).astype(np.int64)
    long = np.maximum(x, y)
    apart = np.bitwise_count((a ^ b) >> U64(16)).astype(np.int64)
    return (long == 65535) | ((100 * np.minimum(x, y) >= (100 - EDITS) * long) & (apart <= 2 * (EDITS * long // 100)))


def packed_keys(docs: DataFrame, nodes: DataFrame, level: np.ndarray, bits: int) -> DataFrame:
    """(bucket, often, keys, ids, marks): the keys of the lines ``nodes`` (h, doc_id), and of few others
    that are equal to one, packed by bucket: 32 bits a key, sorted.

    A bucket is the first bits of the key, so all lines of a key meet in it.  Keys that many
    lines show are spread over the buckets by line instead, and hold all 64 bits."""
    shared = docs.sparkSession.sparkContext.broadcast((level, Held(_places(nodes), 27)))
    shift = U64(64 - bits)

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        level, held = shared.value
        tokens, doc, _ = _cut(batch.column(1))
        whole = group_hash(tokens.hashes, tokens.first[:-1], tokens.counts)
        use = tokens.counts >= MIN_WORDS
        use[use] = held(_place(whole[use], np.asarray(batch.column(0))[doc[use]]))
        tokens = tokens.keep(use)
        keys, rows, often = first_grams(tokens, level)
        return keys, whole[rows], line_marks(tokens.counts, parities(tokens.hashes, tokens.counts))[rows], often

    def pack(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, ids, marks, often = (np.concatenate(x) for x in zip(*held, strict=True))
        press = zstandard.ZstdCompressor(level=1)
        for many in (False, True):
            some = np.flatnonzero(often == many)
            where = (mix(ids[some]) if many else keys[some]) >> shift
            order = np.lexsort((keys[some], where)) if many else np.argsort(keys[some])
            order, where = some[order], where[order]
            at = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
            rows = []
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(where)], strict=False):
                o = order[lo:hi]
                k = keys[o]
                if not many:
                    k = (k << U64(bits)) >> U64(32)
                    k = np.diff(k, prepend=U64(0)).astype(np.uint32)
                    k = np.ascontiguousarray(k.view(np.uint8).reshape(-1, 4).T)
                rows.append((int(where[lo]), many, press.compress(k.tobytes()), ids[o].tobytes(), marks[o].tobytes()))
            for i in range(0, len(rows), 256):
                part = list(zip(*rows[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "often", "keys", "ids", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                held.append(keys_of(piece))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield from pack(held)
                    held, size = [], 0
        if size:
            yield from pack(held)

    return _told(docs).mapInArrow(lean(run), "bucket int, often boolean, keys binary, ids binary, marks binary")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed keys by bucket -> (key, a, b): pairs of lines that may be alike (key null); of keys with
    more than ``SMALL`` lines the pairs with one centre, and the other members (a; b the centre);
    and the members of keys that are spread (b null).

    The centre is the line whose sketch is nearest to that of most members: lines of one family
    share it in most of their keys."""
    unpack = zstandard.ZstdDecompressor().decompress

    def out(key, a, b) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none if key is None else pa.array(signed(key)), pa.array(signed(a)), none if b is None else pa.array(signed(b))], ["key", "a", "b"])

    def close(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, ids, marks = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort((keys << U64(32)) | (ids & U64(0xFFFFFFFF)))  # equal lines of a key side by side
        keys, ids, marks = keys[order], ids[order], marks[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
        keys, ids, marks = keys[fresh], ids[fresh], marks[fresh]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(start, len(keys)))
        left = np.repeat(start + size, size) - np.arange(len(keys))  # items of the key from here on
        wide = np.repeat(size, size)
        many = wide > SMALL
        for lo in start[size > SMALL].tolist():
            hi = lo + int(wide[lo])
            bits = np.unpackbits((marks[lo:hi] >> U64(16)).view(np.uint8).reshape(-1, 8), axis=1)
            most = np.packbits(2 * bits.sum(0, dtype=np.int64) > hi - lo).view(U64)[0]
            at = lo + int(np.bitwise_count((marks[lo:hi] >> U64(16)) ^ most).argmin())
            others = np.delete(np.arange(lo, hi), at - lo)
            good = others[maybe_alike(marks[others], np.full(len(others), marks[at]))]
            if len(good):
                yield out(None, ids[good], np.full(len(good), ids[at]))
            yield out(keys[others] | (U64(bucket) << U64(32)), ids[others], np.full(len(others), ids[at]))
        at = np.flatnonzero((wide > 1) & ~many)
        for d in range(1, SMALL):
            at = at[left[at] > d]
            if not len(at):
                return
            good = at[maybe_alike(marks[at], marks[at + d])]
            if len(good):
                yield out(None, ids[good], ids[good + d])

    now, held = None, []
    for batch in batches:
        for bucket, often, keys, ids, marks in zip(*(batch.column(i) for i in range(5)), strict=True):
            ids = np.frombuffer(ids.as_buffer(), U64)
            if often.as_py():
                yield out(np.frombuffer(unpack(keys.as_buffer()), U64), ids, None)
                continue
            if bucket.as_py() != now:
                if held:
                    yield from close(now, held)
                now, held = bucket.as_py(), []
            planes = np.frombuffer(unpack(keys.as_buffer()), np.uint8).reshape(4, -1)
            k = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32)[:, 0], dtype=U64)
            held.append((k, ids, np.frombuffer(marks.as_buffer(), U64)))
    if held:
        yield from close(now, held)


def _documents(wanted: DataFrame) -> DataFrame:
    """One column: the places of the documents of ``wanted``."""

    def place(doc: pa.Array) -> pa.Array:
        return pa.array(signed(mix(np.asarray(doc).view(U64))))

    return wanted.select("doc_id").distinct().select(arrow_udf(place, "long")("doc_id").alias("p"))


def line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, said): hashes of the normalised words of the lines ``wanted`` (h, doc_id), and of few
    others; a line may come more than once."""
    shared = docs.sparkSession.sparkContext.broadcast((Held(_places(wanted)), Held(_documents(wanted))))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, documents = shared.value
        batch = batch.filter(pa.array(documents(mix(np.asarray(batch.column(0)).view(U64)))))
        tokens, doc, _ = _cut(batch.column(1))
        whole = group_hash(tokens.hashes, tokens.first[:-1], tokens.counts)
        use = np.flatnonzero(tokens.counts >= MIN_WORDS)
        use = use[lines(_place(whole[use], np.asarray(batch.column(0))[doc[use]]))]
        use = use[np.unique(whole[use], return_index=True)[1]]
        some = np.zeros(len(tokens.counts), bool)
        some[use] = True
        kept = tokens.keep(some)
        at = np.flatnonzero(some)
        return pa.RecordBatch.from_arrays([pa.array(signed(whole[at])), list_array(kept.hashes.astype(np.uint32).view(np.int32), kept.counts[at], pa.int32())], ["h", "said"])

    return map_arrow(_told(docs), cut, "h long, said array<int>")


def group_hash(h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each group's sequence."""
    out = np.zeros(len(counts), U64)
    some = np.flatnonzero(counts)
    if len(some):
        place = np.arange(len(h), dtype=U64) - np.repeat(first[some], counts[some]).astype(U64)
        out[some] = np.add.reduceat(mix(h ^ mix(place + U64(1))), first[some])
    return mix(out ^ counts.astype(U64))


def within_edits(a: list, b: list, most: int) -> bool:
    """Whether ``most`` insertions, deletions and substitutions of words turn a into b.

    Furthest points by diagonal: the time is that of the differences, not of the lines."""
    if abs(len(a) - len(b)) > most:
        return False
    n, m = len(a), len(b)

    def slide(i: int, j: int) -> int:
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    far = {0: slide(0, 0)}
    if n == m == far[0]:
        return True
    for e in range(1, most + 1):
        new = {}
        for d in range(-e, e + 1):  # diagonal: j - i
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            new[d] = i = slide(i, i + d)
            if i == n and i + d == m:
                return True
        far = new
    return False


def _similar(left: pa.Array, right: pa.Array) -> pa.Array:
    """Over the lines' word hashes.  Lines of one length that differ in few places need no table."""
    x, y = left.flatten().to_numpy(), right.flatten().to_numpy()
    n, m = pc.list_value_length(left).to_numpy().astype(np.int64), pc.list_value_length(right).to_numpy().astype(np.int64)
    most = EDITS * np.maximum(n, m) // 100
    good = np.zeros(len(n), bool)
    even = np.flatnonzero(n == m)
    if len(even):
        size = n[even]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        begin = np.repeat((np.cumsum(n) - n)[even], size), np.repeat((np.cumsum(m) - m)[even], size)
        apart = np.add.reduceat(x[begin[0] + step] != y[begin[1] + step], np.cumsum(size) - size, dtype=np.int64)
        good[even] = apart <= most[even]
    rest = np.flatnonzero(~good & (np.abs(n - m) <= most))
    if len(rest):  # an edit turns two parities at most
        marks = (parities(np.asarray(pc.list_flatten(side.take(pa.array(rest)))), size[rest]) for side, size in ((left, n), (right, m)))
        rest = rest[np.bitwise_count(np.bitwise_xor(*marks)).sum(axis=1, dtype=np.int64) <= 2 * most[rest]]
    for i in rest.tolist():
        a, b = left[i].as_py(), right[i].as_py()
        if (Counter(a) & Counter(b)).total() >= max(len(a), len(b)) - most[i]:  # each edit takes one word at most
            good[i] = within_edits(a, b, int(most[i]))
    return pa.array(good)


def _marks(said: pa.Array) -> pa.Array:
    bits = parities(np.asarray(said.flatten()), pc.list_value_length(said).to_numpy().astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(signed(np.ascontiguousarray(b))) for b in bits.T], MARKS)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, removed): the numbers of the lines that go, for every document that loses one."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(line_rows(docs), "lines")
    lines = rows.where("slot is null").select("doc_id", "line", "h", "words")
    # the least place takes two steps, each over numbers, which Spark adds up in hash tables without sorting
    nodes = scratch.write(lines.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("words").alias("words"), F.count("*").alias("n")), "nodes")
    total = nodes.agg(F.sum(F.col("words") * (SHOWN[0] * EDITS / 100) + 1)).first()[0] or 0
    packed = packed_keys(docs, nodes.select("h", "doc_id"), levels(rows), max(10, math.ceil(math.log2(1 + total / BUCKET))))
    met = scratch.write(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_meet), "key long, a long, b long"), "met")
    pairs = scratch.write(met.where("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # words of all lines that are paired, or that are in a key of many lines
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).union(met.where("key is not null").select("a")).distinct()
    wanted = scratch.write(nodes.select("h", "doc_id").join(wanted, "h", "left_semi"), "wanted")
    said = scratch.write(line_words(docs, wanted).join(wanted.select("h"), "h", "left_semi").dropDuplicates(["h"]), "words")

    def verified(pairs: DataFrame, said: DataFrame) -> DataFrame:
        both = pairs.join(said.toDF("a", "said_a"), "a").join(said.toDF("b", "said_b"), "b")
        return both.where(arrow_udf(_similar, "boolean")("said_a", "said_b")).select("a", "b")

    links = scratch.write(verified(pairs, said), "links")
    # a centre has met all members of its key: what is left are keys whose other members are in
    # several components, and keys that were spread
    roots = components(scratch, links, "lines-first")
    told = met.where("key is not null and b is not null").select("key", F.col("a").alias("id")).join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("label"))
    mixed = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    spread = met.where("key is not null and b is null").select("key", F.col("a").alias("id"))
    members = scratch.write(told.join(mixed, "key").select("key", "id").union(spread).distinct(), "members")
    if not members.isEmpty():
        own = scratch.write(members.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("ks")), "own")
        many = scratch.write(said.join(own.select(F.col("id").alias("h")), "h", "left_semi"), "many-words")  # each round joins with them
        marks = many.select(F.col("h").alias("id"), F.size("said").alias("size"), arrow_udf(_marks, "struct<" + ",".join(f"{m}:long" for m in MARKS) + ">")("said").alias("m")).select("id", "size", *(f"m.{m}" for m in MARKS))
        ranked = scratch.write(marks.join(own.select("id", F.size("ks").alias("held")), "id"), "ranked")
        bits = " + ".join(f"bit_count({m}_a ^ {m}_b)" for m in MARKS)
        alike = f"100 * least(size_a, size_b) >= {100 - EDITS} * greatest(size_a, size_b) and {bits} <= 2 * ({EDITS} * greatest(size_a, size_b) div 100)"
        first = "array_min(array_intersect(ks_a, ks_b)) = key"  # a pair that shares several keys is taken in one of them
        roots = link_buckets(scratch, members, lambda p: verified(p, many), "true", "lines", ranked, alike, known=links, early=True, rank="held", late=own, once=first)
    roots = scratch.write(roots, "roots")
    roots = roots.union(roots.select("root", "root").distinct())
    # of the lines that occur twice or are linked: the least place of each group
    grouped = nodes.select("h", "n").join(roots.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "h").alias("root"))
    told = scratch.write(lines.select("doc_id", "line", "h").join(grouped, "h").select("doc_id", "line", "root"), "told")
    first = told.groupBy("root").agg(F.min("doc_id").alias("doc_id"))
    keep = told.join(first, ["root", "doc_id"]).groupBy("root").agg(F.min("doc_id").alias("keep_doc"), F.min("line").alias("keep_line"))
    gone = told.join(keep, "root").where("doc_id <> keep_doc or line <> keep_line").select("doc_id", "line")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts."""
    at = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "n_chars") if c in docs.columns}
    gone = removed_lines(docs.select("doc_id", "text")).toDF("line_doc", "line_gone")
    rows = plain(docs)
    rows = rows.join(gone, F.col(at["doc_id"]).cast("long") == F.col("line_doc"), "left")
    lines = F.split(F.col(at["text"]).cast("string"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("line_gone"))
    changed = F.col("line_gone").isNotNull()
    rows = rows.withColumn(at["text"], F.when(changed, F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).otherwise(F.col(at["text"])))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.when(changed, F.length(at["text"]).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col(at["n_chars"])))
    return rows.drop("line_doc", "line_gone").toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row of ``docs``."""
    gone = removed_lines(docs)
    per = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"))
    return per.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
