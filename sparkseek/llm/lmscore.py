"""Language-model scores by a weighted backoff automaton.

Model.  Every training token counts.  Words, and the bigrams and trigrams that occur ``LEAST``
times or more, whatever the size of the input, have probabilities by interpolated absolute
discounting:

    p(w)      = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h)  = (c(h w) - D) / c(h) + bow(h) p(w | h without its first word)

where the first term is left out unless h w is kept, and bow(h), what the kept ones leave of the
history's mass, makes the probabilities of all words and of an unseen one add up to 1.

Automaton.  States are the root, a word (or the start of text) and a pair of words that begin kept
n-grams.  An arc leads from a state over a word, with log10 p(w | state), to the longest suffix
that is a state; on a word without an arc the failure arc is taken, with log10 bow(state), to the
state without its first word, and in the end the root's arc.  Texts are traversed from left to
right, many at a time, each carrying its state and adding up weights.

Scale.  The model grows with the corpus and is never collected or broadcast.  Texts are encoded
once, in parts of about ``FLUSH`` tokens; a task adds up the counts of ``TOGETHER`` tokens before it
hands them on.  N-grams are counted by a shuffle of packed keys, of
which only those whose shorter n-grams are kept take part (a bitmap of fixed size lets a few more
through; the counts decide).  A part asks for the counts of its own words and n-grams, once each;
requests meet the model's entries by key, packed by bucket, and the answers are the part of the
automaton that its texts can reach.

Defined results.  A null, empty or blank text is its end token alone.  A null doc_id isn't
held out.  Repeated rows count, and are scored, once each.  Without any training document N is
0 and V is 0.  Extra columns are ignored."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Held, Scratch, Tokens, free_shuffles, lean, mix, signed, slices
from .lookup import Lookup

LEAST, DISCOUNT, FLUSH, TOGETHER, LANE, BUCKET, PARTITIONS = 8, 0.75, 700_000, 4_000_000, 64, 1 << 18, 50_000
#: Masses are whole multiples of 1 / QUARTERS, as the discount is, and are sent as whole numbers.
QUARTERS = 4
#: Hashes of the end of a text, and of its start as a history.
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
STATES = "flush long, docs array<{kind}>, out array<boolean>, sizes binary, words binary, tokens binary"


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def after(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the n-gram of a history (a word's hash or an n-gram's key) and a word."""
    return mix(history * U64(0x9E3779B97F4A7C15) + mix(word ^ U64(0x2545F4914F6CDD1D)))


# --------------------------------------------------------------------------- packing


_zstd: list = []


def squeeze(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte by byte position, compressed."""
    if not _zstd:
        _zstd.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _zstd[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def spread(raw: pa.Scalar, kind: type = U64) -> np.ndarray:
    if not _zstd:
        _zstd.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    planes = np.frombuffer(_zstd[1].decompress(raw.as_buffer()), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind)[:, 0]


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted keys, by their first bits."""
    where = keys >> U64(64 - bits)
    at = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(keys) else np.zeros(0, np.int64)
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=False):
        yield int(where[lo]), slice(lo, hi)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


# --------------------------------------------------------------------------- encoded texts


class Part:
    """One part of the encoded texts: words and, for every position, its n-grams."""

    def __init__(self, out: pa.Scalar, sizes: pa.Scalar, words: pa.Scalar, tokens: pa.Scalar):
        self.sizes = np.frombuffer(sizes.as_buffer(), np.int64)
        self.words = np.frombuffer(words.as_buffer(), U64)
        self.tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens.as_buffer()), np.uint8).reshape(4, -1)
        self.tokens = np.ascontiguousarray(self.tokens.T).view(np.int32)[:, 0]
        self.out = np.asarray(out.values).astype(bool)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]

    def grams(self) -> None:
        """Hash of every token and of the one before, the key of both, and of those with the pair before."""
        self.h = self.words[self.tokens]
        self.past = np.concatenate(([START], self.h[:-1]))
        self.past[self.first] = START
        self.pair = after(self.past, self.h)
        self.back = np.concatenate((self.pair[:1], self.pair[:-1]))  # the pair that ends before the token; none at a text's first
        self.triple = after(self.back, self.h)
        self.inner = np.ones(len(self.h), bool)
        self.inner[self.first] = False

    def drop(self) -> None:
        """Frees what :meth:`grams` made, before the next part is built."""
        self.h = self.past = self.pair = self.back = self.triple = self.inner = None

    def training(self) -> np.ndarray:
        return ~np.repeat(self.out, self.sizes)

    def known(self, pairs: Held, triples: Held) -> np.ndarray:
        """The sorted keys that the part's automaton may hold."""
        return np.unique(np.concatenate([self.words, [START], self.pair[pairs(self.pair)], self.triple[self.inner & triples(self.triple)]]))


def encode(rows: DataFrame) -> DataFrame:
    """Parts of ``rows`` (doc_id, text, held_out), as ``STATES`` says."""
    kind = dict(rows.dtypes)["doc_id"]

    def pack(held: list) -> pa.RecordBatch:
        docs = pa.concat_arrays([x[0] for x in held])
        out = pa.concat_arrays([x[1] for x in held])
        sizes = np.concatenate([x[2] for x in held])
        words, tokens, counts = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words have small numbers, which take less room
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, tokens = words[order], rank[tokens]
        planes = np.ascontiguousarray(tokens.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        raw = zstandard.ZstdCompressor(level=3).compress(planes.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), one(docs), one(out), *(pa.array([x], pa.binary()) for x in (sizes.astype(np.int64).tobytes(), words.tobytes(), raw))], ["flush", "docs", "out", "sizes", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                h, first = with_ends(Tokens.of(piece.column(1)))
                held.append((piece.column(0), piece.column(2), np.diff(first), h))
                size += len(h)
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return rows.select("doc_id", "text", "held_out").mapInArrow(lean(run), STATES.format(kind=kind))


def with_ends(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the end token after each row, and where each row begins."""
    first = tokens.first + np.arange(len(tokens.first))
    out = np.full(first[-1], END, U64)
    at = np.arange(len(tokens.hashes)) + tokens.rows
    out[at] = tokens.hashes
    return out, first


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Part]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i], Part(*(batch.column(j)[i] for j in range(1, 5)))


def _each(states: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return states.select("flush", "out", "sizes", "words", "tokens").mapInArrow(lean(fn), schema)


# --------------------------------------------------------------------------- counts


def _grouped(batches: Iterator[pa.RecordBatch], unpack: Callable) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Rows sorted by bucket -> each bucket's arrays, joined."""
    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
            if bucket.as_py() != now:
                if held:
                    yield now, tuple(np.concatenate(x) for x in zip(*held, strict=True))
                now, held = bucket.as_py(), []
            held.append(unpack(*row))
    if held:
        yield now, tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _tallied(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each stands first, and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), counts
    order = np.argsort(keys)
    ranked = keys[order]
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return ranked[at], order[at], np.add.reduceat(counts[order], at)


def _added(parts: Iterator[tuple[int, tuple[np.ndarray, ...]]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(tokens, (keys, counts, ..)) of parts, keys distinct -> the same of ``TOGETHER`` tokens, sorted."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def close() -> tuple[np.ndarray, ...]:
        keys, counts, *more = (np.concatenate(x) for x in zip(*held, strict=True))
        k, at, c = _tallied(keys, counts)
        return (k, c, *(x[at] for x in more))

    for n, row in parts:
        held.append(row)
        size += n
        if size >= TOGETHER:
            yield close()
            held, size = [], 0
    if held:
        yield close()


def word_counts(states: DataFrame, bits: int) -> DataFrame:
    """(k, c) of the training tokens."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for _, part in _parts(batches):
                c = np.bincount(part.tokens[part.training()], minlength=len(part.words))
                yield len(part.tokens), (part.words[c > 0], c[c > 0])

        def rows():
            for keys, counts in _added(each()):
                for bucket, s in by_bucket(keys, bits):
                    yield bucket, squeeze(np.diff(keys[s], prepend=U64(0))), squeeze(counts[s])

        yield from batches_of(rows(), schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys, counts) in _grouped(batches, lambda k, c: (np.cumsum(spread(k), dtype=U64), spread(c, np.int64))):
            k, _, c = _tallied(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(c)], ["k", "c"])

    return _each(states, pack, "bucket int, keys binary, counts binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(tally), "k long, c long")


def gram_counts(states: DataFrame, chosen: Callable[[Part], tuple[np.ndarray, np.ndarray]], bits: int, least: int) -> DataFrame:
    """(k, c, history) of the n-grams that occur ``least`` times or more; of the history the ``bits`` + 40
    first bits, which is what requests carry.  chosen: the keys and histories of the positions of
    a part that may be kept.

    Two rounds: the first counts the beginnings of the keys, ``bits`` + 32 bits, which can only join
    counts; what passes it is counted by whole keys."""
    sc = states.sparkSession.sparkContext
    low = U64(32 - bits)

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for _, part in _parts(batches):
                part.grams()
                keys = chosen(part)[0]
                part.drop()
                yield len(part.tokens), np.unique(keys >> low, return_counts=True)

        def rows():
            for keys, counts in _added(each()):
                for bucket, s in by_bucket(keys << low, bits):
                    yield bucket, squeeze(np.diff(keys[s], prepend=U64(bucket) << U64(32))), squeeze(counts[s])

        yield from batches_of(rows(), pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (keys, counts) in _grouped(batches, lambda k, c: (np.cumsum(spread(k), dtype=U64), spread(c, np.int64))):
            k, _, c = _tallied(keys + (U64(bucket) << U64(32)), counts)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[c >= least]))], ["p"])

    some = _each(states, beginnings, "bucket int, keys binary, counts binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(often), "p long")
    passed = sc.broadcast(Held(some))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for _, part in _parts(batches):
                part.grams()
                keys, past = chosen(part)
                part.drop()
                use = passed.value(keys >> low)
                keys, at, counts = np.unique(keys[use], return_index=True, return_counts=True)
                yield len(part.tokens), (keys, counts, past[use][at])

        def rows():
            for keys, counts, past in _added(each()):
                for bucket, s in by_bucket(keys, bits):
                    yield bucket, squeeze(np.diff(keys[s], prepend=U64(0))), squeeze(past[s] >> U64(24 - bits)), squeeze(counts[s])

        yield from batches_of(rows(), pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("histories", pa.binary()), ("counts", pa.binary())]))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda k, h, c: (np.cumsum(spread(k), dtype=U64), spread(h) << U64(24 - bits), spread(c, np.int64))
        for _, (keys, past, counts) in _grouped(batches, unpack):
            k, at, c = _tallied(keys, counts)
            kept = c >= least
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[kept])), pa.array(c[kept]), pa.array(signed(past[at[kept]]))], ["k", "c", "history"])

    packed = _each(states, pack, "bucket int, keys binary, histories binary, counts binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(tally), "k long, c long, history long")


class Model:
    """Tables of kept n-grams, and what is needed to ask for them."""

    def __init__(self, scratch: Scratch, states: DataFrame, least: int = LEAST):
        self.sc = states.sparkSession.sparkContext
        size = states.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0  # some two bytes a token
        words = scratch.write(word_counts(states, max(8, math.ceil(math.log2(1 + size / BUCKET)))), "words")
        total, self.distinct, starts = words.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("k") == int(END.view(np.int64)), F.col("c")))).first()
        self.total = total or 0
        self.bits = max(8, math.ceil(math.log2(1 + self.total / BUCKET)))
        often = self.sc.broadcast(Held(words.where(F.col("c") >= least).select("k")))

        def pairs(part: Part) -> tuple[np.ndarray, np.ndarray]:
            ok = often.value(part.words)[part.tokens]
            use = ok & np.concatenate(([True], ok[:-1])) & part.training()
            use[part.first] = (ok & part.training())[part.first]
            return part.pair[use], part.past[use]

        two = scratch.write(gram_counts(states, pairs, self.bits, least), "pairs")
        free_shuffles(scratch.spark)  # the counts are written: their shuffles would stay beside the next ones
        self.pairs = self.sc.broadcast(Held(two.select("k")))
        kept = self.pairs

        def triples(part: Part) -> tuple[np.ndarray, np.ndarray]:
            ok = kept.value(part.pair)
            use = ok & np.concatenate(([False], ok[:-1])) & part.inner & part.training()
            return part.triple[use], part.back[use]

        three = scratch.write(gram_counts(states, triples, self.bits, least), "triples")
        free_shuffles(scratch.spark)
        self.triples = self.sc.broadcast(Held(three.select("k")))
        none, start = F.lit(0.0).alias("mass"), [(int(START.view(np.int64)), starts or 0, 0.0)]
        left = lambda grams: grams.groupBy(F.col("history").alias("k")).agg(F.lit(0).cast("long").alias("c"), F.sum(F.col("c") - DISCOUNT).alias("mass"))
        self.entries = words.select("k", "c", none).union(two.select("k", "c", none)).union(three.select("k", "c", none)).union(left(two).select("k", "c", "mass")).union(left(three).select("k", "c", "mass"))
        self.entries = self.entries.union(states.sparkSession.createDataFrame(start, "k long, c long, mass double"))

    def answers(self, states: DataFrame) -> DataFrame:
        """(flush, bucket, c, mass): for each part, bucket by bucket, the counts of its :meth:`Part.known`
        keys, and of those as histories the mass that kept n-grams take.

        Requests carry the first ``bits`` + 40 bits of a key, of which two entries share all with a
        probability of some 1e-8."""
        bits, pairs, triples = self.bits, self.pairs, self.triples
        low = U64(24 - bits)
        form = "bucket int, flush long, keys binary, c binary, mass binary"
        schema = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("keys", pa.binary()), ("c", pa.binary()), ("mass", pa.binary())])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for flush, part in _parts(batches):
                    part.grams()
                    keys = part.known(pairs.value, triples.value)
                    part.drop()
                    for bucket, s in by_bucket(keys, bits):
                        short = keys[s] >> low
                        yield bucket, flush.as_py(), squeeze(np.diff(short, prepend=U64(bucket) << U64(40))), None, None

            yield from batches_of(rows(), schema)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def close(held: list[pa.RecordBatch]):
                k, c, mass = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in range(3))
                k = k.view(U64)
                order = np.argsort(k, kind="stable")
                k, c, mass = k[order], c[order], mass[order]
                for bucket, s in by_bucket(k, bits):
                    yield bucket, None, squeeze(np.diff(k[s] >> low, prepend=U64(bucket) << U64(40))), squeeze(c[s]), squeeze(np.rint(mass[s] * QUARTERS).astype(np.int64))

            def rows():
                held, size = [], 0
                for batch in batches:
                    held.append(batch)
                    size += batch.num_rows
                    if size >= FLUSH // 2:
                        yield from close(held)
                        held, size = [], 0
                if size:
                    yield from close(held)

            yield from batches_of(rows(), schema)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                now, held, table = None, [], None
                for batch in batches:
                    for bucket, flush, keys, c, mass in zip(*(batch.column(i) for i in range(5)), strict=True):
                        if bucket.as_py() != now:
                            now, held, table = bucket.as_py(), [], None
                        keys = np.cumsum(spread(keys), dtype=U64)
                        if not flush.is_valid:  # entries come before requests
                            held.append((keys, spread(c, np.int64), spread(mass, np.int64)))
                            continue
                        if table is None:
                            k, n, m = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                            k, at = np.unique(k, return_inverse=True)
                            table = k, *(np.bincount(at, x, len(k)).astype(np.int64) for x in (n, m))
                        k, n, m = table
                        at = np.minimum(np.searchsorted(k, keys), max(len(k) - 1, 0))
                        hit = k[at] == keys if len(k) else np.zeros(len(keys), bool)
                        got = (np.where(hit, x[at], 0) if len(k) else np.zeros(len(keys), x.dtype) for x in (n, m))
                        yield flush.as_py(), now, *map(squeeze, got)

            yield from batches_of(rows(), pa.schema([("flush", pa.int64()), ("bucket", pa.int32()), ("c", pa.binary()), ("mass", pa.binary())]))

        both = self.entries.mapInArrow(lean(pack), form).union(_each(states, ask, form))
        return both.repartition("bucket").sortWithinPartitions("bucket", F.col("flush").asc_nulls_first()).mapInArrow(lean(meet), "flush long, bucket int, c binary, mass binary")


# --------------------------------------------------------------------------- automaton


class Automaton:
    """The states and arcs that the texts of a part can reach, numbered by ``keys``; -1 is the root.

    ``counts`` and ``mass``: of each key; total, distinct: of the training tokens."""

    def __init__(self, part: Part, keys: np.ndarray, counts: np.ndarray, mass: np.ndarray, total: int, distinct: int):
        self.part, self.keys, self.mass = part, keys, mass
        find = Lookup(keys).find
        self.word = find(part.words)[part.tokens]  # of every position
        self.counts = counts.astype(float)
        root = (self.counts + 0.5) / (total + 0.5 * (distinct + 1))
        self.root = np.log10(root)
        bow = np.where(mass > 0, 1 - mass / np.maximum(self.counts, 1), 1.0)
        self.bow = np.log10(bow)
        state = np.where(mass > 0, np.arange(len(keys), dtype=np.int32), np.int32(-1))
        # arcs over the second word of a pair, and what follows from the pair
        self.pair = find(part.pair)
        self.pair[(self.pair < 0) | (self.counts[self.pair] == 0)] = -1
        self.start = int(find(np.array([START]))[0])
        past = np.concatenate((np.array([self.start], np.int32), self.word[:-1]))
        past[part.first] = self.start
        self.p, self.target, self.fail = np.zeros(len(keys)), np.full(len(keys), -1, np.int32), np.full(len(keys), -1, np.int32)
        at = np.flatnonzero(self.pair >= 0)
        arc, h, w = self.pair[at], past[at], self.word[at]
        self.p[arc] = (self.counts[arc] - DISCOUNT) / self.counts[h] + bow[h] * root[w]
        self.fail[arc] = state[w]
        self.target[arc] = np.where(state[arc] >= 0, state[arc], state[w])
        # arcs over the third word of a triple; its shorter n-grams are kept, so their arcs are there
        three = find(part.triple)
        back = np.concatenate((np.array([-1], np.int32), self.pair[:-1]))
        at = np.flatnonzero(part.inner & (three >= 0) & (back >= 0) & (self.pair >= 0))
        at = at[self.counts[three[at]] > 0]
        arc, h, low = three[at], back[at], self.pair[at]
        self.p[arc] = (self.counts[arc] - DISCOUNT) / self.counts[h] + bow[h] * self.p[low]
        self.target[arc] = self.target[low]
        self.weight = np.log10(np.where(self.p > 0, self.p, 1.0))
        self.state, self.find = state, find
        part.past = part.pair = part.back = part.triple = None

    def traverse(self) -> np.ndarray:
        """Log10 probability of each text.

        Texts are cut into lanes of ``LANE`` tokens that are traversed side by side, from left to
        right; a lane that begins within a text begins in the state of the two tokens before."""
        part = self.part
        per = -(-part.sizes // LANE)
        row = np.repeat(np.arange(len(per)), per)
        at = part.first[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
        end = np.minimum(at + LANE, (part.first + part.sizes)[row])
        before = np.maximum(at - 1, 0)
        pair = self.pair[before]
        two = np.where(pair >= 0, self.state[pair], -1)
        now = np.where(at == part.first[row], self.state[self.start], np.where(two >= 0, two, self.state[self.word[before]]))
        score = np.zeros(len(row))
        go = np.arange(len(row))
        for _ in range(LANE):
            go = go[at[go] < end[go]]
            if not len(go):
                break
            score[go] += self.step(now, go, at[go])
            at[go] += 1
        return np.bincount(row, score, len(per))

    def step(self, now: np.ndarray, go: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Moves the lanes ``go`` over the tokens at ``place``; returns what the arcs weigh."""
        word, h = self.word[place], self.part.h[place]
        out, new, at = self.root[word].copy(), self.state[word], now[go].copy()
        lost = np.zeros(len(go))
        left = np.flatnonzero(at >= 0)
        while len(left):  # twice at most: over a pair's state and a word's
            arc = self.find(after(self.keys[at[left]], h[left])).astype(np.int64)
            hit = (arc >= 0) & (self.p[arc] > 0)
            out[left[hit]], new[left[hit]] = self.weight[arc[hit]], self.target[arc[hit]]
            left = left[~hit]
            lost[left] += self.bow[at[left]]
            at[left] = self.fail[at[left]]
            left = left[at[left] >= 0]
        now[go] = new
        return out + lost


def score(docs: DataFrame, out: Column, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``
    (doc_id, text) by a model of those where ``out`` is false."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), out.alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    states = scratch.write(encode(rows), "states")
    model = Model(scratch, states, least)
    pairs, triples, total, distinct = model.pairs, model.triples, model.total, model.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(docs: pa.Scalar, part: Part, got: list) -> pa.RecordBatch:
            part.grams()
            counts, mass = (np.concatenate(x) for x in zip(*got, strict=True))
            auto = Automaton(part, part.known(pairs.value, triples.value), counts, mass, total, distinct)
            c = auto.counts[auto.word]
            add = lambda x: np.add.reduceat(x, part.first)  # noqa: E731  every row has its end token
            return pa.RecordBatch.from_arrays([docs.values, pa.array(part.out), pa.array(part.sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(add(auto.root[auto.word])), pa.array(auto.traverse())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                flush, bucket, docs, *state, c, mass = (batch.column(j)[i] for j in range(9))
                if not bucket.is_valid:  # a part comes before its answers
                    if held:
                        yield close(*held)
                    held = docs, Part(*state), []
                else:
                    held[2].append((spread(c, np.int64), spread(mass, np.int64) / QUARTERS))
        if held:
            yield close(*held)

    nothing = lambda t: F.lit(None).cast(t)
    told = states.select("flush", nothing("int").alias("bucket"), "docs", "out", "sizes", "words", "tokens", nothing("binary").alias("c"), nothing("binary").alias("mass"))
    got = model.answers(states).select("flush", "bucket", nothing(f"array<{kind}>"), nothing("array<boolean>"), *[nothing("binary")] * 3, "c", "mass")
    # a part a partition, so that a task holds one at a time
    parts = told.union(got).repartition(max(1, min(states.count(), PARTITIONS)), "flush").sortWithinPartitions("flush", F.col("bucket").asc_nulls_first())
    done = parts.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
