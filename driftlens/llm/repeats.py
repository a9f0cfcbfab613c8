"""Removal of byte strings that repeat across documents, by prefix-free parsing.

Rolling hashes over WINDOW-byte windows set triggers: a phrase begins where the least hash of the K-byte strings inside
the window changes. A phrase runs from its first window to the end of its last, so phrases overlap by WINDOW - 1 bytes,
each window lies in exactly one phrase, and equal windows have the same trigger value wherever they stand. Each task
gathers a dictionary of distinct phrases for some megabytes of documents at a time; occurrences whose whole phrase also
stands in a smaller document there are settled at once, and the rest of the parse is dealt to buckets by trigger value.
A bucket holds all unsettled phrases that can share a window: its dictionary, and their occurrences, its parse. The suffix
array of the dictionary puts equal windows side by side; the least document of the phrases that hold them, read off the
parse, decides. The windows found so combine, per document, into spans. As no window crosses phrases, the parse needs no
suffix array of its own.

Nothing is gathered per key: a phrase that many documents share enters a bucket once for each gathering of some
megabytes, and is held there once. Very long texts are parsed whole. Null texts count as empty. A null id counts as larger than any other; rows with equal ids never remove each
other's bytes. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, K = 50, 10
#: Bytes of documents that a task parses at once, and of documents to a bucket on average.
GATHER, BUCKET = 4 << 20, 2 << 20
#: Places of a dictionary that are sorted at once, about.
SLICE = 1 << 19
LAST = np.iinfo(np.int64).max
#: About this many documents show which K-byte strings are common; one is if it begins so many of their phrases.
SAMPLE_DOCS, COMMON = 5000, 40
LEVEL = 9

_TABLE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_NONE = np.empty(0, np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 2**64))


def _rolled(b: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all substrings of each length, doubled up from single bytes."""
    # No closure here: one that named itself would keep its arrays until the next collection of cycles.
    wanted = set(lengths)
    while more := {x for n in wanted if n > 1 for x in (_half(n), n - _half(n))} - wanted:
        wanted |= more
    powers = {1: _TABLE[b]}
    for n in sorted(wanted - {1}):
        a, z, m = powers[_half(n)], powers[n - _half(n)], len(b) - n + 1
        h = a[:m] * _power(n - _half(n))
        h += z[_half(n) : _half(n) + m]
        powers[n] = h
    return [powers[n] for n in lengths]


def _half(n: int) -> int:
    """The largest power of two below n."""
    return 1 << (n - 1).bit_length() - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbours."""
    have, m = 1, v
    while 2 * have <= n:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(v) - n + 1], m[n - have : len(v) - have + 1]) if have < n else m


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... for each start and length."""
    before = np.cumsum(lens) - lens
    return np.arange(int(lens.sum()), dtype=np.int64) + np.repeat(starts - before, lens)


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Whether the lens[i] bytes at a[i] and at b[i] are equal."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    cuts = np.searchsorted(np.cumsum(lens), np.arange(block, int(lens.sum()) + block, block))
    at = 0
    for c in np.unique(np.minimum(cuts + 1, len(a))):
        n = lens[at:c]
        differs = buf[_spread(a[at:c], n)] != buf[_spread(b[at:c], n)]
        out[at:c] = ~np.logical_or.reduceat(differs, np.cumsum(n) - n)
        at = c
    return out


def _ranked(k: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Mixed hashes of K-byte strings, those of common (sorted) strings above all others."""
    v = _mixed(k) >> np.uint64(1)
    if len(common):
        maybe = np.zeros(1 << 16, bool)
        maybe[(common >> np.uint64(47)).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(v >> np.uint64(47)).astype(np.int64)])
        found = np.minimum(np.searchsorted(common, v[at]), len(common) - 1)
        at = at[common[found] == v[at]]
        v[at] |= np.uint64(1 << 63)
    return v


def _phrases(buf: np.ndarray, ends: np.ndarray, common: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that end at ends in buf: each phrase's document, first window, number of windows, trigger, hash.

    Windows are hashed a block of places at a time, which fits the processor's cache; only phrases are kept of them.
    """
    lasts = ends - WINDOW + 1  # where the windows of each document end
    heads = np.append(0, ends[:-1])
    lasts_of = np.flatnonzero(lasts > heads)
    at_last = np.zeros(len(ends), np.uint64)
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 3)]
    before, total = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    for at in range(0, max(0, len(buf) - WINDOW + 1), block):
        k, w = _rolled(buf[at : at + block + WINDOW - 1], (K, WINDOW))
        trigger = _least(_ranked(k, common), WINDOW - K + 1)
        # Sums of the hashes of all windows before each place.
        total = np.cumsum(np.append(total[-1:], _mixed(w)))
        new = trigger != np.append(before, trigger[:-1])
        before = trigger[-1:]
        new[heads[np.searchsorted(heads, at) : np.searchsorted(heads, at + len(w))] - at] = True
        starts = np.flatnonzero(new)
        doc = np.searchsorted(ends, starts + at, side="right")
        inside = starts + at < lasts[doc]
        starts, doc = starts[inside], doc[inside]
        found.append((doc, starts + at, trigger[starts], w[starts] * np.uint64(_P | 1), total[starts]))
        over = lasts_of[np.searchsorted(lasts[lasts_of], at, side="right") : np.searchsorted(lasts[lasts_of], at + len(w), side="right")]
        at_last[over] = total[lasts[over] - at]
    doc, starts, trigger, first, sums = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run ends where the next begins or where the document's windows end.
    next_one = np.append(doc[1:] == doc[:-1], False)[: len(doc)]
    stops = np.where(next_one, np.append(starts[1:], 0)[: len(doc)], lasts[doc])
    name = (np.where(next_one, np.append(sums[1:], np.uint64(0))[: len(doc)], at_last[doc]) - sums) ^ first
    return doc, starts, stops - starts, trigger, name


def _packed(docs: np.ndarray, prints: np.ndarray, places: np.ndarray, counts: np.ndarray, data: np.ndarray) -> bytes:
    head = np.array([len(docs)], np.int64)
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(x.tobytes() for x in (head, docs, prints, places.astype(np.int32), counts.astype(np.int32), data)))


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, np.int32, n, 8 + 16 * n), np.frombuffer(raw, np.int32, n, 8 + 20 * n), np.frombuffer(raw, np.uint8, -1, 8 + 24 * n)


PARSED = "bucket int, doc_id long, print long, spans binary, phrases binary"
SPANS = "doc_id long, print long, spans binary"


def _each(b: pa.RecordBatch, n: int = 256) -> Iterator[tuple]:
    """The rows of a batch; a few at a time are held as Python's objects."""
    for at in range(0, b.num_rows, n):
        yield from zip(*(c.to_pylist() for c in b.slice(at, n).columns), strict=True)


def _span_rows(docs: np.ndarray, prints: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list, list, list]:
    """Packed pairs (first byte, end) of each document."""
    order = np.lexsort((lo, prints, docs))
    docs, prints, pairs = docs[order], prints[order], np.stack([lo[order], hi[order]], 1).astype(np.int32)
    new = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (prints[1:] != prints[:-1]))) if len(docs) else np.empty(0, int)
    return docs[new], prints[new], [x.tobytes() for x in np.split(pairs, new[1:])] if len(docs) else []


def _parse(rows: list[tuple[int, int, bytes]], buckets: int, common: np.ndarray = _NONE) -> pa.RecordBatch:
    """The parse of one gathering: spans settled here, and what is left, dealt to buckets."""
    ids, prints = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    buf = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    doc, start, count, trigger, name = _phrases(buf, np.cumsum([len(r[2]) for r in rows]), common)
    first_byte = np.cumsum([len(r[2]) for r in rows]) - np.array([len(r[2]) for r in rows])
    # The dictionary: phrases in order of name, length and document, the least document first.
    order = np.lexsort((ids[doc], count, name)) if len(doc) else np.empty(0, int)
    doc, start, count, trigger, name = (x[order] for x in (doc, start, count, trigger, name))
    new = np.append(True, (name[1:] != name[:-1]) | (count[1:] != count[:-1]))[: len(doc)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else np.empty(0, int)
    later = np.flatnonzero(ids[doc] > ids[doc[head]]) if len(doc) else np.empty(0, int)
    later = later[_same(buf, start[later], start[head[later]], count[later] + WINDOW - 1)]
    lo = start[later] - first_byte[doc[later]]
    d, p, s = _span_rows(ids[doc[later]], prints[doc[later]], lo, lo + count[later] + WINDOW - 1)
    left = np.ones(len(doc), bool)
    left[later] = False
    doc, start, count, trigger = (x[left] for x in (doc, start, count, trigger))
    bucket = (_mixed(trigger) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, bucket))
    doc, start, count, bucket = (x[order] for x in (doc, start, count, bucket))
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, int)
    blobs = []
    for a, z in zip(cuts, np.append(cuts[1:], len(bucket))[: len(cuts)], strict=True):
        at = slice(a, z)
        blobs.append(_packed(ids[doc[at]], prints[doc[at]], start[at] - first_byte[doc[at]], count[at], buf[_spread(start[at], count[at] + WINDOW - 1)]))
    n, m = len(s), len(blobs)
    to = np.concatenate([(_mixed(p.view(np.uint64) ^ (d.view(np.uint64) * np.uint64(_P))) % np.uint64(buckets)).astype(np.int64) if n else np.empty(0, np.int64), bucket[cuts]])
    return pa.RecordBatch.from_arrays([
        pa.array(to, pa.int32()), pa.array([*d] + [None] * m, pa.int64()), pa.array([*p] + [None] * m, pa.int64()),
        pa.array(s + [None] * m, pa.binary()), pa.array([None] * n + blobs, pa.binary())], schema=_arrow(PARSED))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _eight(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, the first one highest."""
    return np.ndarray(len(buf) - 7, ">u8", buf, strides=(1,))[at].astype(np.uint64)


def _sieved(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places at but for those whose WINDOW bytes surely come once: alone in their slot of a table, a slice of slots at a time."""
    h = np.empty(len(at), np.uint32)
    for i in range(0, len(at), SLICE):
        p = at[i : i + SLICE]
        h[i : i + SLICE] = (_eight(buf, p) * _power(1) ^ _eight(buf, p + (WINDOW // 2 - 4)) * _power(3) ^ _eight(buf, p + (WINDOW - 8)) * _power(5)) >> np.uint64(32)
    bits = (len(at) // SLICE).bit_length()
    slots = SLICE.bit_length() + 1
    kept = np.zeros(len(at), bool)
    for part in range(1 << bits):
        mine = np.flatnonzero(h >> np.uint32(32 - bits) == part) if bits else np.arange(len(at))
        slot = (h[mine] << np.uint32(bits)) >> np.uint32(32 - slots)
        each = np.arange(len(mine), dtype=np.int32)
        last = np.zeros(1 << slots, np.int32)
        last[slot] = each
        shared = np.zeros(1 << slots, bool)
        shared[slot[last[slot] != each]] = True
        kept[mine] = shared[slot]
    return at[kept]


def _ordered(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffix array of a dictionary as far as it matters: of the places at, those whose WINDOW bytes come twice or more,
    in alphabetical order, and the number of each one's class of equal bytes. It comes in ranges of some SLICE places.
    """
    at = _sieved(buf, at)
    if len(at) <= SLICE:
        yield _sorted(buf, at)
        return
    first = _eight(buf, at)
    some = np.sort(first[:: max(1, len(at) // 10_000)])
    n = -(-len(at) // SLICE)
    part = np.searchsorted(some[np.arange(1, n) * len(some) // n], first, side="right").astype(np.int32)
    del first
    for k in range(n):
        yield _sorted(buf, at[part == k])


def _sorted(buf: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by eight bytes, and those still alike by the next few, until WINDOW bytes are compared."""
    group, done = np.zeros(len(order), np.uint64), 0
    while done < WINDOW and len(order):
        # Class and as many bytes as fit beside it in one number, which sorts fast.
        fit = (64 - int(group[-1]).bit_length()) // 8
        done = min(done, WINDOW - fit)
        key = (_eight(buf, order + min(done, WINDOW - 8)) << np.uint64(8 * (done - min(done, WINDOW - 8)))) >> np.uint64(64 - 8 * fit)
        if fit < 8:
            key |= group << np.uint64(8 * fit)
        by = np.argsort(key)
        order, key = order[by], key[by]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(starts, append=len(order))
        twice = np.repeat(sizes > 1, sizes)
        order, group, done = order[twice], np.repeat(np.arange(int((sizes > 1).sum()), dtype=np.uint64), sizes[sizes > 1]), done + fit
    return order, group


def _dictionary(blobs: list[bytes]) -> tuple[pa.BinaryArray, tuple[np.ndarray, ...]]:
    """The distinct phrases of a bucket, and the parse: document, print, place and phrase of each occurrence.

    What is unpacked is looked up some megabytes at a time, and then let go, but for phrases not met before.
    """
    known = pa.array([], pa.binary())
    parts: list[tuple[np.ndarray, ...]] = []
    phrase: list[np.ndarray] = []
    waiting: list[pa.BinaryArray] = []
    size = 0
    for i, blob in enumerate(blobs):
        docs, prints, places, counts, data = _unpacked(blob)
        parts.append((docs.copy(), prints.copy(), places.copy()))
        ends = np.append(0, np.cumsum(counts + (WINDOW - 1))).astype(np.int32)
        waiting.append(pa.BinaryArray.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
        size += len(data)
        if i + 1 == len(blobs) or size > max(BUCKET, known.nbytes):
            coded = pa.chunked_array([known, *waiting]).dictionary_encode().chunks
            phrase.append(np.concatenate([c.indices.to_numpy() for c in coded])[len(known) :])
            known, waiting, size = coded[-1].dictionary, [], 0
    return known, (*(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(phrase))


def _settle(blobs: list[bytes]) -> tuple[list, list, list]:
    """Spans of one bucket: windows that also stand in a smaller document.

    The parse says which phrase of the dictionary stands where. An occurrence of a phrase in a document that is not the
    phrase's least is gone as a whole. In the least document those windows are gone that the dictionary's suffix array
    shows in a phrase whose least document is smaller.
    """
    known, (docs, prints, places, phrase) = _dictionary(blobs)
    starts = np.frombuffer(known.buffers()[1], np.int32, len(known) + 1)
    lens, starts = np.diff(starts), starts[:-1]
    buf = np.frombuffer(known.buffers()[2], np.uint8)[: int(lens.sum())]
    least = np.full(len(lens), LAST)
    np.minimum.at(least, phrase, docs)
    later = docs > least[phrase]
    found = [(docs[later], prints[later], places[later].astype(np.int64), places[later] + lens[phrase[later]])]
    inside = np.ones(len(buf), bool)  # where each suffix of a window or more begins
    for k in range(1, WINDOW):
        inside[starts + (lens - k)] = False
    gone = [np.empty(0, np.int32)]
    for order, group in _ordered(buf, np.flatnonzero(inside).astype(np.int32)):
        if len(order):
            firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            own = least[np.searchsorted(starts, order, side="right") - 1]
            in_class = np.minimum.reduceat(own, firsts)
            gone.append(order[np.repeat(in_class, np.diff(firsts, append=len(order))) < own])
    gone = np.sort(np.concatenate(gone))
    if len(gone):
        # Runs; phrases are WINDOW - 1 places apart.
        new = np.append(True, gone[1:] != gone[:-1] + 1)
        a, z = gone[new], gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
        of = np.searchsorted(starts, a, side="right") - 1
        # Each run of a phrase, in each of the phrase's occurrences in its least document.
        here = np.flatnonzero(~later)
        here = here[np.argsort(phrase[here], kind="stable")]
        lo, hi = (np.searchsorted(phrase[here], of, side=x) for x in ("left", "right"))
        where, run = here[_spread(lo, hi - lo)], np.repeat(np.arange(len(a)), hi - lo)
        found.append((docs[where], prints[where], places[where] + (a - starts[of])[run], places[where] + (z - starts[of])[run] + WINDOW))
    return _span_rows(*(np.concatenate(x) for x in zip(*found, strict=True)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null: LAST), print and text (binary) of each row. print tells rows with equal ids apart, and is 0 if there are none."""
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST)))
    unique = docs.groupBy(doc_id).count().where("count > 1").isEmpty()
    return docs.select(doc_id.alias("doc_id"), (F.lit(0).cast("long") if unique else F.xxhash64(text_col)).alias("print"), F.col(text_col).cast("binary").alias("text"))


def _common(rows: DataFrame, n: int) -> np.ndarray:
    """Triggers that begin COMMON phrases or more in about SAMPLE_DOCS documents.

    They only rank behind others as triggers, lest windows around the commonest words meet in one bucket; results don't
    depend on them. A sample of bounded size has a bounded number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            found = _phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), _NONE)[3]
            names, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64))], names=["trigger", "n"])

    few = rows.where(F.xxhash64("doc_id", F.lit(4)).bitwiseAND(2**31 - 1) < int(min(1.0, SAMPLE_DOCS / max(1, n)) * 2**31))
    counted = few.select("text").mapInArrow(run, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["trigger"] for r in counted.collect()], np.int64).view(np.uint64))


def spans(rows: DataFrame) -> DataFrame:
    """doc_id, print and pairs of bytes to remove, packed, in several rows for each of keyed()."""
    size, n = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    buckets = max(64, (size or 0) // BUCKET)
    common = _common(rows, n)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i, p, t in _each(b):
                held.append((i, p, t or b""))
                n += len(held[-1][2])
                if n >= GATHER:
                    yield _parse(held, buckets, common)
                    held, n = [], 0
        if held:
            yield _parse(held, buckets, common)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for b in batches:
            for k, d, p, s, x in _each(b):
                if s is not None:
                    yield pa.RecordBatch.from_pylist([{"doc_id": d, "print": p, "spans": s}], schema=_arrow(SPANS))
                    continue
                if k != bucket and blobs:
                    yield _rows(_settle(blobs))
                    blobs = []
                bucket = k
                blobs.append(x)
        if blobs:
            yield _rows(_settle(blobs))

    parsed = rows.mapInArrow(parse, PARSED).repartition("bucket").sortWithinPartitions("bucket")
    return parsed.mapInArrow(settle, SPANS)


def _rows(found: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], schema=_arrow(SPANS))


def union(packed: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in packed pairs."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(map(tuple, np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, packed (its whole text, see whole()) and spans (packed pairs of bytes to remove, see union()) of each row."""
    rows = keyed(docs, id_col, text_col)
    per = spans(rows).groupBy("doc_id", "print").agg(F.collect_list("spans").alias("spans"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts cross the network compressed."""
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t or b"") for _, _, t in _each(b)], pa.binary())], names=["doc_id", "print", "packed"])

    packed = rows.mapInArrow(squeeze, "doc_id long, print long, packed binary")
    joined = packed.join(per, ["doc_id", "print"], "left")
    return joined.select(F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).alias("doc_id"), "packed", "spans")


def whole(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def digests(joined: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of without_repeats()."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t, packed in zip(*b.columns, strict=True):
                t, runs, at, kept = whole(t.as_py()), union(packed.as_py() or []), 0, hashlib.sha256()
                view = memoryview(t)
                for lo, hi in runs:
                    kept.update(view[at:lo])
                    at = hi
                kept.update(view[at:])
                out.append((d.as_py(), len(t), sum(z - a for a, z in runs), len(runs), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(5)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
