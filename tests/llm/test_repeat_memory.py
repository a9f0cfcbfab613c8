"""What parsing a gathering and settling a bucket hold at once, and the same spans from small slices."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

from driftlens.llm import repeats

rnd = random.Random(4)
WORDS = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
PASSAGES = [" ".join(rnd.choices(WORDS, k=40)) for _ in range(20)]

POOLS = []  # what they gave may outlive a test


def document(n):
    """About n bytes, a third of them passages of other documents."""
    parts = []
    while (n := n - len(parts[-1]) if parts else n) > 0:
        parts.append(rnd.choice(PASSAGES) if rnd.random() < 0.1 else " ".join(rnd.choices(WORDS, k=20)) + " ")
    return "".join(parts).encode()


def peak(f):
    """f's result, and MB of NumPy's, Python's and Arrow's memory at most while it ran."""
    before = pa.default_memory_pool()
    POOLS.append(pool := pa.proxy_memory_pool(before))
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        out = f()
        return out, (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 1e6
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)


def spans(rows, buckets=3, gathering=5):
    """Of (id, text) rows, through gatherings and buckets as spans() deals them."""
    found, blobs = {}, {}
    for k in range(0, len(rows), gathering):
        for bucket, d, _, s, x in zip(*(c.to_pylist() for c in repeats._parse([(i, 0, t) for i, t in rows[k : k + gathering]], buckets).columns), strict=True):
            (blobs.setdefault(bucket, []) if s is None else found.setdefault(d, [])).append(x if s is None else s)
    for x in blobs.values():
        for d, _, s in zip(*repeats._settle(x), strict=True):
            found.setdefault(int(d), []).append(s)
    return {d: repeats.union(x) for d, x in found.items()}


def brute_spans(rows):
    out = {}
    for i, (n, removed, runs, sha) in brute.op4([(i, t.decode()) for i, t in rows]).items():
        out[i] = (removed, runs, sha)
    return out


def told(rows, found):
    out = {}
    for i, t in rows:
        keep = np.ones(len(t), bool)
        for a, z in found.get(i, []):
            keep[a:z] = False
        out[i] = (int((~keep).sum()), len(found.get(i, [])), brute.sha(bytes(np.frombuffer(t, np.uint8)[keep])))
    return out


def test_a_gathering_is_parsed_in_little_memory():
    rows = [(i, 0, document(4000)) for i in range(repeats.GATHER // 4000)]
    _, mb = peak(lambda: repeats._parse(rows, 64))
    assert mb < 25 * repeats.GATHER / 2**20


def test_a_bucket_is_settled_in_little_memory():
    rows = [(i, document(4000)) for i in range(repeats.BUCKET // 4000)]
    batch = repeats._parse([(i, 0, t) for i, t in rows], 1)
    blobs = [x for x in batch.column(4).to_pylist() if x]
    _, mb = peak(lambda: repeats._settle(blobs))
    assert mb < 60 * repeats.BUCKET / 2**20


def test_one_trigger_in_every_document():
    """A bucket of several times the usual size takes memory for its phrases, and for its sorting no more than others."""
    middle = b"#" + rnd.randbytes(9).hex().encode()[:9]
    rows = [(i, rnd.randbytes(20).hex().encode() + middle + rnd.randbytes(20).hex().encode()) for i in range(60_000)]
    blobs = [repeats._packed(np.array([i for i, _ in rows]), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int32), np.full(len(rows), 41), np.frombuffer(b"".join(t for _, t in rows), np.uint8))]
    found, mb = peak(lambda: repeats._settle(blobs))
    assert found[2] == [] and mb < 120


@pytest.mark.parametrize("small", [16, 300])
def test_small_slices_give_the_same_spans(monkeypatch, small):
    rows = [(i, document(rnd.choice([0, 30, 49, 50, 51, 600, 3000]))) for i in rnd.sample(range(100), 40)]
    monkeypatch.setattr(repeats, "SLICE", small)
    monkeypatch.setattr(repeats, "BUCKET", 1000)
    assert told(rows, spans(rows)) == brute_spans(rows)


@pytest.mark.parametrize("block", [1, 7, 50, 1000])
def test_phrases_are_the_same_in_blocks_of_any_size(block):
    texts = [document(n) for n in (0, 200, 49, 50, 0, 51, 900, 3, 120, 0)] + [b"a" * 200, b""]
    buf, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for got, want in zip(repeats._phrases(buf, ends, repeats._NONE, block), repeats._phrases(buf, ends, repeats._NONE), strict=True):
        assert got.tolist() == want.tolist()
    # Each window of each document lies in one phrase.
    doc, start, count, _, _ = repeats._phrases(buf, ends, repeats._NONE, block)
    windows = [(d, s + k) for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True) for k in range(n)]
    assert sorted(windows) == [(d, int(e) - len(t) + k) for d, (t, e) in enumerate(zip(texts, ends, strict=True)) for k in range(len(t) - 49)]
