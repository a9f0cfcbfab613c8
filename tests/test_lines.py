"""Alignment: the exact matcher against difflib, pieces of long files against the whole, ranges that meet, and time."""

import random
import time
from difflib import SequenceMatcher

import pytest

from driftlens.operators import classify, linediff


def made(rnd, letters, n):
    a = [rnd.choice(letters) for _ in range(rnd.randint(0, n))]
    if rnd.random() < 0.4:
        return a, [rnd.choice(letters) for _ in range(rnd.randint(0, n))]
    b = list(a)
    for _ in range(rnd.randint(0, 6)):
        i = rnd.randrange(len(b) + 1)
        b[i : i + rnd.randint(0, 3)] = [rnd.choice(letters) for _ in range(rnd.randint(0, 3))]
    return a, b


def test_exact_blocks_are_those_of_difflib():
    rnd = random.Random(20260807)
    for _ in range(400):
        a, b = made(rnd, rnd.choice(["ab", "abc}", "abcdefghij"]), 60)
        x, y = linediff.numbered(a, b)
        ours = sorted(linediff.exact(x, y, (0, len(x), 0, len(y))))
        theirs = [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        joined = []
        for i, j, n in ours:
            if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
                joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
            else:
                joined.append((i, j, n))
        assert joined == theirs


def test_many_lines_without_a_unique_one_are_quick():
    rnd = random.Random(4)
    a, b = ([rnd.choice("abcdefgh") for _ in range(24_000)] for _ in range(2))
    began = time.perf_counter()
    found = linediff.changed(a, b)
    assert found and time.perf_counter() - began < 10


def test_many_edits_are_labelled_quickly():
    a = [f"line {k}" for k in range(12_000)]
    b = [f"other {k}" if k % 2 else x for k, x in enumerate(a)]
    began = time.perf_counter()
    texts = "\n".join(a), "\n".join(b)
    _, hunks, _ = classify.classify("plain", *texts, *texts, [])
    assert len(hunks) == 6000 and time.perf_counter() - began < 2


def test_a_sweep_finds_the_first_range_that_is_met():
    rnd = random.Random(8)
    for _ in range(300):
        cuts = sorted(rnd.randrange(30) for _ in range(2 * rnd.randint(0, 6)))
        ranges = [(cuts[k], cuts[k + 1], 0, 0) for k in range(0, len(cuts), 2)]
        h = (lo := rnd.randrange(30), lo + rnd.randint(0, 5), 0, 0)
        met = [o for o in ranges if classify.touches(*h[:2], *o[:2])]
        assert classify.Sweep(ranges, 0).first(h) == (met[0] if met else None)


def frames(spark, files, side):
    return spark.createDataFrame([(rel, k, x) for rel, *sides in files for k, x in enumerate(sides[side])], "rel string, no int, line string").repartition(4)


@pytest.mark.parametrize("piece", [2, 7])
def test_pieces_of_long_files_align_like_the_whole(spark, piece):
    rnd = random.Random(piece)
    files = [(f"f{k}", *made(rnd, rnd.choice(["ab", "abc}", [f"u{n}" for n in range(200)], [f"v{n}" for n in range(40)]]), 60)) for k in range(120)]
    files += [("only_old", ["a", "b"], []), ("only_new", [], ["a"]), ("same", ["a", "b"], ["a", "b"])]
    got = linediff.long_changed(frames(spark, files, 0), frames(spark, files, 1), piece).collect()
    for rel, a, b in files:
        assert sorted(tuple(r[1:]) for r in got if r["rel"] == rel) == linediff.changed(a, b), (rel, a, b)


def test_pieces_of_no_lines(spark):
    none = frames(spark, [], 0)
    assert linediff.long_changed(none, none).isEmpty()


def test_ranges_meet_once(spark):
    rnd = random.Random(6)

    def some(n):
        out = []
        for k in range(n):
            i, j = rnd.randrange(60), rnd.randrange(60)
            out.append((f"f{k % 3}", i, i + rnd.choice([0, 0, 1, 9, 30]), j, j + rnd.choice([0, 1, 20]), k))
        return out

    a, b = some(80), some(80)
    met = lambda x, y, s: classify.touches(x[s], x[s + 1], y[s], y[s + 1])
    want = sorted((x[5], y[5]) for x in a for y in b if x[0] == y[0] and (met(x, y, 1) or met(x, y, 3)))
    frame = lambda rows: spark.createDataFrame(rows, "rel string, i1 int, i2 int, j1 int, j2 int, id int")
    assert sorted(tuple(r) for r in linediff.meeting(frame(a), frame(b), 8).select("a.id", "b.id").collect()) == want
