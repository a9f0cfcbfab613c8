"""Line alignment of two texts: anchors of lines unique on both sides, exact matching in the gaps."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.sources.stored import checkpointed, written

#: Segments nested deeper than this are matched exactly: part of what an alignment is, not a limit on work.
DEEPEST = 100
RANGES = "array<struct<i1:int,i2:int,j1:int,j2:int>>"


def numbered(*sides: list[str]) -> list[list[int]]:
    """The lines of all sides as numbers, equal for equal lines."""
    known: dict[str, int] = {}
    return [[known.setdefault(x, len(known)) for x in side] for side in sides]


def unique_pairs(a: list[int], b: list[int], seg: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """(i, j) of lines that occur once in either side's segment, in order of i."""
    a0, a1, b0, b1 = seg
    ours, theirs = a[a0:a1], b[b0:b1]
    counts, where = Counter(ours), dict(zip(theirs, range(b0, b1), strict=True))
    once = {x for x, n in Counter(theirs).items() if n == 1 and counts.get(x) == 1}
    return [(i, where[x]) for i, x in enumerate(ours, a0) if x in once]


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, which come in order of their first, whose second ascends too."""
    if all(p[1] < q[1] for p, q in pairwise(pairs)):
        return pairs
    ends: list[int] = []  # least last j of a run of each length
    lengths: list[int] = []
    for _, j in pairs:
        k = bisect_left(ends, j)
        ends[k : k + 1] = [j]
        lengths.append(k)
    out, want, below = [], len(ends) - 1, max(ends, default=0) + 1
    for p, k in zip(reversed(pairs), reversed(lengths), strict=True):
        if k == want and p[1] < below:
            out.append(p)
            want, below = k - 1, p[1]
    return out[::-1]


def longest_run(a: list[int], b: list[int], seg: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """(i, j, n) of the longest run of lines that both sides' segments have: the first in a, and its first place in b.

    The segment of b becomes a suffix automaton, which a's lines then walk through, so that time grows with the sum of both.
    """
    a0, a1, b0, b1 = seg
    steps: list[dict[int, int]] = [{}]
    size, link, ends = [0], [-1], [-1]  # of each state: its longest string, its longest suffix elsewhere, its first end
    last = 0
    for j in range(b0, b1):
        x, new, at = b[j], len(size), last
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        ends.append(j)
        while at >= 0 and x not in steps[at]:
            steps[at][x] = new
            at = link[at]
        if at >= 0:
            to = steps[at][x]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(size)
                steps.append(dict(steps[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                ends.append(ends[to])
                link[to] = link[new] = copy
                while at >= 0 and steps[at].get(x) == to:
                    steps[at][x] = copy
                    at = link[at]
        last = new
    best, at, n = (a0, b0, 0), 0, 0
    for i in range(a0, a1):
        x = a[i]
        while at and x not in steps[at]:
            at = link[at]
            n = size[at]
        if x in steps[at]:
            at, n = steps[at][x], n + 1
            if n > best[2]:
                best = (i - n + 1, ends[at] - n + 1, n)
    return best


def exact(a: list[int], b: list[int], seg: tuple[int, int, int, int]) -> list[tuple[int, int, int]]:
    """Blocks of the longest common run and, on either side of it, of what is left."""
    found, todo = [], [seg]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1 or b1 - b0 == 1:
            i, j, n = _only(a, b, (a0, a1, b0, b1))
        else:
            i, j, n = longest_run(a, b, (a0, a1, b0, b1))
        if n:
            found.append((i, j, n))
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return found


def _only(a: list[int], b: list[int], seg: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """longest_run() where one side has one line."""
    a0, a1, b0, b1 = seg
    one, rows, lo, hi = (a[a0], b, b0, b1) if a1 - a0 == 1 else (b[b0], a, a0, a1)
    try:
        k = rows.index(one, lo, hi)
    except ValueError:
        return a0, b0, 0
    return (a0, k, 1) if rows is b else (k, b0, 1)


def between(a: list[int], b: list[int], seg: tuple[int, int, int, int], depth: int = 0, anchors: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Blocks (i, j, n) of equal lines of a segment, in any order; of a given outermost segment the lines that are unique on both sides are known."""
    found, todo = [], [(seg, depth)]
    while todo:
        (a0, a1, b0, b1), depth = todo.pop()
        if anchors is None:
            head = a0
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                a0, b0 = a0 + 1, b0 + 1
            if a0 > head:
                found.append((head, b0 - a0 + head, a0 - head))
            tail = a1
            while a1 > a0 and b1 > b0 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
            if a1 < tail:
                found.append((a1, b1, tail - a1))
            if a0 == a1 or b0 == b1:
                continue
            if a1 - a0 == 1 or b1 - b0 == 1:
                if (one := _only(a, b, (a0, a1, b0, b1)))[2]:
                    found += [one, *exact(a, b, (a0, one[0], b0, one[1])), *exact(a, b, (one[0] + 1, a1, one[1] + 1, b1))]
                continue
        pairs = anchors
        if pairs is None:
            pairs = []
            if depth < DEEPEST:
                pairs = unique_pairs(a, b, (a0, a1, b0, b1))
        anchors = None
        if not pairs:
            found += exact(a, b, (a0, a1, b0, b1))
            continue
        i, j = a0, b0
        run: tuple[int, int, int] | None = None
        for p, q in [*ascending(pairs), (a1, b1)]:
            if i < p and j < q and (p - i > 1 or q - j > 1 or a[i] == b[j]):
                todo.append(((i, p, j, q), depth + 1))
            if run and (p, q) == (i, j) and p < a1:
                run = (run[0], run[1], run[2] + 1)
            else:
                found += [run] if run else []
                run = (p, q, 1) if p < a1 else None
            i, j = p + 1, q + 1
        found += [run] if run else []
    return found


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Blocks (i, j, n) of equal lines, in order."""
    x, y = numbered(a, b)
    return sorted(between(x, y, (0, len(x), 0, len(y))))


def changed(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Half-open ranges (i1, i2, j1, j2) that lie between the matching blocks."""
    blocks = [(0, 0, 0), *matching(a, b), (len(a), len(b), 0)]
    gaps = [(i + n, k, j + n, m) for (i, j, n), (k, m, _) in zip(blocks, blocks[1:], strict=False)]
    return [g for g in gaps if g[0] < g[1] or g[2] < g[3]]


def hunks(pairs: DataFrame, old: str = "old_text", new: str = "new_text", out: str = "ranges") -> DataFrame:
    """pairs with their changed ranges."""

    @F.pandas_udf(RANGES)
    def ranges(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("i1", "i2", "j1", "j2"), h, strict=True)) for h in changed(x.split("\n"), y.split("\n"))] for x, y in zip(a, b, strict=True)])

    return pairs.withColumn(out, ranges(F.col(old), F.col(new)))


def unique_line_anchors(pairs: DataFrame) -> DataFrame:
    """(rel, old_no, new_no) of lines that occur once on each side of a pair (rel, old_text, new_text)."""

    def side(col: str, no: str) -> DataFrame:
        rows = pairs.select("rel", F.posexplode(F.split(col, "\n", -1)).alias(no, "line"))
        return rows.groupBy("rel", F.col("line")).agg(F.count("*").alias("n"), F.min(no).alias(no)).where("n = 1").drop("n")

    return side("old_text", "old_no").join(side("new_text", "new_no"), ["rel", "line"]).select("rel", "old_no", "new_no")


def touches(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether ranges meet; an empty range meets what it touches."""
    return ((a1 < b2) & (b1 < a2)) | ((a1 == a2) & a1.between(b1, b2)) | ((b1 == b2) & b1.between(a1, a2))


#: Lines of a bucket, by which ranges meet.
BUCKET = 256


def meeting(left: DataFrame, right: DataFrame, width: int = BUCKET) -> DataFrame:
    """Pairs (a, b, structs) of ranges (rel, i1, i2, j1, j2, ...) of one file that meet on either side.

    A range goes to each bucket of lines that it touches, on both sides; ranges meet in the first bucket that they share.
    """

    def dealt(ranges: DataFrame, name: str) -> DataFrame:
        ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}1").alias("lo"), F.col(f"{s}2").alias("hi")) for s in "ij"])
        rows = ranges.select("rel", F.struct(*ranges.columns).alias(name), F.explode(ends).alias("e"))
        first, last = (F.floor(F.col(f"e.{x}") / width) for x in ("lo", "hi"))
        return rows.select("rel", "e.side", name, first.alias(f"first_{name}"), F.explode(F.sequence(first, last)).alias("bucket"))

    on = {s: touches(*[F.col(f"{x}.{s}{n}") for x in "ab" for n in (1, 2)]) for s in "ij"}
    met = dealt(left, "a").join(dealt(right, "b"), ["rel", "side", "bucket"]).where(F.col("bucket") == F.greatest("first_a", "first_b"))
    return met.where(F.when(F.col("side") == "i", on["i"]).otherwise(on["j"] & ~on["i"])).select("a", "b")


#: Lines between the places where a long file is cut, at least on average.
PIECE = 50_000


def long_changed(old: DataFrame, new: DataFrame, piece: int = PIECE) -> DataFrame:
    """rel and changed ranges (i1, i2, j1, j2) of files given by line (rel, no from 0, line): those of changed(), by many tasks a file.

    An anchor, a line unique on both sides, that comes after all anchors before it and before all after it on both sides
    is part of every alignment, so files are cut there, about once in piece lines. Lines of a piece meet as digests, and
    each piece is aligned by itself with the anchors that the whole file gives it. Without such anchors, a file is one piece.
    """
    sides = {s: written(t.select("rel", F.col("no").cast("int").alias(s), F.unhex(F.md5("line")).alias("key")), "lines") for s, t in (("i", old), ("j", new))}
    a, b = sides["i"], sides["j"]
    sizes = a.groupBy("rel").agg(F.count("*").cast("int").alias("n")).join(b.groupBy("rel").agg(F.count("*").cast("int").alias("m")), "rel", "full_outer").na.fill(0)
    least = F.least("n", "m")

    def equal_from(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        return x.withColumnRenamed("key", "other").join(y, ["rel", "at"]).where("key <> other").groupBy("rel").agg(F.min("at").alias(name))

    first = equal_from(a.withColumnRenamed("i", "at"), b.withColumnRenamed("j", "at"), "head")
    back = [t.join(sizes, "rel").select("rel", (F.col(n) - 1 - F.col(s)).alias("at"), "key") for s, n, t in (("i", "n", a), ("j", "m", b))]
    known = sizes.join(first, "rel", "left").join(equal_from(*back, "tail"), "rel", "left").withColumn("head", F.coalesce("head", least)).withColumn("tail", F.least(F.coalesce("tail", least), least - F.col("head")))
    known = checkpointed(known)
    inner = {s: t.join(known, "rel").where((F.col(s) >= F.col("head")) & (F.col(s) < F.col(n) - F.col("tail"))).select("rel", s, "key") for s, n, t in (("i", "n", a), ("j", "m", b))}
    once = [t.groupBy("rel", "key").agg(F.min(s).alias(s), F.count("*").alias("c")).where("c = 1").drop("c") for s, t in inner.items()]
    anchors = written(once[0].join(once[1], ["rel", "key"]).select("rel", "i", "j"), "anchors")
    order = Window.partitionBy("rel").orderBy("i")
    before, after = F.max("j").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.min("j").over(Window.partitionBy("rel").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1))
    clear = anchors.select("rel", "i", "j", before.alias("before"), after.alias("after")).where("(before is null or before < j) and (after is null or after > j)")
    cuts = checkpointed(clear.groupBy("rel", F.floor(F.col("i") / piece).alias("part")).agg(F.min_by(F.struct("i", "j"), "i").alias("cut")).select("rel", "cut.i", "cut.j"))
    ends = cuts.unionByName(known.select("rel", (F.col("n") - F.col("tail")).alias("i"), (F.col("m") - F.col("tail")).alias("j")))
    last = [F.lag(c, 1).over(Window.partitionBy("rel").orderBy("i", "j")) for c in "ij"]
    found = anchors.select("rel").distinct().withColumn("anchored", F.lit(True))
    parts = ends.select("rel", "i", "j", *[x.alias(f"last_{c}") for c, x in zip("ij", last, strict=True)]).join(known.select("rel", "head"), "rel").join(found, "rel", "left")
    lows = [F.coalesce(F.col(f"last_{c}") + 1, F.col("head")) for c in "ij"]
    parts = checkpointed(parts.select("rel", *[x.alias(f"{c}1") for c, x in zip("ij", lows, strict=True)], F.col("i").alias("i2"), F.col("j").alias("j2"), F.coalesce("anchored", F.lit(False)).alias("anchored")).where("i1 < i2 and j1 < j2"))

    def within(rows: DataFrame, s: str, *more: Column) -> DataFrame:
        """Rows that lie in a part of side s."""
        lo, hi = F.col(f"{s}1"), F.col(f"{s}2")
        spread = parts.select("rel", "i1", "i2", "j1", "j2", "anchored", F.explode(F.sequence(F.floor(lo / piece), F.floor((hi - 1) / piece))).alias("bucket"))
        return rows.withColumn("bucket", F.floor(F.col(s) / piece)).join(spread, ["rel", "bucket"]).where((F.col(s) >= lo) & (F.col(s) < hi)).select("rel", "i1", "i2", "j1", "j2", "anchored", F.struct(*more).alias("x"))

    none = F.lit(None)
    line = lambda s: (F.lit(s).alias("side"), F.col(s).alias("at"), F.col("key"), none.cast("int").alias("other"))
    rows = within(inner["i"], "i", *line("i")).unionByName(within(inner["j"], "j", *line("j"))).unionByName(within(anchors, "i", F.lit("anchor").alias("side"), F.col("i").alias("at"), none.cast("binary").alias("key"), F.col("j").alias("other")))
    work = rows.groupBy("rel", "i1", "i2", "j1", "j2", "anchored").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel, i1, _, j1, _, anchored, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ours, theirs = numbered(*([r["key"] for r in x if r["side"] == s] for s in "ij"))
                pairs = [(r["at"] - i1, r["other"] - j1) for r in x if r["side"] == "anchor"]
                seg = (0, len(ours), 0, len(theirs))
                out = sorted(between(ours, theirs, seg, 0, pairs) if pairs or not anchored else between(ours, theirs, seg, 1))
                yield pa.RecordBatch.from_arrays([pa.array([rel] * len(out), pa.string()), *(pa.array([y[k] + more for y in out], pa.int32()) for k, more in enumerate((i1, j1, 0)))], names=["rel", "i", "j", "n"])

    blocks = work.mapInArrow(run, "rel string, i int, j int, n int").unionByName(cuts.withColumn("n", F.lit(1)))
    blocks = blocks.unionByName(known.where("head > 0").select("rel", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("head").alias("n")))
    blocks = blocks.unionByName(known.where("tail > 0").select("rel", (F.col("n") - F.col("tail")).alias("i"), (F.col("m") - F.col("tail")).alias("j"), F.col("tail").alias("n")))
    blocks = blocks.unionByName(known.select("rel", F.col("n").alias("i"), F.col("m").alias("j"), F.lit(0).alias("n")))
    gap = Window.partitionBy("rel").orderBy("i", "j", F.col("n").desc())
    ranges = blocks.select("rel", F.coalesce(F.lag(F.col("i") + F.col("n")).over(gap), F.lit(0)).alias("i1"), F.col("i").alias("i2"), F.coalesce(F.lag(F.col("j") + F.col("n")).over(gap), F.lit(0)).alias("j1"), F.col("j").alias("j2"))
    return ranges.where("i1 < i2 or j1 < j2")
