"""Hard negatives by Four-Russians scoring of whole numbers.

Vectors become whole numbers. A candidate's are cut into bit planes, of which eight dimensions are a byte. For an anchor
and each group of eight dimensions, the sums of all 256 subsets of its components are tabulated. A plane's share of the
inner product is then the sum of one lookup a group, and the planes add up by shifts: the score is exact, without a product.

Anchors are dealt to blocks and candidates to parts; each pair of a block and a part is one task's bounded group, in
which the anchors' tables are made. The first pass scores rows of the anchors' own labels for positives, the second all
others for negatives. Each group gives its best rows only, which meet by anchor.

Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Missing dimensions of a
shorter vector count as zero, and an empty vector scores zero with all. Components beyond 64 bits are the largest whole
number of 64; scores are exact where they fit in 64 bits, and wrap beyond. Rows that share a vec_id are rows of their own:
each is an anchor, a positive or a negative by itself, and an anchor is not its own positive. Ties go to the smaller
vec_id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import written

#: Anchors of a block; candidates of a part, at most on average, and at least if there are partitions for more.
BLOCK, PART, LEAST_PART = 1024, 1 << 17, 2048
#: Anchors and candidates that are scored at once.
TILE, ROWS = 64, 4096
WIDTH = 8


def vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """uid, vec_id, label and q, the whole components, of the rows that take part. Labels of every seventh vec_id are one further."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    fit = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & ~odd)
    return fit.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("q"))


def bit_planes(q: np.ndarray) -> np.ndarray:
    """Bytes [plane, group, row] of whole numbers [row, dimension] in two's complement; the last plane is the sign's."""
    width = max(int(np.abs(np.where(q < 0, ~q, q)).max(initial=0)).bit_length(), 1) + 1
    return np.stack([np.ascontiguousarray(np.packbits((q >> min(k, 63)).astype(np.uint8) & 1, axis=1, bitorder="little").T) for k in range(width)])


def subset_sums(a: np.ndarray, kind: type) -> np.ndarray:
    """Sums [group, byte, anchor] of the components of anchors [anchor, dimension] that a byte's bits choose."""
    groups = -(-a.shape[1] // WIDTH)
    out = np.zeros((groups, 1 << WIDTH, len(a)), kind)
    for d in range(a.shape[1]):
        bit = 1 << d % WIDTH
        out[d // WIDTH, bit : 2 * bit] = out[d // WIDTH, :bit] + a[:, d].astype(kind)
    return out


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor]: lookups added by plane, planes added by shifts from the sign's down."""
    total = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    found = np.empty_like(total)
    for k in range(len(planes) - 1, -1, -1):
        if k < len(planes) - 1:
            np.left_shift(total, 1, out=total)
        for g in range(len(sums)):
            np.take(sums[g], planes[k, g], axis=0, out=found, mode="clip")
            (np.subtract if k == len(planes) - 1 else np.add)(total, found, out=total)
    return total


def best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, in order; ties by place."""
    if len(s) > 4 * k:
        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        return near[np.argsort(-s[near], kind="stable")[:k]]
    return np.argsort(-s, kind="stable")[:k]


def _matrix(lists: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    out = np.zeros((len(lists), dimensions), np.int64)
    flat = lists.combine_chunks()
    lengths = np.array([len(x) for x in flat], np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(values):
        out[np.repeat(np.arange(len(lists)), lengths), np.concatenate([np.arange(n) for n in lengths])] = values
    return out


def _tiles(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First anchor, first candidate, and scores [anchor, candidate] of each tile; candidates come in order for each anchor."""
    planes = [bit_planes(candidates[n : n + ROWS]) for n in range(0, len(candidates), ROWS)]
    most = float(np.abs(anchors.astype(float)).sum(axis=1).max(initial=0)) * 2.0 ** max((len(p) for p in planes), default=0)
    for m in range(0, len(anchors), TILE):
        sums = subset_sums(anchors[m : m + TILE], np.int32 if most < 2**31 else np.int64)
        for n, p in enumerate(planes):
            yield m, n * ROWS, np.ascontiguousarray(scores(sums, p).T)


def _in_blocks(anchors: DataFrame, candidates: DataFrame, run, schema: str, block: int, part: int) -> DataFrame:
    """run(anchors, candidates), Arrow tables sorted by vec_id, over all pairs of a block and a part."""
    n, m = candidates.count(), anchors.count()
    blocks = max(1, math.ceil(m / block))
    room = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks
    parts = max(1, math.ceil(n / part), min(room, math.ceil(n / LEAST_PART)))
    deal = lambda rows, own, n, other, k: rows.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    left, right = (deal(anchors, "block", blocks, "part", parts), deal(candidates, "part", parts, "block", blocks))
    left, right = (x.repartition(blocks * parts, "block", "part").groupBy("block", "part") for x in (left, right))

    def both(a: pa.Table, c: pa.Table) -> pa.Table:
        return run(a, c.sort_by("vec_id"))

    return left.cogroup(right).applyInArrow(both, schema)


POSITIVE = "uid long, anchor_id long, positive_id long, positive_score long"
NEGATIVE = "uid long, rank_of_positive int, negative_id long, negative_score long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    columns = [x.split(" ") for x in schema.split(", ")]
    return pa.table([pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(columns), columns, strict=True)], names=[c for c, _ in columns])


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _dimensions(*tables: pa.Table) -> int:
    return max([1, *(len(x) for t in tables for c in t.column("q").chunks for x in c)])


def positives(anchors: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, part: int = PART) -> DataFrame:
    """POSITIVE and rank_of_positive: each anchor's k best other rows of its label."""

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        wide, out = _dimensions(a, c), []
        a_uid, a_id, a_label = _columns(a, "uid", "vec_id", "label")
        c_uid, c_id, c_label = _columns(c, "uid", "vec_id", "label")
        a_q, c_q = _matrix(a.column("q"), wide), _matrix(c.column("q"), wide)
        for label in np.intersect1d(a_label, c_label):
            ours, theirs = np.flatnonzero(a_label == label), np.flatnonzero(c_label == label)
            for m, n, s in _tiles(a_q[ours], c_q[theirs]):
                for row, i in zip(s, ours[m : m + TILE], strict=True):
                    found = [(int(row[j]), x) for j in best(row, k + 1) if c_uid[x := theirs[n + j]] != a_uid[i]][:k]
                    out += [(a_uid[i], a_id[i], c_id[x], v) for v, x in found]
        return _table(POSITIVE, out)

    found = _in_blocks(anchors, candidates, run, POSITIVE, block, part)
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("positive_score").desc(), "positive_id"))
    return found.withColumn("rank_of_positive", place).where(F.col("rank_of_positive") <= k)


def negatives(anchors: DataFrame, candidates: DataFrame, k: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, part: int = PART) -> DataFrame:
    """NEGATIVE and rank: for each anchor and each of its positives (their scores in order: anchors.wanted), the k best rows of other
    labels whose score is low to high percent of the positive's."""

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        wide = _dimensions(a, c)
        a_uid, a_label = _columns(a, "uid", "label")
        c_id, c_label = _columns(c, "vec_id", "label")
        wanted = a.column("wanted").to_pylist()
        ranges = [[(-(-low * w // 100), high * w // 100) for w in ws] for ws in wanted]
        kept: list[list[list]] = [[[] for _ in ws] for ws in wanted]  # (score, place), best first
        for m, n, s in _tiles(_matrix(a.column("q"), wide), _matrix(c.column("q"), wide)):
            for row, i in zip(s, range(m, m + TILE), strict=False):
                # With k rows kept, a later place needs a higher score.
                bounds = [(max(lo, h[-1][0] + 1) if len(h) == k else lo, hi) for (lo, hi), h in zip(ranges[i], kept[i], strict=True)]
                bounds = [(lo, hi) if lo <= hi else None for lo, hi in bounds]
                if not any(bounds):
                    continue
                least, most = min(b[0] for b in bounds if b), max(b[1] for b in bounds if b)
                near = np.flatnonzero((row >= least) & (row <= most) & (c_label[n : n + len(row)] != a_label[i])) if least < 2**63 and most >= -(2**63) else np.array([], int)
                v = row[near].astype(np.int64)
                for h, b in zip(kept[i], bounds, strict=True):
                    if b and len(near):
                        fit = near[(v >= b[0]) & (v <= b[1])]
                        h += [(int(row[j]), n + int(j)) for j in fit[best(row[fit].astype(np.int64), k)]]
                        h.sort(key=lambda x: (-x[0], x[1]))
                        del h[k:]
        return _table(NEGATIVE, [(a_uid[i], r, c_id[j], v) for i, hs in enumerate(kept) for r, h in enumerate(hs, 1) for v, j in h])

    found = _in_blocks(anchors, candidates, run, NEGATIVE, block, part)
    place = F.row_number().over(Window.partitionBy("uid", "rank_of_positive").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, part: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose vec_id every divides."""
    known = written(vectors(rows), "vectors")
    anchors = known.where(F.col("vec_id") % every == 0)
    found = written(positives(anchors, known, n_positives, block, part), "positives")
    wanted = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank_of_positive", "positive_score"))).alias("all")).select("uid", F.col("all.positive_score").alias("wanted"))
    hard = negatives(written(anchors.join(wanted, "uid"), "anchors"), known, n_negatives, low, high, block, part)
    return hard.join(found, ["uid", "rank_of_positive"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
