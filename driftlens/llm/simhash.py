"""SimHash near-duplicates by segment-popcount embedding, grid range-join and exact verification.

A fingerprint is cut into segments of SEGMENT bits, and each is mapped to its bit count: a point whose Manhattan distance
from another never exceeds the Hamming distance of their fingerprints. The coordinates are dealt to HALVES parts. At
distance d or less some part is at Manhattan distance d // HALVES or less, so each part is a grid of its own, on which
every point has its home cell and ranges over the cells within that distance; a link meets where a point in range finds
one at home. What meets is sifted by the Manhattan distance of the whole points and verified on the 64 bits.

Two points at odd distance differ in the parity of their sums, so at distance 1 only those of even sum range over other
cells. Copies cost nothing here: cells hold distinct fingerprints. A cell gives a spanning forest of its links, not its
pairs. Cells beyond `block` members are cut into blocks, and pairs of blocks are tasks of their own, so no group grows
without bound and no link is lost. Components come from alternating large-star and small-star steps over a table of edges.

Null texts count as empty: fingerprint zero, linked like any other. Rows are kept apart even if ids repeat; a null id
keeps its fingerprint, never names a component, and has a null component only if its whole component has null ids.
Very long texts are hashed whole. Extra columns are ignored or, where rows are kept, kept; none can clash with those made
here. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import checkpointed, small

SEED = 42
BITS, SEGMENT, HALVES = 64, 2, 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; a bit is set if over half the hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space alone
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest, seed, n, total = xxhash.xxh64_intdigest, SEED, 0, np.zeros(BITS, np.int64)
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    for part in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[part : part + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row; if keyed, its text_key as key before fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*b.schema.names[:-1], "fp"])

    text = F.col(text_col).cast("string")
    key = [text_key(text).alias("key")] if keyed else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, text.alias("text")).mapInArrow(run, "doc_id long, key long, fp long" if keyed else "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def segment_counts(fp: Column) -> Column:
    """Bit counts of all 2-bit segments at once, packed into the same places."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # 0, 1 or 2, without signed overflow


def part_masks() -> list[int]:
    """Which bits of the packed counts each part of the coordinates has."""
    wide = BITS // HALVES
    return [((1 << wide) - 1) << (wide * k) for k in range(HALVES)]


def grid(fps: DataFrame, distance: int) -> DataFrame:
    """fp, cell, and home: whether the point lies in the cell or only ranges over it."""
    reach = distance // HALVES
    if reach > 1:
        raise ValueError(f"ranges reach over one cell, so distances go up to {2 * HALVES - 1}")
    rows = fps.select("fp", segment_counts(F.col("fp")).alias("counts"))
    cells = []
    for part, mask in enumerate(part_masks()):
        key = lambda c, part=part, mask=mask: F.xxhash64(F.lit(part), c.bitwiseAND(F.lit(_signed(mask))))
        cells.append(F.array(F.struct(key(F.col("counts")).alias("cell"), F.lit(True).alias("home"))))
        if reach:
            even = F.bit_count(F.col("counts").bitwiseAND(F.lit(_signed(mask & 0x5555555555555555)))) % 2 == 0
            around = []
            for k in range(BITS // SEGMENT // HALVES * part, BITS // SEGMENT // HALVES * (part + 1)):
                count = F.shiftrightunsigned("counts", SEGMENT * k).bitwiseAND(F.lit((1 << SEGMENT) - 1))
                for up, inside in ((True, count < SEGMENT), (False, count > 0)):
                    around.append(F.when(even & inside, key(moved(F.col("counts"), k, up))))
            cells.append(F.transform(F.array_compact(F.array(*around)), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))
    return rows.select("fp", F.explode(F.concat(*cells)).alias("at")).select("fp", "at.cell", "at.home")


def moved(counts: Column, k: int, up: bool) -> Column:
    """Packed counts with that of segment k one higher or lower: 00, 01 and 10 stand for 0, 1 and 2."""
    low, both = 1 << (SEGMENT * k), 3 << (SEGMENT * k)
    # 0 to 1 and 1 to 0 flip the low bit; 1 to 2 and 2 to 1 flip both.
    flips = F.when((counts.bitwiseAND(F.lit(_signed(low))) == 0) == F.lit(up), F.lit(_signed(low))).otherwise(F.lit(_signed(both)))
    return counts.bitwiseXOR(flips)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the points of fingerprints: a lower bound of their Hamming distance."""
    odd = np.uint64(0x5555555555555555)
    # With 2-bit segments, unlike counts differ by 2 only where one is 0 and the other 2.
    ones_a, ones_b = (a ^ a >> np.uint64(1)) & odd, (b ^ b >> np.uint64(1)) & odd
    twos_a, twos_b = a & a >> np.uint64(1) & odd, b & b >> np.uint64(1) & odd
    by_two = ~ones_a & ~ones_b & odd & (twos_a ^ twos_b)
    return np.bitwise_count(ones_a ^ ones_b).astype(np.int64) + 2 * np.bitwise_count(by_two)


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether fingerprints lie at distance or less: by the bound first, then by their bits."""
    found = manhattan(a, b) <= distance
    if found.any():
        found &= np.bitwise_count(a ^ b) <= distance
    return found


def _forest(fps: np.ndarray, home: np.ndarray, second: np.ndarray, apart: bool, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of fps at distance or less that have an end at home; if apart, only links between the two blocks."""
    edges, root = [], np.arange(len(fps))
    for i in np.flatnonzero(home):
        others = np.ones(len(fps), bool) if not apart else second != second[i]
        others &= ~home | (np.arange(len(fps)) > i)
        others = np.flatnonzero(others)
        others = others[near(fps[others], fps[i], distance)]
        for r in np.unique(root[others]):
            if r != root[i]:
                edges.append((i, int(others[root[others] == r][0])))
                root[root == r] = root[i]
    return edges


#: One fingerprint in so many shows which cells are to be cut into blocks.
SHOWN = 16


def links(fps: DataFrame, distance: int = 3, block: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that lie at distance or less."""
    members = grid(fps, distance)
    crowded = members.where(F.pmod(F.xxhash64("fp"), F.lit(SHOWN)) == 0).groupBy("cell").count().where(F.col("count") * SHOWN > block)
    # A member of a cell of n blocks goes to the n pairs of blocks that its own block is part of.
    met = members.join(small(checkpointed(crowded)), "cell", "left").withColumn("n", F.coalesce(F.ceil(F.col("count") * SHOWN / block), F.lit(1)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
    met = met.select("cell", "fp", "home", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    met = met.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"), "home", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after another, as the rows are sorted by their key; the last one may go on in the next batch."""
        rest = None
        for b in _with_end(batches):
            if b is not None:
                now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            cell, lo, hi, second, home, fp = *rest[:5], rest[5].view(np.uint64)
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            ends = [*new] if b is not None else [*new, len(cell)]
            starts = [0, *new][: len(ends)]
            starts, ends = np.array(starts, int), np.array(ends, int)
            # Cells of two, the most, are verified all at once.
            two = starts[ends - starts == 2]
            two = two[(home[two] | home[two + 1]) & ((lo[two] == hi[two]) | (second[two] != second[two + 1]))]
            two = two[near(fp[two], fp[two + 1], distance)]
            a, z = [*rest[5][two]], [*rest[5][two + 1]]
            more = ends - starts > 2
            for s, e in zip(starts[more], ends[more], strict=True):
                if home[s:e].any():
                    for i, j in _forest(fp[s:e], home[s:e], second[s:e], lo[s] != hi[s], distance):
                        a.append(rest[5][s + i])
                        z.append(rest[5][s + j])
            if len(ends):
                rest = [x[ends[-1] :] for x in rest]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    dealt = met.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and label (its component's least node) for each node of edges (a, b), by large-star and small-star steps.

    Each round ends in a table in the shared folder, so that the plan stays short and lost executors cost one round.
    """
    now = checkpointed(edges.where("a <> b").select("a", "b"))
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = checkpointed(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links lead to, itself included) of each row."""
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    return with_components(fps, distance)


def with_components(fps: DataFrame, distance: int = 3) -> DataFrame:
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("fp"), distance))
    # A component is named by the least id behind any of its fingerprints.
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def text_key(text: Column) -> Column:
    """With the id it tells the rows of a table apart; null and empty texts have keys of their own."""
    return F.xxhash64(text)


def survivors(docs: DataFrame, rows: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The least row of docs of each component, by id (null ids last), then by text_key. rows: doc_id, key, fp; labels: node, label.

    Of rows that share id and text one stays; unlike texts stand for themselves, whatever their ids.
    """
    named = rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row"))
    first = least.select(F.col("row.doc_id").alias("first"), F.col("row.key").alias("key"))
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col).cast("string")).alias("own"))
    kept = held.join(first, F.col("id").eqNullSafe(F.col("first")) & (F.col("own") == F.col("key")), "left_semi")
    unique = rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    kept = kept if unique else kept.dropDuplicates(["id", "own"])
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The row of docs with the least id of each component; all columns and whole texts stay as they are.

    A component without any id keeps the row of the least text_key.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, keyed=True))
    labels = components(links(rows.select("fp").distinct()))
    return survivors(docs, rows, labels, text_col, id_col)
