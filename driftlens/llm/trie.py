"""Prefix trie of conversations, built as a burst trie.

A conversation is rebuilt (the first turns of its family's head, then its own), and each turn becomes an id of 16 bytes,
so that no text is shuffled. All start in one container under the root. A container that holds more than `burst` turns
becomes a head of the trie and bursts into containers by the next turn id; what is left are containers of bounded size,
dealt to shards (partitions), where suffixes are sorted and swept into nodes.

A container is named by a digest of the turns that lead to it, so that bursting is a count by digest, with partial sums
before the shuffle. A round bursts through 4, 8, 16, ... depths, so that rounds grow with the logarithm of the longest
path that many share. Hot families, first turns and copies become heads, and no task ever holds their members; a
conversation that is alone in its container is no group and is written turn by turn. Conversations are kept in rows of
`piece` turns, so that a very long one is many rows.

Sums over subtrees of heads: the nodes whose least member is c lie one below another at the end of c's path. So each such
c, and each container, adds what it has to all nodes above it on that path: one sum by digest.

Rows without a conv_id take no part. A null role or text is an empty one; a null turn comes first; rows of one turn are
ordered by the digest of role and text, and repeated rows are turns of their own. A negative conv_id is in the family of
conv_id - conv_id % 100 with the sign of conv_id, as in SQL. An empty table has no nodes, not even a root. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import looked_up, written

#: Turns, and one for each member, in a container at most; turns in a row of a conversation; turns of a head at most.
BURST, PIECE, FAMILY_TURNS = 4096, 4096, 5
ID = 16
ROOT = bytes(ID)
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=ID).digest()


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), tid and size (code points of the text) of each turn.

    Rows are sorted over all partitions, so that a long conversation is numbered by many tasks; those that span several
    partitions, two a partition at most, get what lies before added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tid = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    own = written(rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), tid.alias("tid"), F.length(text).cast("long").alias("size")), "turns")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos, pid = None, 0, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for c in b.column(0).to_pylist():
                last, pos = (c, 0) if c != last else (c, pos + 1)
                out.append(pos)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64()), b.column(2), b.column(3), pa.array([pid] * len(out), pa.int32())], names=["conv_id", "pos", "tid", "size", "pid"])

    dealt = own.repartitionByRange("conv_id", "turn", "tid").sortWithinPartitions("conv_id", "turn", "tid")
    local = written(dealt.mapInArrow(number, "conv_id long, pos long, tid binary, size long, pid int"), "numbered")
    runs = local.groupBy("conv_id", "pid").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    later = runs.withColumn("before", before).where("before is not null").select("conv_id", "pid", "before")
    return local.join(F.broadcast(later), ["conv_id", "pid"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "size")


def rebuilt(numbered: DataFrame, piece: int = PIECE) -> DataFrame:
    """c, m, n (turns in all), tids and sizes of the m-th piece of each rebuilt conversation; one without turns has an empty one."""
    heads = numbered.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < FAMILY_TURNS)).groupBy(F.col("conv_id").alias("family"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("first"))
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (FAMILY_TURNS + 1))
    convs = convs.withColumn("family", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "family", "left")
    taken = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.least(F.size("first").cast("long"), "h"))
    convs = convs.select(F.col("conv_id").alias("c"), "h", taken.cast("long").alias("k"), "first", "own")
    convs = written(convs.withColumn("n", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    from_head = convs.where("k > 0").select("c", "n", F.explode(F.slice("first", F.lit(1), F.col("k").cast("int"))).alias("t")).select("c", "n", F.col("t.pos").alias("d"), "t.tid", "t.size")
    own = numbered.join(convs.select("c", "h", "k", "n"), F.col("conv_id") == F.col("c")).where("pos >= h").select("c", "n", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "tid", "size")
    pieces = from_head.unionByName(own).groupBy("c", F.floor(F.col("d") / piece).cast("long").alias("m")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "tid", "size"))).alias("t"))
    none = convs.where("n = 0").select("c", F.lit(0).cast("long").alias("m"), "n", F.array().cast("array<binary>").alias("tids"), F.array().cast("array<bigint>").alias("sizes"))
    return pieces.select("c", "m", "n", F.col("t.tid").alias("tids"), F.col("t.size").alias("sizes")).unionByName(none)


def based(pieces: DataFrame, piece: int = PIECE) -> DataFrame:
    """pieces with base, the digest of all turns before; pieces of longer conversations meet by digests of 16 bytes each."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_digest(*t) for t in b.column(2).to_pylist()], pa.binary())], names=["c", "m", "own"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, owns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = [ROOT]
                for x in owns[:-1]:
                    out.append(_digest(out[-1], x["own"]))
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(out), pa.int64()), pa.array([x["m"] for x in owns], pa.int64()), pa.array(out, pa.binary())], names=["c", "m", "base"])

    owns = pieces.where(F.col("n") > piece).select("c", "m", "tids").mapInArrow(digest, "c long, m long, own binary").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("m", "own"))).alias("owns"))
    bases = owns.mapInArrow(chain, "c long, m long, base binary")
    return pieces.join(bases, ["c", "m"], "left").withColumn("base", F.coalesce("base", F.lit(bytearray(ROOT))))


def _paths(pieces: DataFrame, first: Column, last: Column, piece: int) -> DataFrame:
    """c, n, d, at (digest of the first d turns), above (of one fewer) and size of the d-th turn, for depths first to last."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for c, m, n, tids, sizes, base, lo, hi in zip(*(x.to_pylist() for x in b.columns), strict=True):
                start, h, before = m * piece, hashlib.blake2b(base, digest_size=ID), base
                if start == 0 and lo == 0:
                    for o, v in zip(out, (c, n, 0, ROOT, None, 0), strict=True):
                        o.append(v)
                for d, (tid, size) in enumerate(zip(tids, sizes, strict=True), start + 1):
                    if d > hi:
                        break
                    h.update(tid)
                    at = _digest(base, _digest(*tids)) if d == start + piece else h.copy().digest()
                    if d >= lo:
                        for o, v in zip(out, (c, n, d, at, before, size), strict=True):
                            o.append(v)
                    before = at
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["c", "n", "d", "at", "above", "size"])

    near = pieces.where((F.col("m") * piece < last) & ((F.col("m") + 1) * piece >= first) | (F.col("m") == 0) & (first == 0))
    return near.select("c", "m", "n", "tids", "sizes", "base", first.cast("long").alias("lo"), last.cast("long").alias("hi")).mapInArrow(walk, "c long, n long, d long, at binary, above binary, size long")


def burst(pieces: DataFrame, limit: int = BURST, piece: int = PIECE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads (at, above, d, n_convs, least, size), the rows (c, d, at, n) of paths through heads, and settled conversations.

    Of these (c, n, top): the container is named by the first top turns; top is null where the conversation ends at a head.
    """
    heads, rows, settled = [], [], []
    todo, start, step = pieces, 0, 4
    while True:
        end = start + step - 1
        paths = written(_paths(todo, F.lit(start), F.lit(end), piece), "paths")
        found = paths.groupBy("at").agg(F.first("above").alias("above"), F.first("d").alias("d"), F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("least"), F.first("size").alias("size"), F.sum(F.col("n") - F.col("d") + 1).alias("turns"))
        heads.append(written(found.where((F.col("turns") > limit) & (F.col("n_convs") > 1)).drop("turns"), "heads"))
        met = written(looked_up(paths.select("c", "n", "d", "at"), heads[-1].select("at", F.lit(True).alias("head")), "at"), "met")
        rows.append(met.where("head").drop("head"))
        last = met.groupBy("c", "n").agg(F.coalesce(F.max(F.when(F.col("head"), F.col("d"))), F.lit(start - 1)).alias("last"))
        last = written(last, "last")
        ends = F.col("last") < F.least(F.lit(end).cast("long"), F.col("n"))
        settled.append(last.where(ends | (F.col("n") <= end)).select("c", "n", F.when(ends, F.col("last") + 1).alias("top")))
        left = last.where(~ends & (F.col("n") > end))
        if left.isEmpty():
            break
        todo = todo.join(left.select("c"), "c", "left_semi")
        start, step = end + 1, step * 2
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    return written(union(heads), "heads"), union(rows), written(union(settled), "settled")


class _Open:
    """A node on the path that the sweep is at."""

    __slots__ = ("children", "ends", "leaves", "least", "n", "rows", "saved", "size")

    def __init__(self, size: int):
        self.size, self.n, self.least, self.children, self.leaves, self.saved = size, 0, None, 0, 0, 0
        self.ends: list[int] = []
        self.rows: list[list] = []  # of its children, which lack their parent's name


def sweep(members: list[tuple[bytes, int, list[int]]], top: int) -> list[list]:
    """NODE rows of a container: of each member the turn ids after the container's first top turns, its conv_id, and the sizes from the top node's on.

    The container's own node comes last, without a parent.
    """
    rows: list[list] = []
    members = sorted(members)
    path, before = [_Open(members[0][2][0])], b""

    def close() -> None:
        x, depth = path.pop(), top + len(path)
        x.n += len(x.ends)
        x.least = x.ends[0] if x.ends and (x.least is None or x.ends[0] < x.least) else x.least
        x.leaves += not x.children
        x.saved += (x.n - 1) * x.size
        for r in x.rows:
            r[2] = x.least
        rows.append([x.least, depth, None, x.n, x.children, x.leaves, x.saved, hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest()])
        if path:
            up = path[-1]
            up.least = x.least if up.least is None else min(up.least, x.least)
            up.n, up.children, up.leaves, up.saved = up.n + x.n, up.children + 1, up.leaves + x.leaves, up.saved + x.saved
            up.rows.append(rows[-1])

    for ids, c, sizes in members:
        same = 0
        while before[same : same + ID] == ids[same : same + ID] and same < len(ids) and same < len(before):
            same += ID
        while len(path) > same // ID + 1:
            close()
        path += [_Open(s) for s in sizes[same // ID + 1 :]]
        path[-1].ends.append(c)
        before = ids
    while path:
        close()
    return rows


def _swept(parts: DataFrame) -> DataFrame:
    """NODE rows, and above, of containers. parts: at, above, top, c, m, tids and sizes (from the top node's turn on; none for the root's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above, top, members = None, None, 0, {}

        def done() -> pa.RecordBatch:
            cut = ID if top else 0  # the top node's own turn is the same in all members
            rows = sweep([(b"".join(t)[cut:], c, s if top else [0, *s]) for c, (t, s) in members.items()], top)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string() if k == 7 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))), pa.array([None] * (len(rows) - 1) + [above], pa.binary()), pa.array([False] * (len(rows) - 1) + [True])], names=[*names, "above", "is_top"])

        for b in batches:
            out = []
            for at, up, t, c, _, tids, sizes in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at != now:
                    out += [done()] if members else []
                    now, above, top, members = at, up, t, {}
                have = members.setdefault(c, ([], []))
                have[0].extend(tids)
                have[1].extend(sizes)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if members:
            yield done()

    names = [x.split(" ")[0] for x in NODE.split(", ")]
    dealt = parts.select("at", "above", "top", "c", "m", "tids", "sizes").repartition("at").sortWithinPartitions("at", "c", "m")
    return dealt.mapInArrow(run, f"{NODE}, above binary, is_top boolean")


def _ends(ended: DataFrame) -> DataFrame:
    """at and ends_sha256 of heads at which conversations end (c, at): ids meet in blocks of up to 4096, and blocks pass by one after another."""
    blocks = ended.groupBy("at", F.shiftright("c", 12).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            done = []
            for at, _, ids in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at != now:
                    done += [(now, h.hexdigest())] if h else []
                    now, h = at, hashlib.sha256()
                    h.update(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["at", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["at", "ends_sha256"])

    return blocks.repartition("at").sortWithinPartitions("at", "block").mapInArrow(run, "at binary, ends_sha256 string")


def _head_nodes(heads: DataFrame, rows: DataFrame, tops: DataFrame, ended: DataFrame) -> DataFrame:
    """NODE rows of heads. tops: above, c (least member), leaves and saved of each container's node."""
    children = heads.select("above").unionByName(tops.select("above")).where("above is not null").groupBy(F.col("above").alias("at")).agg(F.count(F.lit(1)).alias("n_children"))
    known = written(heads.join(children, "at", "left").na.fill(0, ["n_children"]), "known")
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    reps = written(known.select(F.col("least").alias("c")).unionByName(tops.select("c")).distinct(), "reps")
    on_path = looked_up(rows.join(reps, "c", "left_semi").select("c", "d", "at"), known.select("at", "least", own_leaf.alias("leaf"), own_saved.alias("more")), "at")
    mine = F.col("least") == F.col("c")
    values = on_path.select("c", "d", "at", F.when(mine, F.col("leaf")).otherwise(0).alias("leaf"), F.when(mine, F.col("more")).otherwise(0).alias("more"))
    values = values.unionByName(tops.select("c", F.lit(2**62).alias("d"), F.lit(None).cast("binary").alias("at"), F.col("leaves").alias("leaf"), F.col("saved").alias("more")))
    below = Window.partitionBy("c").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = values.select("at", F.sum("leaf").over(below).alias("leaf"), F.sum("more").over(below).alias("more")).where("at is not null").groupBy("at").agg(F.sum("leaf").alias("n_leaves"), F.sum("more").alias("saved_tokens"))
    out = known.join(sums, "at").join(_ends(ended), "at", "left")
    parents = looked_up(out, heads.select(F.col("at").alias("above"), F.col("least").alias("parent_conv_id")), "above")
    return parents.select(F.col("least").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def nodes(conversations: DataFrame, limit: int = BURST, piece: int = PIECE) -> DataFrame:
    """A row per node of the trie of rebuilt conversations."""
    pieces = written(based(rebuilt(turns(conversations), piece), piece), "pieces")
    heads, rows, settled = burst(pieces, limit, piece)
    ended = rows.join(settled.where("top is null").select("c"), "c", "left_semi").where("d = n").select("at", "c")
    at_top = settled.where("top is not null")
    own = pieces.join(at_top.select("c", "top"), "c").where("(m + 1) * {0} >= top".format(piece))
    # Containers' names: the digests of the paths at depth top, one row a conversation.
    names = written(_paths(own, F.col("top"), F.col("top"), piece).select("c", "n", F.col("d").alias("top"), "at", "above"), "names")
    alone = F.col("n") - F.col("top") + 1 > limit
    skip = F.greatest(F.col("top") - 1 - F.col("m") * piece, F.lit(0)).cast("int")
    rest = own.join(names.where(~alone).select("c", "at", "above"), "c").where((F.col("m") == 0) | (F.size("tids") > skip))
    cut = lambda c: F.slice(c, skip + 1, F.greatest(F.size(c) - skip, F.lit(0)))
    swept = written(_swept(rest.select("at", "above", "top", "c", "m", cut("tids").alias("tids"), cut("sizes").alias("sizes"))), "swept")
    single = names.where(alone)
    long = pieces.join(single.select("c", "top", "above"), "c").select("c", "n", "top", "above", F.posexplode("sizes").alias("k", "size"), "m").withColumn("depth", F.col("m") * piece + F.col("k") + 1).where("depth >= top")
    ends = F.when(F.col("depth") == F.col("n"), F.col("c").cast("string")).otherwise("")
    chains = long.select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top"), F.col("c")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.sha2(ends.cast("binary"), 256).alias("ends_sha256"), F.when(F.col("depth") == F.col("top"), F.col("above")).alias("above"))
    tops = swept.where("is_top").select("above", F.col("conv_id").alias("c"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(single.select("above", "c", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    columns = [x.split(" ")[0] for x in NODE.split(", ")]
    lower = looked_up(swept.select(*columns, "above").unionByName(chains), heads.select(F.col("at").alias("above"), F.col("least").alias("head_conv_id")), "above")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "head_conv_id")).select(*columns)
    return _head_nodes(heads, rows, written(tops, "tops"), ended).select(*columns).unionByName(lower)
