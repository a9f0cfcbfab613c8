"""Token-ID output: Parquet list columns in document order, with dictionary or delta encoding, row groups and page indexes.

Texts are encoded in Arrow batches, on partitions ranged and sorted by id. Each file row holds the document's id, its
partition, the ids of the partition before it, their number, and its token ids as a list<int>. Parquet's page indexes and row groups
of bounded size let a reader fetch the tokens or the metadata of a few documents alone.

Texts are cut at space, tab, line feed and carriage return, where no token of this kind of vocabulary reaches across. Of a
batch, each distinct piece is looked up once, and encoded if it is new; the ids equal those of whole texts.

Null and empty texts have the end id alone. Rows with equal ids are kept, in order of a hash of their texts; null ids come
first. Very long texts are encoded whole. Extra columns are ignored, whatever their names. An empty table writes no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "doc_id long, part int, before long, n_ids int, ids array<int>"
#: Bytes of a row group and of a page, and how many units of text an encoder remembers.
ROW_GROUP, PAGE, REMEMBERED = 16 << 20, 256 << 10, 500_000

#: Bytes of text that are cut into pieces at once, or remembered.
TEXTS = 24 << 20

#: Bytes of text of a partition, and so of a file, on average.
PARTITION = 256 << 20

ENDS = ".,!?;:|*#$%&()<>\""
LETTERS = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
#: Tab, line feed and carriage return to a space.
SPACED = bytes.maketrans(b"\t\n\r", b"   ")


def byte_letters() -> dict[int, str]:
    """Latin letters beyond ASCII to the characters that stand for their bytes in a byte-level vocabulary.

    Visible characters of Latin-1 stand for themselves, the other bytes for the characters from 256 on, in order.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in visible)}
    return {c: "".join(stands[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class PieceEncoder:
    """Columns of texts to lists of token ids. Distinct pieces of a column are looked up in Arrow; what is new is encoded once.

    Plain Latin letters, with ASCII marks behind them or not, are two units, letters and marks, that go to the tokenizer's model
    directly: for them lower-casing and bytes for letters is all that comes before, and marks are never joined to letters, as is
    seen on a few words. Other pieces, and those that hold an added token (in any case, as some are matched after lower-casing),
    are encoded whole. When too many units, or too long ones, are remembered, those that the last column did not have are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        # A mark that all added tokens have, if there is one, tells most pieces without any.
        self.mark = next((c for c in sorted(set(self.added[0])) if not c.isalnum() and all(c in t for t in self.added)), "") if self.added else None
        self._forget()
        self.plain = True
        seen = pa.array([w + m for w in ("The", "q", "ZYXWVUTSRQPONMLKJIHGFEDCBA", "Für", "ÉTÉ", "ñandú", "ÀÖØöøßÿ", "straße") for m in ("", *ENDS, ENDS, "...", ".$$$")])
        if self._pieces(seen).to_pylist() != [self._whole(p) for p in seen.to_pylist()]:
            self.plain = False
            self._forget()

    def _forget(self) -> None:
        self.known, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def _whole(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _unit(self, unit: str) -> list[int]:
        return [t.id for t in self.tokenize(unit if unit.isascii() else unit.translate(self.letters))]

    def _units(self, units: pa.Array, plain: int) -> pa.ListArray:
        """The ids of distinct units, of which the first ones are plain."""
        at = pc.index_in(units, value_set=self.known)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        ids, sizes = array("i"), []
        for k, unit in zip(new.tolist(), units.take(pa.array(new)).to_numpy(zero_copy_only=False), strict=True):
            found = self._unit(unit) if k < plain else self._whole(unit)
            ids.extend(found)
            sizes.append(len(found))
        at = at.fill_null(0).to_numpy().copy()
        at[new] = len(self.known) + np.arange(len(new))
        lists = pa.concat_arrays([self.lists, pa.ListArray.from_arrays(offsets_of(sizes), np.frombuffer(ids, np.int32))])
        found = lists.take(pa.array(at))
        if len(lists) <= REMEMBERED and self.known.nbytes + units.nbytes <= TEXTS:
            self.known, self.lists = pa.concat_arrays([self.known, units.take(pa.array(new))]), lists
        elif units.nbytes <= TEXTS:
            self.known, self.lists = units, found
        else:
            self._forget()
        return found

    def _pieces(self, pieces: pa.Array) -> pa.ListArray:
        """The ids of distinct pieces."""
        core = pc.ascii_rtrim(pieces, ENDS)
        easy = pc.match_substring_regex(core, LETTERS).to_numpy(zero_copy_only=False) & self.plain
        if self.mark is not None:
            maybe = np.flatnonzero(pc.match_substring(pieces, self.mark).to_numpy(zero_copy_only=False) & easy)
            easy[[k for k, p in zip(maybe.tolist(), pieces.take(pa.array(maybe)).to_pylist(), strict=True) if any(t in p.lower() for t in self.added)]] = False
        marked = np.flatnonzero(easy & (pc.binary_length(core).to_numpy() < pc.binary_length(pieces).to_numpy()))
        both = (x.take(pa.array(marked)).to_numpy(zero_copy_only=False) for x in (pieces, core))
        marks = pa.array([p[len(c) :] for p, c in zip(*both, strict=True)], pa.string())
        units = pa.concat_arrays([pc.utf8_lower(core.filter(pa.array(easy))), marks, pieces.filter(pa.array(~easy))]).dictionary_encode()
        codes, n = units.indices.to_numpy(), int(easy.sum())
        lists = self._units(units.dictionary, int(codes[: n + len(marked)].max(initial=-1)) + 1)
        # A piece is one unit, or two where marks are behind it.
        first, sizes = np.empty(len(pieces), np.int32), np.ones(len(pieces), np.int64)
        first[easy], first[~easy], sizes[marked] = codes[:n], codes[n + len(marked) :], 2
        out = lists.take(pa.array(np.insert(first, marked + 1, codes[n : n + len(marked)])))
        return pa.ListArray.from_arrays(out.offsets.take(offsets_of(sizes)), out.values)

    def ids(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text and the end id. There is one text at least."""
        texts = texts.cast(pa.string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset :][: len(texts) + 1]
        spaced = data.slice(at[0], at[-1] - at[0]).to_pybytes().translate(SPACED) if data else b""
        split = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(spaced)), " ")
        coded, at = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        lists = pa.concat_arrays([self._pieces(coded.dictionary), pa.array([[end_id]], pa.list_(pa.int32()))])
        out = lists.take(pa.array(np.insert(coded.indices.to_numpy(), at[1:], len(lists) - 1)))
        return pa.ListArray.from_arrays(out.offsets.take(pa.array(at + np.arange(len(at)))), out.values)


def offsets_of(sizes: np.ndarray | list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of a column that hold TEXTS bytes, and the rest of a text, at most."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    starts = np.flatnonzero(np.diff((ends - np.diff(ends, prepend=0)) // TEXTS, prepend=-1)).tolist()
    yield from ((a, b - a) for a, b in pairwise([*starts, len(ends)]))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker and tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FILE_SCHEMA rows in order within their partitions, partitions in order of id.

    There are as many partitions as the session asks for, or more where these would be too large. Rows of one id, or of none,
    are dealt to several by a hash of their text. Arrow batches are bounded by bytes, so that no text shares one with too many others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    by_id = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n"))
    size, most = by_id.agg(F.sum("size"), F.max("n")).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PARTITION)
    # Where ids are unique, ranges are found without a look at the texts.
    order = ["doc_id"] if (most or 0) < 2 else ["doc_id", "own"]
    rows = (rows.withColumn("own", F.xxhash64("text")) if "own" in order else rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, before = encoder(tokenizer_path), 0
        for whole in batches:
            for first, n in slices(whole.column(1)):
                b = whole.slice(first, n)
                ids = pieces_of.ids(b.column(1), end_id)
                at = ids.offsets.to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(before + at[:-1]), pa.array(np.diff(at).astype(np.int32)), ids], names=["doc_id", "part", "before", "n_ids", "ids"])
                before += int(at[-1])

    return rows.select("doc_id", "text", "part").mapInArrow(run, FILE_SCHEMA)


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """encoding: dictionary, or delta (Parquet's version 2 pages, integers as differences in small bit widths)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    out = tokens.write.option("compression", "zstd").option("parquet.block.size", row_group).option("parquet.page.size", page)
    out = out.option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
    out.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: list[str] = ()) -> DataFrame:
    """Rows of documents first to last, both included; filters and columns reach row groups and page indexes."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df.select(*columns) if columns else df


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the files' rows. start adds the totals of earlier partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    rows = tokens.select("doc_id", "part", "before", "ids").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    # One row per partition, however many documents; its sum runs on the driver.
    totals, base = [], 0
    for r in tokens.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        totals.append((r["part"], base))
        base += r["n"]
    bases = tokens.sparkSession.createDataFrame(totals, "part int, base long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
