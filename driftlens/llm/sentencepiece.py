"""SentencePiece encoding and decoding by shortest paths in a weighted transducer.

The transducer is compiled from a model file: the normaliser (character map, runs of spaces, space to the space mark, a
mark in front or behind), an arc for each piece, and byte arcs for characters without a piece. Composed with a text it
is a lattice whose states are places in the text, and whose tropical-semiring shortest path is the encoding.

For a unigram model an arc weighs minus its score. For a byte-pair model the weight of an arc depends on the arc before
it: 0 if merging the two pieces' text by the model's ranks gives back those two pieces, infinite otherwise. Exactly one
path then is finite, for each prefix of the text as for the whole, and it is what merging gives; so one arc per place
is kept, and beginnings that texts share keep their paths. Lattices are cut where no piece reaches across.

Null and empty texts have no ids. Rows are encoded one by one: repeated rows, ties, null ids and extra columns stay as
they are, and the length of a text is bounded by memory alone. An empty table gives an empty result. Decoding turns the
space mark back into a space, so a mark that was in the text comes back as a space, and bytes that are no UTF-8 come
back as U+FFFD. What a character map has changed stays changed. Models with pieces of the user's own are refused.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import remembered

MARK = "▁"
#: How many cuts and beginnings, of how many characters at most, and how many pairs a transducer remembers.
REMEMBERED, BEGINNINGS, LONGEST, PAIRS = 300_000, 400_000, 64, 1_000_000
# Fixed values of the model format: the kind of a byte-pair model, and what a character without a piece costs more than the worst piece.
BPE, UNKNOWN_PENALTY = 2, 10.0


class Normaliser:
    """Text as the pieces see it, compiled from a model's normalizer_spec.

    The character map is a double-array trie of UTF-8 keys with the places of their replacements. Its keys are read out
    once; the longest key at each place of a text gives way to its replacement.
    """

    def __init__(self, spec, behind: bool):
        self.trim, self.escape, self.behind = spec.remove_extra_whitespaces, spec.escape_whitespaces, behind
        self.mark = MARK if spec.escape_whitespaces else " "
        self.prefix = self.mark if spec.add_dummy_prefix else ""
        self.keys = character_map(spec.precompiled_charsmap) if spec.precompiled_charsmap else {}
        self.lengths: dict[str, list[int]] = {}
        for k in self.keys:
            self.lengths.setdefault(k[0], []).append(len(k))
        for n in self.lengths.values():
            n.sort(reverse=True)
        first = "".join(map(re.escape, self.lengths))
        self.first = re.compile(f"[{first}]") if first else None

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.first:
            text = self.mapped(text)
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return ""
        text = text.replace(" ", MARK) if self.escape else text
        text = text if self.behind else self.prefix + text
        if self.trim:
            text = text.rstrip(self.mark)
        return text + self.prefix if self.behind else text

    def said(self, text: str) -> str:
        """What decoding gives back: the normalised text with spaces for marks."""
        return self.bare(self(text).replace(MARK, " "))

    def bare(self, text: str) -> str:
        if not self.prefix:
            return text
        return text.removesuffix(" ") if self.behind else text.removeprefix(" ")

    def mapped(self, text: str) -> str:
        out, at = [], 0
        while m := self.first.search(text, at):
            i = m.start()
            out.append(text[at:i])
            n = next((n for n in self.lengths[text[i]] if text[i : i + n] in self.keys), 0)
            out.append(self.keys[text[i : i + n]] if n else text[i])
            at = i + (n or 1)
        return "".join([*out, text[at:]])


def character_map(blob: bytes) -> dict[str, str]:
    """Keys and replacements of a precompiled map: the trie's size in bytes, its units, then replacements ended by NUL."""
    size = struct.unpack("<I", blob[:4])[0]
    units, replaced = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    labels = np.arange(256, dtype=np.uint32)
    # A unit holds its label, whether a value follows, and the way to its children.
    below = lambda u: int(u >> 10) << (int(u & 0x200) >> 6)
    found: dict[str, str] = {}
    todo = [(b"", below(units[0]))]
    while todo:
        key, at = todo.pop()
        places = labels ^ np.uint32(at)
        places, names = places[places < len(units)], labels[places < len(units)]
        for c in names[(units[places] & np.uint32(0x800000FF)) == names].tolist():
            unit = units[at ^ c]
            if c:
                todo.append((key + bytes([c]), at ^ c ^ below(unit)))
        if key and units[at] & 0x80000000:
            start = int(units[at]) & 0x7FFFFFFF
            try:
                found[key.decode()] = replaced[start : replaced.index(b"\x00", start)].decode()
            except UnicodeDecodeError:
                continue  # no text holds half a character
    return found


class State:
    """Of the automaton of all pieces: what was read last and begins a piece. States are made as texts reach them."""

    __slots__ = ("arcs", "begun", "known", "next", "pieces", "text")

    def __init__(self, text: str, arcs: dict[str, int], begun: set[str], known: dict[str, State] | None = None):
        self.text, self.arcs, self.begun, self.next = text, arcs, begun, {}
        self.known = {"": self} if known is None else known
        #: Lengths and ids of the pieces that end here, the longest first.
        self.pieces = [(len(p), arcs[p]) for p in (text[k:] for k in range(len(text))) if p in arcs]

    def after(self, char: str) -> State:
        found = self.next.get(char)
        if found is None:
            text = self.text + char
            while text not in self.begun:
                text = text[1:]
            found = self.known.get(text)
            if found is None:
                found = self.known[text] = State(text, self.arcs, self.begun, self.known)
            if char in self.arcs:  # others are too many to remember
                self.next[char] = found
        return found


class Transducer(dict):
    """Cuts of normalised text to their ids, by shortest paths."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
        if any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("models with pieces of the user's own are not compiled")
        self.normal = Normaliser(spec.normalizer_spec, spec.trainer_spec.treat_whitespace_as_suffix)
        model = SentencePieceProcessor(model_proto=proto)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text_of = {i: model.id_to_piece(i) for i in ids}
        self.arcs = {self.text_of[i]: i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.byte_ids = {int(self.text_of[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = model.unk_id()
        self.silent = {i for i in ids if model.is_control(i)}
        self.bpe = spec.trainer_spec.model_type == BPE
        self.rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-self.score[i], i)))}
        self.lost = -min(self.score.values(), default=0.0) + UNKNOWN_PENALTY
        self.size = len(ids)
        self.root = State("", self.arcs, {p[:k] for p in self.arcs for k in range(len(p) + 1)})
        # No piece reaches across a line feed, into a run of marks, or from a letter to one of self.ends.
        inner = any(MARK in p.lstrip(MARK) or len(p) > 1 and "\n" in p for p in self.arcs)
        self.cuts = re.compile(".+", re.S) if inner else re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        joined = {b for p in self.arcs for a, b in zip(p, p[1:]) if a.isalpha()}
        self.ends = "".join(c for c in ".,;:!?|*#$%&()<>\"'" if c not in joined)
        self.pairs: dict[int, bool] = {}
        self.halves_of: dict[int, tuple[int, int] | None] = {}
        self.paths: dict[str, tuple[int, bytes, State]] = {"": (self.size, b"", self.root)}
        self.older: dict[str, bytes] = {}
        # What an id stands for on its own. Bytes of longer characters depend on their neighbours.
        self.alone = ["" if i in self.silent else chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else self.text_of[i].replace(MARK, " ") for i in ids]
        self.high = np.array([self.byte_of.get(i, 0) >= 128 for i in ids])

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge is the last in making a piece (itself twice: one character), None if merging never makes it."""
        if piece not in self.halves_of:
            parts = list(self.text_of[piece])
            while len(parts) > 2:
                found = [(self.rank[self.arcs[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.arcs]
                if not found:
                    break
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            made = len(parts) <= 2 and all(p in self.arcs for p in parts)
            self.halves_of[piece] = (self.arcs[parts[0]], self.arcs[parts[-1]]) if made else None
        return self.halves_of[piece]

    def stays(self, before: int, after: int) -> bool:
        """Whether merging the text of two pieces gives back those two (before may be self.size: none).

        Merges at the inner ends are undone, the latest first; the pieces stay unless their ends had a merge due earlier.
        """
        if self.halves(after) is None:
            return False
        if before == self.size:
            return True
        due, rank, arcs, text = math.inf, self.rank, self.arcs, self.text_of
        while True:
            joined = arcs.get(text[before] + text[after])
            if joined is not None and rank[joined] < due:
                return False
            left, right = self.halves(before)[1], self.halves(after)[0]
            if left == before and right == after:
                return True
            if right == after or left != before and rank[before] > rank[after]:
                due, before = rank[before], left
            else:
                due, after = rank[after] + 1, right

    def fits(self, before: int, piece: int) -> bool:
        key = before * (self.size + 1) + piece
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.stays(before, piece)
        return ok

    def shared_path(self, cut: str) -> bytes:
        """Of a byte-pair model and a short cut, carried on from the longest beginning whose path is known."""
        paths, pairs, size = self.paths, self.pairs, self.size + 1
        if len(paths) >= BEGINNINGS:
            paths.clear()
            paths[""] = (self.size, b"", self.root)
        known = len(cut)
        while cut[:known] not in paths:
            known -= 1
        state = paths[cut[:known]][2]
        for end in range(known + 1, len(cut) + 1):
            state = state.after(cut[end - 1])
            for length, piece in state.pieces:
                before, ids, _ = paths[cut[: end - length]]
                ok = pairs.get(before * size + piece)
                if self.fits(before, piece) if ok is None else ok:
                    paths[cut[:end]] = piece, ids + piece.to_bytes(4, "little"), state
                    break
            else:  # a character without a piece: nothing merges across it
                paths[cut[:end]] = self.size, paths[cut[: end - 1]][1] + self.spelled(cut[end - 1]), state
        return paths[cut][1]

    def shortest_path(self, text: str) -> bytes:
        n = len(text)
        cost, arc, start = [0.0] + [math.inf] * n, [self.size] * (n + 1), [0] * (n + 1)
        state = self.root
        for end in range(1, n + 1):
            state = state.after(text[end - 1])
            for length, i in state.pieces:
                at = end - length
                if self.bpe:
                    if self.fits(arc[at], i):
                        cost[end], arc[end], start[end] = 0.0, i, at
                        break
                elif (c := cost[at] - self.score[i]) < cost[end]:
                    cost[end], arc[end], start[end] = c, i, at
            if text[end - 1] not in self.arcs and (c := cost[end - 1] + (0.0 if self.bpe else self.lost)) < cost[end]:
                cost[end], arc[end], start[end] = c, self.size, end - 1
        if cost[n] == math.inf:
            raise ValueError("no finite path")
        out: list[bytes] = []
        while n:
            out.append(arc[n].to_bytes(4, "little") if arc[n] < self.size else self.spelled(text[start[n] : n]))
            n = start[n]
        return b"".join(out[::-1])

    def spelled(self, char: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]).tobytes()

    def __missing__(self, cut: str) -> bytes:
        ids = self.older.get(cut)
        if ids is None:
            core = cut.rstrip(self.ends)
            if len(core) < len(cut) and core[-1:].isalpha():
                ids = self[core] + self[cut[len(core) :]]
            else:
                ids = self.shared_path(cut) if self.bpe and len(cut) <= LONGEST else self.shortest_path(cut)
        if len(cut) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[cut] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        cuts = self.cuts.findall(self.normal(text)) if text else []
        ids = np.frombuffer(b"".join(map(self.__getitem__, cuts)), np.int32)
        if not self.byte_ids and len(ids):  # a run of unknown characters is one unknown piece
            ids = ids[~((ids == self.unknown) & (np.append(-1, ids[:-1]) == self.unknown))]
        return ids

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int32)
        if not self.high[ids].any():
            text = "".join(map(self.alone.__getitem__, ids.tolist()))
        else:
            out = [bytes([self.byte_of[i]]) if i in self.byte_of else self.alone[i].encode() for i in ids.tolist()]
            text = b"".join(out).decode("utf-8", "replace")
        return self.normal.bare(text)


_compiled: dict[bytes, Transducer] = remembered()


def transducer(proto: bytes) -> Transducer:
    """Compiled once per Python worker and model, and again after tasks that let go of it."""
    key = zlib.crc32(proto).to_bytes(4, "big") + len(proto).to_bytes(8, "big")
    if key not in _compiled:
        _compiled[key] = Transducer(proto)
    return _compiled[key]


def _model(docs: DataFrame, path: str):
    """The model file, some hundred kilobytes, sent to each executor once."""
    with open(path, "rb") as f:
        proto = f.read()
    if len(proto) > 64 << 20:
        raise ValueError(f"{path} is too large to be a model")
    return docs.sparkSession.sparkContext.broadcast(proto)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with out_col, the token ids of each whole text. A column of that name is replaced."""
    held = _model(docs, model_path)

    @F.pandas_udf("array<int>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(held.value)
        for s in it:
            yield s.map(t.encode)

    return docs.withColumn(out_col, run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """tokens with out_col, the text of each list of ids; null ids give null."""
    held = _model(tokens, model_path)

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(held.value)
        for s in it:
            yield s.map(lambda x: None if x is None else t.decode(x))

    return tokens.withColumn(out_col, run(F.col(ids_col)))


def encoded_and_checked(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep with n_ids, ids, and round_trip: whether decoding gives back the normalised text (marks as spaces), in one pass.

    A column of keep gives way to one of these of its name.
    """
    held = _model(docs, model_path)
    keep = [c for c in keep if c.lower() not in ("n_ids", "ids", "round_trip")]
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    schema = StructType([*kept, StructField("n_ids", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(held.value)
        for b in batches:
            lists, same = [], []
            for x in b.column(b.num_columns - 1):
                text = x.as_py()
                lists.append(t.encode(text))
                same.append(t.decode(lists[-1]) == t.normal.said(text))
            lens = np.array([len(x) for x in lists], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *lists])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lens), ids, pa.array(same, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)
