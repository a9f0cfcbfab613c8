"""What each stretch of a line is (comment, string, number, key word, ...), with comments and strings that run over lines.

A line is a function from the state before it to the state after it; there are four states, so the function is a byte.
Functions of lines compose to functions of blocks of lines, and these, by a prefix scan in doubling steps, to the state
before each block. A long file is therefore many tasks; a file of one block is read once.

Files without rules of their own have no spans. A null text has no lines. Paths are held to be unique in a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.sources.stored import written

#: States before a line: outside of everything, in a comment, in a string of three single or double quotes.
PLAIN, COMMENT, SINGLE, DOUBLE = range(4)
BLOCK = 4096
SPAN = "struct<lo:int,hi:int,kind:string>"

# Words and shapes that have a kind of their own.
NUMBER = r"\b(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?)(?:[uUlL]{1,3}|[fF])?\b"
CALL = r"\b[A-Za-z_]\w*(?=\s*\()"
C_WORDS = "auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while"
C_TYPES = r"void char short int long float double signed unsigned _Bool size_t ptrdiff_t u?int(?:8|16|32|64)_t"
CPP_WORDS = C_WORDS + (
    " alignas alignof and asm catch class compl concept consteval constexpr constinit const_cast co_await co_return co_yield decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept not"
    " nullptr operator or override private protected public reinterpret_cast requires static_assert static_cast template this thread_local throw true try typeid typename using virtual xor"
)
CPP_TYPES = C_TYPES + " bool wchar_t char8_t char16_t char32_t auto"
A2L_WORDS = (
    "A2ML_VERSION ADDR_EPK ALIGNMENT_BYTE ALIGNMENT_FLOAT16_IEEE ALIGNMENT_FLOAT32_IEEE ALIGNMENT_FLOAT64_IEEE ALIGNMENT_INT64 ALIGNMENT_LONG ALIGNMENT_WORD ANNOTATION_LABEL ANNOTATION_ORIGIN ARRAY_SIZE ASAP2_VERSION"
    " AXIS_PTS_REF AXIS_PTS_[XYZ45] AXIS_RESCALE_[XYZ45] BIT_MASK BYTE_ORDER CALIBRATION_ACCESS COEFFS COEFFS_LINEAR COMPARISON_QUANTITY COMPU_TAB_REF CPU_TYPE CURVE_AXIS_REF CUSTOMER_NO CUSTOMER DATA_SIZE"
    " DEFAULT_VALUE_NUMERIC DEFAULT_VALUE DEPOSIT DISCRETE DISPLAY_IDENTIFIER DIST_OP_[XYZ45] ECU_ADDRESS_EXTENSION ECU_ADDRESS ECU_CALIBRATION_OFFSET ECU EPK ERROR_MASK EXTENDED_LIMITS FIX_AXIS_PAR_DIST FIX_AXIS_PAR"
    " FIX_NO_AXIS_PTS_[XYZ45] FNC_VALUES FORMAT FORMULA_INV FORMULA GUARD_RAILS IDENTIFICATION LEFT_SHIFT MATRIX_DIM MAX_DIFF MAX_GRAD MAX_REFRESH MODEL_LINK MONOTONY NO_AXIS_PTS_[XYZ45] NO_OF_INTERVALS"
    " NO_RESCALE_[XYZ45] NUMBER OFFSET_[XYZ45] PHONE_NO PHYS_UNIT PROJECT_NO READ_ONLY READ_WRITE REF_MEMORY_SEGMENT REF_UNIT RIGHT_SHIFT RIP_ADDR_[WXYZ45] SHIFT_OP_[XYZ45] SI_EXPONENTS SRC_ADDR_[XYZ45]"
    " STATIC_RECORD_LAYOUT STATUS_STRING_REF STEP_SIZE SUPPLIER SYMBOL_TYPE_LINK SYMBOL_LINK SYSTEM_CONSTANT UNIT_CONVERSION USER VERSION"
)
A2L_VALUES = (
    "A_INT64 A_UINT64 ASCII BIG_ENDIAN BYTE CALIBRATION_VARIABLES CALIBRATION CODE COLUMN_DIR COM_AXIS CUBOID CUB4 CUB5 CURVE_AXIS CURVE DATA DERIVED DIRECT EXCLUDE_FROM_FLASH EXTERN FIX_AXIS FLOAT16_IEEE FLOAT32_IEEE"
    " FLOAT64_IEEE FORM IDENTICAL INDEX_DECR INDEX_INCR INTERN LINEAR LITTLE_ENDIAN LONG MAP MON_DECREASE MON_INCREASE MONOTONOUS MSB_FIRST MSB_LAST NOT_IN_ECU NOT_IN_MCD_SYSTEM NOT_MON NO_CALIBRATION OFFLINE_CALIBRATION"
    " OFFLINE_DATA PBYTE PLONG PWORD RAT_FUNC RES_AXIS RESERVED ROW_DIR SBYTE SERAM SLONG STD_AXIS STRICT_DECREASE STRICT_INCREASE STRICT_MON SWORD TAB_INTP TAB_NOINTP TAB_VERB UBYTE ULONG UWORD VAL_BLK VALUE VARIABLE"
    " WORD WORM RO RW WO"
)
PY_WORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield True False None match case"
PY_TYPES = "bool bytearray bytes complex dict float frozenset int list object set str tuple type range enumerate len print super isinstance self cls"


def _words(said: str, flags: int = 0) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(said.split())})\b", flags)


def _c_rules(keywords: str, types: str) -> list[tuple[str, re.Pattern, int]]:
    return [("number", re.compile(NUMBER), 0), ("keyword", _words(keywords), 0), ("type", re.compile(rf"\b(?:{'|'.join(types.split())}|[A-Za-z_]\w*_T)\b"), 0), ("call", re.compile(CALL), 0)]


#: Strings of one line: closed, or to its end.
ESCAPED = r"{q}(?:[^{q}\\]|\\.)*(?:{q}|\\?\Z)"
BARE, TWICE = r"{q}[^{q}]*(?:{q}|\Z)", r"{q}(?:[^{q}]|{q}{q})*(?:{q}|\Z)"
#: The rest of a string of three quotes.
TRIPLE = r"(?:(?!{q})[^\\]|\\.)*{q}"


@dataclass
class Language:
    """rules: (kind, pattern, group) for what is neither comment nor string; of those that meet, the earlier rule's counts."""

    rules: list[tuple[str, re.Pattern, int]]
    string: str
    quotes: str = "\"'"
    line: str | None = None
    block: tuple[str, str] | None = None
    triples: bool = False
    directives: bool = False
    special: re.Pattern = field(init=False)
    tails: dict[int, re.Pattern] = field(init=False)

    def __post_init__(self) -> None:
        """Openers in one pattern, the longer before the shorter; a group that ends in a number leaves its state behind."""
        quoted = {SINGLE: "'''", DOUBLE: '"""'} if self.triples else {}
        parts = [f"(?P<string_{s}>{q}{TRIPLE.format(q=q)})|(?P<open_{s}>{q}.*)" for s, q in quoted.items()]
        parts += [f"(?P<comment>{self.line})"] if self.line else []
        self.tails = {s: re.compile(TRIPLE.format(q=q)) for s, q in quoted.items()}
        if self.block:
            a, z = map(re.escape, self.block)
            parts += [f"(?P<comment_1>{a}.*?{z})|(?P<open_1>{a}.*)"]
            self.tails[COMMENT] = re.compile(f".*?{z}")
        parts += [f"(?P<string>{'|'.join(self.string.format(q=q) for q in self.quotes)})"]
        self.special = re.compile("|".join(parts))


LANGUAGES = {
    "c": Language(_c_rules(C_WORDS, C_TYPES), ESCAPED, line="//.*", block=("/*", "*/"), directives=True),
    "cpp": Language(_c_rules(CPP_WORDS, CPP_TYPES), ESCAPED, line="//.*", block=("/*", "*/"), directives=True),
    "arxml": Language([("tag", re.compile(r"(?<=<)/?[A-Za-z_][\w.:-]*"), 0), ("attr", re.compile(r"\b[A-Za-z_][\w.:-]*(?=\s*=)"), 0)], BARE, block=("<!--", "-->")),
    "a2l": Language(
        [("keyword", re.compile(r"/(?:begin|end)\b", re.I), 0), ("type", re.compile(r"/(?:begin|end)\s+([A-Za-z_]\w*)", re.I), 1), ("number", re.compile(NUMBER), 0), ("keyword", _words(A2L_WORDS), 0), ("type", _words(A2L_VALUES), 0)],
        TWICE, quotes='"', line="//.*", block=("/*", "*/")),
    "python": Language([("number", re.compile(NUMBER), 0), ("keyword", _words(PY_WORDS), 0), ("type", _words(PY_TYPES), 0), ("call", re.compile(CALL), 0)], ESCAPED, line="#.*", triples=True),
    "json": Language([("number", re.compile(NUMBER), 0), ("keyword", _words("true false null"), 0)], ESCAPED, quotes='"'),
    # A number sign opens a comment after white space alone; elsewhere it ends what stands before it.
    "yaml": Language(
        [("attr", re.compile(r"(?<![\w.-])[A-Za-z_][\w.-]*(?=\s*:(?:\s|$))"), 0), ("number", re.compile(NUMBER), 0), ("keyword", _words("true false null yes no on off ~", re.I), 0)], BARE, line=r"(?<![^ \t])#.*)|(?P<nothing>#"),
}
DIRECTIVE = re.compile(r"\s*#\s*\w+")


def after(line: str, lang: Language, state: int) -> int:
    """The state after a line."""
    return _walk(line, lang, state)[1] if state or lang.tails else PLAIN


def _walk(line: str, lang: Language, state: int) -> tuple[list[tuple[int, int, str]], int]:
    """Comments, strings, directives and what parts the rest (kind nothing), in order, and the state after."""
    out, at = [], 0
    if not line:
        return out, state
    if state:
        kind = "comment" if state == COMMENT else "string"
        m = lang.tails[state].match(line) if state in lang.tails else None
        if not m:
            return [(0, len(line), kind)], state
        out.append((0, at := m.end(), kind))
    elif lang.directives and (m := DIRECTIVE.match(line)):
        out.append((0, at := m.end(), "preproc"))
    for m in lang.special.finditer(line, at):
        kind, _, left = m.lastgroup.partition("_")
        if kind == "open":
            return [*out, (*m.span(), "comment" if int(left) == COMMENT else "string")], int(left)
        out.append((*m.span(), kind))
    return out, PLAIN


def spans(line: str, lang: Language, state: int = PLAIN) -> tuple[list[tuple[int, int, str]], int]:
    """(lo, hi, kind) of a line's stretches that have a kind, in order, none over another; and the state after it."""
    known, then = _walk(line, lang, state)
    out, at = [x for x in known if x[2] != "nothing"], 0
    for lo, hi, _ in [*known, (len(line), len(line), "")]:
        if at < lo:
            free = bytearray(b"\1") * (lo - at)
            for kind, rule, group in lang.rules:
                for m in rule.finditer(line, at, lo):
                    a, z = m.span(group)
                    if a < z and all(free[a - at : z - at]):
                        free[a - at : z - at] = bytes(z - a)
                        out.append((a, z, kind))
        at = hi
    return sorted(out), then


def states(lines: list[str], lang: Language, state: int = PLAIN) -> list[int]:
    """The state before each line, and after the last."""
    out = [state]
    for x in lines:
        out.append(after(x, lang, out[-1]))
    return out


def block_function(lines: list[str], lang: Language) -> int:
    """The state after the lines for each state before them, two bits a state. A path that meets the first one is it from there on."""
    first = states(lines, lang)
    out = first[-1]
    for s in range(1, 4):
        now = s
        for k, x in enumerate(lines):
            if now == first[k]:
                now = first[-1]
                break
            now = after(x, lang, now)
        out |= now << 2 * s
    return out


def composed(first: Column, then: Column) -> Column:
    """Two functions of states, one after the other: each state is looked up in then by the bits that first gives it."""
    out = F.lit(0)
    for s in range(4):
        out = out + F.floor(then / F.pow(F.lit(4), F.floor(first / 4**s) % 4)) % 4 * 4**s
    return out.cast("int")


def _blocks(files: DataFrame, size: int) -> DataFrame:
    """rel, rules, last (block's number), block and lines of files (rel, text)."""
    rows = files.where("text is not null").select("rel", text.ruleset(F.col("rel")).alias("rules"), text.lines(text.unix_lines(F.col("text"))).alias("all"))
    last = F.floor((F.size("all") - 1) / size).cast("int")
    return rows.select("rel", "rules", last.alias("last"), F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("block"), F.slice("all", k * size + 1, F.lit(size)).alias("lines")))).alias("b")).select("rel", "rules", "last", "b.block", "b.lines")


def before_blocks(blocks: DataFrame) -> DataFrame:
    """rel, block and state, the state before each of blocks (rel, rules, block, lines)."""

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [block_function(x, LANGUAGES[r]) if r in LANGUAGES else 0 for r, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int32())], names=["rel", "block", "f"])

    known = written(blocks.select("rel", "rules", "block", "lines").mapInArrow(functions, "rel string, block int, f int"), "functions")
    most = (known.agg(F.max("block")).first()[0] or 0) + 1
    order, step, now = Window.partitionBy("rel").orderBy("block"), 1, known
    while step < most:
        earlier = F.lag("f", step).over(order)
        now = now.select("rel", "block", "f", earlier.alias("earlier")).select("rel", "block", F.when(F.col("earlier").isNull(), F.col("f")).otherwise(composed(F.col("earlier"), F.col("f"))).alias("f"))
        step *= 2
    return now.select("rel", "block", F.coalesce(F.lag("f", 1).over(order).bitwiseAND(3), F.lit(PLAIN)).alias("state"))


def lexed(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """rel, line (from 0), state (before it) and spans of every line of files (rel, text)."""
    blocks = _blocks(files, size)
    long = blocks.where("last > 0").repartition("rel", "block")
    met = blocks.where("last = 0").withColumn("state", F.lit(PLAIN)).unionByName(long.join(before_blocks(long), ["rel", "block"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel, rules, block, lines, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before, found, lang = [], [], LANGUAGES.get(rules)
                for x in lines:
                    before.append(state)
                    own, state = spans(x, lang, state) if lang else ([], PLAIN)
                    found.append([{"lo": a, "hi": z, "kind": k} for a, z, k in own])
                rows = [pa.array([rel] * len(lines)), pa.array(range(block * size, block * size + len(lines)), pa.int32()), pa.array(before, pa.int32()), pa.array(found, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.string())])))]
                yield pa.RecordBatch.from_arrays(rows, names=["rel", "line", "state", "spans"])

    return met.select("rel", "rules", "block", "lines", "state").mapInArrow(run, f"rel string, line int, state int, spans array<{SPAN}>")
