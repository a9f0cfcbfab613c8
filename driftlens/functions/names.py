"""Generated and authored identifiers, facts by pattern, labels: scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.text import IDENT, WORD, let, strip_comments

# How generated names, fields, temporaries and authored names look.
GENERATED = r"^(?:rtb|rtu|rty|rtDW|rtP|rtC|rtZC|rtPrevZC|localB|localDW|localP|localX|localZCE)_"
STATE_FIELD = r"_(?:DSTATE|PreviousInput|ELAPS_T|MODE|SubsysRanBC|AlreadyDone|Buffer|BufferPtr|Index|FirstOutput|RandSeed|SEED)(?=_|$)"
TAIL = r"_(?:[a-z]\p{Nd}{0,2}|(?=[a-z0-9]*\p{Nd})[a-z0-9]{8,12})$"
SEGMENT = r"(?<=_)(?=[a-z0-9]*\p{Nd})[a-z0-9]{8,12}(?=_)"
SHORT_TAIL = r"_[a-z]\p{Nd}{0,2}$"
TEMPORARY = r"^(tmp|idx|loop_ub|[ijk])(?:_\p{Nd}+)?$"
ALL_CAPS = r"^[A-Z][A-Z0-9_]*$"
RTE_VERBS = (
    "Read DRead Write Send Receive Invalidate Feedback IFeedback Call Result Pim CData Prm IStatus IsUpdated IrvRead IrvWrite IrvIRead IrvIWrite IRead IWrite IWriteRef "
    "IInvalidate Mode Switch SwitchAck Trigger IrTrigger Enter Exit"
).split()
RTE = rf"(?<!{WORD})Rte_(?:{'|'.join(RTE_VERBS)})_{WORD}+"
A2L_OBJECT = rf"(?i)/begin\s+(CHARACTERISTIC|MEASUREMENT)\s+([A-Za-z_](?:{WORD}|[.\[\]])*)"
A2L_STRING = r'"(?:""|[^"\n])*"'


def generated_root(name: Column) -> Column:
    """The name without its generated tail if the generator owns it, else null."""
    return F.when(name.rlike(GENERATED) | name.rlike(STATE_FIELD), F.regexp_replace(name, TAIL, ""))


def checksum_root(name: Column) -> Column:
    """The name without the checksums within it, else null."""
    return F.when(name.rlike(SEGMENT), F.regexp_replace(name, SEGMENT, ""))


def is_authored(name: Column) -> Column:
    """Names declared elsewhere: access points, state fields, constants."""
    return name.rlike(f"^{RTE}$") | name.rlike(STATE_FIELD) | name.rlike(ALL_CAPS)


def canonical_generated(text: Column) -> Column:
    """Each generated identifier in a text by its root. All of them hold an underscore, so a text without one is as it is."""

    def by_parts(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(rf"(?s){IDENT}|[^A-Za-z_]++|."), 0)
        return F.when(F.contains(t, F.lit("_")), F.array_join(F.transform(parts, lambda x: F.coalesce(generated_root(x), checksum_root(x), x)), "")).otherwise(t)

    return let(text, by_parts)


def same_checksummed(a: Column, b: Column) -> Column:
    """False only if both names carry a checksum and differ without it."""
    return F.coalesce(checksum_root(a) == checksum_root(b), F.lit(True))


def autogen_pair(a: Column, b: Column, old_ids: Column, new_ids: Column) -> Column:
    """Whether b may be a, generated anew. old_ids and new_ids are all identifiers of either side."""
    vanished = ~F.array_contains(new_ids, a) & ~F.array_contains(old_ids, b)
    bare = F.regexp_replace(a, SHORT_TAIL, "")
    return (
        F.when(a == b, False)
        .when(generated_root(a) == generated_root(b), True)
        .when(checksum_root(a) == checksum_root(b), vanished)
        .when(a.rlike(TEMPORARY) & b.rlike(TEMPORARY), F.regexp_extract(a, TEMPORARY, 1) == F.regexp_extract(b, TEMPORARY, 1))
        .when((bare != "") & (bare == F.regexp_replace(b, SHORT_TAIL, "")), vanished)
        .otherwise(False)
    )


def rte_calls(text: Column) -> Column:
    """Access points of C text, sorted, comments aside."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(strip_comments(text, "c"), F.lit(RTE), 0)))


def a2l_objects(text: Column) -> Column:
    """(name, kind) of calibration objects, comments and strings aside; of equal names the last."""
    bare = F.regexp_replace(strip_comments(text, "a2l"), A2L_STRING, " ")
    p = F.lit(A2L_OBJECT)
    pairs = F.zip_with(F.regexp_extract_all(bare, p, 2), F.regexp_extract_all(bare, p, 1), lambda n, k: F.struct(n.alias("name"), F.upper(k).alias("kind")))
    return F.filter(pairs, lambda x: x["name"].isNotNull())


def mode_of(kind: Column) -> Column:
    """How a hunk's rows are painted."""
    return F.when(kind.isin("real", "moved", "comment"), kind).otherwise(F.lit("minor"))


def iface_kind(tag: Column) -> Column:
    return F.regexp_replace(tag, "-INTERFACE$", "")


def short_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def digest(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts, each ended by NUL."""
    return F.substr(F.sha1(F.concat(*[x for p in parts for x in (p.cast("binary"), F.lit(b"\x00"))])), F.lit(1), F.lit(16))


def kinds_said(kinds: Column) -> Column:
    """Noise kinds of a file, sorted, in words."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(kinds, lambda k: ~k.isin("real", "moved")))), ", ")
