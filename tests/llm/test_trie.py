"""The conversation trie against a plain one, with small containers and pieces so that every path is taken."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from driftlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def plain(rows):
    """{(conv_id, depth): rest} of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(full.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, sums = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for x in children[p]:
            leaves, saved = leaves + sums[x][0], saved + sums[x][1]
        sums[p] = leaves, saved
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, sha)
    return out


def given(spark, rows, **k):
    found = trie.nodes(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3), **k).collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found}
    assert len(out) == len(found)
    return out


def table():
    rnd = random.Random(5)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 3, "user", "a"), (7, 3, "user", "a"), (7, 2, "b", None), (-7, 1, "user", "neg"), (-105, 0, "x", "y")]
    for c in [*range(0, 12), *range(100, 112), *range(205, 212), 2**40]:
        if rnd.random() < 0.3:  # copies of one conversation
            rows += [(c, t, "user", f"same {t}") for t in range(6)]
        else:
            rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["é" * 4, "yes", ""])) for t in range(rnd.randint(1, 9))]
    for c in (300, 301):  # alike for long, then not
        rows += [(c, t, "user", f"long {t}") for t in range(40)] + [(c, 99, "user", f"end {c}")]
    rows += [(400, t, "user", f"alone {t}") for t in range(60)]
    return rows


@pytest.mark.parametrize(("limit", "piece"), [(3, 4), (20, 3), (4096, 4096), (1, 5)])
def test_nodes_are_those_of_a_plain_trie(spark, limit, piece):
    assert given(spark, table(), limit=limit, piece=piece) == plain(table())


def test_empty_table_and_turnless_conversations(spark):
    assert given(spark, []) == {} == given(spark, [(None, 1, "user", "x")])
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(gone, 0, "user", "a"), (gone, 1, "user", "b")]  # its head is absent, and its first turns are the head's
    assert given(spark, rows, limit=1, piece=1) == plain(rows) == {(gone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())}


def test_ids_of_a_hot_end_pass_in_blocks(spark):
    rows = [(c, 0, "user", "hi") for c in range(0, 30_000, 3)]
    assert given(spark, rows, limit=50) == plain(rows)
