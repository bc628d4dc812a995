"""Operator 11 against a trie of Python dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lorewell.llm import trie
from lorewell.llm.trie import op11_prefix_trie, prefix_trie
from lorewell.session import table
from tests.conftest import SF

COLUMNS = [c.split()[0] for c in trie.NODE.split(", ")]


def plain(rows):
    """rows (conv_id, turn, role, text) by the definition, one row a node."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            up = node[:-1]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    return sorted(
        repr((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())) for k, m in members.items()
    )


def got(df):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def test_conversations(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_prefix_trie(spark, SF)) == plain(rows)
    assert got(prefix_trie(table(spark, SF, "conversations"), local=8)) == plain(rows)


@pytest.mark.parametrize(("bits", "local"), [(12, 1 << 14), (1, 3)])
def test_shapes(spark, bits, local):
    """Copies, a long common prefix, one long conversation, prefixes of others, nulls, repeated rows, negative and missing ids."""
    rows = []
    for c in range(1001, 1040):  # no conversation 1000: what is below h goes
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    for c in range(200, 210):
        rows += [(c, t, "user", f"shared {t}" if t < 12 else f"own {c % 3} {t}") for t in range(12 + c % 4)]
    rows += [(5, t, "a", f"x{t % 7}") for t in range(60)]
    rows += [(6, None, None, None), (6, None, None, None), (6, 0, "a", ""), (6, 0, "a", "b"), (None, 1, "a", "lost"), (-5, 1, "u", "neg"), (-205, 1, "u", "neg"), (300, 0, "u", "é中😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "map('k', turn) AS tid").repartition(4)
    # equal turns of one place are ordered by a digest: the definition leaves their order open
    want = plain([r if r[:2] != (6, 0) else (6, 0 if r[3] == min(("", "b"), key=lambda t: hashlib.sha256(f"1:a{t}".encode()).digest()) else 0.5, r[2], r[3]) for r in rows])
    assert got(prefix_trie(df, local, bits)) == want


def test_empty_and_single(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert got(prefix_trie(spark.createDataFrame([(7, 1, "u", "a")], schema))) == plain([(7, 1, "u", "a")])
