"""The prefix trie of conversations, against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from loomspan.llm import digests, q_trie, trie
from loomspan.llm.scratch import Scratch

SCHEMA = "conv_id long, turn int, role string, text string, place int, depth int, node string"


def sequences(rows):
    """Every conversation's rebuilt turns, by the contract."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 4
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(found):
    nodes = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        kids = [k for k in nodes if len(k) == len(node) + 1 and k[: len(node)] == node]
        below = [k for k in nodes if k[: len(node)] == node]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)]
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in members if len(found[c]) == len(node))))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, tmp_path, rows, name="t"):
    folder = tmp_path / name
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    got = q_trie.op11_prefix_trie(spark, str(folder))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def some_rows(draw):
    rows = []
    for c in [*range(0, 19), *range(21, 60), 100, 119, -1, -20, -21, -39]:  # 20 and 60 to 99 are absent
        for t in range(draw.randrange(1, 7)):
            rows.append((c, t, draw.choice(["user", "assistant", None, ""]), draw.choice(["a b", "c", "", None, "long \t text"]), 1, 2, "x"))
    rows += [(c, t, "user", f"same {t}", None, None, None) for c in range(200, 230) for t in range(5)]  # copies
    rows += [(300, t, "user", f"deep {t % 3}", None, None, None) for t in range(40)] + [(301, t, "user", f"deep {t % 3}", None, None, None) for t in range(33)]
    rows += [(7, None, "user", "first", None, None, None), (7, 2, "user", "tie", None, None, None), (7, 2, "assistant", "tie", None, None, None)]
    rows += [(8, 1, "user", "again", None, None, None)] * 3 + [(None, 1, "user", "no one's", None, None, None), (9, 9, "user", "word " * 20_000, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_trie_is_brute_force(spark, tmp_path, monkeypatch, block):
    """Blocks of 3 depths cut conversations and paths into many."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "HOT_SHARE", 10)
    rows = some_rows(random.Random(block))
    assert query(spark, tmp_path, rows) == brute(sequences(rows))


def test_turnless_conversations_and_none(spark, tmp_path):
    """Conversations that lose all turns are members of the root alone, which may be the only node."""
    bare = [c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4 >= 2][:3]
    rows = [(c, 1, "user", "gone", None, None, None) for c in bare]
    ends = hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest()
    assert query(spark, tmp_path, rows, "bare") == [(bare[0], 0, None, 3, 0, 1, 0, ends)]
    assert query(spark, tmp_path, [], "none") == []


def test_light_edges_are_few_and_ends_are_listed(spark):
    """A comb: each conversation leaves the one before a turn later; its paths are of two levels."""
    scratch = Scratch(spark, "comb")
    rows = [(c, t, bytes([t if t < c else 200 + t]), 1, t == c) for c in range(1, 30) for t in range(1, c + 1)]
    turns = scratch.keep(spark.createDataFrame(rows, "conv_id long, depth long, digest binary, words long, last boolean"), "turns")
    convs = scratch.keep(spark.createDataFrame([(c, c) for c in range(1, 30)], "conv_id long, total long"), "convs")
    made = trie.prefix_trie(turns, convs, scratch)
    assert sorted(r.member for r in made.ends.collect()) == list(range(1, 30))
    assert {r.n_leaves for r in made.nodes.where("depth = 0").collect()} == {29}
    assert spark.read.parquet(f"{scratch.base}/on-paths").agg({"level": "max"}).head()[0] <= 5


def test_long_lists_are_hashed_in_pieces(spark):
    n = digests.PIECE * 2 + 5
    scratch = Scratch(spark, "pieces")
    rows = scratch.keep(spark.range(n).selectExpr("1L as a", "id % 2 as b", f"id * 7 - {n} as value").unionByName(spark.createDataFrame([(0, 0, 5)], "a long, b long, value long")), "rows")
    got = {(r.a, r.b): r.sha256 for r in digests.joined_sha256(rows, scratch, "made").collect()}
    want = {(1, b): ",".join(str(i * 7 - n) for i in range(b, n, 2)) for b in (0, 1)} | {(0, 0): "5"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
