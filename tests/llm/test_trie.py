"""The conversation trie against plain loops, on odd conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from strandweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, base string, chain int"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == node)
        above = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), above, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(spark, rows):
    docs = spark.createDataFrame([(*r, "n", "b", 1) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, trie.conversation_trie(docs).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_loops(spark, seed, monkeypatch):
    if seed == 2:  # tries in parts, identifiers in pieces
        monkeypatch.setattr(trie, "NODES_AT_ONCE", 3)
        monkeypatch.setattr(trie, "IDS_AT_ONCE", 2)
    r = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 10**12 + 3, (1 << 63) - 1]:
        if c % 7 == 3:
            continue
        for t in range(r.choice([1, 2, 2, 3, 12])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, f"x{r.randrange(3)}", "long " * 50])))
    rows += [(None, 0, "user", "lost"), rows[5], rows[5]]
    assert rows_of(spark, rows) == brute(rows)


def test_many_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "NODES_AT_ONCE", 100)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(9)] + [(1000, t, "user", f"turn {t % 13}") for t in range(700)]
    assert rows_of(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(None, 1, "user", "a")]) == []
