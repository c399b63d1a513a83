"""The prefix trie against one built node by node in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_query_is_the_plain_trie(spark, small, middle):
    for sf_dir in (small, middle):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert got(prefix_trie.op11_prefix_trie(spark, sf_dir)) == brute(rows)


def made_up(seed, convs, longest, vocabulary):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rng.choice([1, 2, 3, rng.randint(1, longest)])
        same = rng.random() < 0.6  # most follow one common line for a while
        for t in range(n):
            text = f"common {t} words" if same and rng.random() < 0.9 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 3)))
            rows.append((c * 3, t, "user" if t % 2 else "assistant", text))
    return rows


@pytest.mark.parametrize(("seed", "size", "run"), [(1, 128, 4096), (2, 3, 2), (3, 1, 1), (4, 2, 5), (5, 4, 3)])
def test_small_segments_and_runs_change_nothing(spark, monkeypatch, seed, size, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = made_up(seed, 60, 14, ["a", "b", "c"])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(prefix_trie.prefix_trie(df, size)) == brute(rows)


def test_copies_and_hot_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(5)]
    rows += [(c, t, "user", "first" if t == 0 else f"own {c} {t}") for c in range(400, 700) for t in range(3)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 2)) == brute(rows)


def test_one_conversation_of_many_turns(spark, monkeypatch):
    rows = [(7, t, "user", "again") for t in range(3000)] + [(27, t, "user", "again") for t in range(2990)] + [(c, 0, "user", "x y") for c in range(40, 50)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


ODD = [
    (20, None, None, None), (20, 1, "user", ""), (20, 0, "", None), (21, 5, "user", " a\tb\x0b c\n"), (None, 1, "user", "lost"), (22, 1, "user", "only"), (41, 0, None, "no base"), (41, 1, None, "no base"),
    (41, 2, "u", "x"), (41, 3, "u", "long " * 50_000), (41, 4, "u", "x"), (-19, 0, "u", "below"), (-19, 1, "u", "below"), (-20, 0, "u", "base"), (-20, 1, "u", "base 2"), (-20, 2, "u", "base 3"), (-20, 3, "u", "b"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"depth": F.lit("clash"), "codes": F.lit("clash"), "rank": F.lit("clash")})
    assert got(prefix_trie.prefix_trie(df)) == brute(ODD)


def test_repeated_turns_count(spark):
    rows = [(20, 1, "user", "same"), (20, 1, "user", "same"), (21, 1, "user", "same"), (21, 1, "user", "same"), (21, 2, "user", "more")]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_turnless_conversations(spark):
    rows = [(c, 0, "user", "one turn") for c in range(61, 80)]  # no base; those that begin behind their first turn have none left
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    none = [(c, 0, "user", "x") for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(none, SCHEMA))) == brute(none)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
