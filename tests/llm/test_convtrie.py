import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from retentia.llm import convtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    """Nodes by a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        todo, out = [p], []
        while todo:
            out.append(todo.pop())
            todo += children.get(out[-1], [])
        return out
    result = []
    for p, members in nodes.items():
        sub = below(p)
        ends = sorted(c for c in members if len(full[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in sub if q)
        result.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])),
                       sum(q not in children for q in sub), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(result, key=repr)


def made(seed, convs, longest, words=4):
    rng = random.Random(seed)
    out = []
    for c in range(-convs // 4, convs):
        if rng.random() < 0.15:
            continue                                                # some bases are absent
        for turn in range(rng.randint(1, longest)):
            out.append((c, turn, rng.choice(["user", "user", "bot", None]), rng.choice(["", "a", "a b", "c d  e", None][:words + 1])))
    out += [(5, 1, "user", "a"), (5, 1, "user", "a"), (6, None, "x", "first"), (7, None, None, None), (None, 1, "user", "lost"), (41, 2, "us", "era")]
    rng.shuffle(out)
    return out


def nodes_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 2, 40])
def test_equals_prefix_dictionary(spark, shards, monkeypatch):
    rows = made(shards, 120, 6)
    rows += [(1000 + 20 * k, t, "user", "hot") for k in range(60) for t in range(3)]          # a third are copies
    df = spark.createDataFrame(rows, SCHEMA)
    seqs = convtrie.rebuild(convtrie.sequences(df.selectExpr("*", "'k' AS key", "1 AS shard", "2 AS seq").repartition(3)))
    assert nodes_of(convtrie.trie(seqs, shards)) == plain(rows)


def test_defined_cases(spark):
    assert convtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert convtrie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    for rows in ([(3, 0, "user", "x")], [(20, None, None, None)], [(c, 0, "user", "same") for c in range(20, 40)],
                 [(c, t, "u", "long text " * 5000) for c in (0, 1, 2) for t in range(70 + c)]):
        assert nodes_of(convtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_turnless_conversations(spark):
    # h turns come from an absent base, so nothing is left
    rows = [(c, 0, "user", "only") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = nodes_of(convtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and len(got) == 1 and got[0][3] == len(rows)


@pytest.mark.parametrize("block", [1, 3, 32])
def test_shards_add_up_in_blocks(block, monkeypatch):
    """Without Spark: every cut of the sorted rows gives the same nodes, whatever the column block."""
    monkeypatch.setattr(convtrie, "BLOCK", block)
    monkeypatch.setattr(convtrie, "SEGMENT", 2)
    rng = random.Random(block)
    seqs = [[rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 5, 9]))] for _ in range(60)] + [["z"] * 7] * 20
    rows = sorted((tuple(hashlib.md5(x.encode()).digest() for x in s), c, [len(x) + ord(x) % 5 for x in s]) for c, s in enumerate(seqs))

    def arrays(part):
        flat = b"".join(b"".join(s) for s, _, _ in part)
        return (np.array([c for _, c, _ in part]), np.frombuffer(flat, np.uint8).reshape(-1, 16),
                np.array([w for _, _, ws in part for w in ws], np.int64), np.array([len(s) for s, _, _ in part]))
    path = lambda r: np.frombuffer(b"".join(r[0]), np.uint8).reshape(-1, 16)

    def total(cuts):
        edges = [0, *cuts, len(rows)]
        whole, open_, ends = [], {}, {}
        for a, b in zip(edges, edges[1:]):
            part = rows[a:b]
            rng.shuffle(part)
            for lv in convtrie.shard_nodes(*arrays(part), path(rows[a - 1]) if a else None, path(rows[b]) if b < len(rows) else None):
                for k in range(len(lv["conv_id"])):
                    sums = np.array([int(lv[c][k]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
                    if lv["key"][k] is None:
                        whole.append((int(lv["depth"][k]), int(lv["conv_id"][k]), *sums.tolist(), lv["ends_sha256"][k]))
                    else:
                        key = (lv["key"][k], int(lv["depth"][k]))
                        low, old = open_.get(key, (1 << 60, 0))
                        open_[key] = (min(low, int(lv["conv_id"][k])), old + sums)
                        ends.setdefault(key, []).extend(lv["ends"][k] or [])
        return sorted(whole + [(d, low, *s.tolist(), hashlib.sha256(",".join(ends[k, d]).encode()).hexdigest()) for (k, d), (low, s) in open_.items()])
    want = total([])
    for _ in range(20):
        assert total(sorted(rng.sample(range(1, len(rows)), rng.randint(1, 30)))) == want


def test_query_equals_its_sql(spark):
    import duckdb
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{data}/conversations.parquet')")
    got = queries.op13_conversation_trie(spark, data)
    want = con.execute(queries.ORACLES["op13_conversation_trie"])
    assert sorted(got.columns) == sorted(c[0] for c in want.description) == sorted(COLUMNS)
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.fetchall()))
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    assert nodes_of(got) == plain(rows)
