"""Prefix trie of conversations from padded turn-id matrices, in range shards.

A turn is known by 16 bytes of the SHA-256 of its role and text, so texts never travel. Conversations are dealt by ranges of
(turn sequence, id): copies of one conversation spread over shards like any others. A shard numbers its turns in byte order, pads
the sequences to matrices (in column blocks, so that one long conversation widens no other row), sorts them by ``numpy.lexsort``,
and accumulates by OR down each row where it differs from the row before; at a depth, the rows that differ start the nodes and
``reduceat`` adds up their members. Every measure is a sum over members that needs only how many turns a row shares with the row
before and after it, so a node that spans shards is the sum of its parts. Those boundary nodes (a path at each end of a shard) meet
under a hash of their prefix and are recombined; all others are whole in their shard.

Defined cases: rows with a null conversation id belong to none and are left out; null roles and texts are empty; turns without a number
come first, and turns of one number follow their digest; repeated rows are repeated turns; ids may be negative (the remainder has the
sign of the id); an empty table has no nodes, not even a root. Other columns are not looked at. One conversation is one row of
24 bytes a turn, so a single conversation must fit in a task; the number of conversations that share turns has no limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, stash

#: Turns in a shard, columns in a block of the padded matrix, ids in a segment of a boundary node's list.
SHARD_TURNS, BLOCK, SEGMENT = 400_000, 32, 400
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = ("shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string, ends array<string>")


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written table (conv_id, seq array<binary>, words array<long>): each conversation's turn digests and word counts in order."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
                 F.regexp_count(said, F.lit(WORD)).cast("long").alias("n")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return stash(own.select("conv_id", F.transform("t", lambda x: x["digest"]).alias("seq"), F.transform("t", lambda x: x["n"]).alias("words")),
                 "turn-sequences")


def rebuild(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first h turns replaced by those of conversation c - c % every; h = crc32(decimal c) % most."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    heads = own.where(c % every == 0).select(c.alias("base"), *[F.slice(x, 1, most - 1).alias(f"head_{x}") for x in ("seq", "words")])
    both = own.join(heads, c - c % every == F.col("base"), "left")

    def joined(name: str, kind: str):
        head = F.coalesce(F.slice(f"head_{name}", F.lit(1), h), F.array().cast(kind))
        return F.concat(head, F.slice(name, h + 1, F.size(name) + 1)).alias(name)
    return both.select("conv_id", joined("seq", "array<binary>"), joined("words", "array<long>"))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading rows that two digest arrays have in common."""
    n = min(len(a), len(b))
    same = (a[:n] == b[:n]).all(axis=1)
    return n if same.all() else int(same.argmin())


def turn_ids(digests: np.ndarray) -> np.ndarray:
    """1, 2, ... for each digest in byte order; 0 is left for padding."""
    words = np.ascontiguousarray(digests).view(">u8").reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    new = np.r_[True, (words[order][1:] != words[order][:-1]).any(axis=1)][:len(order)]
    ids = np.zeros(len(order), np.int64)
    ids[order] = np.cumsum(new)
    return ids


def _padded(ids: np.ndarray, at: np.ndarray, size: np.ndarray, block: int) -> np.ndarray:
    """Columns block * BLOCK and on of the rows that start at ``at``; 0 behind a row's end."""
    col = block * BLOCK + np.arange(BLOCK)
    inside = col < size[:, None]
    return np.where(inside, ids[np.where(inside, at[:, None] + col, 0)], 0)


def sorted_rows(ids: np.ndarray, at: np.ndarray, size: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Row order by (sequence, id), a prefix before what extends it: stable sorts from the last column block to the first."""
    order = np.argsort(conv, kind="stable")
    for block in range((int(size.max(initial=0)) - 1) // BLOCK, -1, -1):
        longer = size[order] > block * BLOCK
        rows = order[longer]
        matrix = _padded(ids, at[rows], size[rows], block)
        order = np.r_[order[~longer], rows[np.lexsort(matrix.T[::-1])]]
    return order


def shard_nodes(conv: np.ndarray, digests: np.ndarray, words: np.ndarray, size: np.ndarray,
                before: np.ndarray | None, after: np.ndarray | None) -> Iterator[dict]:
    """The nodes of one shard, by depth. ``before`` and ``after`` are the digests of the last row of the shard before and of the
    first row of the next one. A node that one of them shares has a ``key`` and the sums of this shard's members only."""
    at = np.r_[0, size.cumsum()][:-1]
    ids = turn_ids(digests)
    order = sorted_rows(ids, at, size, conv)
    conv, at, size = conv[order], at[order], size[order]
    n = len(conv)
    first, last = digests[at[0]:at[0] + size[0]], digests[at[-1]:at[-1] + size[-1]]
    left = -1 if before is None else shared(before, first)          # depths up to this go on from the shard before
    right = -1 if after is None else shared(last, after)

    # change masks: common[r] counts the turns that row r shares with the row before it
    common, changed = np.zeros(n, np.int64), np.zeros(n, bool)
    levels = [(np.arange(n), np.zeros(1, np.int64))]                # members and where nodes start, by depth
    for block in range(-(-int(size.max(initial=0)) // BLOCK)):
        rows = np.flatnonzero(size > block * BLOCK)
        matrix = _padded(ids, at[rows], size[rows], block)
        differs = np.ones(matrix.shape, bool)
        differs[1:] = (matrix[1:] != matrix[:-1]) | (rows[1:] != rows[:-1] + 1)[:, None]
        if rows[0] == 0:
            differs[0] = block * BLOCK + 1 + np.arange(BLOCK) > left
        differs[:, 0] |= changed[rows]
        differs = np.logical_or.accumulate(differs, axis=1)
        changed[rows] = differs[:, -1]
        common[rows] += (~differs & (matrix != 0)).sum(axis=1)
        for j in range(BLOCK):
            inside = matrix[:, j] != 0
            if not inside.any():
                break
            starts = differs[inside, j]
            starts[0] = True                                        # a node from the shard before starts here, too
            levels.append((rows[inside], np.flatnonzero(starts)))

    follows = np.r_[common[1:], right]
    leaf = follows < size                                           # -1 behind the last row of all
    tokens = np.r_[0, words.cumsum()]
    names = conv.astype(str).tolist()

    def keys(path: np.ndarray, depth: int) -> list[bytes]:
        h, out = hashlib.blake2b(digest_size=16), []
        for d in range(depth + 1):
            out.append(h.digest())
            if d < depth:
                h.update(path[d].tobytes())
        return out
    left_keys, right_keys = keys(first, left), keys(last, right)

    above = None
    for depth, (rows, starts) in enumerate(levels):
        head = rows[starts]
        saved = np.where(common[rows] >= depth, tokens[at[rows] + common[rows]] - tokens[at[rows] + max(depth, 1) - 1], 0)
        add = lambda x: np.add.reduceat(x.astype(np.int64), starts)
        low, n_ends = np.minimum.reduceat(conv[rows], starts), add(size[rows] == depth)
        key = np.full(len(starts), None, object)
        if depth <= right and rows[-1] == n - 1:
            key[-1] = right_keys[depth]
        if depth <= left and rows[0] == 0:
            key[0] = left_keys[depth]
        own = np.zeros(len(starts), np.int64) if above is None else np.searchsorted(above[0], head, side="right") - 1
        sha, lists = np.full(len(starts), NO_ENDS, object), np.full(len(starts), None, object)
        for k in np.flatnonzero(n_ends).tolist():
            ends = names[head[k]:head[k] + n_ends[k]]
            if key[k] is None:
                sha[k] = hashlib.sha256(",".join(ends).encode()).hexdigest()
            else:
                lists[k] = [",".join(ends[i:i + SEGMENT]) for i in range(0, len(ends), SEGMENT)]
        yield {"key": key, "parent_key": np.full(len(starts), None, object) if above is None else above[1][own], "conv_id": low,
               "depth": np.full(len(starts), depth, np.int64), "parent_conv_id": None if above is None else above[2][own],
               "n_convs": np.diff(np.r_[starts, len(rows)]), "n_children": add((size[rows] > depth) & (common[rows] <= depth)),
               "n_leaves": add(leaf[rows]), "saved_tokens": add(saved), "ends_sha256": sha, "ends": lists}
        above = (head, key, low)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


def _shard(key: tuple, rows: pa.Table, edge: pa.Table) -> pa.Table:
    schema = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()),
                        *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                        ("ends_sha256", pa.string()), ("ends", pa.list_(pa.string()))])
    seq, words = rows.column("seq").combine_chunks(), rows.column("words").combine_chunks()
    sizes = seq.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    near = [None if (v := edge.column(c)[0].as_py()) is None else np.frombuffer(b"".join(v), np.uint8).reshape(-1, 16) for c in ("before", "after")]
    out = []
    for level in shard_nodes(rows.column("conv_id").to_numpy(), _digests(seq.flatten()), words.flatten().to_numpy(zero_copy_only=False), sizes, *near):
        n = len(level["conv_id"])
        level["shard"] = np.full(n, key[0].as_py(), np.int32)
        out.append(pa.table([pa.nulls(n, f.type) if level[f.name] is None else pa.array(level[f.name], f.type) for f in schema], schema=schema))
    return pa.concat_tables(out).combine_chunks()


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's segments, which come in order; only the running state of one key is held."""
    key, h = None, hashlib.sha256()
    for pdf in batches:
        done = []
        for k, piece in zip(pdf["key"], pdf["piece"]):
            k = bytes(k)
            if k != key:
                if key is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends_sha256"])


def trie(seqs: DataFrame, shards: int) -> DataFrame:
    """The nodes of the trie over (conv_id, seq, words), dealt to ``shards`` ranges."""
    dealt = stash(seqs.repartitionByRange(shards, "seq", "conv_id").withColumn("shard", F.spark_partition_id()), "turn-shards")
    ends = dealt.groupBy("shard").agg(F.min(F.struct("seq", "conv_id"))["seq"].alias("first"), F.max(F.struct("seq", "conv_id"))["seq"].alias("last"))
    line = Window.orderBy("shard")                                  # a row per shard
    edges = ends.select("shard", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    nodes = stash(dealt.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_shard, NODES), "trie-parts")

    parts = nodes.where("key IS NOT NULL")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = stash(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
                                            *[F.sum(c).alias(c) for c in sums]), "trie-boundary")
    pieces = parts.select("key", "shard", F.posexplode("ends").alias("pos", "piece"))
    listed = pieces.repartition("key").sortWithinPartitions("key", "shard", "pos").mapInPandas(_chain, "key binary, ends_sha256 string")
    owner = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    spanning = merged.join(owner, "parent_key", "left").join(listed, "key", "left") \
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    # a boundary node's children that are whole in their shard: its id comes by shard, so that the root is no hot key
    local = parts.select("shard", F.col("key").alias("parent_key")).join(owner, "parent_key")
    inner = nodes.where("key IS NULL")
    under = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(local, ["shard", "parent_key"])
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    return inner.where("parent_key IS NULL").select(*columns).unionByName(under.select(*columns)).unionByName(spanning.select(*columns))


def conversation_trie(df: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations; see the module for the columns' meaning and the defined cases."""
    own = sequences(df)
    turns = own.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    out = trie(rebuild(own), n_parts(df.sparkSession, turns, SHARD_TURNS))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
