"""Token-id files with a minimal perfect hash index from document key to place.

A store is a folder, written by Spark's own committers, so lost tasks leave nothing behind:

* ``shards/``: the rows of shards of consecutive doc_ids, in one file per bucket of the shard number. A shard has one index row
  (``page`` -1) and its payload in pages: the ids of its documents in ascending doc_id order as little-endian unsigned
  16- or 32-bit integers, ``width`` bytes each, at most ``PAGE`` bytes to a row. The index row holds ``levels`` (the bit words of the
  minimal perfect hash, with the number of set bits before each block), ``prints`` (an 8-byte fingerprint per slot) and
  ``places`` (per slot: first id within the shard, number of ids).
* ``starts/``: per shard its first (doc_id, number among equal doc_ids) and the number of ids in all shards before it.

The minimal perfect hash is built level by level: keys that hit a bit alone keep it, colliding keys go on to the next, smaller
level; a key's slot is the number of set bits before its own. A lookup reads one bit per level (1.6 on average), at most a block
of words to count, one fingerprint and one place, all in the stored bytes, whatever the shard's size.

Payload is shuffled once, into shards. A lookup sends keys to shards; the shards are read where they lie, since their
files are bucketed by shard, and few asked shards prune the other buckets. Shards hold at most about ``docs_per_shard``
rows and ``SHARD_BYTES`` of text (or one longer text), also where one doc_id has a third of all rows: limits are (doc_id, text hash, salt), and equal doc_ids are numbered across shards.

Defined cases: a null text is empty (the end id alone); repeated doc_ids are repeated keys, each row is stored in the order
of its text's hash and answered in that order; a null doc_id sorts first and is a key like any other.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.operators.ordered import rank_within

from .bpe import encoder, read_json
from .common import lean, n_parts, shared_dir, slices, stash
from .hashing import U64, mix

GAMMA, LEVELS = 2.0, 40
#: Bytes of a page; words of a counted block; files at most; asked shards up to which the others' files are not opened.
PAGE, BLOCK, BUCKETS, FEW = 256 << 10, 8, 20_000, 200
#: Text bytes of a shard, and small ranges that make one.
SHARD_BYTES, FINE = 6 << 20, 8
SHARDS = ("shard int, page int, n_ids long, width int, payload binary, first_key long, first_nth long, levels array<binary>, "
          "prints binary, places binary")
PLACE = np.dtype([("start", "<i8"), ("n", "<i8")])
LIMIT = np.dtype([("key", "<i8"), ("tie", "<i8"), ("salt", "<i8")])
LOW = np.dtype([("key", "<i8"), ("nth", "<i8")])


def _seeded(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys ^ mix(np.full(1, 0xC0FFEE + level, U64)))


class Level:
    """Bits of one level in 64-bit words, and the set bits before each block of words; views of stored bytes."""

    def __init__(self, size: int, words: np.ndarray, before: np.ndarray):
        self.size, self.words, self.before = size, words, before

    @classmethod
    def of(cls, bits: np.ndarray) -> Level:
        blocks = -(-len(bits) // (64 * BLOCK))
        packed = np.zeros(blocks * BLOCK * 8, np.uint8)
        packed[:-(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        words = packed.view("<u8")
        ones = np.bitwise_count(words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        return cls(len(bits), words, np.r_[0, ones.cumsum()].astype("<i8"))

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each bit is set, and the number of set bits before it."""
        word = at >> 6
        mine = self.words[word]
        below = (at & 63).astype(U64)
        block = word // BLOCK
        rank = self.before[block] + np.bitwise_count(mine & ((U64(1) << below) - U64(1)))
        for j in range(BLOCK - 1):
            other = block * BLOCK + j
            rank += np.where(other < word, np.bitwise_count(self.words[other]), 0)
        return (mine >> below) & U64(1) == 1, rank

    def stored(self) -> bytes:
        return self.size.to_bytes(8, "little") + self.words.tobytes() + self.before.tobytes()

    @classmethod
    def view(cls, data: bytes) -> Level:
        size = int.from_bytes(data[:8], "little")
        words = -(-size // (64 * BLOCK)) * BLOCK
        return cls(size, np.frombuffer(data, "<u8", words, 8), np.frombuffer(data, "<i8", offset=8 + 8 * words))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: key -> slot in [0, n)."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.before[-1]) for x in levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys.astype(U64)
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            m = max(64, int(GAMMA * len(rest)) | 1)
            at = (_seeded(rest, len(levels)) % U64(m)).astype(np.int64)
            hits = np.bincount(at, minlength=m)
            levels.append(Level.of(hits == 1))
            rest = rest[hits[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where no level has the key's bit (then it is no key; other strangers get a key's slot)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            hit, rank = level.find((_seeded(keys[todo], k) % U64(level.size)).astype(np.int64))
            out[todo[hit]] = self.before[k] + rank[hit]
            todo = todo[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [x.stored() for x in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        return cls([Level.view(x) for x in levels])


def _keys(docs: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """One key per row: doc_id and its number among rows with that doc_id."""
    return mix(docs.astype(U64)) + nth.astype(U64) * U64(0x9E3779B97F4A7C15)


def _prints(keys: np.ndarray) -> np.ndarray:
    return mix(keys + U64(0x1234567))


def _nth(docs: np.ndarray) -> np.ndarray:
    """Number of each element among its equals; equals are adjacent."""
    new = np.r_[True, docs[1:] != docs[:-1]] if len(docs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return np.arange(len(docs)) - np.repeat(at, np.diff(np.r_[at, len(docs)]))


NULL_DOC = np.iinfo(np.int64).min


def _tokenise(model, end_id: int, limits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, cut = encoder(*model.value), limits.value
        width = "<u2" if bpe.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], width).tobytes()
        for pdf in slices(batches, "text", 4 << 20):
            ids = [x.astype(width).tobytes() + end for x in bpe.encode(pdf.text.tolist())]
            at = np.rec.fromarrays([pdf[c].to_numpy(np.int64) for c in LIMIT.names], LIMIT)
            yield pd.DataFrame({"shard": (np.searchsorted(cut, at, "right") - 1).clip(0).astype(np.int32),
                                "key": pdf.key, "tie": pdf.tie, "salt": pdf.salt, "width": np.int32(int(width[-1])), "ids": ids})
    return run


def _shard(first_nth):
    """Index and pages of a shard; ``first_nth``: the number of its first row among the rows of that doc_id."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "tie", "salt"], kind="stable")
        shard = int(pdf["shard"].iloc[0])
        docs, width = pdf.key.to_numpy(np.int64), int(pdf.width.iloc[0])
        size = pdf.ids.map(len).to_numpy(np.int64) // width
        nth = _nth(docs)
        nth[docs == docs[0]] += first_nth.value[shard]
        keys = _keys(docs, nth)
        index = PerfectHash.build(keys)
        slot = index.slots(keys)
        prints, places = np.zeros(len(keys), U64), np.zeros(len(keys), PLACE)
        prints[slot] = _prints(keys)
        places["start"][slot], places["n"][slot] = np.r_[0, np.cumsum(size)[:-1]], size
        payload = b"".join(pdf.ids)
        rows = [(shard, -1, int(size.sum()), width, None, docs[0], int(nth[0]), index.packed(), prints.tobytes(), places.tobytes())]
        rows += [(shard, k, None, None, payload[a:a + PAGE], None, None, None, None, None) for k, a in enumerate(range(0, len(payload), PAGE))]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SHARDS.split(", ")])
        return out.astype({"n_ids": "Int64", "width": "Int32", "first_key": "Int64", "first_nth": "Int64"})
    return run


def _limits(keyed: DataFrame, rows: int, docs_per_shard: int) -> tuple[np.ndarray, dict[int, int]]:
    """First (key, tie, salt) of each shard, and how many rows of its first key stand in earlier shards.

    Small range partitions of the key columns, in which a hot key spans several, are joined to shards of at most about
    ``docs_per_shard`` rows and ``SHARD_BYTES`` of text.
    """
    spark = keyed.sparkSession
    most = min(docs_per_shard, max(-(-rows // int(spark.conf.get("spark.sql.shuffle.partitions"))), 1))
    ranges = n_parts(spark, rows, max(most // FINE, 1))
    # a task counts ``FINE`` ranges, one after the other
    parted = keyed.select("key", "tie", "salt", F.octet_length("text").cast("long").alias("size")) \
        .repartitionByRange(ranges, "key", "tie", "salt").select("*", F.spark_partition_id().alias("p")).coalesce(-(-ranges // FINE))
    at = F.struct("key", "tie", "salt")
    # a row per range
    edges = stash(parted.groupBy("p", "key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min(at).alias("a"))
                  .groupBy("p").agg(F.min("a").alias("first"), F.max_by(F.struct("key", "n"), "key").alias("last"), F.count("*").alias("keys"),
                                    F.sum("n").alias("n"), F.sum("size").alias("size")), "shard-limits").orderBy("p").collect()
    limits, nth, held, n, size = [], {}, (None, 0), 0, 0           # held: the last key so far and its rows
    for r in edges:
        before = held[1] if r["first"]["key"] == held[0] else 0
        if not limits or n + r["n"] > most or size + r["size"] > SHARD_BYTES:
            nth[len(limits)], n, size = before, 0, 0
            limits.append(tuple(r["first"]))
        n, size = n + r["n"], size + r["size"]
        held = (r["last"]["key"], r["last"]["n"] + (before if r["keys"] == 1 else 0))
    return np.array(limits, LIMIT), nth


def write_store(docs: DataFrame, tokenizer: str, level: str = "word", end_id: int = 1, docs_per_shard: int = 4096, path: str | None = None) -> str:
    """Tokenise ``docs`` and write the store; its folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/retentia/tokens-{uuid.uuid4().hex}"
    # equal (doc_id, text) rows are alike, so any salt deals them; this one is the same whenever a split is read again
    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("key"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumns({"tie": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    limits, nth = _limits(keyed, keyed.select("key").count(), docs_per_shard)
    shards = max(len(limits), 1)
    model, cut, first = (spark.sparkContext.broadcast(v) for v in ((read_json(tokenizer), level), limits, nth))
    rows = keyed.mapInPandas(lean(_tokenise(model, end_id, cut)), "shard int, key long, tie long, salt long, width int, ids binary")
    buckets = min(shards, BUCKETS)
    written = rows.repartition(buckets, "shard").groupBy("shard").applyInPandas(lean(_shard(first)), SHARDS)
    name = f"retentia_tokens_{uuid.uuid4().hex}"
    written.write.bucketBy(buckets, "shard").option("path", f"{path}/shards").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")                               # the files stay: the table is external
    index = spark.read.schema(SHARDS).parquet(f"{path}/shards").where("page = -1").select("shard", "n_ids", "first_key", "first_nth")
    # one row per shard
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index.select("shard", "first_key", "first_nth", before.alias("start"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/starts")
    return path


def _lookup(key: tuple, store: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Digests of the asked (key, number) pairs of a shard, by index, fingerprint and payload."""
    empty = pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "start": np.zeros(0, np.int64), "n_tokens": np.zeros(0, np.int64), "ids_crc32": np.zeros(0, np.int64)})
    if not len(store) or not len(asked):
        return empty
    index = store[store.page == -1].iloc[0]
    places, prints = np.frombuffer(index.places, PLACE), np.frombuffer(index.prints, U64)
    pages = store[store.page >= 0].sort_values("page").payload.tolist()
    docs, nth = asked.key.to_numpy(np.int64), asked.nth.to_numpy(np.int64)
    keys = _keys(docs, nth)
    slot = PerfectHash.unpacked(list(index.levels)).slots(keys)
    ok = slot >= 0
    ok[ok] = prints[slot[ok]] == _prints(keys[ok])
    docs, at, width = docs[ok], places[slot[ok]], int(index.width)
    full = len(pages[0])                                            # all pages but the last have this size

    def ids(a: int, n: int) -> np.ndarray:
        a, b = a * width, (a + n) * width
        part = b"".join(pages[p][max(a - p * full, 0):b - p * full] for p in range(a // full, -(-b // full)))
        return np.frombuffer(part, f"<u{width}")
    crc = [zlib.crc32(ids(a, n).astype("<u4").tobytes()) for a, n in zip(at["start"].tolist(), at["n"].tolist())]
    start = int(asked.start.iloc[0])
    return pd.concat([empty, pd.DataFrame({"doc_id": pd.Series(docs).mask(docs == NULL_DOC).astype("Int64"), "start": start + at["start"],
                                           "n_tokens": at["n"], "ids_crc32": crc})], ignore_index=True)


def look_up(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of ``keys`` (doc_id) that the store has, by keyed access.

    The n-th row of ``keys`` with a doc_id gets the store's n-th row with it. Keys go to the one shard that can hold them;
    no payload is shuffled, and where at most ``FEW`` shards are asked only their buckets are read.
    """
    starts = spark.read.parquet(f"{path}/starts").orderBy("first_key", "first_nth").collect()          # a row per shard
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)
    table = np.array([(r.first_key, r.first_nth, r.shard, r.start) for r in starts], [(c, "<i8") for c in ("key", "nth", "shard", "start")])
    sent = spark.sparkContext.broadcast(table)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value
        first = np.rec.fromarrays([table["key"], table["nth"]], LOW)
        for pdf in batches:
            at = np.searchsorted(first, np.rec.fromarrays([pdf.key.to_numpy(np.int64), pdf.nth.to_numpy(np.int64)], LOW), "right") - 1
            yield pdf[["key", "nth"]][at >= 0].assign(shard=table["shard"][at[at >= 0]].astype(np.int32), start=table["start"][at[at >= 0]])

    asked = keys.select(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("key")).withColumn("salt", F.monotonically_increasing_id())
    asked = stash(rank_within(asked, ["key"], ["key", "salt"], rank_col="nth").select("key", "nth")
                  .mapInPandas(route, "key long, nth long, shard int, start long"), "asked")
    # known to Spark as bucketed files while it is read
    name = f"retentia_tokens_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SHARDS}) USING parquet OPTIONS (path '{path}/shards') CLUSTERED BY (shard) INTO {starts[0].buckets} BUCKETS")
    store = spark.table(name)
    few = [r.shard for r in asked.select("shard").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        store = store.where(F.col("shard").isin(few))
    found = stash(store.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_lookup, schema), "answers")
    spark.sql(f"DROP TABLE {name}")
    return found
