"""A lookup table laid out for its two questions: one row by key, and the rows of the highest scores.

The base files are ranges of the key. Their key ranges are known (a row per file), so a point lookup opens the one file that can hold the
key; Parquet's own Bloom filter on the key then skips its row groups. A second copy of the lookup columns has files that are ranges of
the score, highest first: the top k are read file by file until k rows are found that no later file can beat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.session import shared_folder

#: Files at least; rows in a file otherwise.
FILES, ROWS_PER_FILE = 16, 1_000_000


@dataclass
class LaidOut:
    base: DataFrame
    by_score: DataFrame
    key: str
    score: str
    key_ranges: list[tuple]            # (file, lowest key, highest key)
    score_ranges: list[tuple]          # (file, lowest score, highest score, rows), highest first

    def point(self, value) -> DataFrame:
        """The rows with this key: only files whose range holds it are opened."""
        files = [f for f, low, high in self.key_ranges if low is not None and low <= value <= high]
        rows = self._only(self.base, files)
        return rows.filter(F.col(self.key) == F.lit(value))

    def top(self, k: int, condition: Column | None = None) -> DataFrame:
        """The k rows of the highest score (ties by key) that meet ``condition``; files are opened by their highest score until
        k rows are found whose score no later file reaches."""
        taken, step = 0, 1
        while taken < len(self.score_ranges):
            taken = min(taken + step, len(self.score_ranges))
            rows = self._only(self.by_score, [r[0] for r in self.score_ranges[:taken]])
            rows = rows if condition is None else rows.filter(condition)
            if taken == len(self.score_ranges):
                break
            later = self.score_ranges[taken][2]
            # equal scores may go on in the next file, so they do not settle anything
            if rows.filter(F.col(self.score) > F.lit(later)).limit(k).count() >= k:
                break
            step *= 2
        if not self.score_ranges:
            rows = self.by_score if condition is None else self.by_score.filter(condition)
        return rows.orderBy(F.col(self.score).desc(), F.col(self.key).asc()).limit(k)

    @staticmethod
    def _only(df: DataFrame, files: list[str]) -> DataFrame:
        return df.sparkSession.read.schema(df.schema).parquet(*files) if files else df.limit(0)


def _ranges(df: DataFrame, column: str) -> list[tuple]:
    got = df.groupBy(F.input_file_name().alias("f")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).collect()
    return [(r.f, r.lo, r.hi, r.n) for r in got]                    # a row per file


def lay_out(df: DataFrame, name: str, key: str, score: str, columns: list[str], clustered: bool = False) -> LaidOut:
    """Write the two copies of ``df``. ``clustered``: ``df`` is already read from files that are ranges of ``key``."""
    spark, root = df.sparkSession, shared_folder(df.sparkSession, name)
    n = max(FILES, -(-df.count() // ROWS_PER_FILE))
    base = df
    if not clustered:
        df.repartitionByRange(n, key).sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{root}/by_key")
        base = spark.read.schema(df.schema).parquet(f"{root}/by_key")
    order = [F.col(score).desc(), F.col(key).asc()]
    base.select(*columns).repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(f"{root}/by_score")
    by_score = spark.read.schema(base.select(*columns).schema).parquet(f"{root}/by_score")
    scores = sorted(_ranges(by_score, score), key=lambda r: (r[2] is None, -(r[2] or 0.0), -(r[1] or 0.0)))
    return LaidOut(base, by_score, key, score, [r[:3] for r in _ranges(base, key)], scores)
