"""A Bloom filter built by tasks and merged bit by bit: membership with false positives only."""

import hashlib
from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BloomFilter:
    def __init__(self, capacity: int, error: float = 0.001):
        if capacity < 1 or not 0 < error < 1:
            raise ValueError("capacity must be positive and error between 0 and 1")
        self.capacity, self.error = capacity, error
        self.size = ceil(-capacity * log(error) / log(2) ** 2)
        self.hashes = max(1, ceil(self.size / capacity * log(2)))
        self.bits = np.zeros(-(-self.size // 8), dtype=np.uint8)
        self.added = 0

    def _places(self, items: list[str]) -> np.ndarray:
        """Of each item a row of its bits; the cube keeps steps apart where the step and the size share factors."""
        digests = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in items)
        one, two = (np.frombuffer(digests, dtype="<u8").reshape(-1, 2) % np.uint64(self.size)).astype(np.int64).T
        i = np.arange(self.hashes)
        return (one[:, None] + i * two[:, None] + i**3) % self.size

    def add_all(self, items: list[str]) -> None:
        p = self._places(items).ravel()
        np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        self.added += len(items)

    def add(self, item: str) -> None:
        self.add_all([item])

    def have(self, items: list[str]) -> np.ndarray:
        p = self._places(items)
        return (self.bits[p >> 3] >> (p & 7) & 1).all(axis=1)

    def __contains__(self, item: str) -> bool:
        return bool(self.have([item])[0])

    def union(self, other: "BloomFilter") -> "BloomFilter":
        if (self.size, self.hashes) != (other.size, other.hashes):
            raise ValueError("only filters of one shape can be united")
        self.bits |= other.bits
        self.added += other.added
        return self

    def false_positive_rate(self) -> float:
        return (1 - exp(-self.hashes * self.added / self.size)) ** self.hashes

    def save(self, spark, path: str) -> None:
        """One Parquet row: shape, count and bits."""
        spark.createDataFrame([(self.capacity, self.error, self.added, bytes(self.bits))], "capacity long, error double, added long, bits binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "BloomFilter":
        row = spark.read.parquet(path).first()
        out = cls(row["capacity"], row["error"])
        out.bits, out.added = np.frombuffer(row["bits"], dtype=np.uint8).copy(), row["added"]
        return out

    @classmethod
    def of(cls, df: DataFrame, column: str, capacity: int, error: float = 0.001) -> "BloomFilter":
        """Of all values of a column: each task gives one bit array of the filter's fixed size."""
        shape = cls(capacity, error)

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = cls(capacity, error)
            for b in batches:
                own.add_all([str(x) for x in b[column].dropna()])
            yield pd.DataFrame({"bits": [own.bits.tobytes()], "added": [own.added]})

        for row in df.select(column).mapInPandas(build, "bits binary, added long").toLocalIterator():
            shape.bits |= np.frombuffer(row["bits"], dtype=np.uint8)
            shape.added += row["added"]
        return shape

    def contains(self, column: str) -> F.Column:
        """A column that is true where the value may be in the filter."""
        own = self

        @F.pandas_udf("boolean")
        def test(x: pd.Series) -> pd.Series:
            known = x.notna()
            return pd.Series(own.have([str(v) for v in x[known]]), index=x.index[known], dtype=object).reindex(x.index)

        return test(column)


class ScalableBloomFilter:
    """Filters that follow each other as they fill: the i-th has capacity * 2**i and the error times 0.9**i (small growth) or 0.5**i."""

    def __init__(self, capacity: int = 1000, error: float = 0.001, small: bool = True):
        self.capacity, self.error, self.tighten = capacity, error, 0.9 if small else 0.5
        self.filters = [BloomFilter(capacity, error)]

    def add(self, item: str) -> bool:
        """Whether the item was new; one that may be there is left out."""
        if item in self:
            return False
        if self.filters[-1].added >= self.filters[-1].capacity:
            i = len(self.filters)
            self.filters.append(BloomFilter(self.capacity * 2**i, self.error * self.tighten**i))
        self.filters[-1].add(item)
        return True

    def __contains__(self, item: str) -> bool:
        return any(item in f for f in self.filters)

    def __len__(self) -> int:
        return sum(f.added for f in self.filters)

    @classmethod
    def of(cls, df: DataFrame, column: str, error: float = 0.001) -> BloomFilter:
        """For a table the size is known: one filter of the right size."""
        return BloomFilter.of(df, column, max(1, df.select(column).distinct().count()), error)
