"""What the operators of this folder share: word patterns, tables, and small hash helpers on numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

SPACES = "\t\n\x0b\x0c\r "                      # fixed: what ends a word
WORD = "[^\\x20\\x09-\\x0D]+"                   # fixed: a word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def id_or_last(c: Column) -> Column:
    """A null id reads as the largest one, so that ids have a total order."""
    return F.coalesce(c.cast("long"), F.lit(LAST_ID))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made once per process and grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b)], dtype=np.uint64) for b in (self.base, self.inverse))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The polynomial hash of values[start:end] for every span, equal for equal content wherever it stands."""
        n = len(values)
        self.grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(values * self.up[:n], out=sums[1:], dtype=np.uint64)
            return (sums[ends] - sums[starts]) * self.down[starts]


def random_table(seed: int, n: int = 256) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def row_of(df: DataFrame) -> Column:
    """A number for each row of a table of files: a hash of the file's path, with the row's place in the file laid over it. It does
    not depend on how a read is split. Two files of up to 2**k rows overlap with a chance of 2**(k - 63)."""
    file = df.metadataColumn("_metadata")
    return F.xxhash64(file["file_path"]).bitwiseXOR(file["row_index"]).bitwiseAND(F.lit(LAST_ID))


def settled(df: DataFrame) -> DataFrame:
    """`df` itself if it is a plain scan of files that can number their rows (`row_of`); anything else is written first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if all(line.lstrip(" +-:").startswith(("Project", "Filter", "Relation")) for line in plan.splitlines() if line.strip()):
        try:
            df.select(row_of(df)).schema                     # noqa: B018 - analysed here
            return df
        except AnalysisException:
            pass
    return staged(df, "rows")


def rows_numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `docs` with a number for each row, `row`, the same whenever and wherever the result is read."""
    docs = settled(docs.select(*columns))
    return docs.select("*", row_of(docs).alias("row"))


SLICE_BYTES = 1 << 20


def batch_slices(batch, column: int, most_bytes: int = SLICE_BYTES):
    """A record batch in runs of rows whose texts in `column` make about `most_bytes`: first row, the rows. A longer text stands
    alone. What a task works out for each byte then stays small beside the batch."""
    import pyarrow as pa
    texts = batch.column(column).cast(pa.large_string())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1))
        yield at, batch.slice(at, to - at)
        at = to


def text_slices(batch, column: int, most_bytes: int = SLICE_BYTES):
    """The texts of a record batch by runs of rows, as one buffer of bytes each: first row, bytes, ends of the texts (one more than
    texts, from 0). Nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for at, part in batch_slices(batch, column, most_bytes):
        texts = pc.fill_null(part.column(column).cast(pa.large_string()), "")
        n, (_, offsets, data) = len(texts), texts.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        yield at, raw[ends[0]:ends[-1]], ends - ends[0]


_IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])


def word_bounds(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of concatenated texts start and end; no word goes over the end of a text."""
    full = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[ends] = True
    before, after = np.r_[False, full], np.r_[full, False]          # is there a word's byte before, and at, each place
    return np.nonzero(after & (~before | edge))[0], np.nonzero(before & (~after | edge))[0]


def sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every n neighbours from each place on; shorter at the end."""
    out, width = values.copy(), 1
    while width < n:
        step = min(width, n - width)
        out[:len(out) - step] = best(out[:len(out) - step], out[step:])
        width += step
    return out
