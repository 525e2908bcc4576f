"""Substring dedup: words covered by a window of words that starts anywhere else, with a count-min sketch before the exact groups.

Each window of WINDOW words is told by the least hash among its runs of GRAM words. Equal windows have that run at the same
place, so the run occurs at least as often as the window: its count-min estimate overestimates the window's count. First pass:
partitions count these runs, each occurrence once; the sketches are merged. Second pass: windows whose run may occur twice, and
no others, are grouped exactly by a 128-bit digest of their words. What a stretch of a partition already holds twice is marked at
once and told to the others by one row, so a window that very many documents share is a row per stretch of rows, no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from . import sketch
from .common import Powers, mixed, random_table, rows_numbered, sliding, text_slices, word_bounds

WINDOW = 35
GRAM = 20
HELD = 400_000              # suspects that are compared with each other before they are sent on
_BYTES, _OF_BYTES, _OF_WORDS = random_table(1), Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB)


def window_runs(raw: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: first words of all windows, the hash of each window's least run; all counted runs; text of each word."""
    starts, stops = word_bounds(raw, ends)
    n = len(starts)
    owner = np.searchsorted(ends, starts, side="right") - 1
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), owner
    with np.errstate(over="ignore"):
        words = mixed(_OF_BYTES.spans(_BYTES[raw], starts, stops) + (stops - starts).astype(np.uint64))
        at = np.arange(n - gram + 1)
        runs = mixed(_OF_WORDS.spans(words, at, at + gram)) | np.uint64(1)
    reach = window - gram + 1
    least = sliding(runs, reach, np.minimum)[:n - window + 1]
    whole = owner[:n - window + 1] == owner[window - 1:]
    inside = np.where(whole, least, 0)
    # a run counts if it is the least of a window that holds it: windows starting up to reach - 1 words before it
    most = sliding(np.r_[np.zeros(reach - 1, dtype=np.uint64), inside, np.zeros(reach - 1, dtype=np.uint64)], reach, np.maximum)[:len(runs)]
    first = np.nonzero(whole)[0]
    return first, least[first], runs[most == runs], owner


def _keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, raw, ends in text_slices(batch, 0):
        yield window_runs(raw, ends)[2]


def repeated_windows(texts: DataFrame) -> DataFrame:
    """row, spots (start and number of consecutive windows) of the windows of `texts` (row, text) that start anywhere else too."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = sketch.repeats(texts.select("text"), _keys, size / 6 * 2 / (WINDOW - GRAM + 2))
    width, sent = found.width, spark.sparkContext.broadcast(found.rows.tobytes())

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, spots, digests = sketch.Repeats(width, sent.value), [], [], []

        def told() -> pa.RecordBatch:
            row, spot = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(spots) if spots else np.zeros(0, np.int64)
            pairs = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            s = pairs[order]
            new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)] if len(s) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            n = np.bincount(group) if len(s) else np.zeros(0, np.int64)
            many = np.zeros(len(s), dtype=bool)
            many[order] = n[group] > 1
            lead = order[np.nonzero(new)[0]][n > 1]                          # one of each window that is here twice
            alone = np.nonzero(~many)[0]
            known = np.nonzero(many)[0]
            known = known[np.lexsort((spot[known], row[known]))]
            cut = np.r_[True, (np.diff(row[known]) != 0) | (np.diff(spot[known]) != 1)] if len(known) else np.zeros(0, bool)
            head = np.nonzero(cut)[0]
            run = np.diff(np.r_[head, len(known)])
            # strings seen once have a place, those seen here twice have none; what is known already has no digest
            said, blank = np.r_[alone, lead], np.zeros(len(head), dtype=bool)
            a, b = (pa.array(np.r_[pairs[said, k].view(np.int64), np.zeros(len(head), np.int64)], mask=np.r_[np.zeros(len(said), bool), ~blank]) for k in (0, 1))
            where = pa.array(np.r_[row[alone], np.zeros(len(lead), np.int64), row[known[head]]],
                             mask=np.r_[np.zeros(len(alone), bool), np.ones(len(lead), bool), blank])
            return pa.RecordBatch.from_arrays(
                [a, b, where, pa.array(np.r_[spot[alone], np.zeros(len(lead), np.int64), spot[known[head]]].astype(np.int32)),
                 pa.array(np.r_[np.ones(len(said), np.int64), run].astype(np.int32))], names=["a", "b", "row", "spot", "run"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at, raw, ends in text_slices(batch, 1):
                first, runs, _, owner = window_runs(raw, ends)
                first = first[seen.may_repeat(runs)]
                if not len(first):
                    continue
                owners, begin = np.unique(owner, return_index=True)
                base = np.zeros(len(ends), dtype=np.int64)
                base[owners] = begin
                text = raw.tobytes()
                which = owner[first]
                edges = np.r_[np.nonzero(np.r_[True, np.diff(which) != 0])[0], len(which)]
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    k = int(which[a])
                    words = text[ends[k]:ends[k + 1]].split()
                    line, lens = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                    lo = np.cumsum(lens + 1) - lens - 1
                    spot = first[a:b] - base[k]
                    hi = lo[spot + WINDOW - 1] + lens[spot + WINDOW - 1]
                    digests.extend([hashlib.blake2b(line[x:y], digest_size=16).digest() for x, y in zip(lo[spot].tolist(), hi.tolist())])
                    rows.append(np.full(b - a, numbers[at + k]))
                    spots.append(spot)
                if len(digests) >= HELD:
                    yield told()
                    rows, spots, digests = [], [], []
        if digests:
            yield told()

    told = staged(texts.select("row", "text").mapInArrow(suspects, "a long, b long, row long, spot int, run int"), "windows")
    total = F.sum(F.when(F.col("row").isNull(), 2).otherwise(1)).over(Window.partitionBy("a", "b"))
    shared = told.where("a IS NOT NULL").select("row", "spot", total.alias("total")).where("total > 1 AND row IS NOT NULL")
    marks = told.where("a IS NULL").select("row", "spot", "run").unionByName(shared.select("row", "spot", F.lit(1).alias("run")))
    return staged(marks.groupBy("row").agg(F.collect_list(F.struct("spot", "run")).alias("spots")), "spots")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are text and spots."""
    for batch in batches:
        texts, spots, rest = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), batch.columns[:-2]
        n_words, n_removed, kept = [], [], []
        for text, marks in zip(texts, spots):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if marks.is_valid:
                gone = np.zeros(n + 1, dtype=np.int32)
                spot, run = (marks.values.field(k).to_numpy() for k in (0, 1))
                np.add.at(gone, spot, 1)
                np.add.at(gone, spot + run - 1 + WINDOW, -1)
                stay = np.nonzero(np.cumsum(gone[:n]) == 0)[0].tolist()
                words = [words[k] for k in stay]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=[*[f"c{k}" for k in range(len(rest))], "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every row of `docs` (doc_id, text; other columns are ignored): doc_id, n_words, n_removed and kept, the words that stay.

    Words are runs of other characters than ASCII white space, compared as they are; kept words are joined by one space. A null or
    empty text has no words; texts of fewer than WINDOW words lose none. Rows with equal ids or equal texts are rows of their own, so the copies
    of a text lose all their windows. Windows are judged on the input. An empty table stays empty.
    """
    texts = rows_numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id", "text"])
    spots = repeated_windows(texts).withColumnRenamed("row", "r")
    both = texts.join(spots, F.col("row") == F.col("r"), "left").select("doc_id", "text", "spots")
    return both.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w),
mark AS (SELECT word.*, r.i IS NOT NULL AND word.k < r.i + {WINDOW} AS gone FROM word ASOF LEFT JOIN rep r ON word.doc_id = r.doc_id AND word.k >= r.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY k) FILTER (NOT gone) AS t FROM mark GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
