"""Suffix-array dedup: bytes covered by a string of WINDOW bytes that starts anywhere else go, found by two-stage suffix sorting.

Equal strings must meet in one task. Each string of WINDOW bytes is told by the least hash among its runs of GRAM bytes, which
equal strings share. A count-min sketch finds the runs that may occur twice; only strings with such a run go on, neighbours that
share it as one piece of text, and pieces meet by the run's hash. There they form suffix arrays:

* suffixes smaller than their successors are sorted directly, eight bytes at a time;
* all others are induced from them by one scan over the buckets of first bytes;
* common prefixes of neighbours, up to WINDOW bytes, tell the strings that occur again.

Equal pieces within a stretch of a partition are one row with all its places. A run that more than HEAVY rows share (a passage in
a large part of all texts, with another context in each) is not one task's: its strings are grouped by digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from . import sketch
from .common import Powers, mixed, random_table, rows_numbered, sliding, text_slices

WINDOW = 200
GRAM = 64
STEP = 8                     # bytes compared at once; WINDOW is a multiple
PIECE = 4096                 # strings of one piece of text
HELD = 8 << 20               # bytes of pieces that are compared with each other before they are sent on
ARRAY = 2 << 20              # bytes of one suffix array, but for a run's own pieces
HEAVY = 5_000
_BYTES, _OF_BYTES = random_table(2), Powers(0x8EBC6AF09C88C6E3)
_OF_WINDOW = Powers(0x589965CC75374CC3)
PIECES = "run long, n int, text binary, rows array<long>, spots array<int>"
SPOTS = "row long, spot int, length int"


def window_runs(raw: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM, counted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: where each string of `window` bytes starts, the hash of its least run; and, if `counted`, all runs
    that are the least of some string."""
    n = len(raw)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        at = np.arange(n - gram + 1)
        runs = mixed(_OF_BYTES.spans(_BYTES[raw], at, at + gram)) | np.uint64(1)
    reach = window - gram + 1
    least = sliding(runs, reach, np.minimum)[:n - window + 1]
    whole = np.zeros(n, dtype=bool)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        whole[a:max(a, b - window + 1)] = True
    whole = whole[:n - window + 1]
    first = np.nonzero(whole)[0]
    if not counted:
        return first, least[first], runs[:0]
    none = np.zeros(reach - 1, dtype=np.uint64)
    most = sliding(np.r_[none, np.where(whole, least, np.uint64(0)), none], reach, np.maximum)[:len(runs)]
    return first, least[first], runs[most == runs]


def _keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, raw, ends in text_slices(batch, 0):
        yield window_runs(raw, ends)[2]


def is_smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes of `t` are smaller than their successors; the last is."""
    out = np.ones(len(t), dtype=bool)
    if len(t) > 1:
        change = np.nonzero(t[1:] != t[:-1])[0]                  # the last place of every run of equal values but the last run
        up = t[change + 1] > t[change]
        size = np.diff(np.r_[-1, change])
        out[:change[-1] + 1 if len(change) else 0] = np.repeat(up, size)
    return out


def _words(raw: np.ndarray) -> np.ndarray:
    """The STEP bytes from each place on as a big-endian number, zeros after the end."""
    padded, out = np.r_[raw, np.zeros(STEP, dtype=np.uint8)], np.zeros(len(raw), dtype=np.uint64)
    for k in range(STEP):
        out |= padded[k:k + len(raw)].astype(np.uint64) << np.uint64(8 * (STEP - 1 - k))
    return out


def direct_order(places: np.ndarray, words: np.ndarray, window: int, same: np.ndarray) -> np.ndarray:
    """`places` sorted by the first `window` bytes there. `same`: a hash of those bytes, to leave groups that are all equal."""
    words = np.r_[words, np.zeros(window, dtype=np.uint64)]
    order = places[np.argsort(words[places], kind="stable")]
    lead = words[order]
    group = np.cumsum(np.r_[0, lead[1:] != lead[:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
    for depth in range(STEP, window, STEP):
        size = np.bincount(group) if len(group) else np.zeros(0, dtype=np.int64)
        active = size > 1
        if depth == STEP or depth % (4 * STEP) == 0:
            h = same[order]
            low, high = np.full(len(size), np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(len(size), dtype=np.uint64)
            np.minimum.at(low, group, h)
            np.maximum.at(high, group, h)
            active &= low != high
        where = np.nonzero(active[group])[0]
        if not len(where):
            break
        key, of = words[order[where] + depth], group[where]
        by = np.lexsort((key, of))
        order[where], key = order[where][by], key[by]
        apart = np.zeros(len(order), dtype=np.int64)
        apart[where[1:][(key[1:] != key[:-1]) & (of[1:] == of[:-1])]] = 1
        group = group + np.cumsum(apart)
    return order


def suffix_order(raw: np.ndarray, t: np.ndarray, wanted: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The wanted suffixes in the order of their first `window` bytes. `t`: the bytes plus one, 0 after each text; `wanted` holds,
    with a suffix greater than its successor, the successors up to the first that is smaller than its own."""
    smaller = is_smaller(t)
    words = _words(raw)
    n = len(raw)
    places = np.nonzero(wanted & smaller)[0]
    with np.errstate(over="ignore"):
        same = mixed(_OF_WINDOW.spans(_BYTES[raw], np.arange(n), np.minimum(np.arange(n) + window, n)))
    direct = direct_order(places, words, window, same)
    first = t[direct]
    cuts = np.searchsorted(first, np.arange(258))
    larger = wanted & ~smaller
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        rounds = induced[c]
        part = np.concatenate(rounds) if rounds else np.zeros(0, dtype=np.int64)
        parts = [part]
        while len(part):                                    # runs of one byte: their successors stand in this bucket
            part = part[part > 0] - 1
            part = part[larger[part] & (t[part] == c)]
            parts.append(part)
        bucket = np.concatenate([*parts, direct[cuts[c]:cuts[c + 1]]])
        induced[c] = []
        if len(bucket):
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[larger[before] & (t[before] > c)]
            to = t[before]
            by = np.argsort(to, kind="stable")
            before, to = before[by], to[by]
            heads = np.nonzero(np.r_[True, to[1:] != to[:-1]])[0] if len(to) else []
            for a, b in zip(heads, np.r_[heads[1:], len(to)] if len(to) else []):
                induced[to[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def shared_with_next(order: np.ndarray, words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bytes that each suffix has in common with the next in order, in whole steps up to `window`; 0 for the last."""
    words = np.r_[words, np.zeros(window, dtype=np.uint64)]
    out, left = np.zeros(len(order), dtype=np.int64), np.arange(max(0, len(order) - 1))
    for depth in range(0, window, STEP):
        left = left[words[order[left] + depth] == words[order[left + 1] + depth]]
        if not len(left):
            break
        out[left] += STEP
    return out


def repeated_flags(data: np.ndarray, sizes: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of `sizes` bytes, one after another in `data`: a flag for each place, a zero byte after every text included, does
    the string of `window` bytes there start anywhere else, in these texts or, where a text stands for several (`weights`), in one
    of those? And where each text starts among the flags."""
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    inner = np.ones(len(data) + len(sizes), dtype=bool)
    inner[ends - 1] = False
    raw = np.zeros(len(inner), dtype=np.uint8)
    raw[inner] = data
    t = raw.astype(np.int16) + 1
    t[ends - 1] = 0
    n_strings = np.maximum(0, sizes - window + 1)

    def covered(first: np.ndarray, after: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(raw) + 1, dtype=np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, after, -1)
        return np.cumsum(edge[:-1]) > 0

    is_start = covered(starts, starts + n_strings)
    # after a text's last string, go on to the first suffix that is smaller than its successor
    small = np.nonzero(is_smaller(t))[0]
    last = (starts + n_strings)[n_strings > 0]
    order = suffix_order(raw, t, is_start | covered(last, small[np.searchsorted(small, last)] + 1), window)
    order = order[is_start[order]]
    equal = shared_with_next(order, _words(raw), window) >= window
    flags = np.zeros(len(raw), dtype=bool)
    flags[order] = (equal | np.r_[False, equal[:-1]]) if len(order) else False
    many = weights > 1
    return flags | covered(starts[many], (starts + n_strings)[many]), starts


def repeated_strings(texts: list[bytes], weights: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """`repeated_flags` text by text, a flag for each of its strings."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    flags, starts = repeated_flags(np.frombuffer(b"".join(texts), dtype=np.uint8), sizes, np.asarray(weights), window)
    return [flags[a:a + k] for a, k in zip(starts.tolist(), np.maximum(0, sizes - window + 1).tolist())]


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    start = np.nonzero(edge == 1)[0]
    return start, np.nonzero(edge == -1)[0] - start


def _piecer(width: int, sent):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of text whose strings may occur again; equal ones of a stretch as one row."""
        seen, held, size = sketch.Repeats(width, sent.value), {}, 0

        def told() -> pa.RecordBatch:
            keys = list(held)
            counts = np.fromiter((len(held[k]) for k in keys), dtype=np.int64, count=len(keys))
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.int32())
            flat = np.array([p for k in keys for p in held[k]], dtype=np.int64).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[:, 0])), pa.ListArray.from_arrays(offsets, pa.array(flat[:, 1].astype(np.int32)))]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array(counts.astype(np.int32)),
                                               pa.array([k[1] for k in keys], pa.binary()), *lists], names=["run", "n", "text", "rows", "spots"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at, raw, ends in text_slices(batch, 1):
                first, runs, _ = window_runs(raw, ends, counted=False)
                hit = seen.may_repeat(runs)
                first, runs = first[hit], runs[hit].view(np.int64)
                if not len(first):
                    continue
                owner = np.searchsorted(ends, first, side="right") - 1
                head = np.nonzero(np.r_[True, (np.diff(first) != 1) | (np.diff(runs) != 0) | (np.diff(owner) != 0)])[0]
                text = raw.tobytes()
                for a, b in zip(head.tolist(), np.r_[head[1:], len(first)].tolist()):
                    for k in range(a, b, PIECE):
                        x, y = int(first[k]), int(first[min(b, k + PIECE) - 1]) + WINDOW
                        held.setdefault((int(runs[a]), text[x:y]), []).append((int(numbers[at + owner[a]]), x - int(ends[owner[a]])))
                        size += y - x
                if size >= HELD:
                    yield told()
                    held, size = {}, 0
        if held:
            yield told()
    return pieces


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def marks_of(pieces: pa.RecordBatch) -> pa.RecordBatch:
    """row, spot and length of the strings that occur again in these pieces, in one suffix array."""
    coded = pieces.column(2).dictionary_encode()
    which, texts = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
    weights = np.bincount(which, weights=pieces.column(1).to_numpy(), minlength=len(texts))
    flags, starts = repeated_flags(data, np.diff(ends), weights)
    run, length = _runs_of(flags)
    text = np.searchsorted(starts, run, side="right") - 1
    run = run - starts[text]
    n_runs = np.bincount(text, minlength=len(texts))
    first_run = np.cumsum(n_runs) - n_runs
    # every place of a piece has all runs of its text
    rows, counts = _lists(pieces.column(3))
    spots, _ = _lists(pieces.column(4))
    text = np.repeat(which, counts)
    many = n_runs[text]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first_run[text], many)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, many)), pa.array((np.repeat(spots, many) + run[at]).astype(np.int32)),
                                       pa.array(length[at].astype(np.int32))], names=["row", "spot", "length"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by their run's hash: the places of the strings that occur again. The pieces of a run stay in one array."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, sizes = batch.column(0).to_numpy(), np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
        at = 0
        for k in np.nonzero(np.r_[runs[0] != last, runs[1:] != runs[:-1]])[0].tolist():              # a run begins at k
            if size + (sizes[k - 1] if k else 0) - (sizes[at - 1] if at else 0) >= ARRAY:
                yield marks_of(pa.concat_batches([*held, batch.slice(at, k - at)]))
                held, size, at = [], 0, k
        held.append(batch.slice(at))
        size, last = size + int(sizes[-1] - (sizes[at - 1] if at else 0)), runs[-1]
    if held:
        yield marks_of(pa.concat_batches(held))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of a piece by its digest, with the piece's places."""
    for batch in batches:
        for _, n, text, rows, spots in zip(*[c.to_pylist() for c in batch.columns]):
            d = [hashlib.blake2b(text[k:k + WINDOW], digest_size=16).digest() for k in range(len(text) - WINDOW + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array([n] * len(d), pa.int32()), pa.array(range(len(d)), pa.int32()),
                                              pa.array([rows] * len(d), pa.list_(pa.int64())), pa.array([spots] * len(d), pa.list_(pa.int32()))],
                                             names=["digest", "n", "k", "rows", "spots"])


def repeated_spots(texts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """row, marks (start and number of strings) of the strings of `texts` (row, text) that start anywhere else too."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = sketch.repeats(texts.select("text"), _keys, size * 2 / (WINDOW - GRAM + 2))
    pieces = staged(texts.select("row", "text").mapInArrow(_piecer(found.width, spark.sparkContext.broadcast(found.rows.tobytes())), PIECES), "pieces")
    counts = staged(pieces.groupBy("run").agg(F.count("*").alias("c")).where(F.col("c") > heavy).select(F.col("run").alias("hot")), "heavy_runs")
    light = pieces.join(counts, F.col("run") == F.col("hot"), "left_anti")
    marks = light.repartition("run").sortWithinPartitions("run").mapInArrow(_marked, SPOTS)
    if not counts.isEmpty():
        each = (pieces.join(counts, F.col("run") == F.col("hot"), "left_semi")
                .mapInArrow(_digests, "digest binary, n int, k int, rows array<long>, spots array<int>"))
        again = each.select("*", F.sum("n").over(Window.partitionBy("digest")).alias("total")).where("total > 1")
        marks = marks.unionByName(again.select(F.explode(F.arrays_zip("rows", "spots")).alias("x"), "k").select(
            F.col("x.rows").alias("row"), (F.col("x.spots") + F.col("k")).alias("spot"), F.lit(1).alias("length")))
    return staged(marks.groupBy("row").agg(F.collect_list(F.struct("spot", "length")).alias("marks")), "marks")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, marks: the bytes that stay."""
    for batch in batches:
        size, removed, spans, kept = [], [], [], []
        for text, marks in zip(batch.column(1), batch.column(2)):
            raw = (text.as_py() or "").encode()
            n_spans = gone = 0
            rest = raw
            if marks.is_valid:
                edge = np.zeros(len(raw) + 1, dtype=np.int32)
                spot, length = (marks.values.field(k).to_numpy() for k in (0, 1))
                np.add.at(edge, spot, 1)
                np.add.at(edge, spot + length - 1 + WINDOW, -1)
                drop = np.cumsum(edge[:-1]) > 0
                n_spans, gone = len(_runs_of(drop)[0]), int(drop.sum())
                rest = np.frombuffer(raw, dtype=np.uint8)[~drop].tobytes()
            size.append(len(raw))
            removed.append(gone)
            spans.append(n_spans)
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicated(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Every row of `docs` (doc_id, text; other columns are ignored): doc_id, n_bytes, n_removed, n_spans and kept, the bytes left.

    Texts are UTF-8 bytes; a cut may fall inside a character, so kept is binary. A null text is empty; texts shorter than WINDOW
    bytes lose nothing. Rows with equal ids or texts are rows of their own, so all copies of a long enough text lose all. Strings
    are judged on the input, overlaps count, and no string goes over the end of a text. An empty table stays empty.
    """
    texts = rows_numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id", "text"])
    marks = repeated_spots(texts, heavy).withColumnRenamed("row", "r")
    both = texts.join(marks, F.col("row") == F.col("r"), "left").select("doc_id", "text", "marks")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substring(h, CAST(2 * i + 1 AS BIGINT), {2 * WINDOW})) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {WINDOW - 1})) AS i FROM d WHERE n >= {WINDOW})),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
head AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM rep),
run AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM head GROUP BY doc_id, g),
lap AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM run),
part AS (SELECT *, sum(CASE WHEN p >= a THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM lap),
span AS (SELECT doc_id, k, min(a) AS a, max(b) AS b FROM part GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS q FROM span),
tot AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z FROM span GROUP BY doc_id),
txt AS (SELECT doc_id, string_agg(substring(h, CAST(2 * q + 1 AS BIGINT), CAST(2 * (a - q) AS BIGINT)), '' ORDER BY a) AS t FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN z IS NULL THEN h ELSE t || substring(h, CAST(2 * z + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN txt USING (doc_id)
"""
