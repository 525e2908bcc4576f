"""Phrase collocations by SETM: relations of occurrences, extended word by word, counted as groups, cut down to frequent groups.

The relation of length k has a row for each occurrence of a phrase of k words: where it starts and which phrase it is, sorted by
piece and place. It is kept in slabs (the texts of about SLAB bytes), one written row a slab, with the slab's distinct phrases and
their counts beside the compressed columns; a gap of one place parts two pieces. A round

* counts the groups: a slab sends each of its distinct phrases once, with its count, in sorted and compressed runs to buckets by
  hash, so that a very common phrase is one entry a slab, whatever its occurrences, and no bucket has more than its share;
* tells the slabs which of their phrases are frequent, and so semi-joins the relation (the buckets answer by place, no text goes);
* merge-joins the relation with itself on the next place of the same piece, which gives the relation of length k + 1.

A phrase is as frequent as its rarest part at most, so nothing that reaches `least` is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from .common import mixed, text_slices, word_bounds

SLAB = 8 << 20
LONGEST, LEAST = 3, 10
TOP = 2_000
SCALE = 1_000_000
COVERED = 50                 # per cent of a phrase's occurrences that a longer one must have to replace it
SALTS = 256                  # shares of a language that are ranked by themselves first
UNKNOWN = "und"
WORDS_TYPE = "slab long, langs array<string>, phrases array<string>, counts array<long>, places binary, items binary"
PAIRS_TYPE = "slab long, bucket array<int>, until array<int>, heads binary, tails binary, counts binary, places binary, items binary"
GROUPS_TYPE = "id long, head long, tail long, f long, slab long, spots binary, ids binary"
BUCKET = 2_000_000           # occurrences whose groups one bucket counts, at most about
ID_BITS = 40                 # a frequent group's number: its bucket, and its place there

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10          # fixed: what ends a piece
_FOLD[9] = 32


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(x: bytes | pa.Scalar, kind=np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer() if isinstance(x, pa.Scalar) else x), dtype=kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """Growing numbers as steps from one to the next."""
    return np.diff(x, prepend=x.dtype.type(0))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The relation of single words of (lang, text)."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, raw, ends in text_slices(batch, 1, SLAB):
            raw = _FOLD[raw]
            start, end = word_bounds(raw, ends)
            if not len(start):
                continue
            doc = np.searchsorted(ends, start, side="right") - 1
            piece = np.cumsum(raw == 10)[start] + doc                    # grows with each mark and each text
            places = np.arange(len(start)) + np.cumsum(np.r_[0, np.diff(piece) > 0])
            inside = np.zeros(len(raw) + 1, dtype=np.int8)
            inside[start] = 1
            inside[end] -= 1
            letters = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
            words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.r_[0, np.cumsum(end - start)].astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
            langs = pc.fill_null(batch.column(0).slice(at, len(ends) - 1).cast(pa.string()), UNKNOWN).dictionary_encode()
            n = len(words.dictionary)
            items, told = pd.factorize(langs.indices.to_numpy().astype(np.int64)[doc] * n + words.indices.to_numpy())
            one = pa.array([0, len(told)], pa.int32())
            lists = [pa.ListArray.from_arrays(one, x) for x in (langs.dictionary.take(pa.array(told // n)), words.dictionary.take(pa.array(told % n)).cast(pa.string()),
                                                                pa.array(np.bincount(items), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([_packed(_steps(places).astype(np.int32))], pa.binary()),
                                              pa.array([_packed(items.astype(np.int32))], pa.binary())], names=["slab", "langs", "phrases", "counts", "places", "items"])
            number += 1


def _longer(buckets: int, last: bool):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """slab, places, items, told (spots and ids of the frequent groups among the items): the relation of phrases longer by a
        word. Its items are sorted by bucket, first and last part. The last relation keeps the groups only."""
        for batch in batches:
            for k in range(batch.num_rows):
                number, places, items, told = (c[k] for c in batch.columns)
                items = _unpacked(items)
                name = np.full(int(items.max(initial=0)) + 1, -1, dtype=np.int64)
                for spots, ids in zip(told.values.field(0), told.values.field(1)):
                    name[_unpacked(spots)] = _unpacked(ids, np.int64)
                on = name[items] >= 0
                places, items = np.cumsum(_unpacked(places), dtype=np.int64)[on], items[on].astype(np.int64)
                first = np.nonzero(np.diff(places) == 1)[0]
                if not len(first):
                    continue
                found, pairs = pd.factorize(items[first] * len(name) + items[first + 1])
                heads, tails = name[pairs // len(name)], name[pairs % len(name)]
                with np.errstate(over="ignore"):
                    bucket = (mixed(mixed(heads.view(np.uint64)) + tails.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((tails, heads, bucket))
                spot = np.empty(len(order), dtype=np.int32)
                spot[order] = np.arange(len(order), dtype=np.int32)
                found, none = spot[found], np.zeros(0, dtype=np.int32)
                counts = np.bincount(found).astype(np.int32)
                until = np.r_[np.nonzero(np.diff(bucket[order]))[0] + 1, len(order)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()], pa.int64()), pa.array([bucket[order][until - 1]], pa.list_(pa.int32())), pa.array([until], pa.list_(pa.int32())),
                     *(pa.array([_packed(x)], pa.binary()) for x in (heads[order], tails[order], counts, none if last else _steps(places[first]).astype(np.int32), none if last else found))],
                    names=["slab", "bucket", "until", "heads", "tails", "counts", "places", "items"])
    return extend


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of each slab by bucket: bucket, slab, start (the first one's spot), heads, tails, counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            slab, bucket, until = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values.to_numpy()
            heads, tails, counts = (_unpacked(batch.column(c)[k], kind) for c, kind in ((3, np.int64), (4, np.int64), (5, np.int32)))
            since = np.r_[np.int32(0), until[:-1]]
            cut = lambda x, f=lambda x: x: pa.array([_packed(f(x[a:b])) for a, b in zip(since, until)], pa.binary())          # noqa: E731
            yield pa.RecordBatch.from_arrays([bucket, pa.array(np.full(len(until), slab)), pa.array(since), cut(heads, _steps), cut(tails), cut(counts)],
                                             names=["bucket", "slab", "start", "heads", "tails", "counts"])


def _counter(least: int):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        """The frequent groups of a bucket, and for each slab where they stand among its own."""
        heads = [np.cumsum(_unpacked(x, np.int64)) for x in rows["heads"]]
        tails = np.concatenate([_unpacked(x, np.int64) for x in rows["tails"]])
        counts = np.concatenate([_unpacked(x) for x in rows["counts"]])
        sizes = np.array([len(x) for x in heads])
        h, head_of = pd.factorize(np.concatenate(heads))
        t, tail_of = pd.factorize(tails)
        group, pair_of = pd.factorize(h * len(tail_of) + t)
        f = np.bincount(group, weights=counts).astype(np.int64)
        many = np.nonzero(f >= least)[0]
        name = np.full(len(f), -1, dtype=np.int64)
        # numbers by head and tail, so that they do not hang on the order in which rows come
        by = np.lexsort((tail_of[pair_of[many] % len(tail_of)], head_of[pair_of[many] // len(tail_of)]))
        name[many[by]] = (np.int64(rows["bucket"].iloc[0]) << ID_BITS) + np.arange(len(many))
        known = pd.DataFrame({"id": name[many], "head": head_of[pair_of[many] // len(tail_of)], "tail": tail_of[pair_of[many] % len(tail_of)], "f": f[many]})
        slabs, spots, ids = [], [], []
        for slab, start, own in zip(rows["slab"], rows["start"], np.split(name[group], np.cumsum(sizes)[:-1])):
            if len(hit := np.nonzero(own >= 0)[0]):
                slabs.append(slab)
                spots.append(_packed((hit + start).astype(np.int32)))
                ids.append(_packed(own[hit]))
        flags = pd.DataFrame({"slab": np.array(slabs, dtype=np.int64), "spots": spots, "ids": ids})
        return pd.concat([known, flags], ignore_index=True).astype({c: "Int64" for c in ("id", "head", "tail", "f", "slab")})[["id", "head", "tail", "f", "slab", "spots", "ids"]]
    return count


def _flag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slab, told (spot and id of its frequent words) with the latter packed as two columns."""
    for batch in batches:
        both = batch.column(1)
        parts = [(x.values.field(0).to_numpy(), x.values.field(1).to_numpy()) for x in both]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(s.astype(np.int32)) for s, _ in parts], pa.binary()), pa.array([_packed(i) for _, i in parts], pa.binary())],
                                         names=["slab", "spots", "ids"])


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (lang, text; other columns are ignored): the phrases of up to `longest` words that occur `least` times or more in
    their language (lang, size, phrase, f), and the number of all words of each language (lang, n).

    A null text is empty, a null language is `und` (as one so called). Repeated rows count as often as they are there. Empty
    texts and an empty table have no phrase. A text of any length is one slab at most."""
    relation = staged(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_words, WORDS_TYPE), "occurrences")
    items = relation.select("slab", F.posexplode(F.arrays_zip("langs", "phrases", "counts")).alias("spot", "x"))
    items = items.select("slab", "spot", F.col("x.langs").alias("lang"), F.col("x.phrases").alias("phrase"), F.col("x.counts").alias("f"))
    words = items.groupBy("lang").agg(F.sum("f").alias("n"))
    many = items.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    many = staged(many.withColumn("id", F.monotonically_increasing_id()).withColumn("word", F.col("phrase")), "frequent_1")
    flags = (items.join(many.select("lang", "phrase", "id"), ["lang", "phrase"]).groupBy("slab").agg(F.collect_list(F.struct("spot", "id")).alias("told"))
             .mapInArrow(_flag_rows, "slab long, spots binary, ids binary"))
    out = many.select("lang", F.lit(1).alias("size"), "phrase", "f")
    for size in range(2, longest + 1):
        told = flags.groupBy("slab").agg(F.collect_list(F.struct("spots", "ids")).alias("told"))
        buckets = max(1, -(-(many.agg(F.sum("f")).first()[0] or 0) // BUCKET))
        cut = relation.select("slab", "places", "items").join(told, "slab").select("slab", "places", "items", "told")
        relation = staged(cut.mapInArrow(_longer(buckets, size == longest), PAIRS_TYPE), "occurrences")
        dealt = relation.select("slab", "bucket", "until", "heads", "tails", "counts").mapInArrow(_dealt, "bucket int, slab long, start int, heads binary, tails binary, counts binary")
        counted = staged(dealt.groupBy("bucket").applyInPandas(_counter(least), GROUPS_TYPE), "groups")
        flags = counted.where("slab IS NOT NULL").select("slab", "spots", "ids")
        head = many.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("start"))
        tail = many.select(F.col("id").alias("tail"), "word")
        many = staged(counted.where("id IS NOT NULL").select("id", "head", "tail", "f").join(head, "head").join(tail, "tail")
                      .select("id", "lang", F.concat_ws(" ", "start", "word").alias("phrase"), "word", "f"), f"frequent_{size}")
        out = out.unionByName(many.select("lang", F.lit(size).alias("size"), "phrase", "f"))
    return out, words


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The `top` phrases of two to `longest` words of each language by score: lang, rank, phrase, a, l, r, n, score.

    a: occurrences; of all cuts in two parts that of the least score counts (l and r: the parts' occurrences), then the shortest
    first part. A phrase inside a longer candidate with `covered` per cent of its occurrences is left out. Ties in score go to
    the more frequent, then to the smaller phrase by bytes. For nulls and empty input see `frequent_phrases`."""
    known, words = frequent_phrases(docs, longest, least)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")                                       # noqa: E731
    asked = known.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = asked.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    parts = known.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: f"cast({c} AS decimal(15,0))"                                                 # noqa: E731
    cuts = cuts.withColumn("score", F.expr(f"(cast({SCALE} AS decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every part of two words or more of a longer candidate, with the longer one's occurrences
    inner = asked.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(covered)} * a")
    order = [F.col("cut.score").desc(), F.col("a").desc(), "phrase"]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


ORACLE = f"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM d)),
o AS (SELECT lang, size, w[i:i + size - 1] AS x FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS size))),
f AS (SELECT lang, size, x, count(*) AS f FROM o GROUP BY lang, size, x),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, x, f AS a FROM f WHERE size > 1 AND f >= {LEAST}),
s AS (SELECT c.*, k, l.f AS l, r.f AS r, {SCALE}::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c) AS c JOIN f AS l ON l.lang = c.lang AND l.x = c.x[1:k] JOIN f AS r ON r.lang = c.lang AND r.x = c.x[k + 1:]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, k) AS i FROM s) WHERE i = 1),
g AS (SELECT lang, x[:size - 1] AS x, a FROM c WHERE size = 3 UNION ALL SELECT lang, x[2:], a FROM c WHERE size = 3),
z AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, x, max(a) AS longer FROM g GROUP BY lang, x) AS m ON m.lang = b.lang AND m.x = b.x WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
q AS (SELECT *, array_to_string(x, ' ') AS phrase FROM z)
SELECT lang, CAST(k2 AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS k2 FROM q) JOIN n USING (lang) WHERE k2 <= {TOP}
"""
