"""Document fingerprints of closed syncmers, and how alike two fingerprints are when matched by position.

Only DataFrame functions. A text is a sequence of units: words, and single characters from U+0E00 on, where
the scripts without spaces stand. Of every K
units in a row, the runs of INNER units inside are hashed; the K units are an anchor if the least of those stands at an edge, the
first or the last. That hangs on the K units alone, not on their surroundings, so two texts that share a stretch share its anchors.
A fingerprint lists each anchor once, by hash, with the unit where it first stands.

Two fingerprints are matched anchor by anchor; a match counts if the match before or after it, in the order of the first text, is
shifted by as many units (or if there is no other). Their likeness is twice the matches over all anchors of both.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.staging import staged

from .common import settled

K, INNER = 8, 2
HASH = 8                     # hexadecimal digits of an anchor's hash
UNIT = "[^\\x20\\x09-\\x0D\\x{0E00}-\\x{10FFFF}]+|[\\x{0E00}-\\x{10FFFF}]"
SLICE_BYTES = 16 << 20       # bytes of text of one slice of the order
MOST_SLICES = 65_536
KEY = ["k1", "k2", "k3", "k4"]


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def with_anchors(df: DataFrame, texts: dict[str, str], k: int = K, inner: int = INNER) -> DataFrame:
    """`df` with the anchors of text columns: for each of `texts` (text column: new column) an array of (h, p) sorted by hash.

    Texts may not be null. A text of fewer than `k` units, or one without anchors, has one: all its units."""
    cols = df.columns
    names = list(enumerate(texts.items()))
    df = df.select(*cols, *[_units(F.col(t)).alias(f"u{j}") for j, (t, _) in names])
    run = lambda u, i, n: F.array_join(F.slice(u, i + 1, n), " ")                                     # noqa: E731
    hashed = lambda u, n: lambda i: F.md5(F.concat_ws(" ", *[F.get(u, i + m) for m in range(n)]))                                               # noqa: E731
    till = lambda u, n: F.when(F.size(u) >= n, F.sequence(F.lit(0), F.size(u) - n)).otherwise(F.array().cast("array<int>"))         # noqa: E731
    df = df.select(*cols, *[f"u{j}" for j, _ in names],
                   *[F.transform(till(F.col(f"u{j}"), inner), hashed(F.col(f"u{j}"), inner)).alias(f"g{j}") for j, _ in names])
    width = k - inner + 1
    edge = lambda g: lambda i: F.array_min(F.slice(g, i + 1, width)).isin(F.get(g, i), F.get(g, i + (width - 1)))                   # noqa: E731
    df = df.select(*cols, *[f"u{j}" for j, _ in names], *[F.filter(till(F.col(f"u{j}"), k), edge(F.col(f"g{j}"))).alias(f"i{j}") for j, _ in names])
    named = lambda h, p: F.struct(F.left(h, F.lit(HASH)).alias("h"), p.alias("p"))                    # noqa: E731
    anchor = lambda u: lambda i: named(F.md5(run(u, i, k)), i)                                        # noqa: E731
    df = df.select(*cols, *[F.sort_array(F.when(F.size(f"i{j}") > 0, F.transform(f"i{j}", anchor(F.col(f"u{j}"))))
                                         .otherwise(F.array(named(F.md5(F.array_join(f"u{j}", " ")), F.lit(0))))).alias(f"s{j}") for j, _ in names])
    first = lambda s: lambda x, i: (i == 0) | (x["h"] != F.get(s, i - 1)["h"])                        # noqa: E731
    return df.select(*cols, *[F.filter(f"s{j}", first(F.col(f"s{j}"))).alias(out) for j, (_, out) in names])


def written(anchors: Column) -> Column:
    """Anchors as a string: hash and place of each, by hash."""
    return F.array_join(F.transform(anchors, lambda x: F.concat(x["h"], F.lit("@"), x["p"].cast("string"))), " ")


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with the likeness, from 0 to 1, of pairs of anchor columns: for each of `pairs` a new column."""
    cols, names = df.columns, list(enumerate(pairs.items()))
    side = lambda a, s: F.transform(a, lambda x: F.struct(x["h"].alias("h"), F.lit(s).alias("s"), x["p"].alias("p")))               # noqa: E731
    df = df.select(*cols, *[F.sort_array(F.concat(side(F.col(a), 0), side(F.col(b), 1))).alias(f"m{j}") for j, (_, (a, b)) in names])
    met = lambda m: lambda i: F.get(m, i)["h"] == F.get(m, i + 1)["h"]                                # noqa: E731
    pair = lambda m: lambda i: F.struct(F.get(m, i)["p"].alias("p"), (F.get(m, i)["p"] - F.get(m, i + 1)["p"]).alias("o"))          # noqa: E731
    df = df.select(*cols, *[F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(f"m{j}") - 2), met(F.col(f"m{j}"))), pair(F.col(f"m{j}")))).alias(f"q{j}") for j, _ in names])
    beside = lambda q: lambda x, i: F.coalesce(x["o"] == F.get(q, i - 1)["o"], F.lit(False)) | F.coalesce(x["o"] == F.get(q, i + 1)["o"], F.lit(False)) | (F.size(q) == 1)
    return df.select(*cols, *[(2.0 * F.size(F.filter(f"q{j}", beside(F.col(f"q{j}")))) / (F.size(a) + F.size(b))).alias(out) for j, (out, (a, b)) in names])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and next_text of every row of `docs`, by descending doc_id; the last is followed by the first.

    Rows of one id are ordered by a hash of their text, then by where they are stored; a null id is the smallest. Narrow keys are
    sorted first; their slices of about SLICE_BYTES of text, of which a search in at most MOST_SLICES cuts tells each row its own,
    are windows of bounded size, and each slice gets the next one's first row too."""
    try:
        docs = settled(docs)
        docs.select("_metadata.row_index")
    except AnalysisException:                        # no files that can number their rows
        docs = staged(docs.select("doc_id", "text"), "rows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("k4"))
    rows = rows.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1)).alias("k1"), F.xxhash64("text").alias("k2"), F.xxhash64("file").alias("k3"), "k4")
    keys = staged(rows.select(*KEY, F.octet_length("text").alias("size")), "keys")
    slices = min(MOST_SLICES, 1 + (keys.agg(F.sum("size")).first()[0] or 0) // SLICE_BYTES)
    # at most MOST_SLICES rows
    cuts = sorted(tuple(r.least) for r in keys.repartitionByRange(slices, *KEY).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*KEY)).alias("least")).collect())
    cut = F.from_json(F.lit(json.dumps([dict(zip(KEY, c)) for c in cuts])), "array<struct<" + ",".join(f"{k}:long" for k in KEY) + ">>")
    key, n = F.struct(*KEY), max(1, len(cuts))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    find = F.aggregate(steps, F.lit(0), lambda at, b: F.when(F.coalesce(F.get(cut, at + b) <= key, F.lit(False)), at + b).otherwise(at))
    cut_rows = rows.withColumn("slice", find)
    heads = cut_rows.where(F.coalesce(F.get(cut, F.col("slice")) == key, F.lit(False))).withColumn("slice", F.pmod(F.col("slice") - 1, F.lit(n))).withColumn("lent", F.lit(True))
    both = cut_rows.withColumn("lent", F.lit(False)).unionByName(heads)
    return both.withColumn("next_text", F.lead("text").over(in_order()))


def in_order():
    return Window.partitionBy("slice").orderBy("lent", *KEY)


def fingerprints(docs: DataFrame, k: int = K, inner: int = INNER) -> DataFrame:
    """Every row of `docs` (doc_id, text; other columns are ignored): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has the last half of a text's characters replaced by the first as many (or all) of the next document's. A null
    text is empty. A text without units is like every other such text and like no text with units; for the order of equal and
    null ids see `with_next`. Repeated rows are documents of their own. An empty table stays empty; a single row is its own next."""
    a = with_next(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    a = a.select("doc_id", "text", "slice", "lent", *KEY, edited.alias("edited"))
    a = with_anchors(a, {"text": "own", "edited": "changed"}, k, inner)
    a = a.select("doc_id", "slice", "lent", *KEY, F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "changed")
    a = a.withColumn("following", F.lead("own").over(in_order())).where("NOT lent")
    a = with_likeness(a, {"near_edited": ("own", "changed"), "near_next": ("own", "following")})
    return a.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt,
      coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS nid FROM d),
e AS (SELECT *, t[:length(t) - length(t) // 2] || nt[:length(t) // 2] AS et FROM o),
a AS (SELECT doc_id, 0 AS s, t FROM e UNION ALL SELECT doc_id, 1, et FROM e),
u AS (SELECT doc_id, s, regexp_extract_all(t, '{UNIT}') AS u FROM a),
r AS (SELECT doc_id, s, u, i, md5(array_to_string(u[i + 1:i + {INNER}], ' ')) AS g FROM (SELECT *, unnest(range(0, len(u) - {INNER - 1})) AS i FROM u)),
w AS (SELECT *, min(g) OVER x AS least, last_value(g) OVER x AS final, count(*) OVER x AS n
      FROM r WINDOW x AS (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - INNER} FOLLOWING)),
k AS (SELECT doc_id, s, left(md5(array_to_string(u[i + 1:i + {K}], ' ')), {HASH}) AS h, i AS p FROM w WHERE n = {K - INNER + 1} AND (g = least OR final = least)),
z AS (SELECT * FROM k UNION ALL SELECT doc_id, s, left(md5(array_to_string(u, ' ')), {HASH}), 0 FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = u.doc_id AND k.s = u.s)),
f AS (SELECT doc_id, s, h, min(p) AS p FROM z GROUP BY doc_id, s, h),
c AS (SELECT doc_id, s, count(*) AS n, string_agg(h || '@' || p, ' ' ORDER BY h) AS said FROM f GROUP BY doc_id, s),
x AS (SELECT doc_id, doc_id AS b, 1 AS bs FROM e UNION ALL SELECT doc_id, nid, 0 FROM e),
m AS (SELECT x.doc_id, bs, f.p, f.p - y.p AS o FROM x JOIN f ON f.doc_id = x.doc_id AND f.s = 0 JOIN f AS y ON y.doc_id = x.b AND y.s = bs AND y.h = f.h),
l AS (SELECT *, lag(o) OVER v AS q1, lead(o) OVER v AS q2, count(*) OVER (PARTITION BY doc_id, bs) AS n FROM m WINDOW v AS (PARTITION BY doc_id, bs ORDER BY p)),
g AS (SELECT doc_id, bs, count(*) AS hits FROM l WHERE o = q1 OR o = q2 OR n = 1 GROUP BY doc_id, bs),
y AS (SELECT x.doc_id, x.bs, 2.0::DOUBLE * coalesce(hits, 0) / (c1.n + c2.n) AS near FROM x JOIN c AS c1 ON c1.doc_id = x.doc_id AND c1.s = 0 JOIN c AS c2 ON c2.doc_id = x.b AND c2.s = x.bs
      LEFT JOIN g ON g.doc_id = x.doc_id AND g.bs = x.bs)
SELECT e.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, c0.said AS fingerprint, c1.said AS edited_fingerprint, y1.near AS near_edited, y0.near AS near_next
FROM e JOIN c AS c0 ON c0.doc_id = e.doc_id AND c0.s = 0 JOIN c AS c1 ON c1.doc_id = e.doc_id AND c1.s = 1
JOIN y AS y1 ON y1.doc_id = e.doc_id AND y1.bs = 1 JOIN y AS y0 ON y0.doc_id = e.doc_id AND y0.bs = 0
"""
