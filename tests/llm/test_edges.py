"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.functions.staging import new_path
from fathomline.llm import lines, mixing, mtree, packing, quality, records, simhash, substring, suffixes, urls
from tests.llm.test_queries import assert_packed, brute_fingerprint, brute_groups

TYPES = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `given` int, `drop` string, `size` long, `shard` int, `fp` long, `quality score` int"
PASSAGE = " ".join(f"word{k}" for k in range(60))
LONG = "\n".join(f"Line {k} tells {k * k} things about {k * 7919 % 104729} words, {k * 31} of them new." for k in range(8_000))
ROWS = [
    (1, PASSAGE + "\nA shared line of text.\nown 1", "en", "b", 5), (2, "x " + PASSAGE + " y\n  a SHARED line of text. \nown 2", None, "a", None),
    (3, None, None, None, None), (4, "", "en", "b", 0), (None, None, None, None, None), (None, "A shared line of text.", "en", None, 1),
    (5, "A shared line of text.\nA shared line of text.", "en", "c", 3), (5, "A shared line of text.\nA shared line of text.", "en", "c", 3),
    (6, LONG, "en", "a", 9), (7, "short", "en", "c", 5), (8, " \t\n\x0b ", "en", "", 5), (9, "é" * 150 + "漢" * 100, "fr", "a", 250), (10, "é" * 150 + "漢" * 100, "fr", "a", 250),
    (11, "a" * 900, "en", "b", 900), (12, PASSAGE.upper(), "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "r", 1, "d", 7, 2, 3, 4) for r in ROWS], TYPES).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], TYPES)


def last(i):
    return 2**63 - 1 if i is None else i


def sha(b):
    return hashlib.sha256(b).hexdigest()


def windows_gone(units, window):
    count = Counter(tuple(u[i:i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        until = 0
        for i in range(len(u)):
            if i + window <= len(u) and count[tuple(u[i:i + window])] > 1:
                until = i + window
            gone[i] = i < until
        out.append(gone)
    return out


def test_substring_dedup(docs, none):
    units = [(t or "").encode().split() for _, t, *_ in ROWS]
    want = [(last(r[0]), len(u), sum(g), sha(b" ".join(w for w, x in zip(u, g) if not x))) for r, u, g in zip(ROWS, units, windows_gone(units, 35))]
    got = [(last(r.doc_id), r.n_words, r.n_removed, sha(r.kept.encode())) for r in substring.deduplicated(docs).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
    assert substring.deduplicated(none).count() == 0


@pytest.mark.parametrize("heavy", [suffixes.HEAVY, 1])
def test_suffix_dedup(docs, none, heavy):
    units = [(t or "").encode() for _, t, *_ in ROWS]
    want = []
    for r, u, g in zip(ROWS, units, windows_gone(units, 200)):
        spans = sum(b and not a for a, b in zip([False, *g], g))
        want.append((last(r[0]), len(u), sum(g), spans, sha(bytes(c for c, x in zip(u, g) if not x))))
    got = [(last(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in suffixes.deduplicated(docs, heavy=heavy).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
    assert suffixes.deduplicated(none).count() == 0


def brute_lines(rows):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()                          # noqa: E731
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(last(i))
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(held.get(key(x), ())) < 2 or last(i) == min(held[key(x)])]
        yield last(i), len(all_lines), len(all_lines) - len(kept), "\n".join(kept)


def test_line_dedup(docs, none):
    got = lines.deduplicated(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((last(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == sorted(brute_lines([r[:2] for r in ROWS]))
    assert {(r["row"], r["drop"], r["quality score"]) for r in got.collect()} == {("r", "d", 4)}
    assert lines.deduplicated(none).count() == 0
    with pytest.raises(ValueError):
        lines.deduplicated(docs.withColumn("n_lines", F.lit(1)))


def test_simhash_groups(docs, none):
    prints = [brute_fingerprint(r[1]) for r in ROWS]
    want = sorted((last(r[0]), p, c) for r, p, c in zip(ROWS, prints, brute_groups(prints, [last(r[0]) for r in ROWS])))
    got = simhash.grouped(docs).collect()
    assert sorted((last(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(last(r.doc_id) for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.grouped(none).count() == 0 and simhash.representatives(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(-5, 900), (3, 3)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}, -5: -5, 900: -5}


def test_token_records(spark, docs, none):
    path = new_path(spark, "records")
    index = records.write_records(docs, path)
    got = records.documents_of(index, path).collect()
    assert Counter(last(r.doc_id) for r in got) == Counter(last(r[0]) for r in ROWS)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))]
    assert [r.doc_id for r in order] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    shuffled = records.read_records(index.orderBy(F.rand(3)), path).collect()
    assert sorted((last(r.doc_id), r.n_tokens, r.ids_crc32) for r in shuffled) == sorted((last(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 0 for r in shuffled)
    empty = new_path(spark, "records")
    assert records.documents_of(records.write_records(none, empty), empty).count() == 0


def test_packing(spark, docs, none):
    got = packing.pack(packing.pieces_of(docs)).toPandas()
    assert_packed(got, packing.CAPACITY)
    assert Counter(map(last, got[got.piece == 0].doc_id.astype(object).where(got.doc_id.notna(), None).tolist())) == Counter(last(r[0]) for r in ROWS)
    assert packing.pack(packing.pieces_of(none)).count() == 0
    clash = spark.createDataFrame([(5, "a", 1, 2, 3)] * 4, "length int, `row` string, shard int, bin int, fill int")
    out = packing.pack(clash, capacity=10).collect()
    assert len(out) == 4 and len({r.sequence_id for r in out}) == 2 and {r["row"] for r in out} == {"a"}
    for bad in (None, 0, 11):
        with pytest.raises(Exception, match="length"):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), capacity=10)


def test_mix(docs, none):
    got = mixing.taken(docs).collect()
    sizes = Counter((last(r[0]), len((r[1] or "").encode().split())) for r in ROWS)
    assert Counter((last(r.doc_id), r["size"]) for r in got) == sizes and all(r.taken <= 2 * r["size"] for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(r.text.encode().split()) for r in rows) == sum(r.taken for r in got)
    assert all(r["row"] == "r" and r["size"] == 7 for r in rows)
    assert mixing.taken(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_quality(docs, none):
    got = {last(r.doc_id): r.quality for r in quality.judged(docs).collect()}
    assert got[3].n_words == got[4].n_words == got[2**63 - 1].n_words * 0 and got[3].base_failed and not got[3].kept
    assert got[6].kept and got[6].n_words == len(LONG.split()) and got[6].word_chars == sum(map(len, LONG.split()))
    assert got[5].n_dup_lines == 1 and got[5].n_repeat_words == 0 and got[8].n_words == 0
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 6}
    assert quality.judged(none).count() == 0 and quality.filtered(none).count() == 0
    with pytest.raises(ValueError):
        quality.judged(docs.withColumn("quality", F.lit(1)))


def test_quality_rules_line_by_line(spark):
    clean = "This is a sentence that ends well, and it goes on for quite a few more words than ten."
    other = "Another one follows here: it says something else altogether, at some length, before it stops."
    bad = ["Home | About | Contact | Help", "### !!! $$$ &&& words", "All rights reserved.", "no end", "WOW!! SO!! MANY!! MARKS!! HERE!!"]
    docs = spark.createDataFrame([(1, "\n".join([clean, *bad, other])), (2, "\n".join([clean, *bad * 9])), (3, clean + " " + other),
                                  (4, " ".join(["one two three four five six seven eight"] * 9) + ".")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in quality.filtered(docs).collect()} == {1: clean + "\n" + other, 3: clean + " " + other}
    assert quality.judged(docs).where("doc_id = 4").select("quality.n_repeat_words").first()[0] == 71          # the last window ends otherwise


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/x?y#z"), (2, None), (3, "no scheme"), (4, "x://"), (5, "http://www.example.com/en/"), (6, "http://example.com"), (7, "http://b.net/es/1"),
            (7, "http://b.net/es/1"), (None, "http://net/fr/"), (8, "http://" + "a." * 3000 + "com/" + "b/" * 3000), (9, "http://h/\nx://com/en"), (10, "http://com./"), (11, "http://x.com/fool/y")]
    pages = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, `row` string")
    got = {last(r.page_id): (r.host[:20], r.path[:8], r.rule, r.verdict) for r in urls.judged(pages, urls.rule_table(spark)).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[5][2:] == ("www.example.com/en/", "allow")
    assert got[2] == got[3] == got[4] == ("", "", None, "allow") and got[6] == ("example.com", "", None, "allow")
    assert got[7][2:] == ("net/es/", "block") and got[2**63 - 1][2:] == ("net/fr/", "block") and got[8][2] == "com/"
    assert got[9] == ("h", "/\nx://co", None, "allow") and got[10][2] is None
    assert urls.judged(pages, urls.rule_table(spark)).count() == len(rows)
    rules = urls.rule_table(spark, [("block", "x.com", "/fo"), ("allow", "com", "/fool/y"), ("block", "", "/"), ("allow", "x.com", "/fo"), ("block", "COM", "/fool/y")])
    assert {last(r.page_id): (r.rule, r.verdict) for r in urls.judged(pages, rules).collect()}[11] == ("com/fool/y", "block")
    assert urls.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judged(pages, urls.rule_table(spark, [])).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.judged(pages.withColumn("host", F.lit(1)), rules)


def test_top_k(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]),
               (7, [1.0]), (8, []), (100, [-0.0004, 2.0]), (200, [60000.0, 60000.0]), (300, [])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, `row` string")
    got = [tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()]
    big = 60000 * 1024
    assert sorted(r for r in got if r[0] == 0) == [(0, 1, 200, 1024 * big), (0, 2, 1, 1024**2), (0, 3, 2, 1024**2)]
    assert sorted(r for r in got if r[0] == 100) == [(100, 1, 200, (2048 - 1) * big), (100, 2, 2, 512 * 2047), (100, 3, 0, -1024)]
    assert sorted(r for r in got if r[0] == 300) == [(300, 1, 8, 0)]
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    alone = lambda x: mtree.top_k(spark.createDataFrame([(1, [x])], "vec_id long, embedding array<double>"), F.col("vec_id") == 1).collect()      # noqa: E731
    assert alone(1e30) == []
    with pytest.raises(Exception, match="too large"):
        alone(1e200)


def test_index_holds_every_row(spark):
    q = mtree.quantized(spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(700)], "vec_id long, embedding array<float>"))
    pages, _, _ = mtree.build(q)
    found = pages.select(F.explode("ids").alias("id"), F.size("ids").alias("n")).collect()
    assert sorted(r.id for r in found) == list(range(700)) and max(r.n for r in found) <= mtree.PAGE


def test_pipeline_stages(spark, docs, none):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (docs, none):
        now = start.select(*names, F.col("drop").alias("size"))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = new_path(spark, name)
            stage(spark, now, "").write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == [*names, "size"], name
        assert now.count() > 0 if start is docs else now.count() == 0
