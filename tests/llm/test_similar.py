"""Near-duplicates by the similarity of word shingles: planted copies, brute force, large groups."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import simhash, similar
from fathomline.llm.simhash import fingerprint

WORDS = [f"w{k}" for k in range(5000)]


def brute_set(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k:k + words]) for k in range(max(1, len(w) - words + 1))}


def brute_kept(rows, similarity=0.8):
    """The ids that stay, of rows (id, text) with distinct ids."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 5 * similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups[find(k)] = min(i, groups.get(find(k), i))
    return sorted(groups.values())


def changed(rng, words, similarity):
    """A copy whose words are replaced, one by one, as long as the similarity stays at or above the one given."""
    own, now = brute_set(" ".join(words)), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        new = now[:at] + [f"x{rng.random()}"] + now[at + 1:]
        other = brute_set(" ".join(new))
        if len(own & other) / len(own | other) < similarity:
            break
        now = new
    return now


@pytest.fixture(scope="module")
def planted():
    rng, rows = random.Random(7), []
    for k in range(200):
        words = rng.choices(WORDS, k=rng.randint(60, 400))
        rows += [(4 * k, " ".join(words)), (4 * k + 1, " ".join(changed(rng, words, (0.8, 0.85, 0.9, 0.95)[k % 4])))]
        if k % 2:                                     # these are not similar enough
            far = changed(rng, words, 0.7)
            own, other = brute_set(rows[-2][1]), brute_set(" ".join(far))
            if len(own & other) / len(own | other) < 0.8:
                rows.append((4 * k + 2, " ".join(far)))
    return rows


def test_planted_copies(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert not [i for i in kept if i % 4 == 1]
    assert kept == brute_kept(planted)


def test_fingerprints_come_first(spark, planted, monkeypatch):
    """The SimHash step finds all within three bits, what is alike of them is linked, and no band has to find it again."""
    texts = spark.createDataFrame(planted[:120] + [(i + 5000, t) for i, t in planted[:9]], "row long, text string").withColumn("id", F.col("row"))
    asked = []
    monkeypatch.setattr(similar, "fingerprint_pairs", lambda t, words, plain=similar.fingerprint_pairs: asked.append(plain(t, words)) or asked[-1])
    similar.kept_rows(texts.select(F.col("id").alias("doc_id"), "text"), 0.8, 5)
    assert len(asked) == 1
    rows = {r.row: fingerprint(r.text, 5) for r in texts.collect()}
    root = {r: r for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in similar.fingerprint_pairs(texts, 5).collect():
        x, y = find(r.leader), find(r.node)
        root[max(x, y)] = min(x, y)
    near = [(a, b) for a in rows for b in rows if a < b and (rows[a] ^ rows[b]).bit_count() <= 3]
    assert len(near) > 9 and all(find(a) == find(b) for a, b in near)


def test_large_groups_edges_and_ids(spark):
    rng = random.Random(3)
    words = rng.choices(WORDS, k=300)
    rows = [(k + 10, " ".join(changed(rng, words, 0.97))) for k in range(500)]            # near copies
    rows += [(k + 1000, "the same short text") for k in range(300)]                        # exact copies of fewer than five words
    rows += [(2000, "one"), (2001, "ONE"), (2002, "two"), (2003, ""), (2004, None), (2005, " \n"), (5, "The  same\tshort text")]
    far = rng.choices(WORDS, k=100)
    rows += [(3000 + k, " ".join(far[:70] + rng.choices(WORDS, k=30))) for k in range(60)]  # keys in common, too far apart
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = similar.representatives(docs, 0.8, 5)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == brute_kept(rows)
    twice = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in similar.representatives(twice, 0.8, 5).collect()), key=str) == [(7, "a b"), (None, "c")]
    assert similar.representatives(docs.limit(0), 0.8, 5).count() == 0


def test_a_similarity_that_keys_cannot_find_is_refused():
    assert similar.band_rows(0.8) == 5
    for wrong in (0, 0.1, 1.1):
        with pytest.raises(ValueError):
            similar.band_rows(wrong)


def test_marks_bound_the_similarity():
    rng = random.Random(5)
    for k in range(60):
        words = rng.choices(WORDS, k=rng.randint(1, 600))
        x, y = (similar.shingles(" ".join(w), 5) for w in (words, changed(rng, words, rng.random()) + rng.choices(WORDS, k=rng.randint(0, 300))))
        bound = similar.most_similar(*(similar.loaded_marks(similar.marks(h)) for h in (x, y)))
        assert bound >= similar.jaccard(x, y) - 1e-12
    assert similar.most_similar(*[similar.loaded_marks(similar.marks(similar.shingles("a b", 5)))] * 2) == 1.0


def test_keys_that_more_hashes_do_not_part(spark, monkeypatch):
    monkeypatch.setattr(similar, "MORE_ROWS", ())
    monkeypatch.setattr(similar, "SMALL", 1)
    monkeypatch.setattr(similar, "LEADERS", 3)
    rng = random.Random(11)
    shared = rng.choices(WORDS, k=100)
    rows = [(k, " ".join(shared + rng.choices(WORDS, k=20 + k % 3))) for k in range(12)]
    rows += [(20 + k, " ".join(changed(rng, rows[k][1].split(), 0.85))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert sorted(r.doc_id for r in similar.representatives(docs, 0.8, 5).collect()) == brute_kept(rows)


def unlike(rng, n, shared, own):
    """Texts that hold one passage, and are about shared / (shared + 2 * own) alike."""
    passage = rng.choices(WORDS, k=shared)
    return [" ".join(passage + rng.choices(WORDS, k=own + k % 3)) for k in range(n)]


def test_rounds_do_not_grow_with_the_groups_of_a_key(spark, monkeypatch):
    """Very many texts with one passage share keys without being similar: they are compared in cells, not leader after leader."""
    rng = random.Random(13)
    rows = list(enumerate(unlike(rng, 150, 120, 18)))
    rows += [(1000 + k, " ".join(changed(rng, rows[k][1].split(), 0.85))) for k in range(0, 150, 10)]
    written = []
    for module in (similar, simhash):
        monkeypatch.setattr(module, "staged", lambda df, name="staged", plain=module.staged: written.append(name) or plain(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert sorted(r.doc_id for r in similar.representatives(docs, 0.8, 5).collect()) == brute_kept(rows)
    assert written.count("files") == 2 and len(written) < 40


def test_blocks_of_a_large_key(spark, monkeypatch):
    """Keys that more hashes do not part are cut into blocks, of which each two meet; so are keys of many bytes."""
    rng = random.Random(17)
    rows = list(enumerate(unlike(rng, 30, 100, 15)))
    rows += [(100 + k, " ".join(changed(rng, rows[k][1].split(), 0.85))) for k in range(0, 30, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for name, value in (("MORE_ROWS", (2,)), ("SMALL", 4), ("LEADERS", 3), ("CELL_BYTES", 300)):
        monkeypatch.setattr(similar, name, value)
    assert sorted(r.doc_id for r in similar.representatives(docs, 0.8, 5).collect()) == brute_kept(rows)


def test_a_cell_finds_what_the_marks_of_two_do():
    rng, np = random.Random(19), similar.np
    texts = [rng.choices(WORDS, k=rng.randint(1, 500)) for _ in range(8)]
    texts += [changed(rng, t, s) for t in texts for s in (0.75, 0.8, 0.9)] + [["the", "same"] * 2000, ["the", "same"] * 2000 + ["x"]]
    loaded = [similar.counts(similar.shingles(" ".join(t), 5)) for t in texts]
    loaded.append(np.array([255] * 3 + [1] * 61, dtype=np.uint8))              # counts that stand for any number
    places, root = range(len(loaded)), np.arange(len(loaded)) // 2
    for side in (np.zeros(len(loaded), dtype=bool), np.arange(len(loaded)) % 3 == 0):
        got = sorted((min(k, o), max(k, o)) for k, others in similar.near_in_cell(root, side, loaded, 0.8) for o in others.tolist())
        assert got == [(a, b) for a in places for b in places if a < b and root[a] != root[b] and (not side.any() or side[a] != side[b])
                       and similar.most_similar(loaded[a].astype(np.int64), loaded[b].astype(np.int64)) >= 0.8]
        assert len(got) > 20


def test_a_cell_of_copies_returns_fewer_links_than_members():
    """Pairs of near copies grow with the square of their number; what a cell returns does not."""
    rng, np = random.Random(23), similar.np
    words = rng.choices(WORDS, k=300)
    sets = [similar.shingles(" ".join(changed(rng, words, 0.96)), 5) for _ in range(60)]
    root, side = np.arange(60) // 2, np.zeros(60, dtype=bool)
    assert sum(len(others) for _, others in similar.near_in_cell(root, side, [similar.counts(h) for h in sets], 0.8)) > 1000
    assert len(list(similar.links_in_cell(root, side, sets, 0.8))) == 29
