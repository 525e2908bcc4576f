"""Phrases, the prefix trie and fingerprints: small shards, spilled queues, nulls, ties, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.llm import phrases, syncmers, trie
from tests.llm.test_edges import TYPES, docs, none  # noqa: F401
from tests.llm.test_edges import ROWS


def brute_phrases(rows, least, longest=3):
    count, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\x0b\x0c\r":
            t = t.replace(mark, "\n")
        for piece in t.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            words[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                count[lang or "und"].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        found = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        for x, a in found.items():
            if any(2 * b >= a for y, b in found.items() if len(y) > len(x) and any(y[i:i + len(x)] == x for i in range(len(y) - len(x) + 1))):
                continue
            score, k = min((10**6 * a * a // (f[x[:k]] * f[x[k:]]), k) for k in range(1, len(x)))
            out.append((lang, " ".join(x), a, f[x[:k]], f[x[k:]], words[lang], score))
    return sorted(out)


def test_phrases(spark, docs, none, monkeypatch):          # noqa: F811
    monkeypatch.setattr(phrases, "SLAB", 64)
    monkeypatch.setattr(phrases, "BUCKET", 5)
    rows = [(r[2], r[1]) for r in ROWS if r[0] != 6] + [("en", "red tape, Red  tape! red\ttape; tape red. \x1c é é red tape")] * 4 + [(None, "a a a a a"), ("und", "a a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, spot int, phrases string").repartition(3)
    got = sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, least=3).collect())
    assert got == brute_phrases(rows, 3) and got
    top = phrases.collocations(df, least=2, top=2).collect()
    assert {r.lang: r["rank"] for r in sorted(top, key=lambda r: r["rank"])} == {"en": 2, "fr": 2, "und": 1} or max(r["rank"] for r in top) <= 2
    assert phrases.collocations(none).count() == 0


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest(), said))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def total(k):
        below = [total(x) for x in kids[k]]
        return (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0))
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *total(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rows = [(c, t, "user" if t % 2 else "bot", f"é{t * (c % 3)}") for c in range(60) for t in range(c % 11)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(12)]                     # one very common conversation
    rows += [(200, t, "user", str(t % 7)) for t in range(300)]                                           # and a long one
    return rows + [(-7, 1, None, None), (-7, None, "a", ""), (-7, 1, "b", "x"), (-7, 1, None, None), (-5, 3, "a", "z"), (None, 1, "a", "b"), (2**63 - 1, 0, "a", "b"), (1000, None, "", "")]


@pytest.mark.parametrize("shard, held, cut", [(100_000, 200_000, 4_096), (15, 2, 16)])
def test_trie(spark, monkeypatch, shard, held, cut):
    monkeypatch.setattr(trie, "SLICE", cut)
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = conversations()
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, shard string").repartition(4)
    got = trie.trie(df, shard=shard, held=held).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
    assert trie.trie(df.limit(0)).count() == 0


def test_queue_spills_and_merges(spark, tmp_path):
    q = trie.Messages(f"file://{tmp_path}/queue", 2, held=3)
    for k in (5, 1, 4, 4, 9, 0, 7, 2, 8, 3):
        q.push((k, -k))
    assert len(q.files) == 2 and q.first() == (0, 0)
    assert [q.pop()[0] for _ in range(10)] == [0, 1, 2, 3, 4, 4, 5, 7, 8, 9] and q.first() is None
    q.close()
    assert not list((tmp_path / "queue").iterdir())


def brute_anchors(text, k=syncmers.K, inner=syncmers.INNER):
    units, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r" or c >= "฀":
            units += [word] if word else []
            word = ""
            units += [c] if c >= "฀" else []
        else:
            word += c
    units += [word] if word else []
    md5 = lambda u: hashlib.md5(" ".join(u).encode()).hexdigest()                # noqa: E731
    found = {}
    for i in range(len(units) - k + 1):
        g = [md5(units[i + j:i + j + inner]) for j in range(k - inner + 1)]
        if min(g) in (g[0], g[-1]):
            found.setdefault(md5(units[i:i + k])[:8], i)
    return found or {md5(units)[:8]: 0}


def brute_likeness(a, b):
    met = sorted((p, p - b[h]) for h, p in a.items() if h in b)
    hits = [i for i, (_, o) in enumerate(met) if len(met) == 1 or (i and met[i - 1][1] == o) or (i + 1 < len(met) and met[i + 1][1] == o)]
    return 2.0 * len(hits) / (len(a) + len(b))


def test_fingerprints(spark, docs, none, monkeypatch):      # noqa: F811
    monkeypatch.setattr(syncmers, "SLICE_BYTES", 2_000)
    rows = [(20 - k, t) for k, t in enumerate(dict.fromkeys(r[1] or "" for r in ROWS))] + [(40, " ".join(f"w{k}" for k in range(300))), (39, " ".join(f"w{k}" for k in range(3, 303))), (None, "漢字かな" * 40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, slice int, own string").repartition(5)
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        own, changed, near = brute_anchors(t), brute_anchors(edited), brute_anchors(n)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == " ".join(f"{h}@{p}" for h, p in sorted(own.items())) and r.edited_fingerprint == " ".join(f"{h}@{p}" for h, p in sorted(changed.items()))
        assert r.near_edited == pytest.approx(brute_likeness(own, changed)) and r.near_next == pytest.approx(brute_likeness(own, near))
    assert got[40].near_next > 0.9                          # a shifted copy
    again = syncmers.fingerprints(docs).collect()           # equal and null ids, repeated rows
    assert sorted((r.n_chars, r.fingerprint) for r in again) == sorted((len(t or ""), " ".join(f"{h}@{p}" for h, p in sorted(brute_anchors(t or "").items()))) for _, t, *_ in ROWS)
    assert syncmers.fingerprints(none).count() == 0
    one = syncmers.fingerprints(df.where("doc_id = 40")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert syncmers.fingerprints(df.select("doc_id", F.lit("a b").alias("text"))).where("near_next <> 1").count() == 0
