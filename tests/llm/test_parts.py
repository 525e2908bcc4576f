"""The parts that run inside tasks, against brute force on made-up input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import lines, mixing, mtree, packing, records, simhash, sketch, substring, suffixes, tokens
from fathomline.llm.common import text_slices, word_bounds

TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0 aZé'.,!?;:0²½Ⅷ´漢字👍́​<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_tokenizers_own(text):
    coder = tokens.encoder()
    assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> x", "it's we'll don't I'D", "a\n\n\n  b   ", "  lead", "word,word.word", "été déjà-vu", "x" * 3000])
def test_ids_of_odd_texts(text):
    coder = tokens.Encoder(remembered=2)
    assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text_are_the_librarys():
    coder = tokens.Encoder()
    for text in ("<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "  <|endoftext|>  x\n", "<|endoftext|><|endoftext|>", "<|endoftext|", "it's<|endoftext|>'s, 12<|endoftext|>3"):
        assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert 50256 in coder.ids("a<|endoftext|>b").tolist()


def test_long_text_takes_the_same_ids(monkeypatch):
    text = "Some words, and more of them.\n" * 50
    want = tokens.encoder().ids(text).tolist()
    monkeypatch.setattr(tokens, "LONG_TEXT", 10)
    assert tokens.encoder().ids(text).tolist() == want


def test_records_check_themselves():
    record = records.frame(records.payload_of(7, np.array([1, 2, 50000], dtype="<u2")))
    doc_id, ids = records.parsed(records.unframe(record))
    assert doc_id == 7 and ids.tolist() == [1, 2, 50000]
    assert records.parsed(records.payload_of(None, np.array([], dtype="<u4")))[0] is None
    for k in range(len(record)):
        broken = record[:k] + bytes([record[k] ^ 1]) + record[k + 1:]
        with pytest.raises(ValueError):
            records.unframe(broken)
    with pytest.raises(ValueError):
        records.unframe(record[:-1])


def squares(lengths, bins):
    return int((np.bincount(bins, weights=lengths) ** 2).sum())


@pytest.mark.parametrize("seed", range(12))
def test_local_search_packs_and_never_worsens(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [40, 100, 60, 101][seed % 4], size=300)
    bins = packing.best_fit(lengths, 100)
    better = packing.improve(lengths, bins, 100)
    assert np.bincount(better, weights=lengths).max() <= 100
    assert squares(lengths, better) >= squares(lengths, bins)
    assert len(np.unique(better)) <= len(np.unique(bins))
    poor = np.arange(300)                                   # each alone
    better = packing.improve(lengths, poor, 100)
    assert np.bincount(better, weights=lengths).max() <= 100
    assert len(np.unique(better)) < 300


@pytest.mark.parametrize("lengths,bins,least", [([60, 30, 50, 40, 10, 10], [0, 0, 1, 1, 2, 2], 2), ([55, 50, 45, 50], [0, 1, 1, 2], 2),
                                                ([30, 40, 75, 25, 30], [0, 0, 1, 2, 2], 2)])
def test_swaps_empty_bins(lengths, bins, least):
    got = packing.improve(np.array(lengths), np.array(bins), 100)
    assert len(np.unique(got)) == least and np.bincount(got, weights=lengths).max() <= 100


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_take_each_block_once(n):
    for key in (0, 1, 2**63):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, dtype=np.uint64)).tolist()) == list(range(n))


def test_shard_counts_meet_what_is_owed():
    for seed in range(20):
        owed = [0, 5, 1000, 37, 1]
        got = mixing.shard_counts(owed, 7, seed)
        assert got.sum(axis=0).tolist() == owed and (got >= 0).all()
        assert max(got.sum(axis=1)) - min(got.sum(axis=1)) <= 7


def test_targets_share_the_excess_anew():
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [3, 1]) == [0, 0]
    assert mixing.targets([100, 100], [3, 1]) == [200, 100]
    got = mixing.targets([10, 100, 100], [3, 1, 2])
    assert np.allclose(got, [20, 295 / 3, 590 / 3]) and np.isclose(sum(got), 315)


def brute_links(own, lookers, distance):
    n = len(own)
    pairs = [(a, b) for a in range(n) for b in range(a) if int(own[a] ^ own[b]).bit_count() <= distance]
    return pairs + [(n + a, b) for a in range(len(lookers)) for b in range(n) if int(lookers[a] ^ own[b]).bit_count() < distance]


@pytest.mark.parametrize("small", [512, 0])
@pytest.mark.parametrize("seed", range(8))
def test_file_links_keep_groups_together(seed, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(seed)
    spread = (1 << 32) - 1 if seed % 2 else (1 << 9) - 1
    own = np.unique(rng.integers(0, spread, size=60, dtype=np.uint64))
    lookers = np.r_[own[:20] ^ (np.uint64(1) << rng.integers(0, 32, size=20).astype(np.uint64)), rng.integers(0, spread, size=10, dtype=np.uint64)]
    a, b = simhash.file_links(own, lookers, 3)
    total = len(own) + len(lookers)
    want = simhash._roots(total, *(np.array([p[k] for p in brute_links(own, lookers, 3)], dtype=np.int64) for k in (0, 1)))
    got = simhash._roots(total, a, b)
    assert got.tolist() == want.tolist() and len(a) < total


def test_sketch_loses_no_repeat():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, size=5000, dtype=np.uint64)
    all_keys = np.r_[keys, keys[:700]]
    width, counts = 1 << 20, np.zeros((sketch.DEPTH, 1 << 20), dtype=np.uint8)
    import zstandard
    for part in (all_keys[:3000], all_keys[3000:]):
        for segment, data in sketch.segments(part, width):
            row, at = divmod(segment, width // sketch.SEGMENT)
            at *= sketch.SEGMENT
            counts[row, at:at + sketch.SEGMENT] = np.minimum(2, counts[row, at:at + sketch.SEGMENT] + np.frombuffer(zstandard.decompress(data), dtype=np.uint8))
    seen = sketch.Repeats(width, np.packbits(counts >= 2, axis=1, bitorder="little").tobytes())
    assert seen.may_repeat(keys[:700]).all()
    assert seen.may_repeat(keys[700:]).mean() < 0.01


def test_bloom_filters():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, size=2000, dtype=np.uint64)
    f = lines.Filter(1 << 20)
    f.add(keys[:1000])
    assert f.may_hold(keys[:1000]).all() and f.may_hold(keys[1000:]).mean() < 0.01
    assert len(f.may_hold(keys[:0])) == 0


def test_line_keys():
    keys, owner = lines.keys_of(pa.array(["  A\tb\x0b\n\nÉ \x1c", None, ""]))
    assert keys.to_pylist() == ["a\tb", "", "É \x1c", "", ""] and owner.tolist() == [0, 0, 0, 1, 2]
    same = lines.hashes_of(pa.chunked_array([pa.array(["xx", "abc", "abc"], pa.large_string())]).combine_chunks().slice(1))
    assert same[0] == same[1]


def one_buffer(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    (_, raw, ends), = list(text_slices(batch, 0))
    return raw, ends


def test_word_bounds_end_at_texts():
    texts = ["ab c", None, "", "d", "\t e\x0b", "f\xa0g"]
    raw, ends = one_buffer(texts)
    a, b = word_bounds(raw, ends)
    assert [raw[x:y].tobytes() for x, y in zip(a, b)] == [w for t in texts for w in (t or "").encode().split()]


def least_runs_agree(texts, runs_of, units, window):
    """Equal windows have equal runs, and each run is counted at least as often as any window that it tells."""
    raw, ends = one_buffer(texts)
    first, runs, counted, *_ = runs_of(raw, ends)
    said = {}
    count = {}
    for r in counted.tolist():
        count[r] = count.get(r, 0) + 1
    seen = {}
    k = 0
    for u in units:
        for i in range(len(u) - window + 1):
            key = tuple(u[i:i + window])
            seen[key] = seen.get(key, 0) + 1
            assert said.setdefault(key, int(runs[k])) == int(runs[k])
            k += 1
    assert k == len(first)
    assert all(count[said[key]] >= n for key, n in seen.items())


@pytest.mark.parametrize("seed", range(10))
def test_runs_overestimate(seed):
    random.seed(seed)
    base = [random.choice("abcde") * random.randint(1, 3) for _ in range(120)]
    texts = [" ".join(base[random.randint(0, 20):random.randint(40, 120)]) for _ in range(4)] + ["a " * 90, "short", ""]
    least_runs_agree(texts, substring.window_runs, [t.split() for t in texts], substring.WINDOW)
    long = [t * 4 for t in texts]
    least_runs_agree(long, suffixes.window_runs, [t.encode() for t in long], suffixes.WINDOW)


@pytest.mark.parametrize("seed", range(60))
def test_suffix_arrays_find_repeats(seed):
    random.seed(seed)
    window = random.choice([8, 16, 24, 200])
    letters = random.choice([b"a", b"ab", b"abc\0", bytes(range(256))])
    pool = [bytes(random.choice(letters) for _ in range(random.randint(1, 300))) for _ in range(3)]
    texts = list({b"".join(random.choice(pool)[random.randint(0, 5):] for _ in range(random.randint(1, 3))) for _ in range(random.randint(1, 5))})
    weights = np.array([random.choice([1, 1, 2]) for _ in texts])
    count = {}
    for t, k in zip(texts, weights):
        for i in range(len(t) - window + 1):
            count[t[i:i + window]] = count.get(t[i:i + window], 0) + k
    got = suffixes.repeated_strings(texts, weights, window)
    assert [g.tolist() for g in got] == [[count[t[i:i + window]] > 1 for i in range(len(t) - window + 1)] for t in texts]


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 100, size=3000, dtype=np.uint8)
    raw[-1] = 0
    t = raw.astype(np.int16) + 1
    t[-1] = 0
    order = suffixes.suffix_order(raw, t, np.ones(len(raw), dtype=bool), 200)
    text = raw.tobytes()
    found = [text[k:k + 200] for k in order if k + 200 <= len(text)]
    assert sorted(order.tolist()) == list(range(3000)) and found == sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_best_first_is_exact_and_leaves_out(seed):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-900, 900, size=(8, 6)).astype(float)
    x = np.concatenate([c + rng.integers(-20, 21, size=(50, 6)) for c in centers])
    nodes = {}
    for k, c in enumerate(centers):
        pages = []
        for at in np.array_split(np.arange(k * 50, k * 50 + 50), 4):
            page = x[at[0]]
            gap = np.sqrt(((x[at] - page) ** 2).sum(1))
            pages.append((page, float(np.sqrt(((page - c) ** 2).sum())), float(gap.max()), at, at, x[at], gap))
        nodes[k] = (c, pages)
    counted = []
    for own in range(0, 400, 40):
        found = mtree.best_first(x[own], own, 10, -np.inf, nodes, counted)
        score = (x @ x[own]).astype(int)
        want = sorted((k for k in range(400) if k != own), key=lambda k: (-score[k], k))[:10]
        assert found.ids.tolist() == want and found.score.tolist() == [score[k] for k in want]
    assert np.mean(counted) < 200                           # of 400
