"""Every query of the folder on the smallest tables, beside its SQL or beside brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from fathomline.llm import catalog, mixing, packing
from fathomline.llm.common import table
from tests.conftest import SMALL
from tools.check import as_rows, connect

SPACES = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: t.encode(x or "", add_special_tokens=False).ids + [0] for k, x in texts.items()}


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert {n.split("_")[0] for n in set(catalog.QUERIES) - set(catalog.ORACLES)} == {"op3", "op6", "op7", "op8"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_beside_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert as_rows(got) == as_rows(want)


def test_token_records(spark, ids):
    start, want = 0, []
    for k in sorted(ids):
        want.append((k, start, len(ids[k]), crc(ids[k])))
        start += len(ids[k])
    got = catalog.QUERIES["op3_token_records"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_packing(spark, ids):
    got = catalog.QUERIES["op6_best_fit_packing"](spark, SMALL).toPandas()
    want = []
    for k, x in ids.items():
        first = len(x) % 2048 or 2048
        for j, a in enumerate([0, *range(first, len(x), 2048)]):
            part = x[a:first + 2048 * j]
            want.append((k, j, a, len(part), crc(part)))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    assert_packed(got, 2048)
    assert got.sequence_id.nunique() <= 1.01 * (got.length.sum() / 2048) + 1


def assert_packed(got, capacity):
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id").length
    assert (by.sum() <= capacity).all()
    assert (by.cumsum() - got.length == got.offset).all()


def brute_fingerprint(text, words=3):
    w = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(w[k:k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)) if shingles else 0


def brute_groups(prints, ids, distance=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


def test_simhash(spark, texts):
    keys = sorted(texts)
    prints = [brute_fingerprint(texts[k]) for k in keys]
    got = catalog.QUERIES["op7_simhash_near_dedup"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == list(zip(keys, (f"{x:016x}" for x in prints), brute_groups(prints, keys)))


def test_mix(spark, texts):
    got = catalog.QUERIES["op8_source_mix"](spark, SMALL).toPandas().sort_values("doc_id")
    again = catalog.QUERIES["op8_source_mix"](spark, SMALL).toPandas().sort_values("doc_id")
    assert got.reset_index(drop=True).equals(again.reset_index(drop=True))
    source = {r.doc_id: r.source for r in table(spark, SMALL, "documents").select("doc_id", "source").collect()}
    got["source"] = got.doc_id.map(source)
    assert got["size"].tolist() == [len(texts[k].encode().split()) for k in got.doc_id]
    assert (got.taken <= 2 * got["size"]).all()
    sums = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (sums["size"] == sums.told).all()
    want = mixing.targets(sums["size"].tolist(), [(3, 1, 2)[k % 3] for k in range(len(sums))])
    assert np.allclose(sums.target, want) and np.isclose(sums.target.sum(), 1.5 * sums["size"].sum()) and (sums.target <= 2 * sums["size"]).all()
    # half a block of rounding, and the last block of a source may be short
    assert ((sums.taken - sums.target).abs() <= 1.5 * mixing.BLOCK).all()


def test_packing_capacity_is_a_parameter(spark):
    got = packing.pack(packing.pieces_of(table(spark, SMALL, "documents"), capacity=100), capacity=100, shard_pieces=500).toPandas()
    assert_packed(got, 100)
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 100 + 1
