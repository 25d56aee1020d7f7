import base64
import random
import zlib
from hashlib import sha256

import compare
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, pieces, queries, rans, token_files, tokens
from tidemark.llm.common import scratch
from tidemark.llm.files import new_file, stored_file

PARTS = ["a", "ab", "word", "Über", "été.", "foo,", " ", "  ", "\n", "\n\n", "'s", " 's", "'", "'re", "'r", "'ll", "l", "!", "é", "1", "\t", "\r\n", "\x1c", "　", "<|endoftext|>", "x y", "​", "\x85", "日本", "\xa0", "Ⅷ", "²", "\U0001f600", "٣", "\x00", "%%%"]


def mixed(seed, n, most=40):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.BYTE_BPE)
    return lambda texts: [np.array(e.ids, "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def reference():
    with open(queries.MULTI_BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_give_the_librarys_ids(library):
    coder = tokens.Encoder(queries.BYTE_BPE)
    texts = mixed(1, 4000) + ["", "x" * 5000, " " * 300 + "y"]
    for _ in range(2):  # cold and warm
        assert all(np.array_equal(a, b) for a, b in zip(coder.encode(texts), library(texts), strict=True))


def test_a_full_table_starts_anew(library):
    coder = tokens.Encoder(queries.BYTE_BPE)
    coder.table.limit = 50
    texts = mixed(2, 300)
    for i in range(0, 300, 10):
        assert all(np.array_equal(a, b) for a, b in zip(coder.encode(texts[i : i + 10]), library(texts[i : i + 10])))
    assert len(coder.table) <= 50


def test_pieces_whose_hashes_meet_are_told_apart(library, monkeypatch):
    real = pieces.hashes
    monkeypatch.setattr(pieces, "hashes", lambda p, s: real(p, s) & np.uint64(7))
    coder = tokens.Encoder(queries.BYTE_BPE)
    texts = mixed(3, 50)
    assert all(np.array_equal(a, b) for a, b in zip(coder.encode(texts), library(texts)))


def test_scan_and_merges_match_the_library(reference):
    coder = bpe.Ranks(queries.MULTI_BPE)
    texts = mixed(4, 5000) + ["a" * 4000, "!" * 3000 + "abc" * 2000, "é" * 3000, " " * 4000 + "x", "ab" * 4000, "", "'"]
    for t, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()
        at = coder.offsets(ids)
        assert at[-1] == len(t.encode()) and [t.encode()[a:b] for a, b in zip(at, at[1:])] == [coder.tokens[i] for i in ids]


def test_bpe_query_matches_the_library(spark, reference):
    texts = dict(spark.read.parquet(f"{compare.SF}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op4_byte_bpe(spark, compare.SF).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_odd_rows(spark, odd_docs, no_docs):
    coded = bpe.encode(odd_docs, queries.MULTI_BPE)
    rows = bpe.decode(coded, queries.MULTI_BPE).collect()
    assert sorted(bytes(r["text"]) for r in rows) == sorted((r["text"] or "").encode() for r in odd_docs.collect())
    assert all(r["offsets"][-1] == len(r["text"]) and len(r["offsets"]) == len(r["ids"]) + 1 for r in rows)
    assert bpe.digests(odd_docs, queries.MULTI_BPE).count() == odd_docs.count() and bpe.digests(no_docs, queries.MULTI_BPE).count() == 0


def test_rans_round_trip_and_checkpoints():
    r = np.random.default_rng(1)
    for n, most in ((0, 5), (1, 5), (1023, 50_000), (1024, 3), (5000, 50_000), (rans.LANES * rans.CHECKPOINT * 2 + 77, 300)):
        ids = (r.zipf(1.3, n) % most).astype(np.uint32) if n else np.zeros(0, np.uint32)
        table = rans.Table.of(np.bincount(ids, minlength=most))
        assert table.freq.sum() in (0, 1 << rans.SCALE)
        states, places, stream = rans.encode(ids, table)
        assert np.array_equal(rans.decode(n, states, places, stream, table), ids)
        for k in range(len(states)):
            assert np.array_equal(rans.decode(n, states, places, stream, table, k), ids[k * rans.LANES * rans.CHECKPOINT :])


def ids_of(spark, library):
    rows = spark.read.parquet(f"{compare.SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r["doc_id"]: np.append(i, np.uint32(0)) for r, i in zip(rows, library([r["text"] or "" for r in rows]))}


def test_token_files_query_matches_the_library(spark, library):
    want, start = {}, 0
    for d, ids in ids_of(spark, library).items():
        want[d] = (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op8_token_files(spark, compare.SF).collect()} == want


def test_token_files_odd_rows(spark, odd_docs, no_docs, library):
    folder = scratch(spark, "ids")
    token_files.write_ids(odd_docs, folder, queries.BYTE_BPE, block=100)
    rows = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    docs = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    assert sorted(tuple(r["ids"]) for r in rows) == sorted((*i.tolist(), 0) for i in library([d["text"] or "" for d in docs]))
    ends = [r["start"] + r["n_tokens"] for r in rows]
    assert [r["start"] for r in rows] == [0, *ends[:-1]]
    empty = scratch(spark, "ids")
    token_files.write_ids(no_docs, empty, queries.BYTE_BPE)
    assert token_files.read_ids(spark, empty).count() == 0


def test_a_broken_block_is_refused():
    ids = np.arange(3000, dtype=np.uint32) % 50
    table = rans.Table.of(np.bincount(ids))
    data = token_files.pack_block(np.array([4, 9]), np.array([1000, 2000]), ids, table)
    assert np.array_equal(token_files.unpack_block(data, table)[2], ids)
    for at in (30, 60, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack_block(bytes(broken), table)
    with pytest.raises(ValueError):
        token_files.unpack_block(data, rans.Table.of(np.bincount(ids) + np.arange(50)))


def test_cuts_are_the_cheapest():
    r = random.Random(8)
    for _ in range(150):
        n = r.randint(1, 90)
        at = np.array(sorted({0, n, *range(0, n, 7), *(r.randint(0, n) for _ in range(12))}))
        cost = np.array([r.randint(0, 20) for _ in at])
        cuts = packing.best_cuts(at, cost, 16)
        price = dict(zip(at.tolist(), cost.tolist()))
        pad = lambda k: 0 if k & (k - 1) == 0 else 16 - k
        best = {0: 0}
        for j in at.tolist()[1:]:
            best[j] = min(best[i] + pad(j - i) + price[j] + packing.EACH for i in best if 0 < j - i <= 16)
        assert cuts[0] == 0 and cuts[-1] == n and all(0 < b - a <= 16 for a, b in zip(cuts, cuts[1:]))
        assert sum(pad(b - a) + price[b] + packing.EACH for a, b in zip(cuts, cuts[1:])) == best[n]


def test_cuts_of_small_streams_with_their_own_places():
    """Cuts stand at document and sentence ends, inside only where a stretch without any is longer than a sequence; and no list of cuts is cheaper."""
    r = random.Random(9)
    for _ in range(100):
        n, capacity = r.randint(2, 160), 64
        doc, sentence = (np.array([r.random() < p for _ in range(n)]) for p in (0.03, r.choice([0.0, 0.01, 0.1])))
        at, cost = packing.places(doc, sentence, capacity)
        price = dict(zip(at.tolist(), cost.tolist()))
        ends = [0, *(i + 1 for i in range(n) if doc[i] or sentence[i]), n]
        assert all(any(a < p < b and b - a > capacity for a, b in zip(ends, ends[1:])) for p in price if p not in ends) and set(ends) <= set(price)
        pad, best = (lambda k: 0 if k & (k - 1) == 0 else capacity - k), {0: 0}
        for j in at.tolist()[1:]:
            best[j] = min(best[i] + pad(j - i) + price[j] + packing.EACH for i in best if 0 < j - i <= capacity)
        cuts = packing.best_cuts(at, cost, capacity)
        assert sum(pad(b - a) + price[b] + packing.EACH for a, b in zip(cuts, cuts[1:])) == best[n]


def morse(a, b, n=1024):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_texts_that_a_polynomial_hash_confuses_keep_their_own_ids(spark, library, reference):
    texts = ["x " + morse("a", "b"), "x " + morse("b", "a"), "x " + morse("é", "日", 2048), "x " + morse("日", "é", 2048), "plain"]
    assert (pieces.hashes(*pieces.code_points([morse("a", "b")])[1:2], np.array([0])) == pieces.hashes(*pieces.code_points([morse("b", "a")])[1:2], np.array([0]))).all()
    for _ in range(2):
        assert [x.tolist() for x in bpe.ranks(queries.MULTI_BPE).encode(texts)] == reference.encode_ordinary_batch(texts)
        assert all(np.array_equal(a, b) for a, b in zip(tokens.encoder(queries.BYTE_BPE).encode(texts), library(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    want = {i: np.append(x, np.uint32(0)) for i, x in enumerate(library(texts))}
    holds(packing.pack(docs, queries.BYTE_BPE).collect(), want)
    folder = scratch(spark, "ids")
    token_files.write_ids(docs, folder, queries.BYTE_BPE)
    assert {r["doc_id"]: r["ids"] for r in token_files.read_ids(spark, folder).collect()} == {i: x.tolist() for i, x in want.items()}
    rows = {r["doc_id"]: r for r in bpe.digests(docs, queries.MULTI_BPE).collect()}
    assert all(rows[i]["decoded_sha256"] == sha256(t.encode()).hexdigest() and rows[i]["n_tokens"] == len(reference.encode_ordinary(t)) for i, t in enumerate(texts))


def test_large_ids_beside_null_stay_exact(spark):
    ids = [2**53 + 1, 2**53, None, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id bigint, text string").coalesce(1)
    same = lambda rows: sorted((r["doc_id"] for r in rows), key=str) == sorted(ids, key=str)
    assert same(packing.pack(docs, queries.BYTE_BPE).collect())
    folder = scratch(spark, "ids")
    token_files.write_ids(docs, folder, queries.BYTE_BPE)
    assert same(token_files.read_ids(spark, folder).collect()) and same(token_files.read_ids(spark, folder, digest=True).collect())


def test_shards_of_attempts_that_did_not_count_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
    folder = scratch(spark, "ids")
    token_files.write_ids(docs, folder, queries.BYTE_BPE, block=10)
    name = token_files.manifest(spark, folder).first()["shard"]
    with stored_file(name) as f, new_file(name.replace(".ids", "9.ids")) as out:
        out.write(f.read())
    assert sorted(r["doc_id"] for r in token_files.read_ids(spark, folder).collect()) == list(range(20))


def test_offsets_lead_the_decoder(reference):
    coder = bpe.ranks(queries.MULTI_BPE)
    text = "Some words, ünï 日本 and 12 more."
    ids = coder.encode([text])[0]
    at = coder.offsets(ids)
    for i in range(len(ids)):
        for j in range(i, len(ids)):
            assert coder.decode(ids[i:j], at[i : j + 1]) == text.encode()[at[i] : at[j]]
    with pytest.raises(ValueError):
        coder.decode(ids, at + np.arange(len(at)))


def holds(rows, ids):
    """Every id lies in one piece, pieces lie gapless in sequences of at most 1024; returns the share of padding."""
    seen, length = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == length.get(r["sequence_id"], 0)
        length[r["sequence_id"]] = r["offset"] + r["length"]
        seen.setdefault(r["doc_id"], []).append(r)
    assert max(length.values()) <= 1024 and set(seen) == set(ids)
    for d, own in seen.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[d][at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[d]), zlib.crc32(part.astype("<u4").tobytes()))
            at += r["length"]
        assert at == len(ids[d])
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in length.values()) / sum(length.values())


def test_packing_query(spark, library):
    rows = queries.op6_packing(spark, compare.SF).collect()
    assert holds(rows, ids_of(spark, library)) < 0.03
    ids, ends = ids_of(spark, library), packing.sentence_ends(queries.BYTE_BPE)
    inside = [(r["doc_id"], r["start"] + r["length"]) for r in rows if r["ends_at"] == "inside"]
    for d, at in inside:  # in a stretch longer than a sequence that ends no sentence
        stops = [0, *(np.flatnonzero(ends[ids[d]]) + 1).tolist(), len(ids[d])]
        assert any(a < at < b and b - a > 1024 for a, b in zip(stops, stops[1:]))
    assert {r["ends_at"] for r in rows} <= set(packing.KINDS) and len(inside) < 0.05 * len(rows)


def test_packing_odd_rows(spark, odd_docs, no_docs, library):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: np.append(i, np.uint32(0)) for r, i in zip(docs.collect(), library([r["text"] or "" for r in docs.collect()]))}
    holds(packing.pack(docs, queries.BYTE_BPE).collect(), ids)
    rows = packing.pack(odd_docs, queries.BYTE_BPE).collect()
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in library([r["text"] or "" for r in odd_docs.collect()]))
    assert packing.pack(no_docs, queries.BYTE_BPE).count() == 0
