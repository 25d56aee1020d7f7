from tidemark.operators import vocab as V


def test_both_ways_of_encoding_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["b", "a", "b", None, "zz"]), (2, []), (3, None), (4, ["c"] * 5), (5, ["é", ""])], "k long, tokens array<string>")
    vocab = V.build_vocab(rows.where("k <> 5"), "tokens", 1, ("zz",)).where("token IS NOT NULL").cache()
    by_join = {}
    for limit in (0, 16_000_000):
        monkeypatch.setattr(V, "BROADCAST_LETTERS", limit)
        coded = V.encode(rows, vocab, "k")
        back = V.decode(coded, vocab, "k")
        by_join[limit] = [sorted(map(str, coded.collect())), sorted(map(str, back.collect()))]
    assert by_join[0] == by_join[16_000_000]
    ids = {r["k"]: r["ids"] for r in coded.collect()}
    assert ids[2] == ids[3] == [] and ids[5] == [V.UNKNOWN] * 2 and ids[1][3] == V.UNKNOWN and len(set(ids[1])) == 4
    assert {r["k"]: r["tokens"] for r in back.collect()}[1] == ["b", "a", "b", "<unk>", "zz"]


def test_rare_tokens_alone_are_joined(spark, monkeypatch):
    """The most frequent tokens are broadcast, the rest is joined; rows stay rows, also those with an equal or a null key."""
    monkeypatch.setattr(V, "BLOCK", 4)
    monkeypatch.setattr(V, "BROADCAST_LETTERS", 180)
    data = [(i % 40 or None, [f"t{(i * j) % 23}" for j in range(i % 9)] + ["a", None, "b"] * (i % 2)) for i in range(90)] + [(41, None), (41, ["never"])]
    rows = spark.createDataFrame(data, "k long, tokens array<string>").repartition(3)
    vocab = V.build_vocab(rows.where("k <> 41"), "tokens", 2).where("token IS NOT NULL").cache()
    assert 0 < V.broadcast_part(vocab)[0] < vocab.count() and not V.broadcast_part(vocab)[1]
    ids = {r["token"]: r["idx"] for r in vocab.collect()}
    coded = V.encode(rows, vocab, "k")
    back = V.decode(coded.unionByName(spark.createDataFrame([(50, [10**6, 0]), (51, None)], "k long, ids array<long>")), vocab, "k")
    want = [(k, [ids.get(t, V.UNKNOWN) for t in ts or []]) for k, ts in data]
    assert sorted(map(str, want)) == sorted(str((r["k"], r["ids"])) for r in coded.collect())
    want = [(k, [t if t in ids else "<unk>" for t in ts or []]) for k, ts in data] + [(50, ["<unk>", "<pad>"]), (51, [])]
    assert sorted(map(str, want)) == sorted(str((r["k"], r["tokens"])) for r in back.collect())
