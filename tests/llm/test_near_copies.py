import random

import compare

import corpus_pipeline as pipeline
from tidemark.llm import near_copies
from tidemark.llm.common import table, written


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def plain_kept(docs):
    """(id, text) of the rows that stay, all pairs compared."""
    sets, root = [plain_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i])
    return sorted(min(g) for g in groups.values())


def texts():
    r = random.Random(7)
    docs = []
    for _ in range(60):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([1, 4, 6, 40, 120]))]
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = f"x{r.randrange(500)}"
            docs.append(" ".join(w))
    footer = " ".join(f"footer{i}" for i in range(30))
    docs += [f"{' '.join(f'y{r.randrange(900)}' for _ in range(20))} {footer}" for _ in range(30)]
    r.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


def test_stage_finds_every_similar_pair_and_no_other(spark):
    docs = texts()
    got = pipeline.near(spark, written(spark.createDataFrame(docs, "doc_id bigint, text string"), "near-test"), compare.SF)
    assert sorted(map(tuple, got.collect())) == plain_kept(docs) and len(plain_kept(docs)) < len(docs) - 20


def test_fixture_pairs_are_all_found(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("size(split(text, ' ')) >= 50").dropDuplicates(["text"]).select("doc_id", "text")
    docs = written(docs, "near-fixture")
    left = sorted(r["doc_id"] for r in pipeline.near(spark, docs, compare.SF).collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [i for i, _ in plain_kept(rows)]  # all pairs
    assert left == kept and len(kept) < len(rows)


def test_shared_shingles_that_the_sample_cannot_see(spark, monkeypatch):
    """Many texts below the similarity that share most of their words, and a group of near copies around one of them."""
    monkeypatch.setattr(near_copies, "OFTEN", 10**9)
    r = random.Random(3)
    shared = [f"s{i}" for i in range(45)]
    docs = [" ".join(shared + [f"y{r.randrange(9000)}" for _ in range(r.randint(12, 30))]) for _ in range(150)]
    for _ in range(150):
        w = list(shared) * 2
        for _ in range(r.randint(1, 7)):
            w[r.randrange(len(w))] = f"x{r.randrange(9000)}"
        docs.append(" ".join(w))
    r.shuffle(docs)
    docs = list(enumerate(docs))
    got = pipeline.near(spark, written(spark.createDataFrame(docs, "doc_id bigint, text string"), "near-hot"), compare.SF)
    assert sorted(map(tuple, got.collect())) == plain_kept(docs) and 100 < len(plain_kept(docs)) < 290


def test_a_group_is_linked_through_its_middle(spark, monkeypatch):
    """Texts with two words changed, below the similarity to one another, all similar to each of a few with one word changed."""
    pairs, plain = [], near_copies.verified

    def counted(found, *rest):
        found = written(found, "near-pairs")
        pairs.append(found.count())
        return plain(found, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    r = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(400):
        w = list(base)
        for at in r.sample(range(4, 146), 1 if i < 40 else 2):
            w[at] = f"x{r.randrange(10**6)}"
        docs.append(" ".join(w))
    r.shuffle(docs)
    docs = list(enumerate(docs))
    got = pipeline.near(spark, written(spark.createDataFrame(docs, "doc_id bigint, text string"), "near-middle"), compare.SF)
    assert sorted(map(tuple, got.collect())) == plain_kept(docs) == docs[:1]
    assert sum(pairs[1:]) < len(docs)  # what the first comparison leaves to the later ones


def test_paths_named_twice(spark, tmp_path):
    path, text = str(tmp_path / "t"), " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(0, text), (1, text + " end"), (2, "other words"), (3, None)], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    left = pipeline.near(spark, spark.read.parquet(path, path), compare.SF).collect()
    assert sorted(r["doc_id"] for r in left) == [0, 2, 3]


def test_rows_are_decided_one_by_one(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = [(1, text), (2, text + " more"), (2, " ".join(f"b{i}" for i in range(60))), (3, " ".join(f"c{i}" for i in range(60))), (3, " ".join(f"c{i}" for i in range(61)))]
    left = [r[1] for r in pipeline.near(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), compare.SF).collect()]
    assert len(left) == 3 and text in left and docs[2][1] in left
