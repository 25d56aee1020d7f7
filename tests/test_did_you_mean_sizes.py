import random

from tidemark.operators import matching as M


def plain(typed, values, score, least, top):
    known = {v.lower() for v in values}
    out = []
    for t in {t for t in typed if t.lower() not in known}:
        found = sorted((-M.boosted(score.exact(t.lower(), v.lower()), t.lower(), v.lower()), v) for v in set(values))
        out += [(t, v, -s, i + 1) for i, (s, v) in enumerate([x for x in found if -x[0] >= least][:top])]
    return sorted(out)


def test_suggestions_match_scoring_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdé ", k=r.randint(1, 7)))
    values, typed = ["acb", "", "Zz", "x" * 300, *[word() for _ in range(150)]], ["abc", "z", "c", "ZZ", "xx", "y" * 280, *[word() + "e" for _ in range(60)]]
    frames = [spark.createDataFrame([(w,) for w in [*ws, None]], "v string") for ws in (typed, values)]
    for rows, block in ((20_000, 2000), (25, 7)):
        monkeypatch.setattr(M, "TYPED_ROWS", rows)
        monkeypatch.setattr(M, "BLOCK", block)
        for score in (M.FUZZY, M.EDITS, M.OVERLAP):
            for top in (3, 99):
                assert sorted(map(tuple, M.did_you_mean(*frames, score, top=top).collect())) == plain(typed, values, score, 50, top)


def test_few_pairs_are_compared():
    """20,000 values against 300 typed with two letters exchanged, left out or doubled: the first is always what was meant."""
    r = random.Random(9)
    part = ["".join(r.choices("bcdfglmnprst", k=1) + r.choices("aeiou", k=1) + r.choices("bdklmnrst", k=r.randint(0, 1))) for _ in range(300)]
    values = list({" ".join("".join(r.choices(part, k=r.randint(2, 3))) for _ in range(2)) for _ in range(20_000)})
    typed = []
    for v in values[:300]:
        i = r.randrange(1, len(v) - 1)
        typed.append(r.choice([v[:i] + v[i + 1] + v[i] + v[i + 2 :], v[:i] + v[i + 1 :], v[:i] + v[i] + v[i:]]))
    for score, most in ((M.FUZZY, 0.01), (M.EDITS, 0.15), (M.OVERLAP, 0.02)):
        met = M.Suggestions(typed, score, 50, 3)
        for i in range(0, len(values), M.BLOCK):
            met.show(values[i : i + M.BLOCK], values[i : i + M.BLOCK])
        print(met.tried / len(typed) / len(values), met.compared / len(typed) / len(values))
        assert met.compared < most * len(typed) * len(values)
        assert score is M.OVERLAP or sum(any(x == v for _, x in best) for best, v in zip(met.best, values)) >= 295


def test_edits():
    r = random.Random(1)

    def plain_edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for _ in range(500):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 9))) for _ in range(2))
        assert M.edits(a, b) == plain_edits(a, b)
