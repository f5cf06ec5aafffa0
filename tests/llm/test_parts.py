"""Tables that are kept in parts, and sets that are counted in parts of their shingles."""

from collections import Counter

from pointweave.llm import common, ngram_join


def test_parts_are_dropped_one_by_one(spark):
    rows = [(None, "x"), (-3, "a"), (1, "b"), (2, "c"), (5, "d")]
    parts = common.keep_parts(spark.createDataFrame(rows, "id long, v string"), "of", "id", 4)
    assert [sorted(r.v for r in p.collect()) for p in parts] == [["x"], ["a", "b", "d"], ["c"], []]
    common.drop_kept(parts[0])
    assert sum(p.count() for p in parts[1:]) == 4


def test_parts_of_shingles_make_up_all(spark):
    sets = [(1, [-(1 << 40), 5 << 16, 7]), (2, [5 << 16, 7, 9 << 16]), (3, [-(1 << 40), 9 << 17])]
    df = spark.createDataFrame(sets, "id long, set array<long>")
    repeated = [ngram_join._repeated(df, part) for part in range(ngram_join.PARTS)]
    want = {s: n for s, n in Counter(s for _, x in sets for s in x).items() if n > 1}
    assert {r.shingle: r.classes for p in repeated for r in p.collect()} == want
    shared = sorted((r.node, r.shingle) for i, p in enumerate(repeated) for r in ngram_join._shared(df, common.keep(p, "repeated"), i).collect())
    assert shared == sorted((i, s) for i, x in sets for s in x if s in want)
