"""Operators that compare or gather rows, against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointweave.llm import bpe, embedding_dedup, graph, line_dedup, ngram_join, packing
from pointweave.llm.shingles import shingle_set

rnd = random.Random(9)
WORDS = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 8))) for _ in range(400)]


def sentence(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def changed(text, share):
    words = text.split(" ")
    for _ in range(int(len(words) * share)):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return " ".join(words)


def corpus():
    base = [sentence(rnd.randint(40, 120)) for _ in range(12)]
    shared = sentence(30)
    texts = [base[0]] * 25 + [changed(base[1], 0.02) for _ in range(25)] + [changed(b, s) for b in base for s in (0, 0.01, 0.03, 0.06)]
    texts += [f"{shared}\n{sentence(rnd.randint(5, 60))}\n{shared}" for _ in range(20)] + ["\n".join(rnd.sample(base, 3)) for _ in range(10)]
    texts += [None, "", " \n\t", "one", "one two", "One  TWO", "a b c d e", sentence(9000), "\n\n", "!!! ...", base[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts, 5))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS] + [(None, "no id at all here", "x", 1, 2), (7, DOCS[2][1], "x", 1, 2)], "doc_id long, text string, component_id string, n_dropped int, node int")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    for n, m in ((60, 40), (200, 150), (30, 200)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        chain = [(i, i + 1) for i in range(1000, 1040)]
        star = [(2000, i) for i in range(2001, 2100)]
        u = Union([*range(n), *range(1000, 1041), *range(2000, 2100)])
        for a, b in edges + chain + star:
            u.link(a, b)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges + chain + star, "a long, b long")).collect()}
        assert got == {x: u.find(x) for x in u.up if u.find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join ---


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    u = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.link(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def test_jaccard_classes(docs, monkeypatch):
    want = brute_jaccard(DOCS)
    for frequent in (ngram_join.FREQUENT, 3):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        rows = ngram_join.jaccard_classes(docs).collect()
        assert len(rows) == len(DOCS) + 2
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
        assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert sum(i != c for i, (_, c) in want.items()) > 50
    assert ngram_join.jaccard_classes(docs.where("false")).count() == 0


def test_prefixes_lose_no_pair():
    """Whatever l each set picks, linked sets share the smaller of both in their prefixes."""
    frequent = np.sort(np.concatenate([shingle_set(t)[:30] for _, t in DOCS[:40] if t]))
    frequent = np.unique(frequent)
    counts = np.array([rnd.randint(8, 500) for _ in frequent])
    sets = [s for s in (shingle_set(t or "") for _, t in DOCS) if len(s)]
    cut = [ngram_join.prefix(s, frequent, counts) for s in sets]
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(np.intersect1d(a, sets[j]))
            if 100 * same >= 80 * (len(a) + len(sets[j]) - same):
                linked += 1
                assert len(np.intersect1d(cut[i][1], cut[j][1])) >= min(cut[i][0], cut[j][0])
    assert linked > 300 and len({m for m, _ in cut}) > 1


# --- line dedup ---


def normalised(line):
    line = re.sub(r"[!-/:-@\[-`{-~\r\f\x0B]+", "", line.lower().replace("\t", " "))
    return re.sub(" {2,}", " ", line).strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    """The lines that go, by edit similarity over all pairs alone."""
    places = defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if n := normalised(line):
                places[n].append((d, i))
    lines = list(places)
    u = Union(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if similar(a, lines[j]):
                u.link(i, j)
    first = {}
    for i, x in enumerate(lines):
        first[u.find(i)] = min(first.get(u.find(i), (1 << 60, 0)), min(places[x]))
    gone = defaultdict(set)
    for i, x in enumerate(lines):
        for d, pos in places[x]:
            if (d, pos) != first[u.find(i)]:
                gone[d].add(pos)
    return gone


def test_line_dedup(docs):
    gone = brute_lines(DOCS)
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(DOCS) + 2 and sum(map(len, gone.values())) > 60
    texts = dict(DOCS)
    for r in rows:
        if r.doc_id is None:
            assert r.text == "no id at all here" and r.n_dropped == 0
            continue
        text, drop = texts[r.doc_id], gone.get(r.doc_id, set())
        assert set(r.dropped or ()) == drop and r.n_dropped == len(drop) and r.n_lines == (0 if text is None else len(text.split("\n")))
        assert r.text == (text if not drop else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_pigeonhole_finds_every_near_value(spark):
    base = rnd.getrandbits(60)
    values = {base} | {base ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)) for _ in range(40)} | {rnd.getrandbits(60) for _ in range(100)}
    rows = [(i, v, 1, [rnd.getrandbits(30) for _ in range(line_dedup.ORDERS)]) for i, v in enumerate(sorted(values))]
    keys = defaultdict(set)
    for r in line_dedup.sketch_keys(spark.createDataFrame(rows, "h1 long, simhash long, kind int, least array<int>")).collect():
        keys[r.h1].add(r.key)
    assert all(keys[i] & keys[j] for i, a, *_ in rows for j, b, *_ in rows if bin(a ^ b).count("1") <= 2)


def test_line_dedup_runs_no_python(docs):
    lines = line_dedup.distinct_lines(docs)
    sketches = line_dedup.line_sketches(lines)
    for df in (lines, sketches, line_dedup.shared_keys(lines, sketches), line_dedup.dedup_lines(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    source = open(line_dedup.__file__).read()
    assert not re.search(r"\budf\b|mapIn|applyIn|\.rdd\b|toPandas|toArrow", source)


# --- line dedup against brute force on similarity alone ---


def replaced_words(line, share):
    words = line.split(" ")
    for i in rnd.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = "".join(rnd.choice("ijklmnop") for _ in range(len(words[i])))
    return " ".join(words)


def similar(a, b):
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 0.2 * longest and distance(a, b) <= int(0.2 * longest + 1e-9)


def found_pairs(spark, pairs):
    """For each pair of lines whether one of them is dropped, None if they aren't similar."""
    texts = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    gone = {r.doc_id for r in line_dedup.dropped_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert not any(2 * i in gone for i in range(len(pairs)))
    return [2 * i + 1 in gone if similar(normalised(a), normalised(b)) else None for i, (a, b) in enumerate(pairs)]


def distinct_lines(words, n):
    return [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))) for _ in range(words)) for _ in range(n)]


def mistyped(line, share):
    places = rnd.sample(range(len(line)), int(len(line) * share))
    return "".join(rnd.choice("ijklmnop") if i in places and c != " " else c for i, c in enumerate(line))


SHARES = (0.05, 0.1, 0.15, 0.2)


@pytest.mark.parametrize("words", [8, 12, 30, 70, 150])
def test_changed_lines_are_found(spark, words):
    pairs = [(x, replaced_words(x, share)) for share in SHARES for x in distinct_lines(words, 60)]
    found = found_pairs(spark, pairs)
    for i, share in enumerate(SHARES):
        own = [found[j] for j in range(60 * i, 60 * i + 60) if found[j] is not None]
        print("op5 words", words, share, sum(own) / len(own), len(own))
        assert len(own) > 20 and sum(own) / len(own) >= 0.9


def test_mistyped_lines_are_found(spark):
    pairs = [(x, mistyped(x, 0.05)) for words in (5, 12, 30, 70) for x in distinct_lines(words, 60)]
    found = [x for x in found_pairs(spark, pairs) if x is not None]
    print("op5 typos", [sum(found[i : i + 60]) for i in range(0, 240, 60)], len(found))
    assert len(found) > 200 and sum(found) / len(found) >= 0.8


def test_trimming_keeps_distances(spark):
    lines = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))) for _ in range(40)] + ["漢字abc", "漢字xbc", "é" * 9, "é" * 8]
    pairs = [(i, j, a, b) for i, a in enumerate(lines) for j, b in enumerate(lines)]
    out = line_dedup._trimmed(spark.createDataFrame(pairs, "a int, b int, line_a string, line_b string"))
    rows = out.selectExpr("a", "b", "size", "levenshtein(line_a, line_b) d", "length(line_a) n").collect()
    assert all(r.d == distance(lines[r.a], lines[r.b]) and r.size == max(len(lines[r.a]), len(lines[r.b])) for r in rows)
    assert any(r.n < len(lines[r.a]) for r in rows)


def test_similarity_is_of_characters(spark):
    """Short lines, typos in many words and scripts without spaces, against brute force over all pairs."""
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(150))
    lines = ["alpha", "alphb", "alph", "abcd", "abce", "of it to us", "of it to uz", "12345678901", "1234x678y01", "漢字漢語日本東京", "漢字漢語日木東京", han, han[:70] + "x" + han[75:], han[:100]]
    lines += [x for y in distinct_lines(8, 6) for x in (y, "q" + y[1:-1] + "q")] + [x for y in distinct_lines(2, 6) for x in (y, y[:3] + y[4:])]
    u = Union(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if similar(a, lines[j]):
                u.link(i, j)
    got = {r.doc_id for r in line_dedup.dropped_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i for i in u.up if u.find(i) != i} and {1, 2, 6, 8, 10, 12} <= got and not {4, 13} & got


# --- embeddings ---


def vectors():
    random_ = np.random.default_rng(4)
    points = random_.normal(size=(400, 16))
    groups = [points[i] + random_.normal(size=(30, 16)) * s for i, s in ((0, 0.02), (1, 0.05), (2, 0.2))]
    rows = [v.astype(np.float32).tolist() for v in np.concatenate([points, *groups])] + [[1.0] * 16] * 40
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [3.0, -2.0, 1.0], [1e30] * 16, [1e-30] * 16]
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("margin, block, cell", [(4.0, 1024, 2048), (4.0, 16, 60), (None, 32, 60)])
def test_near_duplicate_vectors(spark, margin, block, cell):
    rows = vectors()
    units = {i: embedding_dedup.unit(v) for i, v in rows}
    u, n = Union(units), defaultdict(int)
    for a, x in units.items():
        for b, y in units.items():
            if a < b and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95:
                u.link(a, b)
                n[a] += 1
                n[b] += 1
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, cell int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, margin=margin, block=block, cell_rows=cell).collect()}
    want = {i: (n[i], u.find(i), u.find(i) == i) for i in units}
    if margin is None:
        assert got == want
    found, all_ = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found / all_ > 0.99  # measured: 1.0
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_links_of_64_dimensions_over_many_cells(spark):
    """With the production margin; cells of 60 rows make about 20, whose borders the loose groups straddle."""
    random_ = np.random.default_rng(5)
    points = random_.normal(size=(300, 64))
    rows = np.concatenate([points, *(points[i] + random_.normal(size=(30, 64)) * (0.1 + 0.005 * i) for i in range(30))]).astype(np.float32)
    units = np.array([embedding_dedup.unit(v) for v in rows])
    links = np.triu(units @ units.T >= embedding_dedup.THRESHOLD, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, cell_rows=60).collect()}
    want = links.sum(0) + links.sum(1)
    print("op3 links", sum(got.values()) // 2, "of", links.sum(), "cells", len(rows) // 60)
    assert links.sum() > 1000 and all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum()


# --- packing ---


def test_packing_holds_each_id_once(docs):
    rows = packing.packed(docs, most=256, shard_docs=40).collect()
    enc = bpe.from_vocabulary()
    texts = DOCS + [(None, "no id at all here"), (7, DOCS[2][1])]
    ids = [(i, np.array([*enc.encode_ordinary(t or ""), 1], "<u4")) for i, t in texts]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for (doc, n), own in pieces.items():
        same = [x for i, x in ids if i == doc and len(x) == n]
        assert sum(r.length for r in own) == n * len(same)
        assert all(zlib.crc32(same[0][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length > 0 for r in own)
        covered = np.zeros(n, int)
        for r in own:
            covered[r.start : r.start + r.length] += 1
        assert (covered == len(same)).all()
    assert sum(len(x) for _, x in ids) == sum(r.length for r in rows)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = 0
        for r in own:
            assert r.offset == total
            total += r.length
        assert total <= 256 and (total == 256 or total & total - 1 == 0)
    assert packing.packed(docs.where("false")).count() == 0


def test_bm25_and_greedy_filling():
    texts = [np.array(t, np.uint16) for t in ([1, 2, 3, 4, 9], [1, 2, 3, 9], [50, 51, 9], [2, 3, 9], [60] * 20)]
    n, df = len(texts), defaultdict(int)
    for t in texts:
        for x in set(t.tolist()):
            df[x] += 1
    idf, mean = np.zeros(100), float(np.mean([len(t) for t in texts]))
    for x, k in df.items():
        idf[x] = np.log1p((n - k + 0.5) / (k + 0.5))
    got = packing.Index(texts, idf, mean).scores(0)
    for d, t in enumerate(texts):
        want = sum(idf[x] * (tf := t.tolist().count(x)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in set(texts[0].tolist()))
        assert np.isclose(got[d], want)
    first = packing.pack(texts[:4], idf, mean, 10)[0]
    assert [p[0] for p in first][:2] == [0, 1] and sum(p[2] for p in first) == 10


def test_packing_searches_all_documents(spark):
    """The sequences are those of one index over the whole table."""
    texts = [sentence(rnd.randint(20, 60)) for _ in range(700)]
    enc = bpe.from_vocabulary()
    ids = [np.array([*enc.encode_ordinary(t), 1], np.uint16) for t in texts]
    seen, counts = packing._signs(enc.n_vocab), np.zeros(enc.n_vocab)
    for x in ids:
        counts[np.unique(x)] += 1
    order = sorted(range(len(ids)), key=lambda i: (seen[ids[i]].min(), i))
    idf = np.log1p((len(ids) - counts + 0.5) / (counts + 0.5))
    want = packing.pack([ids[i] for i in order], idf, sum(map(len, ids)) / len(ids), 256)
    got = defaultdict(list)
    for r in packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=256).orderBy("sequence_id", "offset").collect():
        got[r.sequence_id].append((r.doc_id, r.start, r.length))
    assert list(got.values()) == [[(order[d], s, n) for d, s, n in x] for x in want]


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 7 == 0 and 1 or 0) for i, _ in DOCS], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "packing"]
    lines = pipeline.line_dedup(spark, frame, str(tmp_path))
    assert lines.columns == frame.columns and lines.where("text is not null and n_chars <> length(text)").count() == 0
    kept = pipeline.ngram_join(spark, frame, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute_jaccard(DOCS).items() if c == i} | {None}
    assert pipeline.run(spark, str(tmp_path)).columns == packing.PIECES.names


def test_many_cells_take_little_memory():
    """The largest number of cells, in 768 dimensions: no array of cells x cells x dimensions."""
    import tracemalloc

    centres = np.random.default_rng(1).normal(size=(embedding_dedup.MOST_CELLS, 768))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    tracemalloc.start()
    apart = embedding_dedup.distances(centres)
    home, best = embedding_dedup.nearest_centre(centres, centres)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert np.isinf(np.diag(apart)).all() and abs(apart[0, 1] - np.linalg.norm(centres[0] - centres[1])) < 1e-9
    assert home.tolist() == list(range(len(centres))) and np.allclose(best, 1)
