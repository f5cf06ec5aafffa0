"""Cross-tokenizer alignment: against a plain count with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyarrow import fs
from tokenizers import Tokenizer

from pointweave.llm import alignment as al

TEXTS = [
    "Hello world, this is a plain text.", "", None, "a  b", "naïve café – 中文 テスト 🙂", " leading", "trailing ", "line\nbreak", "<|endoftext|> and <s> </s> <0x41>",
    "▁ bar", "Hello world, this is a plain text.", "x" * 3000, "the of and to in " * 400, "Ⅷ ﬁ ①", "\x00 zero", "tab\there", "1234567890 3.14", "don't won't",
]


@pytest.fixture(scope="module")
def own():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(texts, own):
    a, b = own
    table, held, counts = byte_table(), [], Counter()
    for text in texts:
        row = None
        if text:
            a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            a_bytes = [bytes(table[c] for c in a.id_to_token(i)) for i in a_ids]
            b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                row = (a_ids, b_ids, np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist())
                counts.update((x, y) for x, i in zip(a_ids, row[2], strict=True) for y, j in zip(b_ids, row[3], strict=True) if i == j)
        held.append(row)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for row in held:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a_ids, b_ids, a_end, b_end = row
        links = [(x, y) for x, i in zip(a_ids, a_end, strict=True) for y, j in zip(b_ids, b_end, strict=True) if i == j]
        cuts, groups, start = sorted(set(a_end) & set(b_end)), [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, i in zip(a_ids, a_end, strict=True) if start < i <= cut) + "|" + ",".join(str(x) for x, i in zip(b_ids, b_end, strict=True) if start < i <= cut))
            start = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a_ids), len(b_ids), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_figures_are_those_of_a_plain_count(spark, own):
    r = random.Random(2)
    words = ["the", "Tion", "enßer", "中文", "🙂", "can't", "e.g.", "\n", " ", "12", "Zug"]
    texts = TEXTS + [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in al.alignment_counts(docs).collect()}
    want = dict(enumerate(plain(texts, own)))
    assert got == want and sum(w[0] > 0 for w in want.values()) > 40


def test_groups_are_given_with_their_ids(spark):
    text = "naïve café and 中文"
    row = al.alignments(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[1]["a"] is None
    a, b = al.byte_side(), al.piece_side()[1]
    lo = [0, 0]
    for i, j in zip(row[0]["a_last"], row[0]["b_last"], strict=True):
        assert a.joined(row[0]["a"][lo[0] : i + 1]) == b.joined(row[0]["b"][lo[1] : j + 1])
        lo = [i + 1, j + 1]
    assert lo == [len(row[0]["a"]), len(row[0]["b"])]


def test_special_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert al.alignment_counts(none).count() == 0
    empty = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "", "y")], "doc_id long, text string, pair string")
    assert [tuple(r[n] for n in NAMES) for r in al.alignment_counts(empty).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_small_bounds_give_the_same_counts(spark):
    docs = spark.createDataFrame([(i, f"the number {i % 7} of words is {i % 5}") for i in range(200)], "doc_id long, text string").repartition(3)
    links = al.linked(docs)
    whole = dict(al.partial_counts(links).groupBy("pair").sum("n").collect())
    parts = al.partial_counts(links, most_raw=50, most_held=10)
    assert dict(parts.groupBy("pair").sum("n").collect()) == whole and parts.count() > len(whole)


def test_shards_are_sorted_ranges_and_found_by_search(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(300) << 32 | r.randrange(40), r.randrange(1, 9)) for _ in range(4000)]
    want = Counter()
    for k, n in rows:
        want[k] += n
    folder = f"file://{tmp_path}/shards"
    shards = al.count_shards(spark.createDataFrame(rows, "pair long, n long").repartition(6), folder).collect()
    assert sum(s["n"] for s in shards) == len(want)
    counts = al.Counts(folder, [(s["name"], s["first"], s["last"], s["n"]) for s in shards])
    keys = np.array(sorted(want))
    assert counts.of(keys).tolist() == [want[k] for k in keys.tolist()]
    assert counts.of(keys[::7]).tolist() == [want[k] for k in keys[::7].tolist()]
    with pytest.raises(LookupError):
        counts.of(np.array([41]))
    best = {}
    for k, n in want.items():
        best[k & al.LOW] = max(best.get(k & al.LOW, 0), n)
    found = {}
    for s in shards:
        for b, n in zip(s["b"], s["best"], strict=True):
            found[b] = max(found.get(b, 0), n)
    assert found == best
    name, n = shards[0]["name"], shards[0]["n"]
    apart = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())  # not a local file system by its type
    assert counts._mapped(apart, f"shards/{name}.pairs", n).tolist() == counts._shard(0)[0].tolist()


def test_differences_give_back_the_pairs():
    pairs = np.array([5, 9, 1 << 40, (1 << 40) + 3])
    assert al._pairs(pa.array([np.diff(pairs, prepend=0).astype("<i8").tobytes(), b""]))[0].tolist() == pairs.tolist()
