"""Operators that work row by row."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import bpe, bpe_tree, html_text, licenses, tiff, token_tree, toxicity

DOCS = [(1, "Released under the MIT License.\nIt's  naïve — 日本語 テキスト 123"), (2, None), (3, ""), (4, "x" * 70_000 + " tail"), (5, "a b " * 3000), (5, "a b " * 3000), (None, "no id"), (7, "  \n\t ")]
SCHEMA = "doc_id long, text string, n_tokens string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in DOCS], SCHEMA)


def rows(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=str)


# --- BPE ---


def test_bpe_is_the_library_s(docs):
    enc = bpe.from_ranks()
    want = []
    for i, t in DOCS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe_tree.bpe_digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe_tree.bpe_digests(docs.where("false")).count() == 0
    one = bpe_tree.bpe_encode(docs.where("doc_id = 1")).first()
    assert one["ids"] == enc.encode_ordinary(DOCS[0][1]) and bytes(one["decoded"]).decode() == DOCS[0][1]


def test_bpe_tree_of_any_shape():
    enc, rnd = bpe.from_ranks(), random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "é", "1", "23", "...", "　", "日本", "'re", " 's", "\t", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        assert bpe_tree.encode(text, enc, rnd.randint(2, 9)) == enc.encode_ordinary(text)
    for _ in range(15):
        text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéö日") for _ in range(rnd.randint(3000, 9000)))
        assert bpe_tree.encode(text, enc) == enc.encode_ordinary(text)


def test_vocabulary_file_gives_its_library_s_ids():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.VOCABULARY)
    odd = ["It's <|endoftext|> fine'll 've  \n\n x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "hi  <|endoftext|>  a\n<|endoftext|>\nb", "<|endoftext", "é日 <|endoftext|>'s"]
    texts = [t or "" for _, t in DOCS] + odd
    assert [bpe.as_library(bpe.from_vocabulary(), t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


# --- token trees ---


def test_counts_follow_edits(docs, spark):
    enc, rnd = bpe.from_ranks(), random.Random(2)
    parts = ["a", " ", "  ", "\n", "'s", "'", "re", "é", "1", "... ", "the "]
    for _ in range(400):
        tree = token_tree.TokenTree("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 200))))
        for _ in range(5):
            at = rnd.randint(-2, len(tree.text) + 2)
            tree.edit(at, at + rnd.randint(0, 9), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))))
            assert tree.n_tokens == len(enc.encode_ordinary(tree.text)) and tree.sums[1][0] == len(tree.text)
    out = token_tree.count_edited(token_tree.with_review_edits(docs))
    for r, (i, t) in zip(sorted(out.collect(), key=lambda r: str((r.doc_id, r.n_tokens))), sorted(DOCS, key=lambda d: str((d[0], len(enc.encode_ordinary(d[1] or ""))))), strict=True):
        text = "Reviewed: " + (t or "")
        middle = len(t or "") // 2 + 10
        text = text[:middle] + "[removed]" + text[middle + 24 :]
        assert (r.doc_id, r.n_tokens, r.n_tokens_after, r.n_chars_after) == (i, len(enc.encode_ordinary(t or "")), len(enc.encode_ordinary(text[:-5])), len(text) - 5)
    none = spark.createDataFrame([(1, "abc", None), (2, "abc", [None, (1, 99, None)])], "doc_id long, text string, edits array<struct<start: int, end: int, replacement: string>>")
    assert rows(token_tree.count_edited(none), "doc_id", "n_tokens_after") == [(1, 1), (2, 1)]


def test_edits_touch_little():
    tree = token_tree.TokenTree("one two three " * 2000)
    tree.edit(14_000, 14_003, "four")
    assert tree.reencoded < 12


# --- TIFF ---


@pytest.mark.parametrize("scheme", [(1, 1, False), (5, 1, False), (5, 2, True), (8, 2, True), (32773, 2, False), (32773, 1, True)])
def test_every_scheme_is_lossless(scheme):
    for n in (1, 5, 255, 256, 257, 1025, 2100):
        payload = random.Random(n).randbytes(100 * n).ljust(n * 192, b"a")
        pages = list(tiff.read_pages(tiff.write_pages(payload, scheme)))
        assert b"".join(p.pixels for p in pages) == payload and len(pages) == -(-n // 1024)


def test_big_endian_file_and_errors():
    import struct

    entries = [(256, 3, 3), (257, 3, 1), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8 + 2 + 12 * 9 + 4), (277, 3, 1), (278, 3, 1), (279, 4, 3)]
    body = b"MM\0*" + struct.pack(">IH", 8, 9) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in entries) + struct.pack(">I", 0) + b"xyz"
    page = next(tiff.read_pages(body))
    assert (page.width, page.height, page.pixels) == (3, 1, b"xyz")
    assert list(tiff.read_pages(None)) == []
    with pytest.raises(ValueError):
        list(tiff.read_pages(b"nothing"))


def test_cut_files_are_value_errors():
    media = tiff.write_pages(tiff.payload_of("some text " * 60))
    for end in range(0, len(media), 7):
        try:
            assert sum(len(p.pixels) for p in tiff.read_pages(media[:end])) <= 4 * len(media) + 1024
        except ValueError:
            pass


def test_texts_as_pages(docs):
    got = rows(tiff.media_digests(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in DOCS:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert got == sorted(want, key=str)
    pages = tiff.tiff_pages(tiff.text_media(docs))
    assert rows(pages.groupBy("doc_id").agg(F.sum(F.length("pixels")).alias("n")), "doc_id", "n") == sorted([(i, n * (2 if i == 5 else 1)) for i, n in {w[0]: w[2] for w in want}.items()], key=str)


# --- HTML ---


PAGES = [
    ("http://a.example/1", "<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; all</h1><p>One<br>two<p>three &lt;<script>var x='<p>';</script><div class='ad'>buy</div><form>q</form></article><footer>f</footer>"),
    ("http://a.example/2", None),
    (None, ""),
    ("http://b.example", "<p>plain <b>text</b> here</p><div class=\"comments\"><p>first!</p></div><ul><li>a<li>b</ul>tail &copy"),
    ("x", "no markup at all &#233; &bogus; <3"),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    want = [(0, "Head & all\nOne two\nthree <"), (1, ""), (2, ""), (3, "plain text here\na\nb\ntail ©"), (4, "no markup at all é &bogus; <3")]
    for bound in (html_text.MOST_BROADCAST, -1):
        out = html_text.extract_text(pages, bound)
        assert rows(out, "page_id", "text") == want and all(r.n_chars == len(r.text) for r in out.collect())
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_site_style_tree_removes_repeated_branches(spark):
    page = "<body><div class='top'>Same words on all pages</div><div class='body'><p>Own words {0} of page {0}</p><section>Buy now at our shop</section></div></body>"
    rows_ = [(i, f"http://site.example/{i}", page.format(i)) for i in range(12)] + [(99, "http://other.example/", page.format(99))]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    for bound in (html_text.MOST_BROADCAST, -1):
        got = {r.page_id: r.text for r in html_text.extract_text(pages, bound).collect()}
        assert all(got[i] == f"Own words {i} of page {i}" for i in range(12))
        assert got[99].startswith("Same words")  # a host's single page tells nothing of its site


@pytest.mark.parametrize("tag", ["main", "article"])
def test_template_branches_go_from_marked_articles_too(spark, tag):
    page = f"<body><div class='top'>Same words</div><{tag}><p>Own words {{0}} of page {{0}}</p><div class='writer'><p>Ann writes about all things</p></div></{tag}></body>"
    pages = spark.createDataFrame([(i, f"http://site.example/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    for bound in (html_text.MOST_BROADCAST, -1):
        assert rows(html_text.extract_text(pages, bound), "page_id", "text") == sorted([(i, f"Own words {i} of page {i}") for i in range(12)], key=str)


def test_what_stands_apart_on_single_pages(spark):
    cases = [
        ('<article class="post has-comments"><p>kept</p></article>', "kept"),
        ('<div class="content-with-sidebar"><p>kept</p></div>', "kept"),
        ('<div class="entry no-sidebar">kept</div><div class="left-sidebar">gone</div>', "kept"),
        ('<p>kept <span class="ad"><span>in</span> leaked</span> too</p>', "kept too"),
        ('<article class="teaser">short</article><div><p>the body of the page lies outside of its teaser</p></div>', "short\nthe body of the page lies outside of its teaser"),
        ('<main><p>all the words of the article stand here</p></main><div>more</div>', "all the words of the article stand here"),
        ('<ol class="comment-list"><li id="comment-7">gone</li></ol><div role="navigation">gone</div><p hidden>gone</p>kept', "kept"),
        # names that tell of adverts and the like, but hold the text of the page
        ('<nav>menu</nav><article class="related-work"><h1>kept</h1><p>and kept</p></article><footer>foot</footer>', "kept\nand kept"),
        ('<article class="legal notice"><p>kept</p></article>', "kept"),
        ('<main><section class="share-price-analysis"><p>kept</p></section></main>', "kept"),
        ('<nav>menu</nav><div class="study search"><p>kept</p></div>', "kept"),
        ('<section id="comment-on-the-law"><p>kept</p></section><div role="banner">gone</div>', "kept"),
        ('<p>kept, all of it</p><div id="comments"><p>gone, and three times as long as what is kept</p></div>', "kept, all of it"),
    ]
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", page) for i, (page, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for i, (page, want) in enumerate(cases):
        assert got[i] == want, page


def test_gap_of_a_host_tells_templates_that_vary(spark):
    """Boxes without telling names, from a pool of texts, go; with the nodes of the tree switched off they stay. Copies of one article stay."""
    rnd = random.Random(3)
    pool = [f"offer number {i} of our shop" for i in range(20)]
    page = "<body><div class='x1'>{0}</div><div class='x2'><h2>{1}</h2><p>{2}</p></div><div class='x3'><ul><li>{3}</li></ul></div></body>"
    words = lambda n: " ".join(f"w{rnd.randint(0, 500)}" for _ in range(n))
    texts = [(f"Title {words(4)}", words(60)) for _ in range(60)]
    made = [(i, f"http://site.example/{i}", page.format(rnd.choice(pool), *texts[i], rnd.choice(pool))) for i in range(60)]
    copies = [(100 + i, f"http://copies.example/{i}", f"<body><nav>menu</nav><article><h1>{texts[0][0]}</h1><p>{texts[0][1]}</p></article></body>") for i in range(9)]
    pages = spark.createDataFrame(made + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert all(got[i] == "\n".join(texts[i]) for i in range(60)) and all(got[100 + i] == "\n".join(texts[0]) for i in range(9))
    assert html_text.main_text("http://site.example/1", made[1][2], lambda asked: [False] * len(asked)).count("offer") == 2


def test_importances_are_brute_force(spark):
    """Presentation, content and the branch rule, computed page by page from the definitions."""
    import math

    pages = [f"<body><div class='top'><p>Same</p><ul>{'<li>x</li>' * (i % 2)}</ul></div><article><h1>Title {i}</h1>{'<p>words %d</p>' % i * (i % 3)}<div class='box'><p>About us</p><em>all</em></div></article></body>" for i in range(9)]
    rows_ = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    seen, sizes, away = {}, {}, {}
    for _, url, page in rows_:
        for _, node, kind, feature, more in html_text.page_nodes(url, page):
            entry = seen.setdefault(node, ([], [], set()))
            entry[2].add(feature) if kind == html_text.BELOW else entry[kind].append(feature)
            if kind == html_text.TEXT:
                sizes.setdefault(node, {})[feature] = more
            elif kind == html_text.STYLE:
                away.setdefault(node, []).append(more)
    want = {}
    for node, (styles, texts, above) in seen.items():
        m = len(styles)
        p = [styles.count(x) / m for x in set(styles)]
        presentation = 1.0 if m < 2 else -sum(x * math.log(x) for x in p) / math.log(m)
        content = None if not texts else 1.0 if m < 2 else sum(1 - math.log(texts.count(t)) / math.log(m) for t in set(texts)) / len(set(texts))
        want[node] = (m, presentation, content, above)
    tree = html_text.site_tree(spark.createDataFrame(rows_, "page_id long, url string, html string"))
    got = {}
    for r in tree.collect():
        got.setdefault(r.node, (r.pages, r.presentation, r.content, set()))[3].add(r.above)
    assert got.keys() == want.keys() and len(got) >= 8
    for node, (m, p, c, above) in want.items():
        assert got[node][0] == m and math.isclose(got[node][1], p, abs_tol=1e-9) and got[node][3] == above
        assert (got[node][2] is None) == (c is None) and (c is None or math.isclose(got[node][2], c, abs_tol=1e-9))
    apart = {n: sum(x % 2 for x in xs) / len(xs) for n, xs in away.items()}
    heaviest = max((n for n in sizes if apart[n] <= 0.5), key=lambda n: sum(sizes[n].values()))
    level = 1 - want[heaviest][2]

    def high(n):
        m, presentation, content, _ = want[n]
        gap = max(0.7, (1 + level) / 2) if away[n][0] >= 2 else min(4 * level + 0.02, (1 + level) / 2)
        return apart[n] <= 0.5 and (presentation > 0.5 or m < 3 or (content is not None and 1 - content <= gap + 1e-9))

    branch = {n for n in want if not any(high(d) for d in want if n in want[d][3])}
    assert {r.node for r in html_text.template_nodes(tree).collect()} == branch and branch


def test_copies_of_one_page_are_no_template(spark):
    page = "<body><article><h1>One</h1><p>The same article under another address</p></article></body>"
    pages = spark.createDataFrame([(i, f"http://s.example/{i}", page) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract_text(pages).collect()} == {"One\nThe same article under another address"}


# --- licenses ---


def brute_places(text, phrase):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    want = phrase.split()
    return len(words), [i for i in range(len(words)) if words[i : i + len(want)] == want]


def test_license_places_are_brute_force():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["under ", "the ", "MIT ", "License ", "license. ", "CC-", "BY-", "NC ", "Apache ", "version 2", ", ", "é ", "ẞ", "\x7f"]) for _ in range(rnd.randint(0, 40)))
        found = licenses.scan(text)
        places = [(label, at) for phrase, label in licenses.BASE for at in brute_places(text, phrase)[1]]
        assert sorted((a, s) for a, s, _ in found["base"]) == sorted(places) and found["n_words"] == brute_places(text, "x")[0]
        assert 0 <= found["score"] <= 1


def test_templates_need_their_mandatory_words():
    a = licenses.Automaton("<<optional>>see<</optional>> the <<var 2>> license <<optional>>v <<var 1>><</optional>>")
    run = lambda t: a.longest(t.split(), 0)
    w = lambda t: [x.encode() for x in t.split()]
    assert a.longest(w("see the x y license v 3"), 0) == 7 and a.longest(w("the license"), 0) == 2
    assert a.longest(w("the a b c license"), 0) == -1 and a.longest(w("see license"), 0) == -1 and run("") == -1
    labels = licenses.scan("This work is licensed under the GNU General Public License, version 3.")["accepted"]
    assert {x[0] for x in labels} == {"gpl"}
    with pytest.raises(ValueError):
        licenses.Automaton("<<var 3>>")


def written(markup: str) -> tuple[list[str], list[int]]:
    """A notice as someone would publish it: optional parts left out, names put in; and which of its words are mandatory."""
    words, own, depth = [], [], 0
    for kind, most, word in licenses.MARK.findall(markup):
        depth += (kind == "optional") - (kind == "/optional")
        if kind == "var" and not depth:
            words += ["acme"] * min(int(most), 2)
        elif word and not depth:
            own.append(len(words))
            words.append(word)
    return words, own


@pytest.mark.parametrize("label, markup", [x for x in licenses.TEMPLATES if len(x[1].split()) > 25])
def test_whole_notices_need_all_their_wording(label, markup):
    words, own = written(markup)

    def whole(text):
        """Labels of what is accepted but for statements within the notice."""
        return {x for x, start, end in licenses.scan(" ".join(text).upper())["accepted"] if end - start >= len(words) - 3}

    assert whole(words) == whole(["some", "text", *words, "more"]) == {label}
    rnd = random.Random(label)
    for at in rnd.sample(own, min(len(own), 25)):
        assert whole([*words[:at], "friday", *words[at + 1 :]]) == whole([*words[:at], *words[at + 1 :]]) == set(), words[at]


def test_altered_grants_are_no_licences():
    labels = lambda text: {x[0] for x in licenses.scan(text)["accepted"]}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to look at them for one day.") == set()
    assert labels("Redistribution and use in source and binary forms, with or without modification, are permitted to employees of Acme only.") == set()
    assert labels("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License if you ask.") == set()


def test_license_scan_of_odd_rows(docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[1].labels, got[1].n_base, got[1].first_word) == ("mit", 1, 1)
    for i in (2, 3, 7):
        assert (got[i].n_words, got[i].labels, got[i].first_word) == ((1, "", None) if i == 7 else (0, "", None))


# --- toxicity ---


def labelled(n, seed=0):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        toxic = i % 4 == 0
        for _ in range(rnd.randint(2, 6) if toxic else 0):
            text.insert(rnd.randint(0, len(text)), rnd.choice(["blockhead", "nitwitted", "Scoundrel"]))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    data = labelled(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    out = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [(y, out[i].predicted) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert toxicity.without_toxic(docs, model).count() == sum(not r.predicted for r in out.values())


def test_scores_of_odd_rows(docs, spark):
    model = toxicity.fit([(t, y) for _, t, y in labelled(200)])
    for m in (model, toxicity.Model()):
        got = toxicity.toxicity(docs, m).collect()
        assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not toxicity.learn(docs, none).fitted and not toxicity.fit([("a", 1)]).fitted
    assert toxicity.fit([(None, 0), ("", 1)]).fitted
    assert docs.select(toxicity.held_out().alias("h")).where("h is null").count() == 0
