"""Hard inputs of the training-data operators: marked spans and held-out labels, long and hostile texts, repeated ids, and clashing names."""

import collections
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import chat, common, decontam, html_blocks, mixing, neardup, pii, quality, tokenbin, topk
from framewise.llm.common import Words, utf8

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")

#: Written by hand: each text with the data in it.
MARKED = [
    ("Reach Maria under maria.lopez@uni-berlin.de or (415) 555-0132 after noon.", {("maria.lopez@uni-berlin.de", "email"), ("(415) 555-0132", "phone")}),
    ("His SSN 078-05-1120 was printed on the card, please don't share it.", {("078-05-1120", "id")}),
    ("The server 10.12.0.7 refused the connection from 192.168.1.254.", {("10.12.0.7", "ip"), ("192.168.1.254", "ip")}),
    ('secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', {("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "secret")}),
    ("Charge my card 5500 0000 0000 0004, it is valid until 11/27.", {("5500 0000 0000 0004", "card")}),
    ("Write to jane [at] example [dot] org for the slides.", {("jane [at] example [dot] org", "email")}),
    ("The office: tel 212-555-0187, closed on Mondays.", {("212-555-0187", "phone")}),
    ("Call +44 20 7946 0958 or mail info@shop.co.uk today", {("+44 20 7946 0958", "phone"), ("info@shop.co.uk", "email")}),
    ("password: hunter2000secretKEYvalue77 was in the log", {("hunter2000secretKEYvalue77", "secret")}),
    ("contact bob(at)mail.com, he knows", {("bob(at)mail.com", "email")}),
]
CLEAN = [
    "On 2024-05-17 at 10:45 we sold 1,250 units for 3.14 each, 12 more than in 1999.",
    "Version 2.10.3 of the tool fixes 17 bugs; see pages 120-135 and table 4.",
    "He looked at the dot on the wall. The score was 3-2 at half time, 4-2 in the end.",
    "Chapter 12, verse 7: and there were 40 days and 40 nights.",
    "Room 101 is 25 m long, 3.5 m high and holds 64 people (8 rows of 8).",
]


def test_marked_spans():
    field, found, extra = pii.trained(), 0, 0
    for text, want in MARKED:
        got = {(text[a:b], k) for a, b, k in pii.find(text, field)[1]}
        found += len(got & want)
        extra += len(got - want)
    assert found >= 0.9 * sum(len(w) for _, w in MARKED) and extra <= 1
    assert [pii.find(t, field)[1] for t in CLEAN] == [[]] * len(CLEAN)


def _seconds(f, *a):
    t = time.process_time()
    f(*a)
    return time.process_time() - t


def test_long_texts_take_linear_time():
    field = pii.trained()
    for text in ("1" * 200_000, "x" * 200_000 + "1 at 2", ("ab1" * 100 + " ") * 700, "a1b2c3" * 10_000):
        assert _seconds(pii.find, text, field) < 8
    for page in ("<a " * 350_000, "x>" + "<a " * 350_000, '<p>hi</p><b class="' * 50_000, "<!--" * 250_000):
        assert _seconds(html_blocks.blocks, page) < 5


def test_blocks_keep_formulas_and_drop_open_comments():
    read = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert read("<p>1 &lt; 2 and <math><mi>x</mi></math> y <object>z</object>") == ["1 < 2 and x y z"]
    assert read("<p>a > b <!-- c > d <p") == ["a > b"] and read("x <a href=") == ["x <a href="] and read("<p>a<![CDATA[ b > c") == ["a"]
    deep = "<div class=k>" * 3000 + "x"
    one = html_blocks.blocks(deep)[0]
    assert one.path.vector().sum() == pytest.approx(0.6 * 6000 + 0.4 * 3, rel=1e-3)  # every element counts


@here
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    s = quality.score(docs, quality.fit(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id")
    rows = [r for r in s.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    y, p = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    auc = np.mean((p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0]))
    print("held out", len(y), "auc", auc, "accuracy", ((p >= 0.3) == y).mean())
    assert auc >= 0.9 and ((p >= 0.3) == y).mean() >= 0.93


def test_quality_gradient():
    net = quality.Net(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, doc, y, w, grads = r.integers(0, 256, (5, 64)).astype(np.uint8), np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0], np.float32), np.array([1.0, 0.5, 1.0]), {}
    old, quality.adam = quality.adam, lambda p, g, s, lr: grads.update({k: v.copy() for k, v in g.items()})
    try:
        net.step(x, doc, y, w, {}, 0)
        want = dict(grads)
        for k, g in want.items():
            i = np.unravel_index(np.abs(g).argmax(), g.shape)
            net.p[k][i] += 1e-4
            up = net.step(x, doc, y, w, {}, 0)
            net.p[k][i] -= 2e-4
            down = net.step(x, doc, y, w, {}, 0)
            net.p[k][i] += 1e-4
            assert abs((up - down) / 2e-4 - g[i]) < 2e-3 * max(0.1, abs(g[i])), k
    finally:
        quality.adam = old


def test_chat_roles_that_look_like_markers(spark):
    rows = [(1, 0, "us|>\ner", "a"), (1, 1, "us|>\ner", "b"), (1, 2, "a<|end|>\n&gt;", "<|next|>")]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(x) for x in f.select(chat.read_back(F.col("formatted")).alias("t")).first().t] == [r[2:] for r in rows]


def test_topk_empty_and_chunks_by_bytes(spark, monkeypatch):
    d = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(100)], "vec_id long, embedding array<double>")
    assert topk.top_k(d.where("false")).count() == 0 and topk.top_k(d.where("vec_id = 20")).count() == 0
    whole = sorted(map(tuple, topk.top_k(d, k=3).collect()))
    monkeypatch.setattr(topk, "CHUNK_BYTES", 32)
    assert sorted(map(tuple, topk.top_k(d, k=3).collect())) == whole


def test_mixing_keeps_columns_of_its_own_names(spark):
    d = spark.createDataFrame([(i, "a b c", "en", "s", "MINE", "MINE") for i in range(50)], "doc_id long, text string, lang string, source string, _source string, _Sampled string")
    got = mixing.sample(d)
    assert got.columns == d.columns and {(r._source, r._Sampled) for r in got.collect()} == {("MINE", "MINE")}
    counts = spark.createDataFrame([(t,) for t in ("", " ", "a", " a", "a ", " a\t\n b\r", "  x", None)], "t string").select(mixing.n_tokens(F.col("t"))).collect()
    assert [r[0] for r in counts] == [0, 0, 1, 1, 1, 2, 2, 0]


def test_near_duplicates_of_repeated_ids(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    a, b = [word() for _ in range(80)], [word() for _ in range(80)]
    near = lambda t: " ".join([*t[:-1], word()])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(b)), (6, near(a)), (9, "some other words that are like nothing else here")]
    for rows_ in (rows, rows[::-1]):
        d = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
        assert {x.doc_id: x.class_id for x in neardup.classes(d).collect()} == {1: 1, 5: 1, 6: 1, 9: 9}
    kept = sorted(map(tuple, neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept == [min(rows[:2]), rows[4]]  # of two texts of one id the first


@here
def test_near_duplicates_recall_on_documents(spark):
    """Against all pairs of documents that share a shingle: no linked pair lies in two classes, and no class is without a link."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text").collect()]
    buf, off = utf8(pa.array([t for _, t in docs]))
    d, h = neardup.shingles(Words(buf, off))
    bags, of = [collections.Counter() for _ in docs], collections.defaultdict(set)
    for i, x in zip(d.tolist(), h.tolist()):
        bags[i][x] += 1
        of[x].add(i)
    shared = collections.Counter()
    for s in of.values():
        if 1 < len(s) <= 60:  # only to skip most pairs of passages; pairs at 0.8 share many more shingles
            s = sorted(s)
            shared.update((i, j) for n, i in enumerate(s) for j in s[n + 1 :])
    size = [sum(b.values()) for b in bags]
    found = {x.doc_id: x.class_id for x in neardup.classes(spark.read.parquet(f"{MORE}/documents.parquet")).collect()}
    links = joined = 0
    for (i, j), n in shared.items():
        if n >= 0.2 * max(len(bags[i]), len(bags[j])) and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]):
            both = sum((bags[i] & bags[j]).values())
            if both / (size[i] + size[j] - both) >= 0.8:
                links += 1
                joined += found[docs[i][0]] == found[docs[j][0]]
    print("links", links, "joined", joined)
    assert links >= 20 and joined >= 0.999 * links


def test_tokens_of_long_and_clashing_pieces(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref, own, r = Tokenizer.from_file(path), tokenbin.WordTokenizer(path, special=True), random.Random(4)
    texts = [" ".join("".join(r.choice("abcdeXYZ'é") for _ in range(r.randint(1, 40))) for _ in range(200)) for _ in range(30)] + [None, "", "x" * 70_000]

    def same():
        ids, n = own.encode(pa.array(texts))
        want = [ref.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]

    monkeypatch.setattr(tokenbin, "GROUP", 5000)
    same()
    monkeypatch.setattr(tokenbin, "CACHE_WORDS", 500)  # starts again all the time
    same()
    monkeypatch.setattr(tokenbin, "mix", lambda h: h & np.uint64(255))  # hashes that clash
    own._forget()
    same()


def test_decontamination_shared_windows():
    words = [f"w{i}" for i in range(30)]
    items = [("a", " ".join(words[:15])), ("b", "x " + "  ".join(words[3:14]) + "!"), ("c", "w1 W2"), ("d", None), ("e", "w1--w2")]
    index = decontam.Index(items)
    hit = lambda t: [(i, k, sorted(n)) for i, k, n in index.hits(Words(*utf8(pa.array([t]))))]
    assert hit(" ".join(words[3:13])) == [(0, 10, ["a", "b"])] and hit("w1, w2 w1") == [(0, 2, ["c", "e"])] and hit(" ".join(words[4:12])) == []


def test_durable_tables_are_discarded(spark):
    common.discard(spark)
    common.durable(spark.range(3))
    common.durable(spark.range(4))
    assert common.discard(spark) == 2 and common.discard(spark) == 0
