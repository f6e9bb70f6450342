"""Training-data operators against brute force, exact round trips and held-out accuracy; and the odd inputs of each."""

import collections
import hashlib
import html
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import chat, decontam, html_blocks, langid, mixing, neardup, pii, quality, queries, tokenbin, topk
from framewise.llm.common import Words, utf8

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (3, ""), (4, "Alpha, BETA gamma; delta epsilon zeta eta theta iota kappa lambda!"), (5, "..."), (6, "one two"), (7, "word " * 30000), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "no id here at all"), (8, "é ü \U0001f600 naïve 日本語 text 12")]


def odd(spark, rows=ODD):
    d = spark.createDataFrame([(i, t, "en" if i != 8 else None, None if i == 6 else "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(0) for c in ("score", "key", "bucket", "tokens", "probability", "label", "id")})


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    assert key(got) == key(want)


# ---- personal data --------------------------------------------------------------------------------------------
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_patterns_equal_plain_ones():
    r = random.Random(3)
    texts = ["a@b.c@d.e", "a@b.c_d@e.f x@@b.c.d@e.f", "a@b.c.d..e@f.g", "1.2.3.4.5 0001.2.3.256 999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713, +1", ""]
    texts += ["".join(r.choice("ab1.@+- ()é_%") for _ in range(60)) for _ in range(600)]
    for t in texts:
        want = [(*m.span(), "email") for m in MAIL.finditer(t)]
        want += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                want.append((*m.span(), "card"))
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert sorted(pii.base_spans(t)) == sorted(want), t


def test_field_finds_held_out_spans_and_best_path_is_best():
    field = pii.trained()
    found = wanted = 0
    for text, spans in pii.invented(150, seed=501):
        got = field.best(text)
        found += len(set(got) & set(spans))
        wanted += len(spans)
    assert found >= 0.95 * wanted
    text = "call (123) 456-7890 or ip 1.2.3.4"
    toks = pii.tokens(text)
    segs = [(i, j, float(field.score(pii.features(text, toks, i, j)).max())) for i, j in pii.candidates(text, toks)]

    def best(at):  # every split, by recursion
        if at == len(toks):
            return 0.0
        return max([best(at + 1), *(s + best(j) for i, j, s in segs if i == at)])

    path = sum(float(field.score(pii.features(text, toks, i, j)).max()) for a, b, _ in field.best(text) for i, j in [next((i, j) for i, j, _ in segs if toks[i][0] == a and toks[j - 1][1] == b)])
    assert math.isclose(path, best(0), abs_tol=1e-9)


def test_regions_hold_every_candidate(spark):
    field, r = pii.trained(), random.Random(9)
    rows = [(1, "please mail john(at)acme.com today"), (2, "please mail john [at] acme.org today"), (3, "meet at noon")]
    got = {x.doc_id: x.spans for x in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "email:12:28", 2: "email:12:30", 3: ""}
    assert all(field.dull[1:])
    plain = pii.Field()
    plain.weights = field.weights  # scores every candidate
    bits = ["john(at)acme.com", "eva [at] acme [dot] org", "ann at home dot net", "at", "chat", "_at_", "call", "ssn", "123-45-6789", "a@b.cd", "12", "x" * 90, " " * 150, "\n"]
    for _ in range(150):
        text = " ".join(r.choice(bits) if r.random() < 0.1 else "w" * r.randint(1, 12) for _ in range(r.randint(1, 250)))
        base = pii.base_spans(text)
        whole = [s for s in plain.best(text) if not any(s[0] < y and x < s[1] for x, y, _ in base)]
        assert pii.find(text, field) == (base, pii.ordered(base + whole)), text


def test_pii_odd_rows(spark):
    rows = [*ODD, (9, "mail é a.b@c.de " + "x" * 50000 + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    got = pii.detect(odd(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[9].n_email == 1 and by[9].spans.startswith("email:7:15,secret:") and by[9].base_sha256 == hashlib.sha256(b"email:7:15").hexdigest()
    assert pii.detect(odd(spark).where("false")).count() == 0
    assert pii.redact("x a@b.cd y", pii.trained()) == "x [email] y"


# ---- mixing ---------------------------------------------------------------------------------------------------
def test_raking_meets_the_marginals(spark):
    rows = [(i, "w " * (i % 7 + 1) + ("| a | b" if i % 5 == 0 else "c"), ("en", "de", "fr", "es")[i * i % 4 if i % 3 else i % 4], f"s{i % 3}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = mixing.with_cells(d).groupBy(*[F.col(f"_{k}").alias(k) for k in ("source", "lang", "topic")]).agg(F.sum("_tokens").alias("tokens"))
    got = mixing.calibrate(cells, {"source": 0.5, "lang": mixing.LANGS, "topic": 0.5}, rounds=40)
    langs = {r.lang: r.s for r in got.groupBy("lang").agg(F.sum("share").alias("s")).collect()}
    assert all(abs(langs[k] - v / sum(mixing.LANGS[x] for x in langs)) < 1e-4 for k, v in mixing.LANGS.items() if k in langs)


def test_unlisted_languages_share_a_weight(spark):
    lang = lambda i: ("en", "de", "fr", "es", "pt", None)[i % 6] if i % 5 else "pt"
    d = spark.createDataFrame([(i, "w " * (i % 7 + 1), lang(i), "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    assert {r.lang for r in mixing.sample(d).collect()} == {"en", "de", "fr", "es", "pt", None}
    got = mixing.weigh(d, rounds=20, keep=0.05).groupBy("_lang").agg(F.sum(F.col("_tokens") * F.col("_probability")).alias("e"), F.sum("_tokens").alias("n")).collect()
    total = sum(r.e for r in got)
    share, n = {r._lang: r.e / total for r in got}, {r._lang: r.n for r in got}
    w = mixing.OTHER_LANGS / (sum(mixing.LANGS.values()) + mixing.OTHER_LANGS)
    assert abs(share["pt"] + share["unknown"] - w) < 1e-4 and abs(share["pt"] / share["unknown"] - n["pt"] / n["unknown"]) < 1e-3


def test_sampling_loses_nothing_to_the_bound(spark):
    rows = [(i, "w " * (i % 7 + 1) + ("| a | b" if i % 50 == 0 else "c"), ("en", "de", "fr", "es")[min(3, i % 11)], f"s{i % 3 * (i % 8 > 0)}") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    n = d.select(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    drawn = mixing.sample(d).select(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert abs(drawn / n - mixing.KEEP) < 0.03
    got = mixing.weigh(d, bounded=True).select(F.sum(F.col("_tokens") * F.col("_probability")), F.max("_probability")).first()
    assert abs(got[0] / n - mixing.KEEP) < 1e-3 and got[1] <= 1


def test_mixing_odd_rows(spark):
    d = odd(spark)
    got = mixing.weigh(d)
    assert got.count() == len(ODD) and mixing.sample(d).columns == d.columns
    assert mixing.sample(d.where("false")).count() == 0
    assert got.where("doc_id = 1").select("_sampled").distinct().count() == 1


# ---- pages ----------------------------------------------------------------------------------------------------
def test_blocks_of_broken_html():
    page = '<nav><a href="x>y">m</a></nav><!-- <p>no --><p>a &amp; b<br>c<p><b>d&nbsp;e <script>var s="</p><p>z"</script><li>f<li>g</ul></div>h<div hidden>i</div>'
    assert [b.text for b in html_blocks.blocks(page)] == ["m", "a & b c", "d e", "f", "g h"] or [b.text for b in html_blocks.blocks(page)] == ["m", "a & b c", "d e", "f", "g", "h"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<") != None  # noqa: E711


def test_labeller_on_unseen_layouts_and_pages(spark):
    net, r = html_blocks.trained(), np.random.default_rng(4242)
    wrong = total = 0
    for _ in range(100):
        bs = html_blocks.blocks(html_blocks.invented_page(r))
        y = np.array([html_blocks.MARK in b.text for b in bs])
        for b in bs:
            b.text = b.text.replace(html_blocks.MARK, "") or "."
        wrong += int(((net.probabilities(html_blocks.vectors([bs]))[0] >= 0.5) != y).sum())
        total += len(y)
    assert wrong <= 0.01 * total
    d = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Tom &amp; Eva</h1><p>One  two\nthree four five six.</p></article><footer>&copy; us</footer></body></html>")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {x.page_id: (x.text, x.n_chars) for x in html_blocks.main_text(d).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("Tom & Eva\nOne two three four five six.", 38)}
    assert html_blocks.main_text(d.where("false")).count() == 0


@here
def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = html_blocks.extract(pages.html.tolist(), html_blocks.trained())
    same = 0
    for page, text in zip(pages.html, got):
        m = re.search(r"<article>(.*)</article>", page, re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"<(?:/?p|/?h1)>", m[1])]
        same += "\n".join(p for p in parts if p) == text
    assert same >= 0.98 * len(got)


def test_only_hidden_attributes_hide():
    page = '<p>a <a title="A hidden gem">b</a> c</p><div aria-label="The hidden cost of rent">d</div><article class="card hidden md:block">e</article><p data-x="display: none">f</p><p data-hidden>g</p><p title=\'x="1" hidden y\'>h</p><p style="x-display:none">i</p><p class=hidden>i2</p>'
    assert [b.text for b in html_blocks.blocks(page)] == ["a b c", "d", "e", "f", "g", "h", "i", "i2"]
    page = '<p hidden>a</p><p HIDDEN="">b</p><p id=x hidden=until-found>c</p><p style="color: red; Display : none">d</p><p style=display:none>e</p><p style=\'display:none !important;\'>f</p><p class="x"hidden>g</p>h'
    assert [b.text for b in html_blocks.blocks(page)] == ["h"]


# ---- language and quality -------------------------------------------------------------------------------------
@here
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op4(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in got) and sum(r.lang_pred == r.lang for r in got) >= 0.93 * len(got)
    assert {r.doc_id for r in got} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_gradient_and_odd_rows(spark):
    net = langid.Net(["a", "b"], 1)
    rows, length, y = np.random.default_rng(0).integers(0, 256, (3, 6)).astype(np.uint8), np.array([6, 4, 6]), np.array([0, 1, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grads = {}
    old = langid.adam
    langid.adam = lambda p, g, s, lr: grads.update(g)
    try:
        net.step(rows, length, y, {}, 0)
        for k in ("uf", "xb", "vf", "cb"):
            i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
            want = grads[k][i]
            net.p[k][i] += 1e-3
            up = net.step(rows, length, y, {}, 0)
            net.p[k][i] -= 2e-3
            down = net.step(rows, length, y, {}, 0)
            net.p[k][i] += 1e-3
            assert abs((up - down) / 2e-3 - want) < 1e-3 * max(1, abs(want))
    finally:
        langid.adam = old
    d = odd(spark)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, langid.fit(d, steps=3)).collect()}
    assert got[2] == got[3] == got[5] == ("und", 0.0) and got[7][0] == "en"
    assert langid.predict(d, langid.fit(d.where("false"))).where("lang_pred = 'und'").count() == len(ODD)


def test_quality_learns_and_odd_rows(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeilnorstu") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(r.randint(5, 200))) + "." for _ in range(120)]
    bad = [" ".join(word().upper() + "!!" for _ in range(r.randint(5, 200))) for _ in range(120)]
    net = quality.train(good[:90] + bad[:90], np.array([1] * 90 + [0] * 90), {0: 0.2, 1: 0.8}, steps=120)
    s = quality._scores(net, pa.array(good[90:] + bad[90:]))
    assert ((s >= 0.3) == np.array([True] * 30 + [False] * 30)).mean() >= 0.95
    long = quality._scores(net, pa.array([good[90] * 300, None, ""]))
    assert long[0] >= 0.3 and long[1] == long[2]
    d, none = odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(d, none).count() == len(ODD) and quality.keep_good(d, none).columns == d.columns
    assert quality.score(d.where("false"), net).count() == 0


# ---- chat -----------------------------------------------------------------------------------------------------
def test_chat_round_trip_and_merging(spark):
    rows = [(1, 2, "assistant", "b</s>&lt;|end|>\n<|next|>"), (1, 0, "user", "[INST] x"), (1, 1, "user", None), (1, 2, "assistant", "b"), (2, None, None, ""), (None, 1, "a<b", "&amp;"), (3, 1, "assistant", ""), (3, 2, "assistant", "\U0001f600<")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    f = chat.format_conversations(d).withColumn("back", chat.read_back(F.col("formatted")))
    by = {r.conv_id: r for r in f.collect()}
    assert [tuple(x) for x in by[1].back] == [("user", "[INST] x"), ("user", ""), ("assistant", "b"), ("assistant", "b</s>&lt;|end|>\n<|next|>")]
    assert by[1].formatted.count("<|user|>") == 1 and "</s>" not in by[1].formatted and "[INST]" not in by[1].formatted
    assert [by[3].formatted[a:b] for a, b in by[3].loss] == ["", "\U0001f600&lt;"] and [tuple(x) for x in by[None].back] == [("a<b", "&amp;")]
    assert chat.format_conversations(d.where("false")).count() == 0


# ---- top-k ----------------------------------------------------------------------------------------------------
def test_topk_equals_brute_force_and_prunes(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((6, 8)) * 4
    rows = [(i, (centres[i % 6] + 0.2 * r.standard_normal(8)).tolist()) for i in range(400)] + [(400, None), (401, [float("nan")] * 8), (402, [1.0]), (403, []), (20, [1.0] * 8), (404, [None] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for x in topk.top_k(d, k=5, chunk=7).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    use = [(i, np.floor(64 * np.pad(np.array(v, float), (0, 8 - len(v))))) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    for q in {i for i, _ in use if i % 20 == 0}:
        want = sorted(((-int(v @ w), j) for i, v in use if i == q for j, w in use if j != q))[:5]
        assert [(j, -s) for s, j in want] == got[q]
    x = np.floor(64 * np.array([v for _, v in rows[:400]]))
    s = topk.Search(np.array([0]), x[:1], topk.pick_pivots(x, 8), 5)
    s.add(np.arange(400), x)
    s.add(np.arange(400, 800), x - 1000)
    assert s.evaluated < 700


# ---- near-duplicates ------------------------------------------------------------------------------------------
def weighted(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def bag(text):
    buf, off = utf8(pa.array([text]))
    return collections.Counter(neardup.shingles(Words(buf, off))[1].tolist())


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(8)
    est, true = [], []
    for _ in range(60):
        n = int(r.integers(1, 60))
        a = collections.Counter({int(h): int(c) for h, c in zip(r.integers(1, 2**62, n), r.integers(1, 30, n))})
        b = collections.Counter({h: max(1, c + int(r.integers(-12, 12))) for h, c in a.items() if r.random() < 0.8}) + collections.Counter({int(h): 3 for h in r.integers(1, 2**62, int(r.integers(0, 9)))})
        docs = np.array([0] * sum(a.values()) + [1] * sum(b.values()))
        s = neardup.bag_minhash(docs, np.array([*a.elements(), *b.elements()], np.uint64), 2, 512)
        est.append((s[0] == s[1]).mean())
        true.append(weighted(a, b))
    assert abs(np.mean(np.array(est) - true)) < 0.01 and np.abs(np.array(est) - true).max() < 0.11


def test_classes_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda: r.choice("abcdefghij") + str(r.randint(0, 400))
    texts, passage = [], [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(r.choice([5, 30, 80, 150]))]
        for _ in range(r.choice([1, 2, 12])):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 9]) if len(base) > 20 else 0):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(60)] + ["spam " * 500, "spam " * 480, "x", "X!", None, "", "?"]
    ids = list(range(len(texts)))
    bags = [bag(t) for t in texts]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in range(i):
            if (bags[i] and bags[j] and weighted(bags[i], bags[j]) >= 0.8) or (not bags[i] and not bags[j] and (texts[i] or "") == (texts[j] or "")):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    d = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    assert {x.doc_id: x.class_id for x in neardup.classes(d).collect()} == {i: find(i) for i in ids}


def test_near_duplicates_odd_rows(spark):
    d = odd(spark)
    got = {r.doc_id: r.class_id for r in neardup.classes(d).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8}
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 8]
    assert neardup.classes(d.where("false")).count() == 0 and neardup.keep_one(d.where("false")).count() == 0


# ---- tokens ---------------------------------------------------------------------------------------------------
def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([7]), r.integers(0, 49408, 5000), np.full(3000, 2**32 - 1), np.where(r.random(4096) < 0.03, 2**31, r.integers(5, 9, 4096)), r.integers(0, 2**32, 2049)):
        ids = ids.astype(np.uint32)
        n = np.array([len(ids)])
        data = tokenbin.pack_shard([None], n, ids)
        docs, lengths, back = tokenbin.unpack_shard(data)
        assert docs == [None] and (lengths == n).all() and (back == ids).all()
    small = tokenbin.pack_shard([1], np.array([4096]), np.where(np.arange(4096) % 100 == 0, 10**9, 3).astype(np.uint32))
    assert len(small) < 4096


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = ["don't 'twas we're x'some 3.14 A1b2 !!'s é́cole naïve   tab\tnew\nline", "É ﬁ Ⅳ ½ 日本語 <|endoftext|> İstanbul ǅ ​ x", *[t for _, t in ODD if t]]
    ids, n = tokenbin.WordTokenizer(path).encode(pa.array(texts))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    d = odd(spark)
    got = tokenbin.read_shards(tokenbin.write_shards(d, path, shard_ids=50)).orderBy("start").collect()
    rows = sorted(((i if i is not None else -1, t is not None, t or "") for i, t in ODD))
    start = 0
    for (i, _, t), g in zip(rows, got):
        e = np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (g.doc_id if g.doc_id is not None else -1, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(e), zlib.crc32(e.tobytes()))
        start += len(e)
    assert len(got) == len(rows) and tokenbin.read_shards(tokenbin.write_shards(d.where("false"), path)).count() == 0


def test_added_tokens_equal_the_unmodified_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["b c", "a <|endoftext|> b", None, "<|startoftext|><|EndOfText|>Ab cD", "x" * 50, "", "é<|endoftext|><|endoftext|>", "z <|endoftext| > <|endoftext", "last one"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[1] == [320, 49407, 321]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = 0
    for w, g in zip(want, tokenbin.read_shards(tokenbin.write_shards(d, path)).orderBy("start").collect(), strict=True):
        e = np.array(w + [tokenbin.END], "<u4")
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(e), zlib.crc32(e.tobytes()))
        start += len(e)
    ids, n = tokenbin.WordTokenizer(path, special=True).encode(pa.array(texts))
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# ---- decontamination ------------------------------------------------------------------------------------------
def test_decontamination_odd_rows_and_slices(spark):
    bench = spark.createDataFrame([(10, "beta GAMMA delta epsilon zeta eta theta iota kappa lambda"), (2, "one-two"), (None, "naïve 日本語"), (5, None), (6, "?!"), (10, "word word word")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    one = {tuple(r) for r in decontam.report(odd(spark), bench).collect()}
    by = {r[0]: r[1:] for r in one}
    assert by[1] == by[4] == (11, 10, 1, hashlib.sha256(b"10").hexdigest(), True)
    assert by[2] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert by[6][1:3] == (2, 1) and by[7][:2] == (30000, 30000) and by[8][3] == hashlib.sha256(b"null").hexdigest()
    assert {tuple(r) for r in decontam.report(odd(spark), bench, slice_bytes=20).collect()} == one
    for size in (1 << 20, 20):
        kept = decontam.decontaminate(odd(spark), bench, slice_bytes=size)
        assert kept.columns == odd(spark).columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 5]
        cut = {r.doc_id: r.text for r in decontam.decontaminate(odd(spark), bench, "spans", slice_bytes=size).collect()}
        assert cut[1] == "alpha " and cut[4] == "Alpha, !" and cut[2] is None and cut[5] == "..."
    assert decontam.report(odd(spark).where("false"), bench).count() == 0 and decontam.report(odd(spark), bench.where("false")).where("contaminated").count() == 0


def test_decontamination_slices_by_itself(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two"), (2, "naïve 日本語"), (3, "three")], "item_id long, text string")
    d = spark.createDataFrame([(None, "one two"), (None, "three"), (None, "four"), (7, "one two three"), (7, "five"), (7, "one two three")], "doc_id long, text string")
    whole = sorted(map(str, decontam.report(d, bench).collect()))
    assert decontam.matches(d, bench, slice_bytes=6).count() == 6
    monkeypatch.setattr(decontam, "SLICE_BYTES", 6)
    assert decontam.n_slices(bench) > 1
    assert sorted(map(str, decontam.report(d, bench).collect())) == whole and len(whole) == 6


# ---- pipeline -------------------------------------------------------------------------------------------------
@here
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in p.STAGES[:4]:
        nxt = stage(spark, kept[-1], SF)
        nxt = spark.createDataFrame(nxt.toPandas(), docs.schema)
        assert nxt.columns == docs.columns
        kept.append(nxt)
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    classes = {r.doc_id: r.class_id for r in neardup.classes(kept[1]).collect()}
    assert ids[2] == set(classes.values())
    bad = {r.doc_id for r in decontam.report(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert ids[3] == ids[2] - bad
    out = p.STAGES[4][1](spark, kept[4], SF).collect()
    assert {r.doc_id for r in out} == ids[4]
