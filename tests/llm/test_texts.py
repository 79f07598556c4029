"""Suffix removal, fingerprints, language and pages against plain definitions."""

import collections
import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carecycle.llm import language, minhash, pages, queries, suffixes

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

FOLDER = "/root/testdata/sf0.001"


def texts(spark, rows):
    """Rows of (id, text) with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("k1", F.lit("x")).withColumn("row", F.lit(None).cast("string"))


def plain_removal(docs, length):
    seen = collections.Counter()
    for b in docs:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.count_nonzero(np.diff(np.r_[False, gone, False]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), edges // 2, hashlib.sha256(kept).hexdigest()))
    return out


def test_sorted_suffixes():
    rng = random.Random(5)
    for k in range(40):
        length, letters = rng.choice([24, 37, 40]), "abcd"[: rng.choice([1, 2, 4])]
        docs = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 10, length, 60, 300]))).encode() for _ in range(8)]
        docs += [docs[0] + docs[3], docs[4][:100] + b"zz" + docs[5]]
        seen = collections.Counter(b[i : i + length] for b in docs for i in range(len(b) - length + 1))
        got = suffixes.repeated_windows(docs, length, bucket=rng.choice([50, 1000]))
        for b, again in zip(docs, got):
            assert [seen[b[i : i + length]] > 1 for i in range(len(b) - length + 1)] == list(again)


def test_removal_with_crowded_anchors(spark):
    """A passage in a hundred texts under a group bound of 8, periodic texts, repeated rows, nulls."""
    rng = random.Random(6)

    def word(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    rows = [(i, word("ab é"[: rng.choice([1, 2, 4])], rng.choice([0, 20, 39, 40, 100, 300]))) for i in range(60)]
    passage = word("abcdefghij", 60)
    rows += [(i, word("abcdefghijklmn", rng.randint(0, 90)) + passage + word("abcdefgh", 90)) for i in range(200, 300)]
    rows += [(500, None), (501, passage), (501, passage), (None, passage * 2), (502, "x" * 5000)]
    df = texts(spark, rows)
    found = suffixes.remove_repeats(df, length=40, gram=12, group_rows=8, shard_rows=64).collect()
    got = sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == sorted(plain_removal([(t or "").encode() for _, t in rows], 40))
    assert {r.row.doc_id for r in found} == {i for i, _ in rows} and found[0].row.k1 == "x"
    assert suffixes.remove_repeats(df.filter("false")).count() == 0


def test_removal_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], plain_removal([(r.text or "").encode() for r in rows], 400)))
    got = queries.op4_suffix_dedup(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def plain_passages(docs, length, words):
    """What goes by repeated passages of ``words`` words and by repeated strings that hold fewer."""
    at = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\f]+", b)] for b in docs]
    runs = [[tuple(b[x:y] for x, y in a[i : i + words]) for i in range(len(a) - words + 1)] for a, b in zip(at, docs)]
    seen, strings = collections.Counter(r for x in runs for r in x), collections.Counter()
    for b in docs:
        strings.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for a, b, x in zip(at, docs, runs):
        gone = np.zeros(len(b), bool)
        for i, r in enumerate(x):
            if seen[r] > 1:
                gone[a[i][0] : a[i + words - 1][1]] = True
        for i in range(len(b) - length + 1):
            inside = len(re.findall(rb"(?<=[ \t\n\r\x0b\f])[^ \t\n\r\x0b\f]", b[i : i + length]))
            if strings[b[i : i + length]] > 1 and inside <= words:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_passages_of_words(spark):
    """Planted passages of 51 short words go, those of 50 and short boilerplate stay; unspaced strings go by bytes."""
    import corpus_pipeline

    rng = random.Random(11)

    def some(n, letters="abcdefghijklmnopqrstuvwxyz", size=4):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, size))) for _ in range(n))

    whole, less = some(51, size=2), some(50, size=9)
    assert len(whole) < 200
    rows = [(i, f"{some(40)} {whole} {some(rng.randint(0, 90))}") for i in range(5)]
    rows += [(i, f"{some(30)} {less} {some(50)}") for i in range(10, 14)] + [(15, f"{some(9)}\n" + whole.replace(" ", "\t"))]
    url = "".join(rng.choice("abcdef") for _ in range(450))
    rows += [(20, f"{some(70)} {url} {some(3)}"), (21, f"{some(3)} {url}"), (22, None), (None, whole), (23, "b " * 300)]
    mixed = some(40, size=12) + " " + some(60, size=5)
    rows += [(30, f"x{mixed}{some(5)}"), (31, f" {mixed} {some(80)}"), (32, mixed[50:])]
    df = texts(spark, rows).withColumn("n_chars", F.lit(0).cast("long")).select("doc_id", "text", "n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.STAGES[2][1](spark, df, FOLDER).collect()}
    want = plain_passages([(t or "").encode() for _, t in rows], 400, 51)
    assert got == {i: w.decode() for (i, _), w in zip(rows, want)}
    assert all(whole not in got[i] for i in range(5)) and all(less in got[i] for i in range(10, 14))
    assert got[None] == "" and url not in got[20] and len(got[15].split()) == 9


def test_sorted_windows_are_those_that_repeat():
    """Against counting, for many lengths, bucket sizes, periodic and nearly equal texts."""
    rng = random.Random(5)
    for trial in range(200):
        length = rng.choice([9, 15, 16, 22, 23, 40, 41, 64, 100, 400])
        base = bytes(rng.choice(b"ab") for _ in range(2 * length))
        some = []
        for _ in range(rng.randint(1, 12)):
            at = rng.randint(0, length)
            edited = bytearray(base[: length + rng.randint(0, 20)])
            edited[rng.randrange(len(edited))] = 99
            some.append(rng.choice([
                base[at : at + rng.randint(0, length + 30)], b"a" * rng.randint(0, 3 * length), bytes(edited),
                bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 2 * length))),
            ]))
        seen = collections.Counter(t[i : i + length] for t in some for i in range(len(t) - length + 1))
        found = suffixes.repeated_windows(some, length, bucket=rng.choice([4, 50, 1 << 16]))
        for t, again in zip(some, found):
            assert list(again) == [seen[t[i : i + length]] > 1 for i in range(max(0, len(t) - length + 1))]


def test_long_texts_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 100)
    rng = random.Random(7)
    text = bytes(rng.choice(b"ab") for _ in range(777))
    lo, hi, at, key = suffixes.Anchors(40, 12).of(text)
    assert lo[0] == 0 and hi[-1] == len(text) - 40 and (lo[1:] == hi[:-1] + 1).all()
    assert ((at >= hi) & (at + 12 <= lo + 40)).all()


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_minhash(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [(9000, None), (9001, "one"), (9001, "one"), (9002, "ONE"), (9003, "é" * 7), (None, "null id " * 40)]
    rows += [(9005, "twice the same text"), (9005, "twice the same text"), (9006, "behind it")]
    of_last = hashlib.sha256(b"twice the same behi").hexdigest()
    df = texts(spark, rows)
    found = minhash.fingerprints(df).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    got = minhash.with_likeness(found).collect()
    docs = sorted((i if i is not None else -1, t or "") for i, t in rows)
    by_id = {(r.doc_id if r.doc_id is not None else -1): r for r in got}
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == [i for i, _ in docs]
    copies = sorted(r.edited_sha256 for r in got if r.doc_id == 9001)
    assert copies == sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("one", "one"))
    assert len({r.edited_sha256 for r in got if r.doc_id == 9005}) == 2  # of two copies the last has another behind it
    docs = [d for k, d in enumerate(docs) if d != docs[(k + 1) % len(docs)]]  # copies' last rows stand for them
    by_id[9005] = max((r for r in got if r.doc_id == 9005), key=lambda r: r.edited_sha256 == of_last)
    off, seen = [], {}
    for k, (i, text) in enumerate(docs):
        after, r = docs[(k + 1) % len(docs)][1], by_id[i]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == minhash.BINS
        for a, b, estimate in ((text, edited, r.near_edited), (text, after, r.near_next)):
            a, b = shingles(a), shingles(b)
            off.append(estimate - (len(a & b) / len(a | b) if a or b else 1.0))
    assert np.sqrt(np.mean(np.square(off))) < 0.04 and abs(np.mean(off)) < 0.01
    assert by_id[9000].fingerprint == "0" * minhash.BINS
    assert by_id[9001].near_next == 1.0  # case does not count
    assert minhash.fingerprints(df.filter("false")).count() == 0


def test_every_bin_is_filled_alike(spark):
    """Two texts with the same few shingles in another order have one fingerprint."""
    df = spark.createDataFrame([("a b c d e f",), ("a b c d e f ",), ("a\nb c d e f",), ("a b c d e",)], "text string")
    a, b, c, d = (r[0] for r in df.select(minhash.fingerprint(F.col("text"))).collect())
    assert a == b == c and a != d and len(set(a)) > 4


def test_gradients_are_those_of_the_loss():
    net = language.fresh(["a", "b", "c"], 4)
    net.x, net.u, net.c, net.w, net.b = (w.astype(float) for w in net.weights())
    rng = np.random.default_rng(0)
    codes, labels = rng.integers(0, 257, (5, 3)), np.array([0, 2, 1])

    def loss():
        return language.gradients(net, codes, labels)[0]

    _, grads = language.gradients(net, codes, labels)
    for w, g in zip(net.weights(), grads):
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            if w is net.x:
                at = (at[0], codes[0, 0], at[2])
            old = w[at]
            w[at] = old + 1e-3
            up = loss()
            w[at] = old - 1e-3
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3
    states = [language._run(net, codes, d)[0] for d in (0, 1)]
    want = language._softmax(states[0] @ net.w[:4] + states[1] @ net.w[4:] + net.b)
    assert np.allclose(language.positions(net, codes), want.transpose(2, 0, 1), atol=2e-3)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_language(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    hidden = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in hidden]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    lines = {"en": "the and of that with ", "fr": "le la que des une "}
    rows = [(i, (lang, text * 5)) for i, (lang, text) in enumerate(list(lines.items()) * 20)]
    rows = [(i, t, lang) for i, (lang, t) in rows]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !?", "fr"), (903, "the and " * 9000, None), (None, "the of and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = language.fit(df)
    got = language.predict(df, net).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [pred[i][0] for i in (900, 901, 902)] == ["und"] * 3 and pred[902][1] == 0
    assert pred[903][0] == "en" and pred[None][0] == "en"
    signs = spark.createDataFrame([(1, "12 ½ ² ① Ⅷ", None), (2, "½ a", None)], df.drop("score").schema)
    assert {r.doc_id: r.lang_pred == "und" for r in language.predict(signs, net).collect()} == {1: True, 2: False}
    assert language.fit(df.filter("false")) is None
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}
    assert language.predict(df.filter("false"), net).count() == 0


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>Slogan of the site goes here.</p></header>
<div id="cookieNotice"><p>We use cookies to make this site better. Accept all of them, thanks.</p></div>
<nav><a>x</a></nav><div class="wrap"><div id="content"><h2>Title of it</h2><p>Short.
<p>First para &amp; more&nbsp;text with <a href=x>link</a>, fine.</p><div class="ad">Buy now! Best price for you.</div>
<ul><li>one<li>two</ul><p>End.<form>Name <input> <button>go</button></form><div class="comments"><h3>Comments</h3>
<p>Great article, I enjoyed reading this a lot, thanks for it!</p></div></div><aside><p>Side text, fairly long.</p>
</aside></div><script>var a = "<p>no</p>";</script><footer>Copyright</footer>"""


def test_pages(spark):
    assert pages.main_text(PAGE) == "Title of it\nShort.\nFirst para & more text with link, fine.\none\ntwo\nEnd."
    for odd in (None, "", "<", "<p>", "<![CDATA[x", "<script>x", "</p></div>", "&bogus;&#0;"):
        assert isinstance(pages.main_text(odd), str)
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE), (3, "u", "<article>" + "<p>word word.</p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((str(r.page_id), len(r.text)) for r in pages.extract(df).collect())
    assert got == sorted((str(i), len(pages.main_text(h))) for i, _, h in rows) and got[3][1] == 3000 * 11 - 1
    assert pages.extract(df.filter("false")).count() == 0


def test_head_without_an_end():
    """</head> may be left out; the head then ends at the first thing that can't stand in one."""
    body = "<p>First para of the page, long enough to be its text.</p><p>Second para of it, with more words.</p>"
    want = "First para of the page, long enough to be its text.\nSecond para of it, with more words."
    in_head = "<title>x</title><meta charset=utf-8><link href=a><style>p {}</style><script>var a</script><noscript>y</noscript>"
    for page in (
        f"<html><head>{in_head}<body>{body}", f"<head>{in_head}{body}", f"<html><head>{in_head}</head><body>{body}</html>",
        f"<html><head>{in_head}<body><article>{body}</article></body></html>", f"<head>\n<title>x</title>\n<body></head>{body}",
    ):
        assert pages.main_text(page) == want
    bare = "Bare text of a page right after its title, without any tag of its own, is read as well."
    assert pages.main_text(f"<head><title>x</title> {bare}") == bare


FIRST = "A first paragraph of the article with enough words in it to be read as text."
SECOND = "A second paragraph that follows it, which also has many words and a full stop."


@pytest.mark.parametrize("page, want", [
    ("<article><p>{0}</p><h2 id='related-work'>Related work</h2><p>{1}</p></article>", "{0}\nRelated work\n{1}"),
    ("<article><p>{0}</p><section id='social-life'><p>{1}</p></section></article>", "{0}\n{1}"),
    ("<body><p>{0}</p><ul><li>Milk</li><li>Two eggs</li><li>Flour</li></ul><p>{1}</p></body>", "{0}\nMilk\nTwo eggs\nFlour\n{1}"),
    ("<body><p>{0}</p><div class='x3'><p>Subscribe now and get 50% off!</p></div><p>{1}</p></body>", "{0}\n{1}"),
    ("<article><p>{0}</p><p>{1}</p><div class='kommentare'><p>{0}</p></div></article>", "{0}\n{1}"),
    ("<article><p>{0}</p><p>{1}</p></article><section id='comments'><h2>Comments</h2><p>{0}</p></section>", "{0}\n{1}"),
    ("<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><p>{0}</p><p>{1}</p>", "{0}\n{1}"),
])
def test_parts_without_telling_names(page, want):
    assert pages.main_text(page.format(FIRST, SECOND)) == want.format(FIRST, SECOND)


def test_the_cut_decides_where_the_classifier_is_unsure():
    """Short items lean to boilerplate by themselves; between paragraphs they are content, between menus not."""
    items = "<ul><li>Milk</li><li>Eggs</li></ul>"
    menu = "<nav><a href=x>Somewhere else</a></nav>"
    for around, kept in ((f"<p>{FIRST}</p>", True), (menu, False)):
        page = pages.Blocks()
        page.feed(f"<body>{around}{items}{around}</body>")
        page.close()
        label = dict(zip((b.text for b in page.blocks), pages.labels(page.blocks)))
        assert all(pages.log_odds(b) < 0 for b in page.blocks if b.text in ("Milk", "Eggs"))
        assert label["Milk"] == label["Eggs"] == kept


def test_odd_nesting():
    """Elements that are never closed, ten thousand deep, and end tags without a start."""
    deep = "<div>" * 10_000 + f"<p>{FIRST}" + "</span>" * 5
    assert pages.main_text(deep) == FIRST
    assert pages.main_text(f"<p>{FIRST}<p>{SECOND}<table><tr><td>x" ).startswith(f"{FIRST}\n{SECOND}")


def test_pages_query_finds_whole_articles(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.op5_html(spark, FOLDER).collect()
    assert len(got) == len(source)
    for r in got:
        html = source[r.page_id]
        inner = re.sub(r"</?b>", "", html[html.index("<article>") + 9 : html.index("</article>")])
        parts = [" ".join(pages.re.sub(r"<br>", " ", x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        import html as entities

        assert r.text == "\n".join(entities.unescape(p) for p in parts if p) and r.n_chars == len(r.text)


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(8)
    top = pages.Element("body", None, 0, False, False, False, False)
    for _ in range(60):
        holders = [pages.Element(rng.choice(["p", "div"]), top, 1, False, rng.random() < 0.5, False, rng.random() < 0.3) for _ in range(3)]
        blocks = [pages.Block("w" * rng.randint(1, 200), rng.choice(holders), 0) for _ in range(9)]

        def cost(labels):
            total = sum(max(o, 0) if not x else max(-o, 0) for o, x in zip(map(pages.log_odds, blocks), labels))
            for i in range(1, 9):
                near = pages.NEXT / (1 + pages._distance(blocks[i - 1].element, blocks[i].element) / 2)
                total += (near + pages.SIBLING) * (labels[i] != labels[i - 1])  # all have one grandparent
            return total

        best = min(cost([bool(k >> i & 1) for i in range(9)]) for k in range(512))
        assert abs(cost(pages.labels(blocks)) - best) < 1e-6


def test_minhash_shuffles_texts_once(spark):
    """Texts lend their heads and take one, in two joins by one key; a third by another key would move them again."""
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(5)], "doc_id long, text string")
    found = minhash.fingerprints(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 3, 4]
