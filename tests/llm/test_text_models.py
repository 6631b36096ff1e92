import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, html_text, langid, toxicity

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is the best of all things.</div>
<article><h1>The&nbsp;title</h1><p>One   long paragraph &amp; more of the same words, which is the main text of this page.<p>Yes.<div class="share-bar">Share it</div>
<p>Second <b>bo</b>ld&#8230;</p><form><p>Subscribe to the letter of the week and more.</p></form></article>
<aside>Related things of the day and of the week</aside><section id="comments"><p>I think that this is a very good article and so on.</p></section><footer>&copy; me</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_text.main_text(PAGE) == "The title One long paragraph & more of the same words, which is the main text of this page. Yes. Second bold…"


def test_pages_without_an_article():
    body = "<p>" + "This is the text of a page that has no article in it, and it is long. " * 4 + "</p>"
    page = f"<body><div><a href=x>Start</a> <a href=y>News</a></div><h2>Head</h2>{body}<p>Short.</p><div class='cookie-notice'>We use the cookies of the site.</div></body>"
    text = html_text.main_text(page)
    assert text.startswith("Head This is the text") and text.endswith("Short.") and "cookies" not in text and "News" not in text
    assert html_text.main_text("just words") == "just words"


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<script>x", "<!--", "</p></div>", "<a href='x", "<article><p>x</article", "&#xFFFFFFFF; &am", "<p>" * 3000])
def test_odd_pages_end(page):
    assert isinstance(html_text.main_text(page), str)


def test_open_blocks_follow_their_nearest_neighbours():
    """Against looking outwards from each open block."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        kinds = [("x" * 80 + " the of and is", 0.0, False), ("ab", 0.0, False), ("menu", 0.9, False), ("the of", 0.0, True), ("word " * 20, 0.0, False)]
        found = [(kinds[k][0], kinds[k][1], int(z), kinds[k][2]) for k, z in zip(rng.integers(0, 5, 12), rng.integers(0, 2, 12))]
        alone = [html_text.labels([*found[:i], found[i], *found[i + 1 :]])[i] for i in range(len(found))]
        assert alone == html_text.labels(found)
        one_zone = [(t, x, 0, b) for t, x, _, b in found]
        got = html_text.labels(one_zone)
        words = [t.split() for t, *_ in one_zone]
        first = []
        share = [sum(x in html_text.STOP for x in w) / len(w) for w in words]
        foreign = all(d < 0.05 for d, (t, linked, _, bad) in zip(share, one_zone) if len(t) >= 70 and linked <= 0.34 and not bad)
        for (t, linked, _, bad), density in zip(one_zone, share):
            if foreign and not bad and linked <= 0.34 and len(t) >= 70:
                first.append(True)
                continue
            first.append(False if bad or linked > 0.34 else None if len(t) < 70 or 0.1 <= density < 0.2 and len(t) < 200 else density >= 0.1 or len(t) >= 200 and density >= 0.05)
        for i, x in enumerate(first):
            if x is None:
                for step in range(1, 13):
                    sides = [first[j] for j in (i - step, i + step) if 0 <= j < 12 and first[j] is not None and not one_zone[j][3]]
                    if sides:
                        break
                x = any(sides) if sides else True
            assert got[i] == x


@pytest.mark.parametrize("part", ["<p>hi</p>", "<div><b>hi", "<i>x</p>", "</b><b>y", "<li>z<a href=q>w"])
def test_time_follows_the_length(part):
    import time

    took = []
    for n in (5_000, 40_000):
        t = time.process_time()
        html_text.main_text(part * n)
        took.append(time.process_time() - t)
    assert took[1] < 20 * max(took[0], 0.05)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = html_text.extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)


def test_gradient_matches_differences():
    net = langid.Network(3, hidden=4, seed=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids, mask = langid.as_columns([b"ab", b"cde", b"f"])
    label = np.array([0, 1, 2])
    _, grads = net.gradients(ids, mask, label)
    rng = np.random.default_rng(0)
    for k, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape) if k[0] != "x" else (int(rng.choice([32, 97, 99, 102])), int(rng.integers(0, w.shape[1])))
            old = w[at]
            w[at] = old + 1e-4
            up = net.gradients(ids, mask, label)[0]
            w[at] = old - 1e-4
            down = net.gradients(ids, mask, label)[0]
            w[at] = old
            assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-4


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "12 !? 34", "de"), (None, "le la les de du une est dans", None)], "doc_id long, text string, lang string")
    out = langid.identify(spark, docs.select("doc_id", "text", "lang").union(extra)).toPandas()
    odd = out[out.doc_id >= 10**6]
    assert set(odd.lang_pred) == {"und"} and set(odd.score) == {0.0}
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    held = out[out.held_out & out.doc_id.notna() & (out.doc_id < 10**6)]
    assert (held.lang_pred.values == truth.loc[held.doc_id].values).mean() >= 0.97
    assert out.score.between(0, 1).all() and out[out.doc_id.isna()].held_out.all()
    kept = langid.keep_identified(spark, docs.select("doc_id", "text", "lang").union(extra))
    assert kept.count() == docs.count() + 1


def test_unlearnt_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(1)
    odd = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
        " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(60)),
    ]
    extra = spark.createDataFrame([(10**6 + i, x, None) for i, x in enumerate(odd)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.keep_identified(spark, docs.union(extra).withColumn("clear", F.lit(1))).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_a_very_long_text_and_word(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    long = " ".join(r.text for r in docs.where("lang = 'de'").limit(60).collect()) * 8
    extra = spark.createDataFrame([(10**6, long, None), (10**6 + 1, "x" * 200_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(spark, docs.union(extra)).where(f"doc_id >= {10**6}").collect()}
    assert got[10**6].lang_pred == "de" and got[10**6 + 1].lang_pred in {"de", "en", "es", "fr"}


def test_network_by_plain_steps():
    """The batched network against one word at a time, a byte at a time."""
    net = langid.Network(3, hidden=5, seed=3)
    w, h = {k: v.astype(np.float64) for k, v in net.w.items()}, 5
    sig = lambda x: 1 / (1 + np.exp(-x))

    def walk(raw, d):
        s, out = np.zeros(h), []
        for c in raw if d == "f" else raw[::-1]:
            x, g = w[f"x{d}"][c], s @ w[f"h{d}"]
            z, r = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :])
            out.append(s)
        return out if d == "f" else out[::-1]

    words = ["ab", "zürich", "q", "12", "x" * 70]
    got = langid.measure(net, words)
    for word, row in zip(words, got):
        total, n = np.zeros(3), 0
        for piece in langid.spans(word) if word != "12" else []:
            raw = b" " + piece + b" "
            for f, b in zip(walk(raw, "f"), walk(raw, "b")):
                y = np.r_[f, b] @ w["o"] + w["c"]
                total, n = total + y - np.log(np.exp(y).sum()), n + 1
        assert np.allclose(row, [*total, n], atol=1e-3)


def test_language_is_learnt_from_all_words_of_all_texts(spark, monkeypatch):
    """Each of 600 texts has a word of its own; half of all words are drawn where the steps take no more."""
    learnt = []
    monkeypatch.setattr(langid.Network, "train", lambda self, words, label, count: learnt.append(dict(zip(words, count))))
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = spark.createDataFrame([(i, f"der die das der {letters(i)}", "de") for i in range(600)], "doc_id long, text string, lang string")
    langid.fit(spark, docs)
    assert learnt[0] == {b"der": 1200, b"die": 600, b"das": 600, **{letters(i).encode(): 1 for i in range(600)}}
    monkeypatch.setattr(langid, "STEPS", 1500)
    monkeypatch.setattr(langid, "BATCH", 1)
    langid.fit(spark, docs)
    assert learnt[1][b"der"] == 600 and learnt[1][b"die"] == learnt[1][b"das"] == 300 and 250 < len(learnt[1]) - 3 < 350


def test_batches_take_every_word_as_often_as_it_was_drawn(monkeypatch):
    """A step has as many words of each language; all come before any comes again."""
    taken = []
    net = langid.Network(2, hidden=2)
    monkeypatch.setattr(langid, "BATCH", 6)
    monkeypatch.setattr(langid, "as_columns", lambda words: (taken.extend(words), None))
    monkeypatch.setattr(net, "gradients", lambda ids, mask, label: (0.0, {}))
    net.train([b"a", b"b", b"x"], np.array([0, 0, 1]), np.array([5, 1, 2]), steps=4)
    assert sorted(taken) == sorted([b"a"] * 10 + [b"b"] * 2 + [b"x"] * 12)


def test_every_labelled_text_held_out_sets_the_limit(spark, monkeypatch):
    """The one that is read worst among 1,500 of a language."""
    limits = []

    def shares(net, key):
        def run(batches):
            for b in batches:
                low = [0.2 if "schlecht" in t else 0.9 for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array([500.0] * len(low))], ["share", "n"])

        return run

    plain = langid._keep
    monkeypatch.setattr(langid, "_shares", shares)
    monkeypatch.setattr(langid, "_keep", lambda languages, net, key, least: (limits.append(least), plain(languages, net, key, least))[1])
    monkeypatch.setattr(langid, "STEPS", 5)
    held = [i for i in range(6200) if zlib.crc32(str(i).encode()) % 4 == 2][:1500]
    docs = spark.createDataFrame([(i, "der die das" + " schlecht" * (i == held[700]), "de") for i in range(6200)], "doc_id long, text string, lang string")
    langid.keep_identified(spark, docs)
    assert limits == [langid.SLACK * 0.2]


def test_language_without_anything_to_learn(spark, docs_of):
    d = docs_of(["a b", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(spark, d).collect()} == {"und"}
    assert langid.identify(spark, d.where("false")).count() == 0
    assert langid.keep_identified(spark, d).count() == 1


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(spark, docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    tp = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert tp / (held.toxic == 1).sum() >= 0.8 and tp / (held.predicted == 1).sum() >= 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_toxicity_odd_rows(spark, docs_of):
    d = docs_of(["", None, "!!", "good words here", (None, "x")])
    labels = spark.createDataFrame([(3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(spark, d, labels).collect()} == {0.0}
    assert toxicity.score(spark, d.where("false"), labels).count() == 0


def plain_kneser_ney(toxic, ordinary, encode, size, word):
    """Log-likelihood ratio of a word up to its first rare context, from the definition of each probability."""
    longest = toxicity.ORDER - 1
    counts = []
    for words in (toxic, ordinary):
        c = Counter()
        for w, n in words.items():
            s = encode(w)
            for i in range(1, len(s)):
                c[s[max(0, i - longest) : i], s[i]] += n
        counts.append(c)
    whole = set(counts[0]) | set(counts[1])
    levels = {longest: {x: 1 for x in whole if len(x[0]) == longest}}
    for n in reversed(range(longest)):
        levels[n] = Counter({x: 1 for x in whole if len(x[0]) == n}) + Counter((h[1:], w) for h, w in levels[n + 1])

    def mixed(table, h, w, below):
        row = {x: n for (g, x), n in table.items() if g == h}
        if not row:
            return below
        total = sum(row.values())
        return max(row.get(w, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(row) / total * below

    def shared(h, w):
        return mixed(levels[len(h)], h, w, shared(h[1:], w) if h else 1 / size)

    s, out = encode(word), 0.0
    for i in range(1, len(s)):
        h = s[max(0, i - longest) : i]
        if sum(n for c in counts for (g, _), n in c.items() if g == h) < toxicity.LEAST:
            break
        a, b = (mixed(c, h, s[i], shared(h[1:], s[i])) for c in counts)
        out += np.log(a) - np.log(b)
    return out


@pytest.mark.parametrize("least", [1, toxicity.LEAST])
def test_ratios_equal_plain_kneser_ney(monkeypatch, least):
    """Of seen, unseen, long and odd words; also where a rare context stands inside a word."""
    monkeypatch.setattr(toxicity, "LEAST", least)
    rng = np.random.default_rng(4)
    some = lambda n, letters: Counter({"".join(rng.choice(list(letters), rng.integers(1, 12))): int(rng.integers(1, 9)) for _ in range(n)})
    toxic, ordinary = some(60, "abcd"), some(60, "abce")
    toxic["abcabcabcabc"] = ordinary["cbacbacba"] = 7
    model = toxicity.Model(toxic, ordinary)
    words = [*list(toxic)[:10], *list(ordinary)[:10], "a", "zz", "abcabczabcabcabc", "cbacbaéabcabcabcabcab", "d" * 40, *some(20, "abcde")]
    want = [plain_kneser_ney(toxic, ordinary, model.encode, toxicity.SYMBOLS + 3, w) for w in words]
    got = model.ratios(words)
    assert np.allclose(got[:, 0], want, atol=1e-4)
    assert got[:, 1].tolist() == [len(w) + 1 for w in words]
    assert np.abs(want).max() > 1


def test_toxicity_of_few_labels_repeated_ids_and_a_long_text(spark, docs_of):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words here {i}") for i in range(40)]
    d = docs_of([*rows, *[(1, f"vile again {i}") for i in range(300)], (100, "kind words " * 100_000), (101, "k" * 300_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for n in (4, 40):
        out = toxicity.score(spark, d, labels.where(f"doc_id < {n}")).toPandas()
        assert len(out) == 342 and out.score.between(0, 1).all()
    assert out[(out.doc_id < 40) & (out.doc_id % 2 == 1)].score.min() > out[(out.doc_id < 40) & (out.doc_id % 2 == 0)].score.max()


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 15)).tolist(), rng.integers(0, 4, rng.integers(1, 15)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == t[-1, -1]


def test_leaks_equal_a_search_for_the_items(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs, bench).collect()}
    items = [(r.item_id, " " + " ".join(decontaminate.words_of(r.text)) + " ") for r in bench.collect()]
    low = [(r.doc_id, " " + " ".join(decontaminate.words_of(r.text)) + " ") for r in docs.collect()]
    want = {(d, i) for d, t in low for i, s in items if s in t}
    assert got == want
    clean = decontaminate.without_leaks(spark, docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in got})


def test_paraphrase_and_odd_rows(spark, docs_of):
    item = "the quick copper engine turns seven silver wheels beneath an ancient granite bridge while patient herons observe"
    changed = item.replace("seven", "nine").replace("ancient", "old").replace("quick", "fast")
    filler = " ".join(f"w{i}" for i in range(80))
    d = docs_of([f"{filler} {item} {filler}", f"{filler} {changed.upper()} {filler}", filler, None, "", (7, filler + " patient herons observe")])
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(spark, d, b).collect()) == [(0, 1), (1, 1)]
    assert decontaminate.leaks(spark, d, b.where("false")).count() == 0 and decontaminate.leaks(spark, d.where("false"), b).count() == 0


def test_edited_copies_are_found_whatever_the_turns(spark, docs_of, monkeypatch):
    """Every item with a seventh of its words changed, in a text of other words: at least nine in ten are found."""
    rng = np.random.default_rng(6)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()]
    rows = [(r.item_id, decontaminate.words_of(r.text)) for r in bench.collect()]
    texts, want = [], set()
    for n, (i, words) in enumerate(rows):
        if len(words) >= 12:
            edited = [f"zq{n}" if x < 1 / 7 else w for w, x in zip(words, rng.random(len(words)))]
            want.add((len(texts), i))
            texts.append(f"{docs[n % len(docs)][:400]} {' '.join(edited)} {docs[(n + 7) % len(docs)][:400]}")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs_of(texts), bench).collect()}
    assert len(got & want) >= 0.9 * len(want)
    monkeypatch.setattr(decontaminate, "ITEMS_MOST", 60)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs_of(texts), bench).collect()} == got


def test_a_leak_in_a_very_long_text_and_clashing_columns(spark, docs_of):
    item = "the quick copper engine turns seven silver wheels beneath an ancient granite bridge while patient herons observe"
    filler = " ".join(f"w{i % 9000}" for i in range(400_000))
    d = docs_of([f"{filler} {item} {filler}", filler, None, ""]).withColumn("_row", F.lit("own")).withColumn("row", F.lit("own"))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, d, b).collect()] == [(0, 1)]
    kept = decontaminate.without_leaks(spark, d, b)
    assert kept.columns == d.columns and {r._row for r in kept.select("_row").collect()} == {"own"} and kept.count() == 3


def _held(spark, docs_of, texts, items):
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs_of(texts), b).collect()}


def test_leaks_of_hot_and_repeated_items(spark, docs_of):
    rng = np.random.default_rng(4)
    item = "the quick copper engine turns seven silver wheels beneath an ancient granite bridge while patient herons observe"
    other = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 40)) for _ in range(60)]
    hot = [f"{item} {i}" for i in range(40)]  # short, and in over a third of all passages
    rows = [(1, item), *((10 + i, other[0]) for i in range(10)), *((100 + i, f"{other[1]} {i}") for i in range(10))]
    got = _held(spark, docs_of, hot + other, rows)
    assert got >= {(i, 1) for i in range(40)} | {(40, 10 + i) for i in range(10)}
    changed = item.replace("seven", "nine").replace("ancient", "old")
    assert _held(spark, docs_of, [f"{changed} {i}" for i in range(40)] + other, rows[:1]) == {(i, 1) for i in range(40)}
    family = [(i, f"what is the capital of the land {i}") for i in range(300)]  # its common words have no feature
    assert (0, 7) in _held(spark, docs_of, [f"{other[0]} What is the capital of the land 7? {other[1]}", *other], family)


def test_long_items_and_each_place_by_the_rule(spark, docs_of):
    rng = np.random.default_rng(5)
    long = [f"l{i}" for i in range(1500)]
    filler = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 60)) for _ in range(40)]
    edited = [w if i % 20 else f"e{i}" for i, w in enumerate(long)]
    texts = [f"{filler[0]} {' '.join(long)} {filler[1]}", f"{filler[2]} {' '.join(edited)} {filler[3]}", *filler[4:]]
    assert _held(spark, docs_of, texts, [(1, " ".join(long))]) == {(0, 1), (1, 1)}
    words = [f"q{i}" for i in range(30)]
    more, less = words[:20] + ["x"] * 10, words[:10] + ["y"] * 4 + words[10:12] + ["y"] * 8 + words[24:]
    assert (0, 1) in _held(spark, docs_of, [" ".join(more + [f"z{i}" for i in range(100)] + less), *filler], [(1, " ".join(words))])
