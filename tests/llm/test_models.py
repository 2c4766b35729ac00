from __future__ import annotations

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import html_extract, quality_mil, sentencepiece_dropout, toxicity

HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'


def page(body, nav="Home", foot="&copy; host"):
    return f"{HEAD}<nav><ul><li><a href='/'>{nav}</a></li></ul></nav><div class=\"ad\">Buy</div><article>{body}</article><aside>side</aside><form>f<input></form><div id='comments'><p>hi</p></div><footer>{foot}</footer></body></html>"


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), (page("<h1>A &amp; B</h1><p><b>One.<br><p>Two\n  three</p>"), "A & B\nOne.\nTwo three"),
    (page("<p>a<script>x</script>b</p><!-- c --><p>&#233;&nbsp;&lt;</p>"), "ab\né <"), (page("<p>cut &am")[:-60] if False else HEAD + "<article><p>cut &am", "cut &am"),
    (page("<header><h2>Title</h2></header><p>x <a href=y>link</a> z</p><ul><li>i<li>j</ul>"), "Title\nx link z\ni\nj"),
    (page("<p>t</p><nav>n</nav><p style='display:none'>h</p><aside>a</aside>"), "t"),
    *((page(f"<p>t</p>{x}"), "t\nkeep") for x in (
        '<p title="the hidden valley">keep</p>', '<p data-id="ad">keep</p>', '<p data-hidden="false">keep</p>', '<p class="legal">keep</p>', '<p class="related-work">keep</p>',
        '<section id="search-methods">keep</section>', '<ul class="tags"><li>keep</ul>')),
])
def test_single_pages(html, text):
    assert html_extract.extract_group([html]) == [text]


def bare(body, ad="Buy now", foot="Imprint"):
    """No declared article, and boilerplate that nothing but repetition tells apart."""
    return f"<html><body><div class=top><div>Welcome</div><div>{ad}</div></div><div class=c>{body}</div><div class=bottom><div>{foot}</div></div></body></html>"


STORIES = [bare("".join(f"<p>{f'story {i} part {k} ' * (9 + k)}</p>" for k in range(3)), ad=f"Offer {i % 2}") for i in range(8)]
WANT = ["\n".join((f"story {i} part {k} " * (9 + k)).strip() for k in range(3)) for i in range(8)]


def test_template_is_learned():
    assert html_extract.extract_group([*STORIES, STORIES[0]]) == [*WANT, WANT[0]]


def test_the_wrapper_decides(monkeypatch):
    """A page whose own text is shorter than its boilerplate: the region comes from its neighbours, and is lost without induction."""
    short = bare("<p>Tiny.</p>", ad="An unusually long advert that outweighs the text. " * 3, foot="Another long and unique footer text here. " * 3)
    assert html_extract.extract_group([*STORIES, short])[-1] == "Tiny." != html_extract.extract_group([short])[0]
    learned, together = html_extract.induce, html_extract.extract_group([*STORIES, short])
    monkeypatch.setattr(html_extract, "induce", lambda trees: [w for t in trees for w in learned([t])])
    assert html_extract.extract_group([*STORIES, short]) != together
    monkeypatch.setattr(html_extract, "induce", lambda trees: [html_extract.Wrapper(set(), set()) for _ in trees])
    assert set(html_extract.extract_group([*STORIES, page("<p>x</p>")])) == {""}


def test_constant_blocks_in_articles_need_many_pages():
    made = [page(f"<p>{f'text {i} ' * 20}</p><p class=x>Read our terms</p>") for i in range(12)]
    assert all("terms" not in t for t in html_extract.extract_group(made)) and all("terms" in t for t in html_extract.extract_group(made[:11]))


def test_order_does_not_matter(spark):
    rows = [(i, f"http://h.example/{i}", STORIES[i % 8].replace("story", f"story{i}")) for i in range(150)]
    frames = (spark.createDataFrame(r, "page_id long, url string, html string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 5)))
    first, second = ({r["page_id"]: r["text"] for r in html_extract.extract_pages(f).collect()} for f in frames)
    assert first == second and len(first) == 150


def test_deep_and_long_pages():
    deep = [f"<html><body>{'<div>' * 3000}{f'deep {i} ' * 9}{'</div>' * 3000}<p>x</p></body></html>" for i in range(5)]
    assert html_extract.extract_group(deep) == [(f"deep {i} " * 9).strip() for i in range(5)]
    tangled = "<b><p>" * 2000 + "t" + "</i></b></div>" * 2000 + "<a href='x\">" + "</p" * 50
    assert html_extract.extract_group([tangled] * 5) == html_extract.extract_group([tangled]) * 5
    lists = [f"<html><body><article>{''.join(f'<dl><dt>k{k}</dt><dd>v{i}</dd></dl><p>p</p>' for k in range(900 + i))}</article></body></html>" for i in range(5)]
    assert [t.count("v") for t in html_extract.extract_group(lists)] == [900 + i for i in range(5)]


def slow_match(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.runs) + 1) for _ in range(len(a.runs) + 1)]
    for i, x in enumerate(a.runs):
        for j, y in enumerate(b.runs):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + slow_match(x[0], y[0]))
    return 1 + best[-1][-1]


@pytest.mark.parametrize("seed", range(30))
def test_tree_matching_is_the_plain_recurrence(seed):
    rng = np.random.default_rng(seed)

    def tree(depth):
        tag = ["div", "p", "ul", "section"][rng.integers(4)]
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rng.integers(5)))}</{tag}>" if depth else "<h2>x</h2>"

    a, b = (html_extract.parse("".join(tree(3) for _ in range(4)))[0] for _ in range(2))
    for t in (a, b):
        html_extract.collapse(t)
    size, pairs = html_extract.match(a, b)
    assert size == slow_match(a, b) == len(pairs)
    x, y, w = rng.integers(6, size=400), rng.integers(6, size=300), rng.integers(5, size=(6, 6))
    got = html_extract._trace(x, y, w)
    assert sum(w[x[i], y[j]] for i, j in got) == html_extract._last_row(x, y, w)[-1]
    assert all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))


def test_extract_pages(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<p>text {i}</p>")) for i in range(200)] + [(500, None, None), (501, "x", ""), (7, "http://h.example/7", page("<p>text 7</p>"))]
    out = html_extract.extract_digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out}
    assert len(out) == 203 and got[7] == ("text 7", 6) and got[500] == ("", 0) and all(got[i][0] == f"text {i}" for i in range(200))
    assert html_extract.extract_digest(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_bpe_without_dropout_is_the_library():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=sentencepiece_dropout.model_path())
    bpe = sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 0)
    for t in ["Hello  world\n x ", "  Lead é ﬁ ½ 日本語", "a" * 300, "", "thonble ATION!! der die | über\tq", "   ", "x\r\ny  ", "1234567 0.5 $%&"]:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == sp.encode(t), t


def test_dropout_varies_and_is_lossless():
    text = "internationalization of thonble extraordinary words " * 30
    some = [sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 0.3, seed) for seed in (1, 2, 1)]
    ids = [b.encode(text) for b in some]
    assert ids[0] == ids[2] != ids[1] and all(b.decode(i) == text for b, i in zip(some, ids))
    whole = sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 1.0).encode("abc é")
    assert sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 1.0).decode(whole) == "abc é" and len(whole) // 4 >= 6


def slow_encode(bpe, text):
    """Merge-dropout by the book: every pair of every unit is looked at, and each candidate has its own hash."""
    key, out, number = xxhash.xxh64_intdigest(text.encode(), bpe.seed), [], 0
    whole = "\u2581" + text.replace(" ", "\u2581")
    beside = {p[k : k + 2] for p in bpe.id_of for k in range(len(p) - 1)}
    starts = [i for i in range(len(whole)) if not i or whole[i] == "\u2581" != whole[i - 1] or whole[i - 1 : i + 1] not in beside]
    for unit in (whole[a:b] for a, b in zip(starts, [*starts[1:], None])):
        parts, dead, pop = list(unit), set(), 0
        places = list(range(len(parts)))
        while True:
            pairs = [(-bpe.score[a + b], places[i], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in bpe.score and (places[i], a, b) not in dead]
            if not pairs:
                break
            i = min(pairs)[2]
            x = (key + number * 0x9E3779B97F4A7C15 + pop * 0xD1342543DE82EF95) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            pop += 1
            if x ^ x >> 31 < bpe.dropout:
                dead.add((places[i], parts[i], parts[i + 1]))
                continue
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del places[i + 1]
        number += 1
        out += [i for p in parts for i in ([bpe.id_of[p]] if p in bpe.id_of else [bpe.bytes[b] for b in p.encode()])]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5, 0.9])
def test_dropout_is_drawn_for_each_candidate(dropout):
    bpe = sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), dropout, 5)
    for text in ["Hello world, internationalization! " * 20, "a" * 200, "thonble ating: é½日 x", "ab" * 70 + " aaaa", "word," * 30]:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == slow_encode(bpe, text)


def test_occurrences_are_segmented_afresh():
    bpe = sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 0.2)
    bpe.encode("internationals " * 400)
    assert len({i for i, u in zip(bpe.ids, bpe.unit_of) if u == "\u2581internationals"}) > 20


def test_lockstep_is_the_heap():
    bpe = sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path())
    rng = np.random.default_rng(3)
    units = ["\u2581internationally", "aabababababbbab", "\u2581" * 9 + "the", "\u2581", "é½日本xthe", "\u2581" + "ab" * 9] * 60
    skips = [set(np.flatnonzero(rng.random(60) < 0.3).tolist()) for _ in units]
    ids, pops = bpe.merge(units, np.array([sum(1 << k for k in s) for s in skips], dtype=np.uint64))
    for unit, s, got, n in zip(units, skips, ids, pops):
        parts, want = bpe.segment(unit, s.__contains__)
        assert got == bpe._as_ids(parts) and n == want


def test_slices_do_not_matter(monkeypatch):
    texts = ["some words here and there, again. " * 40, "  two  runs \u2581 of   marks ", "x"] * 3
    whole = sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 0.3).encode_all(texts)
    monkeypatch.setattr(sentencepiece_dropout, "SLICE", 7)
    monkeypatch.setattr(sentencepiece_dropout, "MOST", 50)
    assert sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 0.3).encode_all(texts) == whole


@pytest.mark.parametrize("text", ["a\u2581b", "\u2581", "\u2581\u2581 x \u2581", " \u2581"])
def test_the_mark_itself_is_lossless(text):
    bpe = sentencepiece_dropout.DropoutBpe(sentencepiece_dropout.model_path(), 0.3)
    assert bpe.decode(bpe.encode(text)) == text


def test_encode_documents(spark):
    rows = [(1, "some text  here"), (2, None), (3, ""), (1, "some text  here"), (None, "é\n\t"), (4, "long " * 30_000)]
    out = sentencepiece_dropout.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True)
    got = out.collect()
    assert len(got) == 6 and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got)
    back = {(r["doc_id"], r["text"]) for r in sentencepiece_dropout.decode_documents(out).collect()}
    assert back == {(i, t or "") for i, t in rows}


def test_mil_gradients():
    rng = np.random.default_rng(0)
    model = quality_mil.MilModel.new(rng, 4, 3)
    x, starts = rng.normal(size=(9, quality_mil.N_FEATURES)), np.array([0, 2, 6])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.forward(x, starts)["y"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grads = model.gradients(model.forward(x, starts), starts, y, w)
    for k, g in grads.items():
        at = tuple(rng.integers(n) for n in g.shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-6
        up = loss()
        model.p[k][at] = old - 1e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-6
        model.p[k][at] = old


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def accuracy(out, labels, column):
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return np.mean([r["predicted"] == r[column] for r in rows])


def test_quality_held_out(labelled):
    docs, labels = labelled
    assert accuracy(quality_mil.quality_classifier(docs, labels, max_train=200), labels, "quality") > 0.95


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    assert accuracy(toxicity.toxicity(docs, labels), labels, "toxic") > 0.8


def test_models_with_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "w " * 20_000)], "doc_id long, text string")
    for rows in ([], [(1, None), (None, 1)], [(2, 1), (3, 1)], [(2, 1), (2, 0)]):
        for f, column in ((quality_mil.quality_classifier, "quality"), (toxicity.toxicity, "toxic")):
            out = f(docs, spark.createDataFrame(rows, f"doc_id long, {column} int")).collect()
            assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    empty = docs.where(F.lit(False))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_mil.quality_classifier(empty, labels).collect() == [] and toxicity.toxicity(empty, labels).collect() == []


def test_shared_backoff_is_neutral():
    model = toxicity.ToxicityModel({g: (50, 0) for g in toxicity.top_grams("^good$")} | {g: (0, 50) for g in toxicity.top_grams("^scum$")})
    assert model.ratio(b"scum") > 1 > -1 > model.ratio(b"good") and abs(model.ratio("日本".encode())) < 1


def brute_kneser_ney(texts, labels, word):
    """log P(toxic) - log P(ordinary) of a word, from the definitions: counts of a class above, distinct left neighbours below."""
    d, order = 0.75, 5
    counts = [{}, {}]
    for text, label in zip(texts, labels):
        for w in text.split():
            w = "^" + w.lower().strip(" .,;:!?'\"()[]{}-") + "$"
            for i in range(1, len(w)):
                g = w[max(0, i - order + 1) : i + 1]
                counts[label][g] = counts[label].get(g, 0) + 1
    seen = {g[k:] for c in counts for g in c for k in range(len(g))}
    size = len({g[-1] for g in seen}) + 1

    def below(s):
        if not s:
            return 1 / size
        left = lambda t: sum(len(x) == len(t) + 1 and x.endswith(t) for x in seen)
        ends = {x[-1] for x in seen if len(x) == len(s) + 1 and x[1:-1] == s[:-1]}
        total = sum(left(s[:-1] + e) for e in ends)
        return (max(left(s) - d, 0) + d * len(ends) * below(s[1:])) / total if total else below(s[1:])

    def likelihood(c, g):
        total = sum(n for x, n in c.items() if x[:-1] == g[:-1])
        kinds = sum(x[:-1] == g[:-1] for x in c)
        return (max(c.get(g, 0) - d, 0) + d * kinds * below(g[1:])) / total if total else below(g[1:])

    w = "^" + word + "$"
    grams = [w[max(0, i - order + 1) : i + 1] for i in range(1, len(w))]
    return sum(np.log(likelihood(counts[1], g)) - np.log(likelihood(counts[0], g)) for g in grams)


def test_toxicity_is_kneser_ney(spark):
    texts = ["good words are good, and the day is goodly", "scum of the scummy sort! scums", "the word scones is goods", "a scar"]
    labels = [0, 1, 0, 1]
    counts = toxicity.gram_counts(spark.createDataFrame(list(zip(texts, labels)), "text string, label int"))
    model = toxicity.ToxicityModel.gathered(counts)
    for word in ["good", "scum", "scums", "scones", "the", "goody", "a", "scarf", "xyz", "words"]:
        assert abs(model.ratio(word.encode()) - brute_kneser_ney(texts, labels, word)) < 1e-9, word


def test_expressions_of_several_words_count():
    model = toxicity.ToxicityModel({g: (50, 0) for g in toxicity.top_grams("^good$")} | {g: (0, 50) for g in toxicity.top_grams("^scum$")})
    near, far = (model.features(t, model.words()) for t in ("good good good scum scum good good good", "scum good good good good good good scum"))
    assert near[4] > far[4] and np.allclose(near[:4], far[:4]) and len(near) == toxicity.N_FEATURES


def test_toxicity_keeps_every_gram(spark):
    """No rare gram is dropped, and the table says what a plain reading of all counts says."""
    counts = {f"{a}{b}{c}": (1 + (a + b + c in "aceg"), int(c == "b")) for a in map(chr, range(0x4E00, 0x4E00 + 50)) for b in map(chr, range(0x5E00, 0x5E00 + 50)) for c in "b"}
    counts |= {g: (3, 1) for g in toxicity.top_grams("^good$")} | {g: (0, 5) for g in toxicity.top_grams("^scum$")}
    table = spark.createDataFrame([(g, a, b) for g, (a, b) in counts.items()], "gram string, ordinary long, toxic long")
    made, plain = toxicity.ToxicityModel.gathered(table), toxicity.ToxicityModel(counts)
    assert len(made.gram.keys) == len(counts)
    for a, b in ((made.gram, plain.gram), (made.context, plain.context)):
        assert (a.keys == b.keys).all() and np.allclose(a.values, b.values, rtol=1e-9)


def test_toxicity_learns_from_all_rows(spark):
    """train() holds every gram that its learnable rows have."""
    ids = [i for i in range(1, 12_000) if zlib.crc32(str(i).encode()) % 5]
    text = {i: " ".join(f"{chr(0x4E00 + i)}{chr(0x5000 + k)}" for k in range(60)) for i in ids}
    docs = spark.createDataFrame([(i, t) for i, t in text.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    learnable = [i for i in ids if zlib.crc32(str(i).encode()) % 5 != 4]
    grams = {g for i in learnable for w in text[i].split() for g in toxicity.top_grams(toxicity.core(w))}
    assert len(grams) > 250_000 and len(toxicity.train(docs, labels).gram.keys) == len(grams)
