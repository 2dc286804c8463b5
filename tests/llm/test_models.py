"""Learnt operators, token counts, decontamination: held-out accuracy, brute force, odd inputs."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import tables
from millrace.llm import decontaminate, dom, html_text, plans, quality_net, token_counts, toxicity
from millrace.llm.labels import is_held_out, labelled_sample

DOCS = "doc_id bigint, text string, score string, n_tokens string"
ODD = [(1, None, "own", "x"), (2, "", "own", "x"), (None, "text", "own", "x"), (3, "long words " * 20_000, "own", "x"),
       (3, "long words " * 20_000, "own", "x")]


@pytest.fixture(scope="module")
def larger():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path


def held_out_accuracy(spark, larger, df, label, guess):
    known = tables.load(spark, larger, "labels").filter(is_held_out(F.col("doc_id")))
    return df.join(known, "doc_id").agg(F.avg((F.col(label) == F.col(guess).cast("int")).cast("int"))).first()[0]


def test_quality_on_held_out_rows(spark, larger):
    df = plans.QUERIES["op5_quality_classifier"](spark, larger).cache()
    assert df.count() == tables.load(spark, larger, "documents").count()
    assert df.filter(~F.col("score").between(0, 1)).count() == 0
    assert held_out_accuracy(spark, larger, df, "quality", "predicted") > 0.93


def test_toxicity_on_held_out_rows(spark, larger):
    df = plans.QUERIES["op6_toxicity"](spark, larger).cache()
    assert df.count() == tables.load(spark, larger, "documents").count()
    known = df.withColumnRenamed("toxic", "guess")
    assert held_out_accuracy(spark, larger, known, "toxic", "guess") > 0.93


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 992, 993, 5000):
        data = bytes(random.Random(n).randbytes(n))
        chunks = quality_net.chunks_of(data)
        assert chunks[0] + b"".join(c[quality_net.CHUNK - quality_net.STEP :] for c in chunks[1:]) == data
        assert max(map(len, chunks)) <= quality_net.CHUNK


def test_blocks_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["a", None, "xyz " * 900, "é" * 3000, "b c " * 50]
    chunks = [c for t in texts for c in quality_net.chunks_of((t or "").encode())]
    owners = np.arange(len(chunks)) % 5
    model = quality_net.fit(chunks, owners, rng.integers(0, 2, 5).astype(np.float32), epochs=1)
    whole = quality_net.score_texts(model, texts)
    monkeypatch.setattr(quality_net, "BLOCK", 3)
    assert quality_net.score_texts(model, texts) == pytest.approx(whole, abs=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    chunks = [rng.bytes(200), rng.bytes(512), rng.bytes(90)]
    own, labels = np.array([0, 0, 1]), np.array([1, 0], np.float32)
    model = quality_net.fit(chunks, own, labels, epochs=1)
    ids, lengths = quality_net.as_matrix(chunks)
    seen = quality_net.repeats(ids)
    found = quality_net._gradients(model, ids, seen, lengths, own, labels)

    def loss(m):
        pooled = quality_net.pool(m, ids, lengths)
        f = quality_net.FILTERS
        total, count = np.zeros((2, f)), np.zeros((2, 1))
        largest = np.zeros((2, f))
        np.add.at(total, own, pooled[:, :f])
        np.add.at(count, own, pooled[:, f : f + 1])
        np.maximum.at(largest, own, pooled[:, f + 1 :])
        p = quality_net.combine(m, total, count, largest)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name in ("out", "dense", "filters", "shift"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        up, down = dict(model), dict(model)
        for m, d in ((up, 1e-3), (down, -1e-3)):
            m[name] = m[name].astype(np.float64)
            m[name][at] += d
        assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(float(found[name][at]), rel=0.1, abs=1e-5)


def test_models_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_net.fit_model(df, labels) == 0.5
    chunks = [b"good text here", b"*** bad ###"]
    model = quality_net.fit(chunks, np.array([0, 1]), np.array([1, 0], np.float32), epochs=2)
    rows = quality_net.score(df, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[3].score == rows[4].score
    assert quality_net.score(df.limit(0), model).count() == 0

    assert [m.weights for m in toxicity.fit_model(df, labels)] == [{}, {}, {}]
    assert toxicity.score(df.limit(0), toxicity.fit_model(df, labels)).count() == 0
    seen = [toxicity.counts_of(toxicity.distinct_words(t)) for t in ["you idiot", "you moron", "nice day", "good one"] * 5]
    marks = np.array([[1, 0, 1], [1, 0, 1], [0, 0, 0], [0, 0, 0]] * 5, np.float32)
    chain = toxicity.fit_chain(seen, marks)
    rows = toxicity.score(spark.createDataFrame([*ODD, (9, "An IDIOT!", "", "")], DOCS), chain).collect()
    assert len(rows) == 6 and rows[5].p_toxic > 0.5 > rows[0].p_toxic
    assert len(chain[2].before) == 2


def test_toxicity_of_long_texts_scores_as_fitted():
    many = "you idiot " + " ".join(f"idio{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(5000))
    texts = ["you idiot here", "nice day here", many, "good one " + many[10:]] * 5
    seen = [toxicity.counts_of(toxicity.distinct_words(t)) for t in texts]
    marks = np.array([[1, 1], [0, 0], [1, 1], [0, 0]] * 5, np.float32)
    chain = toxicity.fit_chain(seen, marks)
    sample, every = toxicity.Sample(seen), np.arange(len(seen))
    before = np.zeros((len(seen), 0), np.float32)
    for k, model in enumerate(chain):
        features = np.arange(len(sample.names))
        fitted = toxicity._scores(model, sample, every, features, before)
        scored = [toxicity.Chain(chain).score(t)[k] for t in texts]
        assert scored == pytest.approx(list(fitted), abs=1e-4)
        before = np.column_stack([before, fitted])
    assert any(w and f.startswith("idio") for m in chain for f, w in m.weights.items())


def test_toxicity_learns_from_every_word(spark):
    """The telling words come last in the alphabet, behind more words than any limit let through."""
    filler = " ".join("a" + f"{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(21_000))
    docs = [(i, f"{filler} {'worthless zzz' if i % 2 else 'weather'}") for i in range(32)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(32)], "doc_id bigint, toxic int")
    chain = toxicity.fit_model(df, labels)
    assert chain[2].weights.get("=worthless", 0) > 0 and chain[2].weights.get("=zzz", 0) > 0
    rows = toxicity.score(df, chain).collect()
    assert all((r.p_toxic > 0.5) == bool(r.doc_id % 2) for r in rows)


def test_toxic_rows_fall_into_the_groups_of_their_words():
    kinds = [["idiot", "moron", "fool"], ["trash", "junk", "rubbish"]]
    rng = random.Random(3)
    texts, labels, kind = [], [], []
    for i in range(240):
        words = rng.choices(["sun", "rain", "tree", "house", "road", "river", "bread"], k=6)
        toxic = i % 3 == 0
        which = (i // 3) % 2
        if toxic:
            words += rng.sample(kinds[which], 2)
        texts.append(" ".join(words))
        labels.append(float(toxic))
        kind.append(which if toxic else -1)
    sample = toxicity.Sample([toxicity.counts_of(toxicity.distinct_words(t)) for t in texts])
    groups = [{sample.names[f] for f in g} for g in toxicity.word_groups(sample, np.array(labels, np.float32))]
    assert sorted(map(sorted, groups)) == [["=fool", "=idiot", "=moron"], ["=junk", "=rubbish", "=trash"]]
    marks = toxicity.marks_of(sample, np.array(labels, np.float32))
    first = 0 if "=idiot" in groups[0] else 1
    assert [list(m[:2]) for m in marks] == [[0, 0] if k < 0 else [float(k == first), float(k != first)] for k in kind]
    # Out of fold: a word that only one fold knows stands in no group.
    odd = [t + " unheard" if i % 4 == 0 and labels[i] else t for i, t in enumerate(texts)]
    sample = toxicity.Sample([toxicity.counts_of(toxicity.distinct_words(t)) for t in odd])
    assert all("=unheard" not in {sample.names[f] for f in g} for g in toxicity.word_groups(sample, np.array(labels, np.float32)))


def test_one_row_of_a_labelled_id_is_learnt_from(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "good"), (3, None), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(2, 1), (2, 0)], "doc_id bigint, quality int")
    sample = labelled_sample(docs, labels, "quality", 40)
    rows = {r.doc_id: (r.text, r["__label"]) for r in sample.collect()}
    open_ = {r.doc_id for r in docs.filter(~is_held_out(F.col("doc_id"))).select("doc_id").distinct().collect()}
    assert set(rows) == open_ & {1, 2, 3} and sample.count() == len(rows)
    assert sample.collect() == labelled_sample(docs.repartition(9), labels, "quality", 40).collect() or len(rows) > 1
    if 2 in rows:
        assert rows[2] == ("good", 0)


def test_quality_learns_from_whole_texts(spark):
    """What tells the classes apart stands in the middle of long texts, outside of any few chunks."""
    filler = "the words go on and on " * 60
    texts = [(i, filler + ("*** ### $$$ " * 12 if i % 2 else "more of the same ") + filler) for i in range(60)]
    df = spark.createDataFrame([*texts, (61, "long " * 40_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(62)], "doc_id bigint, quality int")
    model = quality_net.fit_model(df, labels)
    rows = quality_net.score(df, model).collect()
    assert sum((r.score > 0.5) == (r.doc_id % 2 == 0) for r in rows if r.doc_id < 60) >= 57


def test_tokens_are_those_of_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        frequent = token_counts.frequent_lengths(file.read())
    assert len(frequent) > 20_000 and frequent["the"] == 1 and frequent["é"] == 1
    texts = [r.text for r in tables.load(spark, sf_dir, "documents").collect()]
    texts += [None, "", " ", "<|endoftext|> a<|startoftext|>", "it's we'll 've''s", "İstanbul ΑΣ ẞ é", "日本語 ½ ²³ _a-b_",
              "\x85\x1c x", "Он сказал: “привет” — Мир… ёж", "漢字かな交じり文 한국어 텍스트 ١٢٣", "e\u0301 ﬁ Ǆ ὈΔΥΣΣΕΎΣ \u200d\ufeff",
              "".join(chr(c) for c in range(0x250, 0x3000) if chr(c).isprintable()), "".join(map(chr, range(1, 0x250))), "z" * 100_000, "á Å 👩‍👩‍👧", "don't " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("n_bytes", F.lit("own"))
    got = {r.i: r for r in token_counts.count_tokens(df, path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 2048, len((t or "").encode()))
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row, last = [i], row
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_distance_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choices("abc", k=rng.randrange(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randrange(0, 120)))
        assert decontaminate.best_match(item, text)[0] == edit_distance_inside(item, text)


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "short one"), (15, items[0][1])]
    docs = [(None, items[0][1], "x"), (50, None, "x"), (51, "", "x"), (52, "so SHORT \n one it is", "x")]
    for d in range(40):
        text = " ".join(word() for _ in range(30))
        leak = list(items[d % 12][1])
        for _ in range(rng.randrange(0, 9)):
            leak[rng.randrange(len(leak))] = rng.choice(["", "x", "Q", "  "])
        docs.append((d, text + " " + "".join(leak) + "\n" + text if d % 3 else text, "x"))
    got = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"),
        spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=300,
    ).collect()
    expected = {}
    for d, t, _ in docs:
        for i, s in items:
            item, text = decontaminate.normal(s), decontaminate.normal(t)
            if item and text:
                best = edit_distance_inside(item, text)
                if best <= decontaminate.budget(len(item), decontaminate.ERROR_RATE, decontaminate.MIN_CHARS):
                    expected[d, i] = best
    assert {(r.doc_id, r.item_id): r.edits for r in got} == expected
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)


def test_rows_without_leaks_are_told_apart_by_their_text(spark):
    item = "a passage of the benchmark that is long enough to be found again"
    large = 2**60 + 1
    docs = [(None, f"x {item}"), (None, "clean"), (3, f"{item} y"), (3, "clean too"), (large, item), (large + 1, "fine"), (5, None), (6, ""),
            (7, "long " * 100_000), (8, "long " * 100_000 + item), (8, "long " * 100_000 + item)]
    df = spark.createDataFrame([(*d, "own") for d in docs], "doc_id bigint, text string, check string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = decontaminate.without_leaks(df, items)
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted(((d, t) for d, t in docs if item not in (t or "")), key=repr)
    assert {r.doc_id for r in decontaminate.find_leaks(df, items).collect()} == {None, 3, large, 8}
    assert decontaminate.without_leaks(df, items.limit(0)).count() == len(docs)
    assert decontaminate.without_leaks(df.limit(0), items).count() == 0


class Article(HTMLParser):
    """An independent reading of a page: the blocks inside the article, without the parts that never belong to it."""

    apart = frozenset({"aside", "form", "nav", "script", "style", "footer"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.lines, self.line = 0, 0, [], ""

    def handle_starttag(self, tag, attrs):
        names = set((dict(attrs).get("class") or "").split()) | {dict(attrs).get("id")}
        if tag == "article":
            self.inside += 1
        elif self.skip and tag not in ("br", "input", "img", "hr"):
            self.skip += 1
        elif tag in self.apart or names & {"comments", "ad", "notice", "related"}:
            self.skip = 1
        if tag in dom.BLOCKS:
            self.end_block()

    def handle_endtag(self, tag):
        if tag == "article":
            self.end_block()
            self.inside -= 1
        elif self.skip:
            self.skip -= 1
        if tag in dom.BLOCKS:
            self.end_block()

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.line += data

    def end_block(self):
        if self.inside and self.line.split():
            self.lines.append(" ".join(self.line.split()))
        self.line = ""


def article_of(source):
    reader = Article()
    reader.feed(source)
    return "\n".join(reader.lines)


def test_every_page_of_the_table(spark, larger):
    sources = {r.page_id: r.html for r in tables.load(spark, larger, "pages").collect()}
    got = {r.page_id: r for r in plans.QUERIES["op4_html_extraction"](spark, larger).collect()}
    assert got.keys() == sources.keys()
    for page, source in sources.items():
        assert got[page].text == article_of(source)
        assert got[page].n_chars == len(got[page].text)


def test_repeated_pages_change_no_other(spark):
    page = (
        "<html><body><nav><a href=/>home</a><a href=/b>b</a></nav><article><h1>Title {0}</h1><p>First text {0}, which goes on.</p>"
        "<p>More of it.</p></article><div class=comments><p>Nice {0}.</p></div><footer>end</footer></body></html>"
    )
    pages = [(i, page.format(i)) for i in range(40)]
    often = pages + [(100 + i, page.format(0)) for i in range(2000)]
    few, many = (
        {r.page_id: r.text for r in html_text.extract(df, html_text.fit_model(df)).collect()}
        for df in (spark.createDataFrame(x, "page_id int, html string") for x in (pages, often))
    )
    assert {i: many[i] for i in few} == few and set(t for i, t in many.items() if i >= 100) == {few[0]}
    assert few[3] == "Title 3\nFirst text 3, which goes on.\nMore of it."


@pytest.mark.parametrize("piece,tail", [
    ("<a", ""), ("<script", ""), ("<x y", ""), ('<a "', ""), ('<a "', ">"), ("<a '\"x", ">"), ("<", ""), ("<!-", ""),
    ("<div>", "</x>" * 1000), ('<p title="', "x"), ("<li><b>", ""), ("<table><td>", ""), ("<!-- ", ""), ("</p", ""),
])
def test_broken_pages_are_read_in_one_scan(piece, tail):
    source = piece * (300_000 // len(piece)) + tail
    began = time.process_time()
    dom.read(source)
    assert time.process_time() - began < 3


def test_tokens_of_odd_markup():
    text = lambda s: dom.text_of(p := dom.read(s), [True] * len(p.tags))
    assert text("a < b <c") == "a < b <c" and text("1 <2> 3") == "1 <2> 3"
    assert text("<p>x<!-- <p> --> y<?php z ?> w<!D>") == "x y w"
    assert text("<script>if (a<b) '</p>'</script >t<style>never ends <p>x") == "t"
    assert dom.read("<a title='>' href=x>y</a>").attrs[1] == " title='>' href=x"
    assert text('<a "<b>bold</b>') == '<a "bold' and text("<SCRIPT>x</Script>y") == "y"


def test_pages(spark):
    page = (
        "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><a href=/>home</a></nav>"
        "<article><h1>A &amp; B</h1><p><b>First  text,\n which goes on.<br><p>Second &lt;one&gt;, also long.</p></article>"
        "<footer>end</footer></body></html>"
    )
    pages = [(i, page.replace("goes", f"goes{i}")) for i in range(20)]
    odd = [(90, None), (91, ""), (92, "plain  text"), (93, "<p>unclosed <b"), (94, page + "<div>" * 3000), (95, "<" * 500)]
    df = spark.createDataFrame(pages + odd, "page_id int, html string").withColumn("text", F.lit("own"))
    model = html_text.fit_model(df.filter("page_id < 90"))
    got = {r.page_id: r.text for r in html_text.extract(df, model).collect()}
    assert got[5] == "A & B\nFirst text, which goes5 on.\nSecond <one>, also long."
    assert got[90] == got[91] == "" and got[92] == "plain text"
    assert html_text.fit_model(df.limit(0)) is None
    assert html_text.extract(df.limit(0), None).count() == 0


def test_left_out_elements_take_their_subtrees_along():
    rng = np.random.default_rng(0)
    source = "<div><p>a</p><section><p>b</p><ul><li>c</li></ul></section></div><aside><p>d</p></aside>"
    tree = html_text.Tree(dom.read(source))
    for _ in range(50):
        kept = tree.decode(rng.random(tree.size))
        assert all(kept[tree.page.parents[i]] or not kept[i] for i in range(1, tree.size))
