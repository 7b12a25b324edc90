import random

import pytest

from textharbor.llm import boilerplate, language, paths, spam

SAMPLES = [("en", s) for s in ("The cat sat on the mat in the house.", "A dog and the bird of a town are here.", "The end of the road is in a field.", "It was a day in the life of the king.", "We saw the sea and a boat on the sand.")] + [
    ("de", s) for s in ("Die Katze sitzt auf der Matte in dem Haus.", "Der Hund und die Frau gehen in die Stadt.", "Das Ende der Straße ist in dem Feld.", "Es war ein Tag in dem Leben der Frau.", "Wir sahen die See und das Boot auf der Insel.")
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, "language string, sample string")


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_keyword_pages(spark, samples, monkeypatch, most):
    monkeypatch.setattr(spam, "MOST_PHRASES", most)
    function = spam.function_words(samples)
    assert {"the", "der"} <= function and "cat" not in function
    nouns, adds = "sofa lamp phone watch drone".split(), "cheap best free new top sale".split()
    rng = random.Random(1)
    rows = []
    for i in range(24):
        kind = i % 4
        words = [f"{rng.choice(adds)} {rng.choice(nouns)}" for _ in range(30)]
        body = [" ".join(words), ", ".join(words), "#" + " #".join(w.replace(" ", "") for w in words), "The cat is on the mat in a house.\n" + "\n".join(w.title() for w in words)][kind]
        rows.append(("docs", i, f"host{i % 5}.x", body))
    prose = " ".join(f"The {a} {n} of the {m} is in a house." for a in adds[:2] for n in nouns for m in nouns)
    rows += [("docs", 100 + i, f"h{i}.y", prose) for i in range(3)]
    rows += [("docs", 200, "h.z", "The cat is on the mat. A dog is in the town.\n" + "cheap sofa, best lamp, " * 10), ("docs", 201, None, None), ("docs", 202, None, ""), ("docs", 203, "q.q", "zyx wvu tsr qpo nml kji hgf edc baz yyy xxx www"), ("docs", None, "a.b", "cheap sofa " * 9)]
    df = spark.createDataFrame(rows + rows[:2], "tab string, rec_id long, host string, body string")
    got = sorted(r.rec_id for r in spam.keyword_pages(df, function).collect())
    assert got == list(range(24))
    assert spam.keyword_pages(df.limit(0), function).count() == 0


def test_evidence_of_flagged_pages(spark):
    docs = spark.createDataFrame([(1, "cheap sofa\n Best  lamp\n\nA real sentence.", ["best lamp", None]), (2, "x", None), (3, None, None), (1, "cheap sofa\n Best  lamp\n\nA real sentence.", ["best lamp", None])], "doc_id long, body string, anchor_text array<string>")
    pages = spark.createDataFrame([(1, "home\nshop", [("u", "Home"), ("v", "Shop")]), (2, "a", None)], "page_id long, body string, links array<struct<url:string,anchor:string>>")
    found = spark.createDataFrame([("docs", 1, 5), ("extracted", 1, 2)], "tab string, rec_id long, words int")
    got = {(r.tab, r.rec_id): (r.words, r.lines, r.listed, r.linked) for r in spam.evidence(found, docs, pages).collect()}
    assert got == {("docs", 1): (5, 3, 2, 1), ("extracted", 1): (2, 2, 2, 2)}
    assert spam.evidence(found.limit(0), docs, pages).count() == 0


def test_unigrams_sum_over_all_segmentations():
    pieces = {"▁", "▁a", "ab", "b", "▁ab", "a"}
    model = language.train([("x", "ab ab aa"), ("y", "bb ba b")], pieces)

    def every(s, at):
        if not s:
            return 1.0
        return sum((model.table[s[:n]][at] if s[:n] in model.table else model.floor[at] * (0.01 if n == 1 else 1)) * every(s[n:], at) for n in range(1, len(s) + 1) if s[:n] in model.table or n == 1 or s[:n] in pieces)

    import math

    for w in ("ab", "ba", "abab", "c"):
        assert model.word(w) == pytest.approx([math.log(every("▁" + w, at)) for at in range(2)])
    assert all(map(math.isfinite, model.word("abc" * 500)))


@pytest.mark.parametrize("label, code", [("en-US", "en"), ("EN", "en"), ("deu", "de"), (" pt_BR ", "pt"), (None, None), ("", None), ("-", None), ("und", None), ("xx", None), ("unknown", None), ("ja", "ja")])
def test_labels(label, code):
    assert language.label_code(label) == code


def test_languages(spark, samples):
    en, de = "The cat and the dog are in the house of the king.", "Die Katze und der Hund sind in dem Haus der Frau."
    rows = [
        (1, f"{en}\n{en}\n{de}\n{en}", "en"), (2, f"{de}\n{de}", "en_GB"), (3, f"{de}\n\n{de}", "DEU"), (4, en, None), (5, None, "en"), (6, "", ""), (7, "12 34", "en"), (8, (en + " ") * 300, "de"), (9, f"{en}\n{en}\nDie Katze", "en"), (2, f"{de}\n{de}", "en_GB"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, body string, language string, line_no string")
    model = language.model_of(samples)
    got = {(r.doc_id, r.line_no): r.language for r in language.wrong_labels(df, "doc_id", "body", "language", model).collect()}
    assert got == {(1, 2): "de", (2, -1): "de", (4, -1): "en", (8, -1): "en"}
    whole = {(r.doc_id, r.line_no): r for r in language.identify(df, "doc_id", "body", "language", model).collect()}
    assert whole[5, -1].language is None and whole[7, -1].confidence == 0 and 0.9 < whole[1, -1].confidence <= 1
    assert language.identify(df.limit(0), "doc_id", "body", "language", model).count() == 0
    refined = language.model_of(samples, df)
    assert {(r.doc_id, r.line_no) for r in language.wrong_labels(df, "doc_id", "body", "language", refined).collect()} == set(got)


def test_furniture(spark):
    rng = random.Random(3)
    nouns, verbs = [f"noun{chr(97 + i)}" for i in range(12)], [f"verb{chr(97 + i)}" for i in range(8)]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} and {rng.choice(verbs)} a {rng.choice(nouns)}."
    rows, expected = [], set()
    for i in range(60):
        host = f"site{chr(97 + i % 6)}"
        title = f"The {rng.choice(nouns)} of {rng.choice(nouns)}"
        lines = [("Home", 1), ("Shop", 1), (f"Home > {title}", 1), (title, 0), (sentence() + " " + sentence(), 0), ("250 g flour", 0), ("10 g butter", 0), (sentence(), 0), ("", 0), (sentence(), 0), ("Share this page", 1), (f"© 20{i + 10} {host}. All rights reserved.", 1)]
        rows.append((i, f"http://{host}.test/{i}", title, "\n".join(x for x, _ in lines), [("u", "Home"), ("u", "Shop"), ("u", "in text")], "z"))
        expected |= {(i, n) for n, (_, f) in enumerate(lines) if f}
    rows += [(900, None, None, None, None, "z"), (901, None, None, "", None, "z"), (902, None, None, "One line", None, "z"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, body string, links array<struct<url:string,anchor:string>>, path string")
    got = {(r.page_id, r.line_no) for r in boilerplate.furniture_lines(df, "page_id").collect()}
    assert got == expected
    clean = {r.page_id: r for r in boilerplate.main_content(df, "page_id").collect()}
    assert clean[5].main_body.startswith(clean[5].title) and "rights" not in clean[5].main_body and "flour" in clean[5].main_body and clean[900].main_body is None and clean[902].main_body == "One line"
    assert boilerplate.furniture_lines(df.limit(0), "page_id").count() == 0


def test_lines_in_a_hosts_own_words(spark):
    rng = random.Random(5)
    nouns, verbs = [f"noun{chr(97 + i)}" for i in range(12)], [f"verb{chr(97 + i)}" for i in range(8)]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} and {rng.choice(verbs)} a {rng.choice(nouns)}."
    rows, expected = [], set()
    for i in range(90):
        own = i % 3 == 0  # one host holds a third of the pages
        host = "big.test" if own else f"site{chr(97 + i % 7)}.test"
        menu, legal = (["Quorvex Zindle Brumf"], ["Drelk Vonta 2019"]) if own else ([], [])
        lines = [*menu, f"The {rng.choice(nouns)} of {rng.choice(nouns)} {i}", sentence(), "Kelvo Trint" if own else "", sentence(), *legal]
        rows.append((i, f"http://{host}/{i}", lines[len(menu)], "\n".join(lines)))
        expected |= {(i, 0), (i, 5)} if own else set()
    df = spark.createDataFrame(rows, "page_id long, url string, title string, body string")
    assert {(r.page_id, r.line_no) for r in boilerplate.furniture_lines(df, "page_id").collect()} == expected


def test_long_link_texts_tile(spark):
    texts = {"one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "home", "all news"}
    starts = boilerplate._first_words(texts)
    assert boilerplate._tiled("home one two three four five six seven eight nine ten eleven twelve thirteen fourteen all news", texts, starts, "")
    assert boilerplate._tiled("home | all news | home", texts, starts, "") and not boilerplate._tiled("home all the news", texts, starts, "")


def test_sentences_that_begin_alike_differ(spark):
    rng = random.Random(9)
    nouns = [f"noun{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(40):
        start = "The nouna and the nounb of the nounc are in the"
        rows.append((i, f"http://site{chr(97 + i % 4)}.test/{i}", None, f"{start} {nouns[i % 12]} of {nouns[(i * 5 + 1) % 12]} with {nouns[(i // 12)]}.\nThe {rng.choice(nouns)} is of the {rng.choice(nouns)} in a {rng.choice(nouns)}."))
    df = spark.createDataFrame(rows, "page_id long, url string, title string, body string")
    assert boilerplate.furniture_lines(df, "page_id").where("line_no = 0").count() == 0


HTML = """<html><head><title>t</title><style>p{{}}</style></head><body><div class="menu m{0}"><ul><li><a href=/>Home</a></li><li><a href=/s>Shop</a></li></ul></div>
<div class="post"><p>The first story number {0} is told in a few words here.</p><p>Short aside {0}</p><p>The story number {0} goes on and on to an end.</p></div>
<div class="foot">All rights reserved {0}</div><script>var x = "no text";</script></body>"""


def test_main_text_by_tag_class_paths(spark):
    rows = [(i, f"http://a{i % 2}.test/{i}", HTML.format(i)) for i in range(12)] + [(90, None, None), (91, "http://a0.test/", ""), (92, "http://b.test/", "<p>lost<b>"), (3, "http://a1.test/3", HTML.format(3))]
    df = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, path string")
    found = paths.containers_of_html(df, "page_id", "url", "html").cache()
    assert {r.path for r in found.where("key = 5").collect()} == {"div.m#.menu/ul/li", "div.post/p", "div.foot"}
    got = {r.key: r.main for r in paths.main_text(found).collect()}
    assert set(got) == {*range(12), 92} and got[92] is None
    for i in range(12):
        assert got[i].split("\n") == [f"The first story number {i} is told in a few words here.", f"Short aside {i}", f"The story number {i} goes on and on to an end."]
    assert paths.main_text(found.limit(0)).count() == 0
    assert paths.blocks_of("<div><p>a<p>b</div>c") == [("div/p", "a", False), ("div/p/p", "b", False), ("", "c", False)]


def test_a_host_overrules_all(spark):
    block = lambda k, h, no, path, link, prose: (k, h, no, path, "x", link, prose)
    rows = [r for k in range(20) for r in ([block(k, "own", 0, "p", False, True), block(k, "own", 1, "q", False, False), block(k, "own", 2, "p", False, True)] if k < 6 else [block(k, f"h{k}", 0, "p", False, True), block(k, f"h{k}", 1, "q", False, False)])]
    df = spark.createDataFrame(rows, "key long, host string, no int, path string, text string, link boolean, prose boolean")
    assert {(r.key, r.no) for r in paths.furniture(df).collect()} == {(k, 1) for k in range(6, 20)}


def test_line_paths_of_pages(spark):
    rows = []
    for i in range(30):
        body = ["Home", "Shop", f"Story {i}", f"The story of number {i} begins right here today.", f"{i} eggs", f"The story of number {i} comes to an end now.", "Terms of use"]
        rows.append((i, f"http://h{i % 3}.test/", f"Story {i}", "\n".join(body), [("u", "Home"), ("u", "Shop"), ("u", "Terms of use")], "z"))
    rows += [(90, None, None, None, None, "z"), (91, None, None, "", None, "z"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, body string, links array<struct<url:string,anchor:string>>, path string")
    lines = paths.containers_of_lines(df, "page_id").cache()
    got = {(r.key, r.no) for r in paths.furniture(lines).collect()}
    assert got >= {(i, n) for i in range(30) for n in (0, 1, 6)} and not got & {(i, n) for i in range(30) for n in (3, 4, 5)}
    assert paths.furniture(lines.limit(0)).count() == 0
