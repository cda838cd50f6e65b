"""Small brute-force and known-answer tests of the corpus operators."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import boilerplate, bpe, lines, maxent, mixing, near_duplicates, residue, sentences, spans

WORDS = "pump kiln net yard route weir dam oven quay mill ridge inlet lathe market valve sensor".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- problem 1 ---------------------------------------------------------------


def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        base = words(rng, 70).split()
        texts.append(" ".join(base))
        for edits in (1, 4, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "".join(rng.choice("abcdefgh") for _ in range(5))
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0], texts[1], "short", "", None, "x" * 300, "x" * 301]
    data = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0])]
    df = spark.createDataFrame(data, "id long, text string").withColumn("extra", F.lit(1))
    want = sorted(
        (i, j)
        for i in range(len(texts))
        for j in range(i + 1, len(texts))
        if texts[i] and texts[j] and min(len(texts[i]), len(texts[j])) >= 250 and jaccard(texts[i], texts[j]) >= 0.7
    )
    got = rows(near_duplicates.similar_pairs(df))
    assert got == want
    assert rows(near_duplicates.similar_pairs(df.limit(0))) == []
    classes = {r.id: (r.class_id, r.n_links) for r in near_duplicates.similar_classes(df).collect()}
    assert classes[100][0] == 0 and classes[103] == (103, 0) and len(classes) == len(texts)


def test_banding_grows_with_the_records():
    assert near_duplicates.banding(10_000, 0.7) == (80, 6) == near_duplicates.banding(0, 0.7)
    for n in (10**7, 10**9, 10**11):
        bands, width = near_duplicates.banding(n, 0.7)
        assert width > 6 and (1 - 0.7**width) ** bands <= 5e-5


def test_sketch_fills_and_estimates():
    a, b = "abcdefghij" * 40 + "klmno pqrst", "abcdefghij" * 40
    s = near_duplicates.sketch_batch([a, b, "abcde"], 480, 5)
    assert (s != 2**64 - 1).all()
    assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.12


# --- problem 2 ---------------------------------------------------------------


@pytest.fixture(scope="module")
def splitter():
    rng = random.Random(2)
    arrays = []
    for _ in range(400):
        page = []
        for _ in range(6):
            name, noun = rng.choice(["Ada", "Bo", "Cy"]), f"{rng.choice(WORDS)} {rng.choice(WORDS)} {''.join(rng.choice('aeiou') for _ in range(4))} {rng.choice(WORDS)}"
            page.append(rng.choice([
                f"The {noun} of St. {name} Street was opened by Dr. {name} in {rng.randrange(1900, 2000)}.",
                f"Was it the old M.V. {name} or the {noun}?",
                f"Prof. V. R. {name} measured {rng.randrange(9)}.{rng.randrange(9)} litres near the {noun}.",
                f'"Stop!" the {noun} keeper shouted.',
                f"See Fig. {rng.randrange(99)} of the {noun}.",
            ]))
        arrays.append(page)
        arrays.append(["".join(rng.choice("古新窯堤防灯台果樹園") for _ in range(8)) + "を測定した。" for _ in range(4)])
    hard, soft = sentences.fit_on(arrays)
    return sentences.Splitter(hard.table(), soft.table())


def test_sentence_units_known_answers(splitter):
    text = 'The kiln of St. Ada Street was opened in 1950. "Stop!" the yard keeper shouted. Was it the old M.V. Bo or the net?'
    ends = splitter.unit_ends(text, [text])
    assert sentences.units_of(text, ends) == [
        "The kiln of St. Ada Street was opened in 1950.", '"Stop!" the yard keeper shouted.', "Was it the old M.V. Bo or the net?",
    ]
    parts = ["Notes on a pump", "1. Rinse the net. Then dry it", "a | b | c", "It stood by St.", "Ada Street was closed."]
    assert sentences.units_of(" ".join(parts), splitter.unit_ends(" ".join(parts), parts))[:3] == parts[:3]
    assert splitter.unit_ends("", None) == []
    assert splitter.unit_ends("   ", None) == [3]
    assert splitter.unit_ends("古い窯を測定した。「閉まりました。」と言った。", None)[0] == 9


def test_long_quotations_are_one_unit(splitter):
    for n in (4, 40, 400):
        text = "The keeper read: “" + "The kiln was opened. The net was closed! " * n + "” and left the yard."
        assert splitter.unit_ends(text, [text]) == [len(text)] and splitter.unit_ends(text, None) == [len(text)]
        cut = text.split(". ")
        parts = [x + "." for x in cut[:-1]] + cut[-1:]
        assert splitter.unit_ends(" ".join(parts), parts) == [len(text)]
    thai = "ข่าว  วันนี้ ตลาดเปิด แล้ว"
    assert splitter.unit_ends(thai, [thai]) == [12, 21, 26]


def test_units_cover_any_text(splitter):
    rng = random.Random(5)
    for _ in range(200):
        parts = ["".join(rng.choice('ab. !?"()A「」。 ก1\n') for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 4))]
        for text, array in ((" ".join(parts), parts), (" ".join(parts), None)):
            ends = splitter.unit_ends(text, array)
            assert ends == sorted(set(ends)) and (not text or ends[-1] == len(text))


def test_sentence_units_on_rows(spark):
    data = [(1, "One two. Three four.", ["One two. Three four."]), (1, "One two. Three four.", ["One two. Three four."]),
            (2, None, None), (3, "", []), (None, "x", ["x"]), (4, "line " * 5000, None)]
    df = spark.createDataFrame(data, "chunk_id long, text string, sentences array<string>")
    got = rows(sentences.sentence_units(df))
    assert {r[0] for r in got} == {1, 4} and (1, 20) in got and (4, 25000) in got
    assert rows(sentences.sentence_units(df.limit(0))) == []


# --- problem 3 ---------------------------------------------------------------


def test_residue(spark):
    cases = [
        "Dear {{first_name}}, the kiln order is on its way.", "Lead paragraph goes here", "404 – page not found The address does not exist.",
        "Please enable JavaScript to read this page.", "Blah blah blah foo bar baz.", "请启用JavaScript后刷新页面。",
        "Zugriff verweigert Bitte melden Sie sich an.",
    ]
    fine = [
        "The mill logged error 404 in 38 of 86,301 requests, which Ada powered rarely.", "Pupils learn JavaScript before they enter the yard.",
        "The set {0, 1, 727} describes the states of the kelp.", '[CODE]: print("{{noun_1}}")', "The road was denied funds.",
    ]
    data = [(i, f"s{i}", t, [t], "https://a.example/mill/x-1") for i, t in enumerate(cases + fine)]
    data += [(90, "s", None, None, None), (91, "s", "", [], None), (0, "s0", cases[0], [cases[0]], None)]
    data += [(100 + i, f"h{i}", f"Script gate number {i} for host{i}.example", None, f"https://host{i}.example/a") for i in range(4)]
    df = spark.createDataFrame(data, "chunk_id long, source_id string, text string, sentences array<string>, url string")
    got = {r[0] for r in residue.residue_records(df).collect()}
    assert got == set(range(len(cases))) | {100, 101, 102, 103}
    assert residue.residue_records(df.limit(0)).count() == 0


RESPONSES = {  # in languages and words that no labelled line has
    "fi": ["Sivua ei löytynyt", "Istuntosi on vanhentunut, kirjaudu uudelleen.", "Ota selaimen komentosarjat käyttöön."],
    "hu": ["A keresett oldal nem található.", "Hozzáférés megtagadva", "Az oldal karbantartás alatt áll."],
    "cs": ["Stránka nebyla nalezena", "Přístup byl odepřen", "Zapněte si prosím podporu skriptů."],
    "uk": ["Сторінку не знайдено", "Увімкніть підтримку сценаріїв", "Триває обслуговування"],
    "he": ["הדף לא נמצא", "הגישה נדחתה"],
    "ta": ["பக்கம் கிடைக்கவில்லை", "அணுகல் மறுக்கப்பட்டது"],
    "en": ["Whoops, nothing lives here", "Hold tight while we look at your visit", "This gate opens for people only, tick the box"],
}


def test_responses_by_their_hosts(spark):
    rng = random.Random(12)
    texts = [x for group in RESPONSES.values() for x in group]
    data = [(i * 10 + k, f"r{i}-{k}", f"{t} {rng.randrange(999)}", None, f"https://www.r{i}x{k}.example/{rng.choice(WORDS)}/p-{k}") for i, t in enumerate(texts) for k in range(4)]
    for i in range(300):
        page, _ = make_page(rng)
        data.append((1000 + i, f"a{i % 50}", " ".join(page), page, f"https://a{i % 50}.example/{rng.choice(WORDS)}/{i}"))
    # short bodies of one host, on their slug's subject, or said once are content
    data += [(5000 + i, "one", "Notes on the larch", ["Notes on the larch"], f"https://one.example/p/{i}") for i in range(6)]
    data += [(5100 + i, f"t{i}", "The weir opened", ["The weir opened"], f"https://t{i}.example/weir/{i}") for i in range(2)]
    df = spark.createDataFrame(data, "chunk_id long, source_id string, text string, sentences array<string>, url string")
    got = {r[0] for r in residue.residue_records(df).collect()}
    want = {r[0] for r in data if r[0] < 1000}
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_responses_of_any_length(spark):
    long_page = "Error 503: Service temporarily unavailable. " + "The server cannot answer your request right now, please try again later. " * 6
    found = ["504 Gateway Timeout", "Pagina non trovata", "Страница не найдена", "Pagina niet gevonden", "This page could not be found", "Your session has ended, sign in again",
             "Please allow scripts to use this page.", "Hello %NAME%, welcome", "Hello [[first_name]], welcome", "Hello {first name}, welcome", long_page]
    fine = ["Access denied was the phrase of the day at the council, wrote the old mill keeper after the meeting in the yard of 1950.",
            "A page not found in the register of 1874 was shown to visitors of the harbour museum by the teacher who kept it in her house.",
            "The gateway of the old harbour failed in spring, and the crew of the valve works repaired it overnight."]
    data = [(i, "s", t, [t], None) for i, t in enumerate(found + fine)] + [(50, "s", " ".join([*fine, long_page]), [*fine, long_page], None)]
    df = spark.createDataFrame(data, "chunk_id long, source_id string, text string, sentences array<string>, url string")
    assert {r[0] for r in residue.residue_records(df).collect()} == set(range(len(found))) | {50}


def test_signs_are_implied_by_their_detectors(spark):
    rng = random.Random(13)
    alphabet = list("{}<>$#@~_[]%|!*- aAbN_1sd.") + ["{{", "}}", "<%", "%>", "%s", "*|", "|*", "TODO_A", "<!--", "-->", "here", "goes here", "click to edit", "lorem ipsum", "TBD", "Heading 1", "\n", "ここに"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slot, prompt = F.col("t").rlike(residue._any(residue.SLOTS, "")), F.col("t").rlike(residue._any(residue.PROMPTS, "(?im)"))
    word = F.exists(F.array(*map(F.lit, residue._PROMPT_WORDS)), lambda w: F.contains(F.lower("t"), w))
    assert df.where(slot).count() > 100 and df.where(prompt).count() > 100
    assert df.where((slot & ~F.col("t").rlike(residue._SLOT_SIGN)) | (prompt & ~word)).count() == 0


def test_every_filler_reaches_its_detector(spark):
    rng = random.Random(11)
    fill = ["test 123 test 123", "xxx xx xxx", "bbbb cccc dddd", "bar baz qux", "Dicunt, legam; sunt, veniam - ponunt.", "Bellum regunt, Marcus, quaerunt, villam"]
    latin = ["dicunt", "legam", "rosae", "caput", "sint", "illis"]
    for _ in range(300):
        n, known = rng.randrange(3, 25), rng.choice([residue.FILLER, latin])
        body = [rng.choice(["quay", "ridge"]) if rng.random() < 0.15 else rng.choice(known) for _ in range(n)]
        fill.append("".join(w + rng.choice([" ", ", ", " - "]) for w in body).strip())
    df = spark.createDataFrame([(i, "s", t, [t], None) for i, t in enumerate(fill)], "chunk_id long, source_id string, text string, sentences array<string>, url string")
    taken = {i for i, t in enumerate(fill) if residue.is_filler(t, residue._TOKEN.findall(t), residue._Kinds())}
    got = {r[0] for r in residue.residue_records(df).collect()}
    assert set(range(6)) <= taken <= got and len(taken) > 100
    # words tell of which lines nothing has to be looked at
    kinds, scorer = residue._Kinds(), residue.Scorer(*(m.table() for m in residue.fit_on([], [])))
    fill += residue.MESSAGES + residue.PAGE_LINES + ["", " ", "ไทย 5", "a.b/c d"]
    may = [*residue.doubtful(fill, residue._Marks(kinds, scorer))]
    tokens = [residue._TOKEN.findall(t) for t in fill]
    assert all(f for (f, _), t, x in zip(may, fill, tokens, strict=True) if residue.is_filler(t, x, kinds)) and not all(f for f, _ in may)
    assert [r for _, r in may] == [scorer.screen(x) > 0 for x in tokens] and [*residue.doubtful([], residue._Marks(kinds, scorer))] == []


# --- problem 4 ---------------------------------------------------------------


def make_page(rng):
    body = [f"The {rng.choice(WORDS)} at {rng.choice(['Ada', 'Bo'])} {rng.choice(['opened', 'flooded', 'passed'])} the old {rng.choice(WORDS)} in {rng.randrange(1900, 2000)}." for _ in range(rng.randrange(5, 9))]
    page = [rng.choice(["Home | About | Login", "We use cookies to measure visits."]), "Share this page with a friend", "Back to top", f"© {rng.randrange(1990, 2020)} Ada Press. All rights reserved."]
    top, bottom = rng.sample(page, rng.randrange(2)), rng.sample(page, rng.randrange(1, 3))
    return top + body + bottom, [1] * len(top) + [0] * len(body) + [1] * len(bottom)


def test_page_lines_held_out():
    rng = random.Random(3)
    scorer = boilerplate.Scorer(boilerplate.fit_on([make_page(rng)[0] for _ in range(600)]).table())
    good = total = 0
    for _ in range(200):
        page, truth = make_page(rng)
        found = set(boilerplate.page_lines([scorer(x) for x in page]))
        good += sum((i in found) == bool(t) for i, t in enumerate(truth))
        total += len(page)
    assert good / total > 0.97


def test_places_are_counted_over_all_pages(spark):
    rng = random.Random(14)
    extra = ["", "  ", "Ada Bo, 1.5", "l'Ada 12:30 x", "古い窯 12 を測定", "ไทย  A 5", "x " * 150, "By Ada", "By Bo"]
    pages = [make_page(rng)[0] + rng.sample(extra, rng.randrange(4)) for _ in range(200)] + [["one"], ["Ada", "Bo", "x"]]
    wanted = {k for p in pages[:20] for x in p for k in (boilerplate.whole_form(x), *boilerplate.line_ends(x))}
    want = defaultdict(Counter)
    for p in pages:
        for x, where in zip(p, boilerplate.places_in_chunk(p), strict=True):
            for k in ((boilerplate.whole_form(x),) if len(x) <= 220 else ()) + boilerplate.line_ends(x):
                if k in wanted:
                    want[k][where] += 1
    assert boilerplate.count_places(pages, wanted, boilerplate.places_in_chunk) == want
    # a sample of the table is labelled by the counts of the whole table
    df = spark.createDataFrame(list(enumerate(pages)), "chunk_id long, sentences array<string>")
    seen = []
    keep = boilerplate.label_lines
    try:
        boilerplate.label_lines = lambda *a: seen.append(a[3]) or keep(*a)
        boilerplate.train(df, 20)
    finally:
        boilerplate.label_lines = keep
    assert len(seen) == 2 and sum(seen[0]["=A to top"].values()) == sum(p.count("Back to top") for p in pages) > 20


def test_scorer_equals_features_and_region():
    model = boilerplate.fit_on([make_page(random.Random(i))[0] for i in range(50)])
    scorer = boilerplate.Scorer(model.table())
    for line in ("The Mill at Ada opened.", "SHARE THIS", "古い窯を測定した。", "", "a b c 12.5"):
        assert scorer(line) == pytest.approx(model.score(boilerplate.features(line)), abs=1e-6)
    rng = random.Random(4)
    for _ in range(100):
        s = [rng.uniform(-3, 3) for _ in range(rng.randrange(1, 9))]
        a, b = boilerplate.best_region(s)
        best = max([0.0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert sum(s[a:b]) == pytest.approx(best)


def test_lines_are_scored_together(spark):
    rng = random.Random(15)
    scorer = boilerplate.Scorer(boilerplate.fit_on([make_page(rng)[0] for _ in range(50)]).table())
    bits = ["Ada", "the", "MILL", "l'Ada", "12:30", "ΟΔΟΣ", "İl", "²", "_", "|", "ไทยแลนด์ 5", "古い窯", "é" * 40, "«Ça»", "  ", "\x1cA", "[CODE]", "-", "end.", "A"]
    lines = ["", "_ _", *bits] + [" ".join(rng.choices(bits, k=rng.randrange(1, 7))) for _ in range(3000)]
    for some in (lines, ["_ _"], [""], ["é" * 40], []):
        got = scorer.scores(some)
        assert got.keys() == {*some} and all(got[x] == pytest.approx(scorer(x), abs=1e-9) for x in some)
    # the two steps over all chunks don't go line by line
    asked = []
    keep, block = boilerplate.Scorer.__call__, boilerplate._BLOCK
    part = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([["Back to top", "The mill opened."], [None]])], ["chunk_id", "sentences"])
    try:
        boilerplate.Scorer.__call__, boilerplate._BLOCK = lambda self, x: asked.append(x) or keep(self, x), 2
        (found,) = boilerplate._page_rows(np.array(scorer.weights))([part])
        [*boilerplate._count_rows({"^back to"}, scorer.weights)([part.select(["sentences"])])]
    finally:
        boilerplate.Scorer.__call__, boilerplate._BLOCK = keep, block
    assert found.column(0).to_pylist()[0] == 7 and asked == []


def test_arrays_and_samples_of_rows(spark):
    column = pa.array([["a", None], None, [], ["b"], ["ไ", ""]])
    assert [maxent.list_rows(c) for c in (column, column.slice(1, 3), column.slice(3), column[:0])] == [c.to_pylist() for c in (column, column.slice(1, 3), column.slice(3), column[:0])]
    df = spark.range(5000).withColumn("odd", F.expr("id % 2 = 1"))
    want = maxent.bounded_sample(df.where("odd"), "id", 50)
    assert maxent.bounded_sample(df, "id", 50, "odd") == maxent.bounded_sample(df, "id", 50, "odd", 2500) == want and len(want) == 50


def test_page_elements_rows(spark):
    rng = random.Random(6)
    data = [(i, "s", " ".join(p), p, None) for i, p in enumerate(make_page(rng)[0] for _ in range(300))]
    data += [(0, "s", data[0][2], data[0][3], None), (900, "s", None, None, None), (901, "s", "", [], None), (902, "s", None, [None, "Back to top"], None)]
    df = spark.createDataFrame(data, "chunk_id long, source_id string, text string, sentences array<string>, url string")
    got = rows(boilerplate.page_elements(df))
    assert len(got) == len(set(got)) > 250
    assert rows(boilerplate.page_elements(df.limit(0))) == []


# --- problem 5 ---------------------------------------------------------------


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(7)
    data = []
    for i in range(300):
        src = "hot" if i % 3 else f"s{i % 7}"
        page = [f"unique {i} {words(rng, 3)}"]
        if rng.random() < 0.3:
            page.append(rng.choice(["Share  this page", "SHARE this page ", "share this page"]))
        if rng.random() < 0.06:
            page.append(f"Viewed {rng.randrange(9999)} times")
        data.append((i, src, page + [None] * (i % 2)))
    data += data[:20] + [(None, "hot", ["Share this page"]), (999, None, ["Share this page"]), (998, "hot", None), (997, "hot", [])]
    df = spark.createDataFrame(data, "chunk_id long, source_id string, sentences array<string>").withColumn("text", F.array_join("sentences", " ")).withColumn("bits", F.lit(1))
    import re

    once = {i: (s, p) for i, s, p in data if i is not None and s is not None}
    total, where = Counter(s for s, _ in once.values()), defaultdict(set)
    key = lambda x: re.sub("[0-9]+", "0", re.sub("[ \t ]+", " ", x.lower())).strip(" ")
    for i, (s, p) in once.items():
        for x in p or []:
            if x is not None:
                where[s, key(x)].add(i)
    want = sorted(
        (i, n) for i, (s, p) in once.items() for n, x in enumerate(p or [])
        if x is not None and len(where[s, key(x)]) >= 8 and len(where[s, key(x)]) * 100 >= 5 * total[s]
    )
    assert rows(lines.repeated_line_elements(df)) == want and want
    clean = {r.chunk_id: r.sentences for r in lines.remove_repeated_lines(df).collect()}
    assert all("share" not in " ".join(x or "" for x in (v or [])).lower() for k, v in clean.items() if once.get(k, ("",))[0] == "hot")
    assert rows(lines.repeated_line_elements(df.limit(0))) == []


# --- problem 6 ---------------------------------------------------------------


def test_ids_equal_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["", None, "Hello  world, don't <|endoftext|> stop", "日本語の窯" * 700, "x" * 5000, " \n\t ", "é\U0001f600\x00​"]
    texts += ["".join(rng.choice("ab é中กञ'12 \n.!") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows(bpe.token_ids(df)))
    assert all(got[i] == (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in enumerate(texts))
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert all(counts[i] == len(got[i]) for i in got)
    assert bpe.token_ids(df.limit(0)).count() == 0


def test_long_piece_alone_equals_side_by_side():
    b = bpe.ByteBpe()
    raw = ("unbelievably" * 30).encode()
    assert b._merge_one(raw).tolist() == b._merge_many([raw], 512)[0].tolist()


# --- problem 7 ---------------------------------------------------------------


def cut_mean(lam, cap):
    """Mean of min(Poisson(lam), cap)."""
    term, below, mean = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        mean, below, term = mean + k * term, below + term, term * lam / (k + 1)
    return mean + cap * (1 - below)


def test_poisson_parameter():
    even = np.ones(4096)
    for cap in (1, 2, 5):
        for rate in (0.2, 0.9, cap * 0.95):
            lam = mixing.poisson_parameter(rate * 4096, cap, even)
            assert cut_mean(lam, cap) == pytest.approx(rate, abs=2e-3)
    for rate, cap in ((520, 600), (800, 1000), (5000, 6000)):
        lam = mixing.poisson_parameter(rate * 4096, cap, even)
        u = (np.arange(4096) + 0.5) / 4096
        assert lam == pytest.approx(rate, rel=0.01) and mixing.copies_at(u, lam, cap).mean() == pytest.approx(rate, rel=1e-3)
    assert mixing.poisson_parameter(3 * 4096, 3, even) == math.inf and mixing.poisson_parameter(0, 3, even) == 0
    assert mixing.poisson_parameter(5, 3, np.zeros(4096)) == 0


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(9)
    docs = [(i, words(rng, 30), rng.choice(["A ", "a", "b", "b", "b", "c", "other", None])) for i in range(3000)]
    docs += [(5000, None, "a"), (5001, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.15, 4), ("gone", 0.05, 3)], "source string, target_weight double, max_repeats int")
    got = {r.source: r for r in mixing.mixture_shares(df, targets).collect()}
    assert set(got) == {"a", "b", "c", "gone"} and got["gone"].rows_out == 0
    for s in "abc":
        assert got[s].actual_share == pytest.approx(got[s].target_weight / 0.95, abs=0.004) and got[s].max_used <= got[s].max_repeats
    mixed = mixing.mix_documents(df, targets)
    counts = Counter((r.doc_id, r.source) for r in mixed.collect())
    assert sum(n for (_, s), n in counts.items() if s == "a") == got["a"].rows_out
    assert max(n for (_, s), n in counts.items() if s == "b") <= 2
    assert mixing.mix_documents(df.limit(0), targets).count() == 0


# --- problem 8 ---------------------------------------------------------------


def brute_spans(texts, length):
    seen = defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]].add(i)
    out = []
    for i, t in texts.items():
        shared = [False] * len(t)
        for p in range(len(t) - length + 1):
            if len(seen[t[p : p + length]]) > 1:
                shared[p : p + length] = [True] * length
        p = 0
        while p < len(t):
            if shared[p]:
                q = p
                while q < len(t) and shared[q]:
                    q += 1
                out.append((i, p, q))
                p = q
            else:
                p += 1
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 8])
def test_shared_spans_equal_brute_force(spark, limit):
    rng = random.Random(10)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))
    passage, other = fresh(150), fresh(70)
    texts = {i: fresh(rng.randrange(40, 200)) + (passage[rng.randrange(60) : rng.randrange(90, 150)] if i % 2 else other) + fresh(50) for i in range(30)}
    texts |= {40: "ab" * 100, 41: "x" + "ab" * 80, 42: texts[1], 43: texts[1], 44: "short", 45: passage + passage}
    data = list(texts.items()) + [(50, None), (51, ""), (None, passage), (45, texts[45])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("start_pos", F.lit(0))
    got = rows(spans.shared_spans(df, min_length=60, gram=15, pair_limit=limit))
    assert got == brute_spans(texts, 60) and got
    report = {r.doc_id: r for r in spans.shared_report(df.where("doc_id IS NOT NULL"), 200).collect()}
    assert report[50].shared_part == 0 and len(report) == len(texts) + 2
    assert rows(spans.shared_spans(df.limit(0))) == []
