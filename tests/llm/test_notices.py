import random
import re

from memloom.llm import notices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def made(rng, n):
    return ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(2 + rng.randrange(7))) for _ in range(n)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base_places(text):
    tokens = WORD.findall(lower(text))
    out = []
    for phrase, label in notices.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(tokens) - len(p) + 1) if tokens[i : i + len(p)] == p]
    return len(tokens), sorted(out)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def stands(notice, form):
    """Whether the notice stands in the form with its runs' edits, by trying every split."""
    ends = {i + 1 for i, c in enumerate(form) if c == " "}
    for i, (part, k) in enumerate(notice.parts):
        after = set()
        for a in ends:
            for n in range(max(0, len(part) - k), len(part) + k + 1):
                b = a + n
                if form[b : b + 1] == " " and (form[a:b] == part if not k else edits(part, form[a:b]) <= k):
                    after.add(b + 1)
        ends = after
    return bool(ends)


def test_finder_agrees_with_trying_every_place():
    rng = random.Random(5)
    known = notices.notices()
    finder = notices.Finder(known)
    found_some = 0
    for _ in range(60):
        notice = rng.choice(known)
        text = list(notice.text)
        for _ in range(rng.randrange(0, notice.edits + 2)):
            i = rng.randrange(len(text))
            kind = rng.randrange(3)
            text[i : i + (kind != 1)] = "" if kind == 0 else rng.choice("abcxyz ")
        form = " " + " ".join(" ".join([*made(rng, rng.randrange(4)), "".join(text), *made(rng, rng.randrange(4))]).split()) + " "
        got = {n for n, *_ in finder.find(form)}
        want = {i for i, n in enumerate(known) if stands(n, form)}
        assert got == want, form
        found_some += bool(want)
    assert found_some > 30


def test_report(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(made(rng, n))
    texts = [
        "Released under the MIT License.", "under the mit-license UNDER THE MIT LICENSE under the mit license", "under the mit licence", "funder the mit license", "Released undr the MIT licence",
        fill(20_000) + " Apache License,\nVersion 2.0 " + fill(5), "CC BY-NC 4", "cc by nc by nc cc by nc", "cc by nd", "licensed under the apache licence version 2", "apache license version 1", "ünder the mit license é", "GNU Genral Public Licence, version 3", "", None, " .,; ", "MIT",
        "Permission is hereby granted, free of charge, too any persn obtaining a copy of this sofware", "under the mit license " * 300,
    ]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[0], 2, "y"), (0, texts[0], 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, notices int, _text string").repartition(3)
    got = notices.license_report(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        text = texts[r.doc_id or 0]
        n, places = base_places(text)
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places) and (r.score == 0) == (r.labels == "")
        by[r.doc_id] = r
    labels = {i: r.labels for i, r in by.items()}
    assert labels[2] == labels[3] == labels[4] == labels[17] == "mit" and labels[12] == "gpl-3" and "apache-2" in labels[9] and labels[11] == "mit"
    assert labels[8] == labels[10] == labels[13] == labels[14] == labels[16] == ""
    assert 0.7 < by[4].score < 1 and by[18].n_base == 300


def test_spans_are_those_of_the_text_and_columns_stay(spark, none):
    text = "Ärger! Released  under\tthe MIT—Lizense (é)"
    df = spark.createDataFrame([(1, text, "keep")], "doc_id long, text string, notices_words2 string")
    r = notices.find_notices(df, df.columns).first()
    assert r["notices_words2"] == "keep" and r["notices"] == []
    df = spark.createDataFrame([(1, text.replace("—Lizense", "-Licenze"))], "doc_id long, text string")
    (found,) = notices.find_notices(df, df.columns).first()["notices"]
    plain = text.replace("—Lizense", "-Licenze")
    assert plain[found.start : found.end] == "under\tthe MIT-Licenze" and found.edits == 1 and not found.exact
    assert notices.license_report(none).count() == 0
