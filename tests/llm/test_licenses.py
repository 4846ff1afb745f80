import random

import pytest

from postlens.llm import licenses as L
from tests.llm.helpers import docs, empty


def brute(text, templates):
    """Templates of which some window holds the wanted share of shingles."""
    w = L.words_of(text)
    sh = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    out = set()
    for n, t in enumerate(templates):
        for k in range(0, max(1, len(sh)), t.step):
            if len(set(sh[k:k + t.window - 4]) & t.shingles) >= L.LEAST * len(t.shingles) - 1e-9:
                out.add(n)
                break
    return out


def texts(n=300, seed=4):
    pick = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["the", "license", "licensed", "under"]
    out = []
    for _ in range(n):
        words = pick.choices(vocab, k=pick.randint(0, 400))
        for _ in range(pick.randint(0, 3)):
            t = pick.choice(L.TEMPLATES)[1].split()
            for _ in range(pick.choice([0, 0, 0, 1, 1, 3])):
                t[pick.randrange(len(t))] = "changed"
            if pick.random() < .2:
                t = t[:max(1, int(len(t) * .85))]
            at = pick.randint(0, len(words))
            words[at:at] = [x.upper() if pick.random() < .1 else x for x in t]
        out.append(pick.choice([" ", "\n", "  "]).join(words))
    return out


def test_against_every_window():
    scanner = L.Scanner()
    for t in texts():
        assert {m[0] for m in scanner.scan(t)} == brute(t, scanner.templates)


def brute_lines(text, templates):
    """Numbers of the lines (after the templates) whose words follow each other anywhere in the text."""
    words = L.words_of(text)
    return {n for n, (_, line) in enumerate(L.LINES, len(templates))
            if any(words[i:i + len(L.words_of(line))] == L.words_of(line) for i in range(len(words)))}


def test_query(spark, sf_small):
    import __spark_entry__ as E
    got = {(r.doc_id, r.template) for r in E.queries()["op9_licenses"](spark, sf_small).collect()}
    templates = L.prepare()
    want = {(r.doc_id, n) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()
            for n in brute(r.text, templates) | brute_lines(r.text, templates)}
    assert got == want


def test_passages_and_spans(spark):
    line = L.TEMPLATES[5][1]
    text = f"É start.\n{line}\nmiddle … words {line.upper()} end"
    rows = L.scan(docs(spark, [(1, text, "", "", 0)])).where("template = 5").orderBy("start_byte").collect()
    assert [r.passage for r in rows] == [line, line.upper()]
    assert all(text.encode()[r.start_byte:r.end_byte].decode() == r.passage and r.containment == 1 for r in rows)


@pytest.mark.parametrize("words", [5, 8, 11, 20, 60, 500])
def test_bands_make_collisions_nearly_certain(words):
    step = max(1, words // 8)
    b = L.bands_for(words, step)
    own, window = words - 4, words + step - 5
    shared = -(-4 * own // 5)
    j = shared / (own + window - shared)
    assert (1 - j ** L.ROWS) ** b <= L.MISS * 1.0001


def test_awkward_rows(spark):
    assert L.scan(docs(spark)).collect() == [] and L.scan(empty(spark)).collect() == []
    line = L.TEMPLATES[0][1]
    rows = L.scan(docs(spark, [(None, line, None, None, 0), (2, line, None, None, 0), (2, line, None, None, 0)])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["2", "2", "None"]
    with pytest.raises(ValueError):
        L.prepare([("X", "too short")])


def test_short_notices_are_found(spark):
    texts = ["All rights reserved.", "x y z. ALL RIGHTS\nRESERVED! all rights reserved", "all rights are reserved", "", None]
    rows = L.scan(docs(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).orderBy("doc_id", "start_byte").collect()
    assert [(r.doc_id, r.passage) for r in rows] == [(0, "All rights reserved."), (1, "ALL RIGHTS\nRESERVED"), (1, "all rights reserved")]
    assert all(r.license == "LicenseRef-All-Rights-Reserved" and r.containment == 1 and r.best for r in rows)


@pytest.mark.parametrize("license", ["GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "ISC", "Unlicense",
                                     "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-3.0"])
def test_the_best_template_tells_the_license(license):
    scanner = L.Scanner()
    for name, text in L.TEMPLATES:
        if name == license:
            found = scanner.scan("some words before it " + text + " and some words after")
            best = {scanner.entry(f[0])[0] for f, b in zip(found, scanner.best(found)) if b}
            assert best == {license}


def test_overlapping_versions_are_reported_and_one_is_best(spark):
    gpl2 = next(t for n, t in L.TEMPLATES if n == "GPL-2.0" and "either version 2" in t)
    rows = L.scan(docs(spark, [(1, gpl2, "", "", 0)])).collect()
    assert {r.license for r in rows} >= {"GPL-2.0", "GPL-3.0"} and {r.license for r in rows if r.best} == {"GPL-2.0"}


def whole_text_share(text, t):
    w = L.words_of(text)
    return len({tuple(w[i:i + 5]) for i in range(len(w) - 4)} & t.shingles) / len(t.shingles)


def test_stretched_copies_against_the_whole_text():
    """A copy with words put in, up to twice the template's length, is found if the text holds enough of its shingles."""
    pick, scanner, checked = random.Random(7), L.Scanner(), 0
    for number, t in enumerate(scanner.templates):
        own = L.TEMPLATES[number][1].split()
        for _ in range(6 if len(own) > 20 else 2):
            words = list(own)
            at = pick.randrange(1, len(words))
            words[at:at] = ["x%d" % i for i in range(pick.randint(1, len(t.words) - 1))]        # one long insertion
            if pick.random() < .5:
                words.insert(pick.randrange(1, len(words)), "y")
                words = words[:1] + words[1:][:2 * len(own) - 1]
            text = " ".join(["before"] * pick.randint(0, 40) + words + ["after"] * pick.randint(0, 40))
            want = whole_text_share(text, t) >= L.LEAST - 1e-9
            assert (number in {m[0] for m in scanner.scan(text)}) == want, text
            checked += want
    assert checked > 40


@pytest.mark.parametrize("mark", ["--", "-- ", "#", "//", " *", "---", "—"])
@pytest.mark.parametrize("license", ["MIT", "GPL-3.0"])
def test_notices_in_comments(mark, license):
    import textwrap
    number, text = max(((n, t) for n, (name, t) in enumerate(L.TEMPLATES) if name == license), key=lambda x: len(x[1]))
    comment = "\n".join(f"{mark} {line}" for line in textwrap.wrap(text, 76))
    assert [m[1] for m in L.Scanner().scan(comment) if m[0] == number] == [1.0]
    assert len(L.word_spans(comment)) == len(L.words_of(comment))


def test_copies_near_each_other_are_passages_of_their_own():
    scanner, line = L.Scanner(), L.TEMPLATES[6][1]
    n = len(L.words_of(line))
    found = [m for m in scanner.scan(" ".join([line, "between", line, line])) if m[0] == 6]
    assert [(m[1], m[2], m[3]) for m in found] == [(1, 0, n), (1, n + 1, 2 * n + 1), (1, 2 * n + 1, 3 * n + 1)]


def test_band_tables_retrieve_templates_and_windows_are_signed_once(monkeypatch):
    """Ten times the templates of a length make no more signatures of a text."""
    signed = []
    sign = L._signature
    monkeypatch.setattr(L, "_signature", lambda h, bands: signed.append(bands) or sign(h, bands))
    line = "this work is licensed under the terms of the license number %d of the house"
    text = "before " * 30 + line % 3 + " after" * 30
    calls = {}
    for n in (4, 40):
        scanner = L.Scanner([(str(i), line % i) for i in range(n)])
        signed.clear()
        assert 3 in {m[0] for m in scanner.scan(text)}
        calls[n] = len(signed)
    assert calls[4] == calls[40]


def test_band_tables_give_the_templates_whose_bands_agree():
    scanner = L.Scanner()
    for table in scanner.tables:
        own = [n for n, t in enumerate(scanner.templates) if (t.step, t.window, t.bands) == (table.step, table.window, table.bands)]
        for n in own:
            window = L.shingle_hashes(scanner.templates[n].words + [b"and", b"more", b"words"])
            mine = L._signature(window, table.bands)
            assert table.retrieve(window) == [m for m in own if (mine == scanner.templates[m].signature).all(axis=1).any()]
