import re

import numpy as np

from strandline.llm.licenses import _WORD, TEMPLATES, LicenseScanner, op10_license_scan, scan_licenses


def test_wording():
    scan = LicenseScanner(TEMPLATES).scan
    one = lambda x: [(f.license, x[f.start : f.stop], f.missing, f.extra) for f in scan(x)]
    assert one("x licensed under\nthe Apache   License,\nVersion 2.0. y") == [("Apache-2.0", "licensed under\nthe Apache   License,\nVersion 2.0", (), ())]
    assert one("This work is licensed under GNU General Public License, version 3.") == [("GPL-3.0", "This work is licensed under GNU General Public License, version 3", ("the",), ())]
    assert [f[0] for f in one("Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0")] == ["CC-BY-SA-4.0", "CC-BY-4.0"]
    for none in ("Licensed under CC BY 3.0.", "driver license renewal", "license " * 300, "version 2.0 of the Apache pump"):
        assert one(none) == []
    long = "word " * 30_000 + "İ Released under the MIT License. " + "q " * 30_000
    assert one(long) == [("MIT", "Released under the MIT License", (), ())]


def test_query_finds_each_known_line(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    short = {n: t.rstrip(".") for n, t in TEMPLATES.items() if n in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")}
    rows = op10_license_scan(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = sorted((m.start(), m.end(), n) for n, t in short.items() for m in re.finditer(re.escape(t), texts[r.doc_id]))
        assert r.licenses == ",".join(f"{n}:{a}:{b}:0" for a, b, n in want) and r.n_licenses == len(want)
    assert any(r.n_licenses for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "Released under the MIT License.", 0), (3, "x", 0), (3, "x", 0)], "doc_id long, text string, licenses int")
    assert sorted((str(r.doc_id), len(r.licenses)) for r in scan_licenses(df).collect()) == [("1", 0), ("2", 0), ("3", 0), ("3", 0), ("None", 1)]
    assert scan_licenses(df.limit(0)).count() == 0


def test_every_template_of_a_line():
    scan = LicenseScanner(TEMPLATES).scan
    line = "This work is licensed under the GNU General Public License, version 3. Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert [f.license for f in scan(line)] == ["GPL-3.0", "Apache-2.0", "MIT"]
    assert [f.license for f in scan(line + " Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.")] == ["GPL-3.0", "Apache-2.0", "MIT", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-4.0"]
    # whole texts hold the notices that begin them
    every = "\n\n".join(TEMPLATES.values())
    assert [f.license for f in scan(every)] == list(TEMPLATES)
    assert all(not f.missing and not f.extra for f in scan(every))


def test_every_place_of_a_line():
    scan = LicenseScanner(TEMPLATES).scan
    for name, notice in TEMPLATES.items():
        text = f"{notice} Some words stand between. {notice} {notice} End."
        assert [(f.license, f.start, f.missing, f.extra) for f in scan(text)] == [(name, m.start(), (), ()) for m in re.finditer(re.escape(notice), text)]
    # one with a word missing, after a longer run of words that is no notice
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this map. Permission is hereby granted, free of charge, to any obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    assert [(f.license, text[f.start :][:10], f.start > 80, f.missing) for f in scan(text)] == [("MIT-text", "Permission", True, ("person",))]


def exact_places(text, templates):
    """Every place where a template's words stand one after another, however far apart on the page."""
    own = [w.lower() for w in _WORD.findall(text)]
    wants = {n: [w.lower() for w in _WORD.findall(t)] for n, t in templates.items()}
    return {(n, b, b + len(w)) for n, w in wants.items() for b in range(len(own) - len(w) + 1) if own[b : b + len(w)] == w}


def test_every_exact_place_is_covered():
    scanner, random = LicenseScanner(TEMPLATES), np.random.default_rng(3)
    texts, planted = list(TEMPLATES.values()), 0
    for _ in range(60):
        parts = [texts[i] for i in random.integers(len(texts), size=random.integers(1, 6))]
        text = " some words stand here ".join(["", *parts, ""]).replace(" ", "  \n" if random.random() < 0.5 else " ")
        spans = [m.span() for m in _WORD.finditer(text)]
        found = [(f.license, f.start, f.stop) for f in scanner.scan(text)]
        want = exact_places(text, TEMPLATES)
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))
        # each exact place is reported, or lies under a longer one that is
        for name, first, last in want:
            low, high = spans[first][0], spans[last - 1][1]
            assert (name, low, high) in found or any(a <= high and low <= b and b - a >= high - low for _, a, b in found), name
        assert {(n, a, b) for n, a, b in found} <= {(n, spans[i][0], spans[j - 1][1]) for n, i, j in want}
        planted += len(want)
    assert planted > 150


def test_planted_differences_are_found_and_named():
    scanner, random = LicenseScanner(TEMPLATES), np.random.default_rng(4)
    for name in ("MIT-full", "Zlib-full", "GPL-3.0-or-later", "Apache-2.0-full", "BSD-3-Clause-full"):
        words = TEMPLATES[name].split()
        for _ in range(5):
            # a word lost and one put in, far apart and not such as must stay
            soft = [i for i, w in enumerate(words) if re.fullmatch("[a-z]{4,}", w) and not re.match("attribution|lesser|library|only", w)]
            gone = int(random.choice(soft))
            own = [w for i, w in enumerate(words) if i != gone]
            far = len(own) // 2 if abs(gone - len(own) // 2) > 20 else len(own) // 2 + 30
            own.insert(far, "zebra")
            found = [f for f in scanner.scan("before " + " ".join(own) + " after") if f.license == name]
            assert len(found) == 1 and len(found[0].missing) == 1 and found[0].extra == ("zebra",), (name, words[gone])


def test_size_reductions_select_and_rank(monkeypatch):
    text = "x " + TEMPLATES["MIT-full"] + " y " + TEMPLATES["GPL-3.0"]
    plain = LicenseScanner(TEMPLATES)
    assert [f.license for f in plain.scan(text)] == ["MIT-full", "GPL-3.0"]
    assert all(plain.gains(" ".join(words))[t] > 0 for t, words in enumerate(plain.words))
    none = LicenseScanner(TEMPLATES)
    monkeypatch.setattr(none, "gains", lambda block: [0] * len(TEMPLATES))
    assert none.scan(text) == []
    # with the long text's gain gone its parts are found instead; with ranks turned round a part goes before the whole
    lost = LicenseScanner(TEMPLATES)
    monkeypatch.setattr(lost, "gains", lambda block: [0 if n == "MIT-full" else g for n, g in zip(lost.names, plain.gains(block))])
    assert [f.license for f in lost.scan(text)] == ["MIT-text", "MIT-warranty", "GPL-3.0"]
    turned = LicenseScanner(TEMPLATES)
    monkeypatch.setattr(turned, "gains", lambda block: [10_000 - g for g in plain.gains(block)])
    assert [f.license for f in turned.scan(text)] == ["MIT-text", "MIT-warranty", "GPL-3.0"]


def test_short_notices_and_spellings():
    scan = LicenseScanner(TEMPLATES).scan
    name = lambda x: [f.license for f in scan(x)]
    assert name("Licensed under the MIT license") == ["MIT-licensed"] and name("// SPDX-License-Identifier: MIT") == ["MIT-spdx"]
    assert name("Released under the MIT Licence") == ["MIT"] and name("the terms of the GNU GPL v3, see") == ["GPL-3.0-terms"]
    assert name("SPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: Apache-2.0") == ["GPL-2.0-or-later-spdx", "Apache-2.0-spdx"]
    assert name("# Licenced under the Apache Licence 2.0") == ["Apache-2.0-short"]
    assert name("SPDX-License-Identifier: Other") == [] and name("the MIT campus, licensed") == []


def test_no_trigger_words_and_close_relatives():
    scan = LicenseScanner(TEMPLATES).scan
    name = lambda x: [f.license for f in scan(x)]
    assert name("x THE SOFTWARE IS PROVIDED \"AS IS\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.") == ["MIT-warranty"]
    assert name("# " + TEMPLATES["MIT-full"].replace(" ", "\n# ").replace("sublicense", "sub-let")) == ["MIT-full"]
    assert name(TEMPLATES["BSD-2-Clause-full"]) == ["BSD-2-Clause-full"] and name(TEMPLATES["BSD-3-Clause-full"]) == ["BSD-3-Clause-full"]
    assert name(TEMPLATES["LGPL-2.1-or-later"].replace("2.1", "9")) == []
    assert name("This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 International License.") == []
    many = scan("Released under the MIT License. " * 4000)
    assert len(many) == 4000
