import math
import os
import random
import re

import duckdb
import pytest

from lodestack.llm import licenses as m

SCHEMA = "path string, text string, license string, score int, tid string, term string"


def brute(rows):
    w = m.Weights()
    headers = {}
    for path, text, *_ in rows:
        text = text or ""
        units, named = text.split("\n"), bool(path and re.search(m.FILE_NAMES, path))
        if named:
            units = [text, *units, *(f"{a} {b}" for a, b in zip(units, units[1:], strict=False))]
        best, covered = None, {}
        parts = [(n, part) for n, line in enumerate(units) for part in [line, *(x for x in re.split(m.STOP, line) if x != line)]]
        for n, line in parts:
            tf = m.terms(line)
            x = {t: c * w.idf.get(t, w.unknown) for t, c in tf.items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            told = [set(m.NEEDS.get(name, "").split()) <= set(tf) and not set(m.LACKS.get(name, "").split()) & set(tf) for name in w.names]
            told = [t and len(set(tf) & set(u)) >= m.SHARED for t, u in zip(told, w.unit, strict=True)]
            got = max(((round(sum(v * u.get(t, 0) for t, v in x.items()) / norm, 9) * told[k], -k) for k, u in enumerate(w.unit)), default=(0, 0)) if norm else (0, 0)
            if got[0] >= m.THRESHOLD:
                covered[n] = max(covered.get(n, 0), len(line.encode()))
                name = w.names[-got[1]]
                best = max(best or (False, 0, 0, 0), (name not in (m.GENERIC, m.RESERVED), *got, -n))
        if best:
            headers[path, text] = (best[1], w.names[-best[2]], sum(covered.values()) >= m.FILE_SHARE * len(text.encode()) or named)
    at = {}
    for (path, _), (score, name, speaks) in headers.items():
        if speaks and path is not None:
            key = (-score, path, name)
            folder = path.rpartition("/")[0]
            at[folder] = min(at.get(folder, key), key)
    out = []
    for path, text, *_ in rows:
        if found := headers.get((path, text or "")):
            out.append((path, found[1], round(found[0], 6), "header", path))
            continue
        folder, got = path and path.rpartition("/")[0], None
        while path is not None:
            if folder in at:
                got = at[folder]
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        out.append((path, got[2], round(-got[0], 6), "directory", got[1]) if got else (path, None, None, "none", None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(11)
    filler = "the of under a license version public and work stone river by cc all rights 4 0 general terms".split()
    rows = []
    for i in range(250):
        folder = "/".join(rng.choices("abc", k=rng.randrange(4)))
        lines = [" ".join(rng.choices(filler, k=rng.randrange(1, 14))) for _ in range(rng.randrange(4))]
        if i % 4 == 0:
            name, text = rng.choice(m.TEMPLATES)
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "# ", "Copyright 2024 Someone. "]) + rng.choice([text, text.upper(), text + " see below"]))
        rows.append((f"{folder}/f{i}.txt".lstrip("/"), "\n".join(lines)))
    rows += [("a/b/LICENSE", m.TEMPLATES[1][1].replace(" ", "\n")), ("COPYING.txt", "nothing of note"), ("top.txt", None), ("a/b/c/empty.txt", ""), (None, "All rights reserved."), (None, "words"), ("a/x.txt", "All rights reserved.\n" * 3000), rows[4], rows[4]]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(4)
    got = sorted(((r.path, r.license, None if r.score is None else round(r.score, 6), r.origin, r.license_path) for r in m.scan(df).collect()), key=str)
    assert got == brute(rows)
    assert {r[3] for r in got} == {"header", "directory", "none"}


def test_lines_without_triggers_cannot_match():
    w = m.Weights()
    for unit in w.unit:
        rest = [v for t, v in unit.items() if t not in w.triggers]
        assert math.sqrt(sum(v * v for v in rest)) < m.THRESHOLD
    assert "the" not in w.triggers


@pytest.mark.parametrize("name, text", m.TEMPLATES)
def test_templates_match_themselves(spark, name, text):
    w = m.Weights()
    x = {t: c * w.idf[t] for t, c in m.terms(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    assert w.names[max(range(len(w.unit)), key=lambda k: sum(v / norm * w.unit[k].get(t, 0) for t, v in x.items()))] == name


def test_empty_table(spark):
    assert m.scan(spark.createDataFrame([], SCHEMA)).collect() == []


MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
COMMON = "/usr/share/common-licenses"
WHOLE = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize(
    "line, licence",
    [
        ("GNU General Public License, version 2", "GPL-2.0"),
        ("GNU General Public License, version 3", "GPL-3.0"),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
        ("Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("Not all rights are reserved", None),
        ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("Released under the MIT License.", "MIT"),
        ("Copyright (c) 2024 Foo Inc. All rights reserved.", "Proprietary"),
        ("Copyright 2024 Foo. All rights reserved. Released under the MIT License.", "MIT"),
        ("These notes on rivers and stones were collected over ten years of walking; Licensed under CC BY-NC 4.0. Write to us with corrections of any kind.", "CC-BY-NC-4.0"),
        ("all rights", None),
        ("Sie kam. Mit. Dann ging sie.", None),
        ("License: MIT", "MIT"),
        ("CC BY 4.0", "CC-BY-4.0"),
        ("They know their rights. Then they left.", None),
    ],
)
def test_near_wordings(spark, line, licence):
    got = m.scan(spark.createDataFrame([("a.c", f"int x;\n{line}\nint y;")], "path string, text string")).first()
    assert got.license == licence


def test_whole_licence_texts_speak_for_their_directories(spark):
    texts = {"mit": (MIT, "MIT"), "closed": ("Copyright 2024\nAll rights reserved.\n", "Proprietary")}
    for name, licence in WHOLE.items():
        if os.path.exists(f"{COMMON}/{name}"):
            with open(f"{COMMON}/{name}", encoding="utf-8") as f:
                texts[name] = (f.read(), licence)
    rows = [r for at, (text, _) in texts.items() for r in ((f"{at}/LICENSE", text), (f"{at}/src/a.c", "int x;"))]
    got = {r.path: (r.license, r.origin) for r in m.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    want = {f"{at}/{file}": (licence, origin) for at, (_, licence) in texts.items() for file, origin in (("LICENSE", "header"), ("src/a.c", "directory"))}
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the generated tables")
@pytest.mark.parametrize("extra", [False, True])
def test_query_equals_its_sql(spark, tmp_path, extra):
    """On the generated table, and on one with notices inside lines, tags, licences in single files, null and equal rows."""
    sf = "/root/testdata/sf0.01"
    if extra:
        rng = random.Random(4)
        notices = [t for _, t in m.TEMPLATES] + ["SPDX-License-Identifier: ISC and more", "# SPDX-License-Identifier: MIT"]
        rows = [(7, None, "a"), (8, "", "b"), (None, "All rights reserved.", None), (12, "GNU General Public License, version 3", "a")]
        for i in range(400):
            lines = [" ".join(rng.choices("River stone of the walking license version 2 3 rights".split(), k=9)) + "." for _ in range(rng.randrange(3))]
            if i % 5 == 0:
                lines.insert(0, rng.choice(["", "One line. ", "One line "]) + rng.choice(notices) + rng.choice(["", " More words follow; and more"]))
            rows.append((i, "\n".join(lines), rng.choice(["a", "b", "c/d", None])))
        spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet{'/*.parquet' if extra else ''}'")
    found = m.op3_licenses(spark, sf)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({m.OP3_SQL})").fetchall(), key=str)
    assert {r[3] for r in got} >= {"header", "none"} | ({"directory"} if extra else set())
