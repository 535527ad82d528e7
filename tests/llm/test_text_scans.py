import re

from graphloom.llm import licenses, pii, queries

from .cases import frame

KEY = b"test key"


def test_license_lines_of_the_table(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    rows = queries.op1_licenses(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = {v for k, v in known.items() if " ".join(licenses.wording(k)) in " ".join(licenses.wording(texts[r.doc_id]))}
        assert set(filter(None, r.license_ids.split(","))) == want, (r, texts[r.doc_id][-300:])


def test_license_differences():
    s = licenses.Scanner(licenses.TEMPLATES)
    (a,) = s.scan(b"Lorem ipsum dolor.\nLicensed under the Apache License, Version 3.0.\nAmet sit.")
    assert a["license"] == "Apache-2.0" and a["differences"] == ["2.0 -> 3.0"]
    text = "Some prose stands here first.\n\n" + licenses._MIT.upper().replace("SUBLICENSE", "RELICENSE").replace(", ", ",\n") + "\n\nOther prose."
    (a,) = s.scan(text.encode())
    assert a["license"] == "MIT" and a["differences"] == ["sublicense -> relicense"] and text[a["start"] : a["end"]].startswith("PERMISSION")
    assert sorted(x["license"] for x in s.scan(b"Released under the MIT License.\nLicensed under CC BY-NC 4.0.")) == ["CC-BY-NC-4.0", "MIT"]
    assert s.scan(b"He has no permission to drive without a licence, a warrant said.") == []
    assert s.scan(b"") == [] and s.scan(b"license " * 50_000) == []


def test_license_at_the_end_of_a_paragraph():
    s = licenses.Scanner(licenses.TEMPLATES)
    prose = "The committee met in the spring to look at the work of the past year and to say which of its parts should go on. " * 4 + "Any person who was there may use the notes for a purpose of their own without charge, and the copyright holders were told of it. "
    known = {"Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the MIT License.": "MIT", "Released under the BSD 3-Clause License.": "BSD-3-Clause", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    for line, want in known.items():
        for text in (prose + line, line + " " + prose, prose + line + " " + prose):
            assert [(x["license"], x["differences"]) for x in s.scan(text.encode())] == [(want, [])], (line, s.scan(text.encode()))
    assert s.scan(prose.encode()) == []
    (a,) = s.scan((prose + licenses._APACHE.replace("compliance", "accordance") + " " + prose).encode())
    assert a["license"] == "Apache-2.0" and a["differences"] == ["compliance -> accordance"]


def test_license_whole_wordings():
    s = licenses.Scanner(licenses.TEMPLATES)
    names = lambda text: [(x["license"], x["differences"]) for x in s.scan(text.encode())]
    for name, text in licenses.TEMPLATES:
        assert names(text) == [(name, [])], text
    parts = licenses._BSD_CLAUSES, licenses._BSD_THIRD, licenses._BSD_DISCLAIMER
    assert names("\n\n".join(parts[::2])) == [("BSD-2-Clause", [])] and names("\n\n".join(parts)) == [("BSD-3-Clause", [])]
    assert names("\n".join(parts).replace("tort", "wrong")) == [("BSD-3-Clause", ["tort -> wrong"])]
    assert names("\n".join(parts[::2]).replace("tort", "wrong")) == [("BSD-2-Clause", ["tort -> wrong"])]
    for text, want in {"// SPDX-License-Identifier: MIT": {"MIT"}, "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport os": {"MIT", "Apache-2.0"}, "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": {"GPL-2.0"}, "SPDX-License-Identifier: LGPL-2.1+": {"LGPL-2.1"}, "SPDX-License-Identifier: Foo-1.0": set()}.items():
        assert {x for x, _ in names(text)} == want, (text, names(text))


def test_license_odd_rows(spark):
    assert licenses.scan(frame(spark)).where("size(licenses) > 0").count() == 0
    assert licenses.scan(frame(spark)).count() == frame(spark).count() and licenses.scan(frame(spark, [])).count() == 0


PRIVATE = ["und.34@mail7.example.com", "jo@x.org", "97.51.17.173", "10.0.0.7", "+1 (017) 555-7713", "(826) 555-4081", "4111 1111 1111 1111", "9807915762804490", "123-45-6789", "DE89 3704 0044 0532 0130 00", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "sk-abcDEF123456789012", "00:1b:44:11:3a:b7", "Frau Erika Mustermann", "Mr. John Smith", "господин Иван Петров"]


def test_types_formats_and_coreference():
    s = pii.Surrogates(KEY)
    for x in PRIVATE:
        text = f"Vor {x}, nach {x}."
        found = pii.entities(text)
        assert len(found) == 2, x
        made = [s.of(text[i:j], k, g) for i, j, k, g in found]
        assert made[0] == made[1]
        (i, j, kind, _) = found[0]
        old = text[i:j]
        assert old not in made[0] and old != made[0]
        if kind != "NAME" and kind != "IPV4":
            mask = lambda t: re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", t))
            if kind not in ("SECRET", "MAC"):
                assert mask(old) == mask(made[0])
            assert len(old) == len(made[0])
        again = pii.entities(text.replace(x, text[:i][4:] + made[0]) if kind == "NAME" else f"Vor {made[0]}, nach")
        assert [k for _, _, k, _ in again][:1] == [kind], (x, made)
    assert re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", s.of("Иван Петров", "NAME", "m"))
    assert s.of("Erika Mustermann", "NAME", "f").split()[0] in pii._GIVEN["Latin", "f"]
    assert pii._luhn([int(c) for c in s.of("4111111111111111", "CARD")]) and s.of("10.0.0.7", "IPV4").startswith("10.")
    iban = s.of("DE89370400440532013000", "IBAN")
    assert pii._iban_check(iban[:2] + "00" + iban[4:]) == iban[2:4]


def test_forms_of_a_name_share_a_surrogate(spark):
    text = "Mr. John Smith met Ms. Jane Smith. John Smith left. Mr. Smith slept; Dr. John\nSmith's dog and Dr. John Smith too. Smith and JOHN SMITH. Ms. Smith's car, John’s coat, Jane said. A smith. Smithson."
    made = pii.replaced(frame(spark, [(1, text), (2, "Dr. Ada Lind spoke. Mrs. Lind left. Ada Lind slept.")], more=False), KEY, with_entities=True).collect()
    out, other = (r.text for r in made)
    he, she = re.fullmatch(r"Mr\. (\w+ \w+) met Ms\. (\w+ \w+)\..*", out, re.S).groups()
    (a, b), (c, d) = he.split(), she.split()
    assert a in pii._GIVEN["Latin", "m"] and c in pii._GIVEN["Latin", "f"] and b != d
    assert out == f"Mr. {a} {b} met Ms. {c} {d}. {a} {b} left. Mr. {b} slept; Dr. {a}\n{b}'s dog and Dr. {a} {b} too. {b} and {a.upper()} {b.upper()}. Ms. {d}'s car, {a}’s coat, {c} said. A smith. Smithson."
    assert [out[e.start : e.end] for e in made[0].pii_entities][:3] == [he, she, he]
    ada, lind = re.match(r"Dr\. (\w+) (\w+) spoke", other).groups()
    assert other == f"Dr. {ada} {lind} spoke. Mrs. {lind} left. {ada} {lind} slept." and ada in pii._GIVEN["Latin", "f"]


def test_no_surrogate_is_its_entity():
    import unicodedata

    s = pii.Surrogates(KEY)
    script = lambda t: [unicodedata.name(c).split()[0] if c.isalpha() else c for c in t]
    for x in ["李明@例子.公司", "علي@مثال.شركة", "דוד@דוגמה.קום", "łőžšč@łő.pl", "ก@ไทย.ไทย", "a@b.co", *[f"{a}@{b}.org" for a in "abcdefghij" for b in "klmnopqrst"]]:
        ((i, j, kind, _),) = pii.entities(f"({x})")
        assert kind == "EMAIL" and (i, j) == (1, 1 + len(x))
        made = s.of(x, "EMAIL")
        assert all(p != q for p, q in zip(x.split(".")[0].split("@"), made.split(".")[0].split("@"))), (x, made)
        assert script(x) == script(made) and len(pii.entities(f"({made})")) == 1
    assert len({s.shaped(a + b, "t") for a in "李明王" for b in "אבł"}) == 9
    moved = [s.moved(x, 1000, "t") for x in range(1000)]
    assert sorted(moved) == list(range(1000)) and all(x != y for x, y in enumerate(moved))
    assert all(s.permute(s.permute(x, 77, "t"), 77, "t", back=True) == x for x in range(77))


def test_compressed_addresses_and_labelled_secrets():
    s = pii.Surrogates(KEY)
    for kind, values in {"IPV6": ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::ffff:192.0.2.128", "2001:0db8:0000:0000:0000:ff00:0042:8329", "2001:DB8::8:800:200C:417A", "2001:db8::"]}.items():
        for x in values:
            for text in (f"at {x}, then", f"[{x}]", f"{x}."):
                ((i, j, k, _),) = pii.entities(text)
                assert (k, text[i:j]) == (kind, x), (text, pii.entities(text))
            made = s.of(x, kind)
            assert made != x and len(pii.entities(f"at {made}, then")) == 1, made
    assert pii.entities("std::vector a::b x12::find at 12:30:45 or 1::2::3 ::") == []
    for text, x in {"password: p@ssw0rd!23": "p@ssw0rd!23", "Password = correcthorse, he said": "correcthorse", '{"client_secret": "ab-c.d/e", "n": 1}': "ab-c.d/e", "pwd:x7": "x7", "secret: !!??": "!!??", "passwd='öäü$'.": "öäü$"}.items():
        ((i, j, k, _),) = pii.entities(text)
        assert (k, text[i:j]) == ("SECRET", x), text
        made = s.of(x, "SECRET")
        assert made != x and len(made) == len(x)
    assert pii.entities("The secret of a good password is its length.") == []


def test_permutations_are_distinct():
    s = pii.Surrogates(KEY)
    assert sorted(s.permute(x, 1000, "t") for x in range(1000)) == list(range(1000))
    assert len({s.shaped(f"{x:04d}", "t", lambda y: y[0] != "0" or x < 1000) for x in range(1000)}) == 1000
    assert pii.Surrogates(b"other").of("und.34@mail7.example.com", "EMAIL") != s.of("und.34@mail7.example.com", "EMAIL")


def test_names_that_meet_are_drawn_again(spark, monkeypatch):
    monkeypatch.setitem(pii._SYLLABLES, "Latin", ["ba"] * 127 + ["bo"])
    names = [f"{a}{b}" for a in "ABCDEFGHIJ" for b in ("nde", "rto", "lsa")]
    df = frame(spark, [(i, f"Yesterday Mr. {n} met Mr. {names[0]} there.") for i, n in enumerate(names)])
    drawn = pii.redraws(df, KEY)
    s = pii.Surrogates(KEY, drawn)
    # workers have the unpatched syllables: the result is theirs
    monkeypatch.undo()
    s = pii.Surrogates(KEY, pii.redraws(df, KEY))
    assert len({s.of(n, "NAME", "m") for n in names}) == len(names)


def test_rows_and_columns(spark, sf):
    df = frame(spark).selectExpr("*", "cast(length(text) as long) AS n_chars", "1 AS pii_entities")
    out = pii.replaced(df, KEY)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert pii.replaced(frame(spark, []), KEY).count() == 0
    d = sf.replace("sf0.001", "sf0.01")
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    private = re.compile(r"\S+@\S+\.\w+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-fA-F]{40}\b")
    seen = {}
    for r in queries.op3_surrogates(spark, d).collect():
        a, b = private.findall(old[r.doc_id]), private.findall(r.text)
        assert len(a) == len(b) == r.n_entities or not a, (a, b)
        assert not set(a) & set(b)
        if not a and not r.n_entities:
            assert r.text == old[r.doc_id]
        for x, y in zip(a, b):
            x, y = re.sub(r"[^\w@.+() -]+$", "", x), re.sub(r"[^\w@.+() -]+$", "", y)
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen) > 10
