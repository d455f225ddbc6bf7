"""License scans: frequencies of all terms, wrapped headers, and real license files."""

from pathlib import Path

import pytest

from wordloom.llm import licenses

FOLDER = Path("/usr/share/common-licenses")


def files(spark, rows):
    return spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id int, path string, text string")


def test_frequent_words_beside_a_license(spark):
    plain = [(f"d/{k}", f"on the way to number{k} of them") for k in range(1, 400)]
    got = licenses.scan(files(spark, [("a/x", "code of many other words than that\nReleased under the MIT License on the way to them of\nmore of it"), *plain])).filter("license IS NOT NULL").collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(0, "MIT")] and got[0]["score"] > 0.9


def test_a_license_file_of_its_full_text(spark):
    text = "MIT License\n\nCopyright (c) 2021 Some Person\n\n" + "\n\n".join(licenses._MIT) + "\n"
    bsd = "Copyright 2020, Some Person\n\n" + "\n".join([licenses._BSD[0], "1. " + licenses._BSD[1], "2. " + licenses._BSD[2]]) + "\n\n" + licenses._BSD_WARRANTY
    three = bsd.replace("\n\nTHIS", "\n3. " + licenses._BSD_NAMES + "\n\nTHIS")
    rows = [("p/about.txt", text), ("p/src/a.c", "int main;"), ("q/t", bsd), ("q/x/y", "y"), ("r/t", three), ("r/x/y", "y")]
    got = {r["path"]: r for r in licenses.scan(files(spark, rows)).collect()}
    assert [(got[p]["license"], got[p]["license_file"]) for p in ("p/about.txt", "q/t", "r/t")] == [("MIT", True), ("BSD-2-Clause", True), ("BSD-3-Clause", True)]
    assert [got[p]["inherited"] for p in ("p/src/a.c", "q/x/y", "r/x/y")] == ["MIT", "BSD-2-Clause", "BSD-3-Clause"]


def test_wrapped_headers(spark):
    header = [
        "/*", " * Copyright 2020 Some Person", " *", " * This program is free software: you can redistribute it and/or modify",
        " * it under the terms of the GNU General Public License as published by", " * the Free Software Foundation, either version 3 of the License, or",
        " * (at your option) any later version.", " *", " * It is distributed in the hope that it will be useful.", " */",
    ]
    apache = ["# Copyright 2020 Some Person", '# Licensed under the Apache License, Version 2.0 (the "License");', "# you may not use this file except in compliance with the License.", "import os", *(f"print(os.name, value{k})" for k in range(60))]
    got = {r["path"]: r for r in licenses.scan(files(spark, [("a.c", "\n".join([*header, "int main;"] + ["x += 1;"] * 200)), ("b.py", "\n".join(apache)), ("c.c", "int x;")])).collect()}
    assert [(got[p]["license"], got[p]["license_file"]) for p in ("a.c", "b.py", "c.c")] == [("GPL-3.0", False), ("Apache-2.0", False), (None, False)]


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no license texts here")
def test_real_license_files(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    rows = [(f"{n}/LICENSE", (FOLDER / n).read_text(errors="replace")) for n in names] + [(f"{n}/src/a.c", "int x;") for n in names]
    got = {r["path"]: r for r in licenses.scan(files(spark, rows)).collect()}
    assert {n: (got[f"{n}/LICENSE"]["license"], got[f"{n}/LICENSE"]["license_file"], got[f"{n}/src/a.c"]["inherited"]) for n in names} == {n: (x, True, x) for n, x in names.items()}
    # with the texts as templates whole files are known by any name
    known = licenses.scan(files(spark, [(p.replace("LICENSE", "words.txt"), t) for p, t in rows]), licenses.with_texts(str(FOLDER)))
    got = {r["path"]: r for r in known.collect()}
    assert all(got[f"{n}/words.txt"]["license_file"] and got[f"{n}/src/a.c"]["inherited"] for n in names)
