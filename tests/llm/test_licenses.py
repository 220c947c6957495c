"""The licence scan on licences' own wording, and against a brute-force version on word lists."""

import random
import re

from logloom.llm.licenses import KNOWN, MARK, RULES, SENTENCES, SQL, scan

SCHEMA = "doc_id long, text string, ids string, got int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], SCHEMA)


def found(spark, texts):
    return sorted((r.doc_id, r.licenses, r.families, r.n_matches) for r in scan(frame(spark, texts)).collect())


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the holder nor the names of its contributors may be used
   to endorse or promote products derived from this software without specific
   prior written permission.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


def test_licences_own_wording(spark):
    texts = [MIT, APACHE, GPL, BSD, BSD[: BSD.index("3. N")], MPL, "This project is licensed under the MIT License.", "like the mit\n\nlicense"]
    got = found(spark, list(enumerate(texts)))
    assert got == [
        (0, "MIT", "permissive", 1), (1, "Apache-2.0", "permissive", 1), (2, "GPL-2.0-or-later", "copyleft", 1), (3, "BSD-3-Clause", "permissive", 1),
        (4, "BSD-2-Clause", "permissive", 1), (5, "MPL-2.0", "weak copyleft", 1), (6, "MIT", "permissive", 1),
    ]


def test_odd_input(spark):
    long = "word " * 300_000 + "Released under the MIT License. " + "x" * 1_000_000 + "\n" * 1000 + ";" * 1000 + " Licensed under CC BY-NC 4.0."
    got = found(spark, [(1, None), (2, ""), (3, "|;.\n\n"), (4, long), (5, MIT + "\n" + APACHE + MIT), (6, MPL), (6, MPL)])
    assert got == [(4, "CC-BY-NC-4.0,MIT", "non-commercial,permissive", 2), (5, "Apache-2.0,MIT", "permissive", 3), *[(6, "MPL-2.0", "weak copyleft", 1)] * 2]
    assert found(spark, []) == []


def test_every_rule_fires_alone(spark):
    rules = [(n, "\n\n".join(KNOWN[i][0] for i in r[0].split())) for n, r in enumerate(RULES)]
    assert found(spark, rules) == [(n, x, f, 1) for n, (_, x, f) in enumerate(RULES)]
    assert all(any(all(re.search(MARK, s) for s in KNOWN[i]) for i in r[0].split()) for r in RULES)
    assert all(i in KNOWN for r in RULES for i in r[0].split())


def brute(text):
    """Words one by one, sentences and rules by comparing lists."""
    sentences, lines = [[]], (text or "").split("\n")
    word = ""
    for n, line in enumerate(lines):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        if 0 < n < len(lines) - 1 and not re.search("[a-z0-9]", low):
            sentences.append([])
        for at, c in enumerate(low + " "):
            if c in "abcdefghijklmnopqrstuvwxyz0123456789":
                word += c
                continue
            if word:
                sentences[-1].append(word)
            word = ""
            if c in ".;":
                after = "\n".join([low[at + 1 :], *lines[n + 1 :]]).lstrip(" \t\n\r")
                if not re.match("[0-9]", after):
                    sentences.append([])
    known = sorted(((s.split(), i) for s, i in SENTENCES.items()), key=lambda x: -len(x[0]))
    rules = sorted(((r[0].split(), r) for r in RULES), key=lambda x: -len(x[0]))

    def takes(items, lists):
        at, out = 0, []
        while at < len(items):
            hit = next(((x, y) for x, y in lists if items[at : at + len(x)] == x), None)
            out += [hit[1]] if hit else []
            at += len(hit[0]) if hit else 1
        return out

    got = takes([i for s in sentences for i in takes(s, known)], rules)
    return (",".join(sorted({r[1] for r in got})), ",".join(sorted({r[2] for r in got})), len(got)) if got else None


def test_against_brute_force_and_sql(spark):
    import duckdb

    r = random.Random(9)
    every = list(SENTENCES)
    texts = []
    for n in range(400):
        parts = []
        for _ in range(r.randrange(12)):
            words = r.choice(every).split()
            if r.random() < 0.2:
                words = words[: r.randrange(1, len(words))]
            if r.random() < 0.3:
                words = [w.upper() for w in words]
            parts.append("".join(w + r.choice([" ", " ", " ", "\n", ", ", "\n# ", "-"]) for w in words))
            parts.append(r.choice(["", ". ", ";", ".\n\n", "\n\n", "\n *\n", ".2 ", "; 3", " | ", "é", " and ", "\r\n\r\n"]))
        texts.append((n, "".join(parts)))
    for name in ("apache_notice apache_comply apache_copy apache_basis", "mit_grant mit_keep as_is"):
        texts += [(len(texts), ". ".join(KNOWN[i][0] for i in name.split()))]
    want = sorted((n, *b) for n, t in texts if (b := brute(t)))
    assert len(want) > 150 and found(spark, texts) == want
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", texts)
        assert sorted(db.execute(SQL).fetchall()) == want
