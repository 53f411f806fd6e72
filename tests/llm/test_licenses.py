"""Every template wrapped between other lines, in pairs, and on one line with another."""

import random
import textwrap

from axonframe.llm import licenses

MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
BEFORE, AFTER = "rows of gray stones lay\nby the long river bank", "and nobody went there\nfor many summers after"


def test_wrapped_and_in_pairs(spark):
    wrapped = {k: textwrap.wrap(v, 72, break_on_hyphens=False) for k, v in licenses.TEMPLATES.items()}
    docs, want = [], {}

    def add(parts, text_lines):
        want[len(docs)] = parts
        docs.append((len(docs), "\n".join(text_lines)))

    for k, x in wrapped.items():
        add([(2, 1 + len(x), k)], [*BEFORE.split("\n"), *x, *AFTER.split("\n")])
        for m, y in wrapped.items():
            add([(2, 1 + len(x), k), (2 + len(x), 1 + len(x) + len(y), m)], [*BEFORE.split("\n"), *x, *y, *AFTER.split("\n")])
            add([(0, 0, k), (0, 0, m)], [f"{licenses.TEMPLATES[k]} {licenses.TEMPLATES[m]}"])
    add([(2, 4, "MPL-2.0")], [*BEFORE.split("\n"), *MPL.split("\n"), *AFTER.split("\n")])
    for public in ("free and unencumbered software released into the public\n * domain",):
        text = licenses.TEMPLATES["Unlicense"].replace("free and unencumbered software released into the public domain", public)
        add([(0, 1, "Unlicense")], text.split("\n"))
    got = {}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for r in licenses.scan_licenses(df).where("confirmed").collect():
        got.setdefault(r.id, []).append((r.first_line, r.last_line, r.license))
    wrong = {i: (sorted(got.get(i, [])), sorted(w)) for i, w in want.items() if sorted(got.get(i, [])) != sorted(w)}
    assert not wrong, list(wrong.items())[:5]


def test_numbers_and_limit():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    sure = lambda text: [r[2] for r in scanner.scan(text) if r[5]]
    assert sure("This work is licensed under the GNU General Public License, version 4.") == []
    mit = licenses.TEMPLATES["MIT"].split()
    assert sure(" ".join(mit[:40] + ["x"] * 8 + mit[40:])) == ["MIT"] and sure(" ".join(mit[:40] + ["x"] * 9 + mit[40:])) == []


def test_names_and_denials():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    sure = lambda text: sorted(r[2] for r in scanner.scan(text) if r[5])
    gpl = licenses.TEMPLATES["GPL-3.0-or-later"]
    assert sure(gpl) == ["GPL-3.0-or-later"] and sure(gpl.replace("General", "Affero General")) == ["AGPL-3.0-or-later"]
    assert sure(gpl.replace("version 3", "version 2")) == ["GPL-2.0-or-later"]
    assert sure("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0-notice"]
    assert sure("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0-notice"]
    assert sure("This work is licensed under the GNU Lesser General Public License, version 2.1.") == ["LGPL-2.1-notice"]
    assert sure("Not released under the MIT License.") == [] and sure("It is not yet released under the MIT License.") == []
    assert sure("Released under the MIT License.\nSPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-Clause-tag", "MIT-notice"]
    assert sure("Licensed under CC BY-NC-ND 4.0.") == ["CC-BY-NC-ND-4.0"] and sure("SPDX-License-Identifier: Foo-1.0") == []
    bsd = licenses.TEMPLATES["BSD-3-Clause"]
    assert sure(bsd) == ["BSD-3-Clause"] and sure(bsd[: bsd.index(" Neither")]) == ["BSD-2-Clause"]
    assert sure(gpl.replace("or (at your option) any later version", "and no other version")) == []


def test_scan_against_every_alignment():
    """Ranking by compression loses no wording that aligning every template with the whole text would find."""
    rng = random.Random(4)
    names = [k for k in licenses.TEMPLATES if not k.endswith("-tag")]
    filler = "stone river summer garden the of a software and license house under permission notice walks public domain sea".split()
    scanner = licenses.Scanner(licenses.TEMPLATES)
    planted = caught = 0
    for _ in range(60):
        parts, want = [], []
        for _ in range(rng.randint(1, 4)):
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randint(3, 60))))
            k = rng.choice(names)
            words = licenses.TEMPLATES[k].split()
            for _ in range(int(len(words) * 0.04)):  # a few words changed
                i = rng.randrange(1, len(words) - 1)
                if not any(c.isdigit() for c in words[i]) and licenses._WORD.findall(words[i].lower()) and not licenses.NAMING & set(licenses._WORD.findall(words[i].lower())):
                    words[i] = "zzz"
            parts.append(" ".join(words) + ".")
            want.append(k)
        text = "\n".join(parts)
        every = [w.lower() for w in licenses._WORD.findall(text)]
        brute = {k for k in licenses.TEMPLATES if any(not scanner.denied(every, s) for _, s, _ in licenses.aligned(scanner.words[k], every, licenses.DIFFER * len(scanner.words[k])))}
        got = [r[2] for r in scanner.scan(text) if r[5]]
        assert set(got) <= brute
        planted += len(want)
        caught += sum(min(got.count(k), want.count(k)) for k in set(want))
    assert caught >= 0.97 * planted, (caught, planted)
