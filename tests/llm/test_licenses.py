"""Published licence headers, SPDX tags and references by name."""

import pytest

from ampflow.llm import licenses

WORDS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
ADVERTISE = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.'
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.'


def gnu(name, version, what="program", colon=":", stop=","):
    """The header that the licence itself gives."""
    return (
        f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version.\n\n"
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\n"
        f"You should have received a copy of the {name} along with this {what}; if not, see <https://www.gnu.org/licenses/>."
    )


GPL = "GNU General Public License"
CASES = [
    (MIT, "MIT"), (APACHE, "Apache-2.0"), (ISC, "ISC"), ("Licensed under the MIT License. " + MIT, "MIT"), ("ISC License " + ISC, "ISC"),
    (WORDS + AS_IS, "BSD-2-Clause"), (WORDS + ENDORSE + AS_IS, "BSD-3-Clause"), (WORDS + ADVERTISE + ENDORSE.replace("3.", "4.") + AS_IS, "BSD-4-Clause"),
    (gnu(GPL, 3), "GPL-3.0-or-later"), (gnu(GPL, 2, colon=";", stop=";"), "GPL-2.0-or-later"),
    (gnu("GNU Affero General Public License", 3), "AGPL-3.0-or-later"), (gnu("GNU Lesser General Public License", "2.1", "library", ";", ";"), "LGPL-2.1-or-later"),
    (gnu("GNU Lesser General Public License", "3", "library"), "LGPL-3.0-or-later"), (gnu("GNU Library General Public License", "2", "library", ";", ";"), "LGPL-2.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of version 3 of the GNU General Public License.", "GPL-3.0"),
    ("The GNU General Public License, v. 3 holds.", "GPL-3.0"), ("This work is under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("Released under the BSD 3-Clause licence.", "BSD-3-Clause"), ("Distributed under the 2-clause BSD license.", "BSD-2-Clause"), ("Released under GPLv3.", "GPL-3.0"), ("Distributed under the GPL-2 terms.", "GPL-2.0"), ("Licensed under LGPLv2.1.", "LGPL-2.1"), ("Licensed under AGPLv3.", "AGPL-3.0"),
    ("Licensed under the Apache 2.0 license.", "Apache-2.0"), ("License: ISC License", "ISC"), ("This is under the zlib license.", "Zlib"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("Made available under the terms of the Eclipse Public License v2.0", "EPL"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("It was placed in the public domain.", "Public-domain"), ("Permission is granted to anyone to use this software for any purpose, including commercial applications.", "Zlib"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA"), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC-BY-NC-ND"), ("CC BY-NC 4.0", "CC-BY-NC"), ("Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA"), ("CC BY-ND 4.0", "CC-BY-ND"), ("CC0 1.0", "CC0"), ("Creative Commons Attribution 4.0", "CC-BY"), ("All rights reserved.", "Proprietary"),
    ("Copyright 2020 X. All rights reserved.\n\n" + WORDS + ENDORSE + AS_IS, "BSD-3-Clause"), ("Released into the public-domain.", "Public-domain"), ("distributed under the Foo terms", "unknown"), ("It is licensed under the Foo Licence.", "unknown"),
    *[(f"// SPDX-License-Identifier: {tag}\nint x;", want or tag) for tag, want in {
        "MIT": "", "Apache-2.0": "", "ISC": "", "BSD-2-Clause": "", "BSD-3-Clause": "", "BSD-4-Clause": "", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "", "GPL-3.0-or-later": "",
        "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "MPL-2.0": "", "EPL-2.0": "EPL", "Zlib": "", "BSL-1.0": "", "Unlicense": "", "CC0-1.0": "CC0", "CC-BY-4.0": "CC-BY", "CC-BY-SA-4.0": "CC-BY-SA", "Made-Up": "unknown",
    }.items()],
]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [t for t, _ in CASES] + ["SPDX-License-Identifier: MIT OR Apache-2.0 OR BSD-3-Clause"]
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{w}-{i}" for i, (_, w) in enumerate(CASES)])
def test_published_text(scanned, i):
    got = scanned[i]
    assert got.license == CASES[i][1], got
    assert got.license == "unknown" or not got.left_over, got


def test_all_of_an_expression(scanned):
    assert set(scanned[len(CASES)].licenses.split()) == {"MIT", "Apache-2.0", "BSD-3-Clause"} and not scanned[len(CASES)].left_over


def test_every_rule_has_a_case(scanned):
    assert {name for name, _ in licenses.RULES} <= {r.license for r in scanned.values()} | {"LGPL"}


def test_rights_reserved_beside_a_licence(scanned):
    i = next(i for i, (t, _) in enumerate(CASES) if t.startswith("Copyright 2020"))
    assert scanned[i].licenses == "BSD-3-Clause" and not scanned[i].left_over


def test_sql_gives_the_same_over_all_headers(scanned):
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*enumerate(t for t, _ in CASES), (len(CASES), "SPDX-License-Identifier: MIT OR Apache-2.0 OR BSD-3-Clause")])
    assert sorted(con.execute(licenses.SQL).fetchall()) == sorted(tuple(r) for r in scanned.values())
