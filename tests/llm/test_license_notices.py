"""The usual raw notices of the licences, through license_scan."""

import duckdb
import pandas as pd

from amity.llm import license_scan

LATER = "version %s of the License, or (at your option) any later version.\n"
GPL2 = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public\n"
        "License as published by the Free Software Foundation; either " + LATER % 2)
HOPE = ("\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied "
        "warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n")
BSD2 = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
        "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n"
        "   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above "
        "copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other "
        "materials provided with the distribution.\n")
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
       "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation "
       "the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to "
       "permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright "
       "notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
       "provided that the above\ncopyright notice and this permission notice appear in all copies.\n")
APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance "
          "with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n")
AS_IS = ("you may not use this file except in compliance with the License.\nUnless required by applicable law or agreed to in "
         "writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR "
         "CONDITIONS OF ANY KIND, either express or implied.\n")
GPL3 = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
        "License as published by\nthe Free Software Foundation, either " + LATER % 3)
CC = "This work is licensed under a Creative Commons Attribution%s 4.0 International License."
NOTICES = [
    (BSD2 + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or "
     "promote products derived from\n   this software without specific prior written permission.\n", "BSD-3-Clause"),
    (BSD2, "BSD-2-Clause"), (MIT, "MIT"), (ISC, "ISC"), (GPL3 + HOPE, "GPL-3.0-or-later"), (GPL2 + HOPE, "GPL-2.0-or-later"),
    ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", "GPL-3.0-or-later"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
     "License as published by the Free Software Foundation; either\n" + LATER % 2.1, "LGPL-2.1-or-later"),
    ("# SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"), (APACHE, "Apache-2.0"), (AS_IS, "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-3.0-only */", "GPL-3.0-only"),
    ("Licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
    ("Licensed under the GNU General Public License, version 2.", "GPL-2.0-only"),
    (GPL3, "GPL-3.0-or-later"), (GPL3.replace("Foundation,", "Foundation;"), "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"),
    ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-only"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not "
     "distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n", "MPL-2.0"),
    ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0"),
    ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"), ("SPDX-License-Identifier: MIT License", "MIT"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
    (CC % "-NonCommercial", "CC-BY-NC-4.0"), (CC % "-ShareAlike", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), (CC % "", "CC-BY-4.0"), ("Licensed under CC0 1.0.", "CC0-1.0"),
    ("This is free and unencumbered software released into the public domain.\n", "Unlicense"),
    ("Licensed under the GNU Affero General Public License version 3.", "AGPL-3.0-only"), ("Available under the ISC license.", "ISC"),
    ("Distributed under the GNU Lesser General Public License v2.1.", "LGPL-2.1-only"),
    ("Released into the public domain.", "public-domain"), ("Copyright (c) 2020 A B. All rights reserved.", "proprietary"),
]


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["license"] for r in license_scan.license_scan(docs).collect()}


def test_usual_notices(spark):
    got = scanned(spark, [text for text, _ in NOTICES])
    assert [(got[i], text) for i, (text, _) in enumerate(NOTICES)] == [(name, text) for text, name in NOTICES]
    assert {name for _, name in NOTICES} == {name for _, name, _ in license_scan.RULES}


def test_grants_below_title_and_copyright(spark):
    heads = ["A Tool\n\nCopyright (c) 2020 A B\n\n%s", "Copyright (c) 2020 A B <a@b.org>\n\n%s", "A Tool\nCopyright 2020, A B\n%s",
             "A Tool\r\n\r\nCopyright © 2020 A B\r\n \t\r\n%s"]
    grants = [(MIT, "MIT"), (ISC, "ISC"), (BSD2, "BSD-2-Clause"), (GPL2 + HOPE, "GPL-2.0-or-later"), (GPL3, "GPL-3.0-or-later"),
              (APACHE, "Apache-2.0")]
    cases = [(h % g, name) for h in heads for g, name in grants]
    cases += [("/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in (heads[0] % g).split("\n")) + " */\n", name) for g, name in grants]
    cases.append((BSD2.replace("\n\n", "\n").replace("\n", "\n\n"), "BSD-2-Clause"))  # double-spaced
    got = scanned(spark, [text for text, _ in cases])
    assert [(got[i], text) for i, (text, _) in enumerate(cases)] == [(name, text) for text, name in cases]


def test_wrapped_and_double_spaced_sentences_equal_oracle(spark):
    texts = ["All rights\nreserved.", "All  rights  reserved.", "Released into the public\ndomain."]
    for sentence, _ in license_scan.SENTENCES:
        texts += [gap.join(sentence.split()) for gap in ("\n", "  ", " \t", "\n * ")]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = {tuple(r) for r in license_scan.license_scan(spark.createDataFrame(documents)).collect()}
    con = duckdb.connect()
    con.register("documents", documents)
    assert got == set(con.execute(license_scan.OP5_SQL).fetchall())
    assert all(n > 0 for *_, n in got)


MIT_DISCLAIMER = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO "
                  "THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\n")
ENDORSE = ("Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or promote products derived "
           "from\nthis software without specific prior written permission.\n")
#: text, license, licenses
SLOTS = [
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\nimport os", "MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) AND BSL-1.0 */", "(GPL-2.0 WITH Linux-syscall-note) AND BSL-1.0", None),
    ("SPDX-License-Identifier: MIT\nx\nSPDX-License-Identifier: Zlib\nSPDX-License-Identifier: MIT\n", "MIT AND Zlib", "MIT, Zlib"),
    ("Licensed under the Apache License, Version 2.0 or the MIT license at your option.", "Apache-2.0 OR MIT", "Apache-2.0 OR MIT"),
    ("Licensed under either of\n\nApache", None, ""),
    ("This crate is dual licensed under the MIT license and the Apache License, Version 2.0.", "MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided "
     "that the above\ncopyright notice and this permission notice appear in all copies.\n", "ISC", "ISC"),
    (BSD2 + "\n3. " + ENDORSE, "BSD-3-Clause", "BSD-3-Clause"), (ENDORSE, "BSD-3-Clause", "BSD-3-Clause"),
    (MIT_DISCLAIMER, "MIT", "MIT"), (MIT + "\n" + APACHE, "MIT", "MIT, Apache-2.0"),
    ("This file is distributed under the terms of the Mozilla Public License 2.0.\nOther files are available under the ISC license.", "MPL-2.0", "MPL-2.0, ISC"),
    ("The weather is fine. All rights reserved.\nReleased under the MIT License.", "MIT", "MIT"),
    ("This program is distributed under the terms of the GPL v2.", "GPL-2.0-only", "GPL-2.0-only"),
    ("I got my driving licence under a minute.", None, ""), ("He was admitted under the licence of a friend.", None, ""),
    ("", None, ""), (None, None, ""),
]


def test_slots_alternatives_and_several_licences(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SLOTS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    for i, (text, name, names) in enumerate(SLOTS):
        assert (got[i]["license"], text) == (name, text)
        assert names is None or (got[i]["licenses"], text) == (names, text)


def test_all_notices_equal_oracle_with_one_scan(spark):
    """All readings are in the SQL text; the plan reads the documents once and
    shuffles nothing."""
    texts = [t for t, _ in NOTICES] + [t for t, _, _ in SLOTS] + [
        h % g for h in ("A Tool\n\nCopyright (c) 2020 A B\n\n%s", "A Tool\nCopyright 2020, A B\n%s") for g in (MIT, ISC, BSD2, GPL3, APACHE)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license_scan.license_scan(frame)
    con = duckdb.connect()
    con.register("documents", documents)
    order = ", ".join(found.columns)
    assert {tuple(r) for r in found.collect()} == set(con.execute(f"select {order} from ({license_scan.OP5_SQL})").fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
