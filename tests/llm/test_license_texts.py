import pytest
from pyspark.sql import functions as F

from corvia.llm import license as L
from corvia.llm import license_texts as T


def comment(text, mark):
    return "\n".join(f"{mark} {x}".rstrip() for x in text.splitlines())


MIT = f"MIT License\n\nCopyright (c) 2021 Some Body\n\n{T._MIT}\n\n{T._MIT_REST}\n"
BSD3 = f"Copyright (c) 2019, Some Body\nAll rights reserved.\n\n{T._BSD}\n\n{T._BSD_THIRD}\n\n{T._BSD_REST}\n"
BSD2 = f"Copyright (c) 2019, Some Body\n\n{T._BSD}\n\n{T._BSD_REST}\n"
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint main() { return 0; }"
GPL3 = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'
CASES = [
    ("a/LICENSE", MIT, "MIT"), ("b/x.py", comment(MIT, "#") + "\n\nimport os", "MIT"), ("c/LICENSE.txt", BSD3, "BSD-3-Clause"), ("d/x.c", comment(BSD3, " *"), "BSD-3-Clause"), ("e/LICENSE", BSD2, "BSD-2-Clause"),
    ("f/x.c", MPL, "MPL-2.0"), ("g/x.py", comment(GPL3, "#") + "\n\ncode", "GPL-3.0"), ("h/x.sh", comment(GPL3.replace("version 3", "version 2"), "#"), "GPL-2.0"), ("i/x.js", comment(APACHE, "//"), "Apache-2.0"),
    ("j/x.go", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage main", "BSD-3-Clause"),
    ("k/x", "SPDX-License-Identifier: ISC", "ISC"), ("l/x", "SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"), ("m/x", "SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("n/x", "SPDX-License-Identifier: LicenseRef-Proprietary", None),
    ("o/x", "GNU Affero General Public License, version 3.", "AGPL-3.0"), ("p/x", "Eclipse Public License, version 2.0.", "EPL-2.0"), ("q/x", "the driver's license was under the bridge", None),
    ("r/x", "Licensed under the Apache License, Version 1.1.", None), ("s/x", "Licensed under the Sleepycat License.", None), ("t/x", "All rights reserved. Copyright 2020 by nobody in particular, see the license", None),
    ("u/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies", "GPL-3.0"),
    ("v/x", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("w/x", "This library is free software under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(p, t) for p, t, _ in CASES] * 2, "path string, text string")
    clashing = ["n", "key", "word", "cosine", "license", "df", "name", "i", "_dir", "up", "depth", "x"]
    rows = L.scan(files.withColumns({c: F.lit("clash") for c in clashing})).collect()
    assert len(rows) == 2 * len(CASES) and {r["n"] for r in rows} == {"clash"}
    return {r["path"]: r for r in rows}


@pytest.mark.parametrize(("path", "want"), [(p, w) for p, _, w in CASES])
def test_notices_and_texts(found, path, want):
    assert found[path]["own_license"] == want, found[path]
