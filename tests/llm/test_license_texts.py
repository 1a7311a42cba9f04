"""Licences besides the short ones: full texts, file headers and SPDX tags."""

from pathlib import Path

import pytest

from rfmlens.llm import licenses as L
from rfmlens.llm.license_texts import DIGESTS, HEADERS, SPDX


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.license, r.notices, r.n_notices) for r in L.scan(docs).orderBy("doc_id").collect()]


def test_full_texts(spark):
    """op8_licenses: whole standard texts."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    at = Path("/usr/share/common-licenses")
    if not at.is_dir():
        pytest.skip("no licence texts on this machine")
    texts = [(at / f).read_text() for f in names]
    assert [r[0] for r in scan(spark, [*texts, *map(str.upper, texts), texts[0] + " And more."])] == [*names.values()] * 2 + [None]


def test_headers_and_tags(spark):
    """op8_licenses: headers of several lines in a file, and tags of all names."""
    apache = ("# Copyright 2020 Some One\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance "
              "with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\nimport os\n")
    gpl = (" * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\nint x;")
    tags = ["// SPDX-License-Identifier: BSD-3-Clause\nint x;", "x\n# SPDX-License-Identifier: GPL-3.0-only\ny"]
    assert scan(spark, [apache, gpl, *tags]) == [(None, "Apache-2.0", 1), (None, "GPL-3.0", 1), (None, "BSD-3-Clause", 1), (None, "GPL-3.0", 1)]
    assert {n for n, _ in [*L.KNOWN, *HEADERS, *DIGESTS]} <= {n for n, _ in SPDX}
