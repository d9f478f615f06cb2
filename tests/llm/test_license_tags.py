"""Licence tags and bodies, and the SQL twin on notices that the tables do not hold."""

import duckdb
import pandas as pd
from test_text_operators import NOTICES

from leafmill.llm import license

ROWS = {
    "MIT": "// SPDX-License-Identifier: MIT\nint main() {}",
    "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0\n",
    "GPL-2.0-only": "/* SPDX-License-Identifier: GPL-2.0 */",
    "GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0+",
    "LGPL-2.1-or-later": "spdx-license-identifier: LGPL-2.1-or-later, kept",
    "MIT-0": "SPDX-License-Identifier: MIT-0",
    "BSD-3-Clause": "text before. SPDX-License-Identifier: (BSD-3-Clause)",
    "none": "SPDX-License-Identifier: LicenseRef-own",
    "CC0-1.0": "CC0 1.0 Universal\n\nStatement of Purpose",
    "GPL-3.0-only": "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use",
}


def test_tags_and_bodies(spark):
    rows = list(enumerate(ROWS.items()))
    got = {r["doc_id"]: r["licenses"] for r in license.scan(spark.createDataFrame([(i, t) for i, (_, t) in rows], "doc_id long, text string")).collect()}
    assert [(got[i], t) for i, (_, t) in rows] == [x for _, x in rows]


def test_twin(spark):
    """The SQL gives the same rows on wrapped notices, tags, marks and odd white space."""
    texts = [*ROWS.values(), *NOTICES.values(), *("# " + t.replace("\n", "\n# ") for t in NOTICES.values()), "\n".join(NOTICES.values()), None, "", "\n\nlicense\n", "a license! b license?) c", "Released under the MIT License.", "x | license | y. ]Released under the MIT license."]
    rows = list(enumerate(texts))
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in license.scan(docs).collect()) == sorted(db.execute(license.oracle()).fetchall())
