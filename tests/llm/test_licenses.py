"""Whole licence texts, headers, SPDX tags and wrapped notices in the licence scan."""

from __future__ import annotations

import textwrap

from billoom.llm import licenses

LONG = dict(licenses.long_templates()[len(licenses.HEADERS) :])
APACHE = licenses.HEADERS[1][1]
CASES = {
    **{f"{k}/LICENSE": (t.replace("<year>", "2021").replace("<owner>", "A. Person"), k) for k, t in LONG.items()},
    "mit.c": ("/*\n" + textwrap.indent(textwrap.fill(LONG["MIT"], 70), " * ") + "\n */\n\nint main(void) { return 0; }\n", "MIT"),
    "apache.py": (textwrap.indent(textwrap.fill(APACHE, 60), "# ") + "\n\nimport os\nprint(os.name)\n", "Apache-2.0"),
    "gpl.py": (textwrap.indent(textwrap.fill(licenses._GNU.format(it="program", name="General Public License", v="3"), 60), "# ") + "\n\nx = 1\n", "GPL-3.0"),
    "paragraphs.txt": ("About\n\n" + LONG["MIT"].split("\n\n")[2] + "\n\nThe end of it", "MIT"),
    "tag.py": ("# SPDX-License-Identifier: Apache-2.0\nx = 1\n", "Apache-2.0"),
    "tag.html": ("<!-- SPDX-License-Identifier: (MIT OR 0BSD) -->", "(MIT OR 0BSD)"),
    "wrapped.txt": ("some words\n\nThis work is licensed under the GNU General\nPublic License, version 3.\n\nmore words", "GPL-3.0"),
    "unsaid.txt": ("Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause", "BSD-3-Clause"),
    "none.txt": ("The mat is here, all rights or wrongs of the cat are not known to any person.\n\nmit dem Hund", None),
    "null.txt": (None, None),
}


def test_texts_headers_and_tags(spark):
    files = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "path string, text string")
    got = {r["path"]: (r["license"], r["score"]) for r in licenses.scan(files).collect()}
    assert {k: v for k, (v, _) in got.items()} == {k: want for k, (_, want) in CASES.items() if want}
    assert all(0.7 <= s <= 1.000001 for _, s in got.values())
