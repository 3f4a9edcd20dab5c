"""License rules: the gate lets every text pass that a rule fits."""

import random
import re
from re import _constants as op
from re import _parser as parser

from tracelake.llm import licenses

LOST = {
    "distributed under BSD-3-Clause": "BSD-3-Clause",
    "available under Creative Commons Attribution-ShareAlike 4.0": "CC-BY-SA",
    "placed in the public\ndomain": "public-domain",
    "placed in the public  domain": "public-domain",
    "CC_BY-SA": "CC-BY-SA",
    "CC\nBY": "CC-BY",
}
#: Texts that no rule found, or not in full.
MORE = {
    "// SPDX-License-Identifier: MIT": ("MIT", 1.0),
    "# SPDX-License-Identifier: Apache-2.0": ("Apache-2.0", 1.0),
    "SPDX-License-Identifier: GPL-3.0-only": ("GPL-3.0-only", 1.0),
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": ("Apache-2.0,MIT", 1.0),
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath": ("GPL-2.0-or-later", 1.0),
    "code under GPLv3": ("GPL-3.0", 0.7),
    "available under LGPL v2.1": ("LGPL-2.1", 0.95),
    "released under GPLv2": ("GPL-2.0", 1.0),
    "Permission is hereby granted, free of charge": ("MIT", 0.7),
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy": ("BSL-1.0", 0.7),
    "Redistribution and use in source and binary forms, with or without modification": ("BSD", 0.7),
    "Neither the name of the copyright holder nor the names of its\ncontributors may be used": ("BSD-3-Clause", 0.7),
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": ("ISC", 0.7),
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": ("GPL-3.0,gpl", 0.9),
    "a page about submitting and limits, the vim editor and the city of Fair": ("", 0.0),
}


def example(tree, rnd):
    """A string that a parsed pattern matches."""
    out = ""
    for kind, at in tree:
        if kind is op.LITERAL:
            out += chr(at)
        elif kind is op.NOT_LITERAL:
            out += "q"
        elif kind is op.IN:
            k, v = rnd.choice(at)
            out += "q" if k is op.NEGATE or at[0][0] is op.NEGATE else chr(v if k is op.LITERAL else rnd.randint(*v))
        elif kind is op.BRANCH:
            out += example(rnd.choice(at[1]), rnd)
        elif kind is op.SUBPATTERN:
            out += example(at[3], rnd)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            out += "".join(example(at[2], rnd) for _ in range(rnd.randint(at[0], min(at[1], at[0] + 2))))
        else:
            assert kind is op.AT, kind
    return out


def test_gate_follows_from_the_rules(spark):
    rnd = random.Random(1)
    texts = []
    for label, _, pattern, _ in licenses.rules():
        for _ in range(4):
            if licenses.SPDX_LINE in pattern:  # Python's re has no such lookbehind
                plain = f"spdx license identifier {licenses.spdx_words(label)}"
            else:
                plain = example(parser.parse(pattern), rnd)
                assert re.search(pattern, plain), (label, plain)
            texts.append((label, plain, re.sub(" ", lambda _: rnd.choice([" ", "\n", "  ", "-", "_", ": ", " (", "', \x01"]), rnd.choice([plain, plain.upper(), plain.title()]))))
    docs = spark.createDataFrame(list(enumerate(t for _, _, t in texts)), "doc_id long, text string").repartition(8)
    rows = {r.doc_id: r for r in licenses.report(docs).collect()}
    bad = [(texts[i], rows[i].labels) for i in rows if rows[i].score == 0]
    assert not bad


def test_texts_that_the_gate_lost(spark):
    docs = spark.createDataFrame(list(enumerate(LOST)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.report(docs).collect()}
    assert [rows[i].labels for i in range(len(LOST))] == list(LOST.values())
    assert all(r.score > 0 for r in rows.values())


def test_ids_short_names_and_clauses(spark):
    docs = spark.createDataFrame(list(enumerate(MORE)), "doc_id long, text string")
    rows = {r.doc_id: (r.labels, r.score) for r in licenses.report(docs).collect()}
    assert [rows[i] for i in range(len(MORE))] == list(MORE.values())


def test_no_two_signatures_are_crossed_from_one():
    patterns = [r[2] for r in licenses.rules()]
    bare = [p.replace(licenses.CITED, "") for p in patterns]
    assert len(set(bare)) == len(patterns) == len(licenses.SPDX.split()) + len(licenses.NAMES) + len(licenses.MORE) + len(licenses.NOTICES)
