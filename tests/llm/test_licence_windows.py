"""Notices against all lines and all windows of a text, without a gate of any kind."""

from __future__ import annotations

import math
import re
from collections import Counter

from siftwall.llm import licenses


def cosine(tokens, vector, idf, other):
    w = {t: n * idf.get(t, other) for t, n in Counter(tokens).items()}
    norm = math.sqrt(sum(v * v for v in w.values()))
    if len(w.keys() & vector.keys()) < licenses.MIN_SHARED:
        return 0.0
    return round(sum(e * w.get(t, 0.0) for t, e in vector.items()) / norm, 9)


def templates():
    """Licence, tokens in number, vector, idf and idf of others, of every template."""
    vectors, idf, other = licenses.template_weights()
    out = [(k, len(re.findall(licenses._TOKEN, licenses.TEMPLATES[k].lower())), v, idf, other) for k, v in vectors.items()]
    vectors, idf, other = licenses.text_weights()
    for (name, text), v in zip(licenses.TEXTS, vectors):
        out.append((name, len(re.findall(licenses._TOKEN, text.lower())), v, idf, other))
    return out


def own(text):
    lines = [re.findall(licenses._TOKEN, x) for x in text.lower().split("\n")]
    tokens = [(t, i) for i, x in enumerate(lines) for t in x]
    hits = []
    for name, n, vector, idf, other in templates():
        n = min(n, len(tokens))
        units = [(i, x) for i, x in enumerate(lines) if x]
        units += [(tokens[s][1], [t for t, _ in tokens[s : s + n]]) for s in range(len(tokens) - n + 1) if n]
        hits += [(-cosine(x, vector, idf, other), i, name) for i, x in units]
    hits = [h for h in hits if -h[0] >= licenses.MIN_COSINE]
    if not hits:
        return None
    score, line, _ = min(hits)
    return -score, line, max(name for s, i, name in hits if (s, i) == (score, line))


FILLER = "ones thatin nterti with the onan of erat "
#: Wrapped, embedded, without a marker, beside each other, and no notices at all.
TEXTS = {
    "/* Released under the MIT\n * License. */\ncode": "MIT",
    FILLER * 6 + "Licensed under CC BY-NC 4.0. " + FILLER * 9: "CC-BY-NC-4.0",
    FILLER * 5 + "This work is licensed under the GNU\nGeneral Public License, version 3.\n" + FILLER: "GPL-3.0",
    "GNU General Public, version 2": "GPL-2.0",
    "one\n\nISC\n\nReleased under the\n\n   ISC License.": "ISC",
    "Licensed under the Apache License, Version 2.0. " * 3: "Apache-2.0",
    FILLER * 40: None,
    "the terms of the work, as they are, and by any means to be in the public": None,
    "Mit": None,
    "": None,
    "\n \n": None,
}


def test_every_line_and_window(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {r.text: r.own for r in licenses.own_licences(docs.selectExpr("'x' AS path", "text")).collect()}
    for text, licence in TEXTS.items():
        want, o = own(text), got[text]
        assert (o and o.licence) == licence == (want and want[2]), (text, o, want)
        if want:
            assert abs(o.score - want[0]) < 1e-6 and (abs(o.score - want[0]) > 0 or o.line == want[1])


def test_texts_of_common_words_cannot_have_a_notice():
    for name, _, vector, _, _ in templates():
        assert sum(v * v for t, v in vector.items() if t in licenses.COMMON) < licenses.MIN_COSINE**2, name
