"""Licence scans against a brute-force cosine, with ties, repeated rows, long texts and prose that only names a licence."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewheel.llm import licenses

TERM = re.compile("[a-z0-9]+")


def brute(files, templates, threshold):
    """(path, text) -> (licence, cosine, line, at), every passage scored against every template."""
    counts = licenses.template_counts(templates)
    vocabulary = {t for _, _, c in counts for t in c}
    held = [set(TERM.findall(text.lower())) for _, text in files]
    df = Counter(t for h in held for t in h & vocabulary)
    n = len(files)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    vector = lambda terms: {t: k * idf.get(t, math.log(1 + n) + 1) for t, k in Counter(terms).items()}
    models = [(name, exact, {t: k * idf[t] for t, k in c.items()}, sum(c.values())) for name, exact, c in counts]
    near = [set(licenses.anchors(w, df, threshold)) for _, _, w, _ in models]
    every = set().union(*near)

    def cosine(terms, w):
        x = vector(terms)
        dot = sum(a * w.get(t, 0) for t, a in x.items())
        return round(dot / math.sqrt(sum(a * a for a in x.values())) / math.sqrt(sum(a * a for a in w.values())), 6) if x else 0

    out = {}
    for path, text in files:
        found = []
        lines = [TERM.findall(line) for line in text.lower().split("\n")]
        lines = {i: t for i, t in enumerate(lines) if every & set(t)}
        placed = [(t, i, j) for i, line in enumerate(text.lower().split("\n")) for j, t in enumerate(TERM.findall(line))]
        for k, (name, exact, w, length) in enumerate(models):
            least = 1.0 if exact else threshold
            passages = [(t, i, 0) for i, t in lines.items()] + [([x for t in lines.values() for x in t], 2**31, 0)]
            for start in range(0, len(placed), max(1, length // licenses.STEPS)):
                terms = [t for t, _, _ in placed[start : start + length]]
                if near[k] & set(terms):
                    passages.append((terms, placed[start][1], placed[start][2]))
            found += [(-c, line, at, name) for terms, line, at in passages if (c := cosine(terms, w)) >= least]
        if found:
            # at is where the first passage of the line with that licence begins
            best = {}
            for c, line, at, name in found:
                was = best.get((name, line), (0, 2**31))
                best[name, line] = (min(was[0], c), min(was[1], at))
            c, line, at, name = min((c, line, at, name) for (name, line), (c, at) in best.items())
            out[path, text] = (name, -c, -1 if line == 2**31 else line, at)
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(8)
    words = "the of software license under permission notice copy terms version released granted public use river stone apple window".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notices = list(licenses.TEMPLATES.values())
    files = [(f"d/{i}", f"{prose(rng.randint(0, 30))} {rng.choice(notices)} {prose(rng.randint(0, 30))}\n{prose(9)}") for i in range(40)]
    files += [(f"e/{i}", prose(60) + "\n" + licenses.TEXTS["MIT"][0][: 200 + 60 * i] + "\n" + prose(20)) for i in range(8)]
    files += [("tie", f"{notices[1]}\n{notices[1]}\n{notices[12]}"), ("twice", notices[12]), ("twice", notices[12]), ("twice", "another text"), ("empty", "")]
    files += [("long", prose(3000) + "\n" + notices[3] + " " + prose(2000))]
    frame = spark.createDataFrame(files, "path string, text string").withColumn("mark", F.xxhash64("text"))
    texts = {(r.path, r.mark): r.text for r in frame.collect()}
    got = {(r.path, texts[r.path, r.mark]): (r.licence, r.cosine, r.line, r.at) for r in licenses.own_licences(frame, licenses.ALL_TEMPLATES, licenses.THRESHOLD).collect()}
    want = brute(files, licenses.ALL_TEMPLATES, licenses.THRESHOLD)
    assert got.keys() == want.keys()
    for k, (licence, cosine, line, at) in want.items():
        assert abs(got[k][1] - cosine) < 2e-6
        assert got[k] == (licence, got[k][1], line, at)
    assert len(want) > 40


def test_prose_that_names_a_licence_is_none(spark):
    prose = [
        "Students at MIT were released early under heavy snow while the council debated a parking license for cyclists downtown",
        "The public domain of the lake is free, and the unencumbered view was released to all the visitors of the town",
        "A new version of the general plan for public works was published by the foundation in the spring of that year",
    ]
    real = {"MIT": licenses.TEXTS["MIT"][0], "BSD-3-Clause": licenses.TEXTS["BSD-3-Clause"][0], "Apache-2.0": licenses.TEXTS["Apache-2.0"][0], "GPL-3.0": "# SPDX-License-Identifier: GPL-3.0"}
    rows = [(f"prose/{i}", p) for i, p in enumerate(prose)] + [(name, f"int x;\n{text}\nreturn x;") for name, text in real.items()]
    got = licenses.licence_scan(spark.createDataFrame(rows, "path string, text string"), F.col("path"), F.col("text"), is_licence_file=F.lit(False)).collect()
    assert {r.path: r.own_licence for r in got} == {p: real.get(p) and p for p, _ in rows}
