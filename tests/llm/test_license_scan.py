"""Places of the base phrases against a scan of every position."""

import re

from pitchside.llm import license_scan

from .helpers import documents, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["Released UNDER the MIT-License. Under the MIT license", "Apache License, Version 2.0 cc by-nc CC BY NC nc by cc", "licen\u212ae under the m\u0130t license", "cc by nc" * 3,
         "This work is licensed under the GNU General Public License, version 3.", "cc\ncc by\nnc", "under the mit licenses", "apache license version 2\u00e9"]


def test_base_places(spark):
    data = rows() + [(300 + i, t, *([None] * 10)) for i, t in enumerate(TEXTS)]
    got = license_scan.scan_licenses(documents(spark, data)).collect()
    want = []
    for d in data:
        w = TERM.findall((d[1] or "").translate(LOWER))
        places = [(t.label, k) for t in license_scan.BASE for k in range(len(w)) if w[k:k + len(t.phrase.split())] == t.phrase.split()]
        want.append((d[0], len(w), sorted(places)))
    assert sorted(((g.doc_id, g.n_words, sorted((p.label, p.start) for p in g.places if p.base)) for g in got), key=str) == sorted(want, key=str)
    labels = {g.doc_id: {p.label for p in g.places} for g in got}
    assert labels[304] == {"gpl-3"} and labels[300] == {"mit"} and labels[306] == set() and labels[307] == set()
    assert all(0 < p.coverage <= 1 for g in got for p in g.places)


def test_empty_table(spark):
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0
