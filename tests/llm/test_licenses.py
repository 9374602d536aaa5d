import re
from collections import Counter

from dwellspark.llm import licenses as L
from dwellspark.llm.queries import op13_license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def starts(words, phrase):
    parts = phrase.split()
    return [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]


def brute(docs, templates=L.TEMPLATES):
    """No index: every place of every template is tried."""
    texts = [(i, words_of(t)) for i, t in docs]
    vocabulary = {w for t in templates for w in t.text.split()}
    held = Counter(w for _, words in texts for w in set(words) & vocabulary)
    out = []
    for doc_id, words in texts:
        base = {label: starts(words, phrase) for phrase, label in L.PHRASES}
        places = sorted(p for found in base.values() for p in found)
        labels, score = {label for label, found in base.items() if found}, 0.0
        spots = {}
        for i, w in enumerate(words):
            if w in vocabulary:
                spots.setdefault(w, []).append(i)
        for label, text, phrases in templates:
            own = text.split()
            at = {p: starts(words, p) for p in phrases}
            if not all(at.values()):
                continue
            rare = sorted(set(own) & set(words), key=lambda w: (held[w], w))[: L.RAREST]
            agree = Counter(i - k for k, w in enumerate(own) if w in rare for i in spots[w])
            enough = min(len(set(own)), 5, max(3, len(set(own)) // 2))
            for first, n in agree.items():
                end = first + len(own) + L.SLACK
                if n >= enough and all(any(first - L.SLACK <= p < end for p in at[q]) for q in phrases):
                    labels.add(label)
                    score = max(score, round(len(set(own) & set(words[max(0, first - L.SLACK) : end])) / len(set(own)), 6))
        row = (doc_id, len(words), len(places), places[0] if places else None, places[-1] if places else None)
        out.append((*row, ",".join(sorted(label for label, found in base.items() if found)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def scan(docs):
    return sorted((tuple(r)[:8] for r in L.license_scan(docs).collect()), key=repr)


def test_equals_brute_force(make, odd):
    named = {t.label: t.text for t in L.TEMPLATES}
    docs = odd + [
        (20, "MIT License"), (21, "mit license MIT-License, mit mit license"), (22, "Released under the MIT License."), (23, "the mit licenses and gnu general public\nlicense"),
        (24, named["apache-2-notice"].upper()), (25, "x " * 500 + named["mit-text"] + " y" * 50), (26, named["gpl-3-or-later"].replace("warranty", "")),
        (27, " ".join(w for k, w in enumerate(named["bsd"].split()) if k not in (12, 22))), (28, named["isc"].replace("copy", "duplicate") + " " + named["unlicense"]),
        (29, "either version 3 of nothing, any later version, gnu general public license"), (30, "Licensed under CC BY-NC 4.0. " * 300), (31, "cc by cc by 4 0"),
        (32, " ".join(named.values())), (33, "version 3 " + "z " * 40 + "this work is licensed under the gnu general public license"), (34, "ＭＩＴ license é mit license"),
        (35, named["gpl-2-or-later"] + " " + named["lgpl-or-later"]), (None, "apache license"), (36, "\x00mit\x1flicense\x7f"),
    ]
    got = scan(make(docs))
    assert got == brute(docs)
    by = {r[0]: r for r in got}
    assert by[22][5:] == ("mit", "mit,mit-named", 1.0) and by[29][6] == "gpl" and by[33][6] == "gpl"
    assert {"apache-2-notice", "isc", "unlicense", "bsd"} <= {x for i in (24, 27, 28) for x in by[i][6].split(",")}
    assert set(by[32][6].split(",")) >= set(named), "a file with all notices has all labels"


def test_found_places_and_empty_tables(make, spark):
    docs = make([(1, "a b c Released under the MIT license and Licensed under CC BY-SA 4.0")])
    (row,) = L.license_scan(docs).collect()
    assert {tuple(f) for f in row.found} == {("mit-named", 3), ("cc-by-sa-4", 9)}
    assert L.license_scan(docs.limit(0)).collect() == []
    assert scan(make([(1, None)])) == [(1, 0, 0, None, None, "", "", 0.0)]


def test_query_equals_brute_force(spark, folder, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted(map(tuple, op13_license_scan(spark, folder).collect()), key=repr)
    assert got == brute(docs) and any(r[7] > 0 for r in got)
