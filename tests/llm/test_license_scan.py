import re

from glyphgrove.llm import license_scan
from tests.llm.conftest import LOWER, ODD


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, names = [], set()
    for phrase, name in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                names.add(name)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names))


def found(docs):
    rows = license_scan.scan(docs, license_scan.build_index(docs)).collect()
    return [(r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]), r) for r in rows]


def test_phrases_equal_brute_force(documents, texts):
    rows = found(documents)
    assert len(rows) == len(texts)
    for i, got, r in rows:
        assert got == brute(texts[i])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_places_and_notices(spark):
    mit = license_scan.NOTICES[0][0]
    rows = [
        (1, "MIT License MIT license. Apache-License / GNU general\nPublic LICENSE cc by CC-BY"),
        (2, f"Some words before. {mit.capitalize()}, and more"),
        (3, mit.replace("permission is", "permission was")),
        (4, "Licensed under the Apache License, Version 2.0."),
        (5, "gnu general public licence; gnu gnu general public license"),
        (6, "mit license " * 3000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: (g, r) for i, g, r in found(docs)}
    for i, text in rows:
        assert got[i][0] == brute(text)
    assert got[1][1]["labels"] == "apache,cc-by,gpl,mit"
    assert got[2][1]["labels"] == "mit-text"
    assert got[3][1]["labels"] == ""
    assert got[4][1]["labels"] == "apache,apache-2.0"
    assert got[6][0][1] == 3000


def test_odd_rows(odd, nothing):
    rows = found(odd)
    assert len(rows) == len(ODD)
    for i, got, r in rows:
        assert got in [brute(o[1]) for o in ODD if o[0] == i]
        assert r["labels"] == "" and 0 <= r["score"] <= 1
    assert found(nothing) == []


def test_an_altered_notice_after_a_true_one_hides_nothing(spark):
    mit = license_scan.NOTICES[0][0]
    altered = mit.replace("permission is", "permission was")
    rows = [(1, mit), (2, f"{mit}. {altered}"), (3, f"{altered}. {mit}"), (4, f"{altered}. {altered}")]
    labels = {i: r["labels"] for i, _, r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert labels[1] and labels[1] == labels[2] == labels[3] and labels[4] == ""


def brute_labels(text, index):
    """Labels and best share, template by template and start by start."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    names, top = set(), 0.0
    for k, t in enumerate(index.templates):
        rare = [(i, x, dict((e[:2], e[2]) for e in index.postings[x])[k, i]) for i, x in enumerate(t.words) if x in index.postings]
        offset = next(i for i in range(len(t.words)) if t.words[i : i + len(t.key)] == t.key)
        for start in range(-len(t.words), len(w)):
            share = sum(v for i, x, v in sorted(rare) if 0 <= start + i < len(w) and w[start + i] == x) / index.needs[k]
            top = max(top, share)
            at = start + offset
            if share >= license_scan.ENOUGH - 1e-12 and at >= 0 and w[at : at + len(t.key)] == t.key:
                names.add(t.label)
    return ",".join(sorted(names)), top


def test_labels_equal_brute_force(spark):
    """Cut, altered, joined and nested notices among other words, against every start of every template."""
    import random

    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [rng.choice("alpha beta the of software license gamma delta in and".split()) for _ in range(30)]
        for _ in range(rng.randrange(3)):
            own = rng.choice([t for t, _, _ in license_scan.NOTICES] + list(license_scan.PHRASES)).split()
            cut = rng.randrange(len(own) // 2 + 1)
            own = [x if rng.random() > 0.05 * rng.randrange(3) else "altered" for x in own[cut if rng.random() < 0.3 else 0 :]]
            at = rng.randrange(len(words))
            words[at:at] = own
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = license_scan.build_index(docs)
    texts = dict(rows)
    seen = set()
    for r in license_scan.scan(docs, index).collect():
        labels, top = brute_labels(texts[r["doc_id"]], index)
        assert r["labels"] == labels
        assert r["n_base"] > 0 or abs(r["score"] - min(1.0, top)) < 1e-9
        seen |= set(labels.split(","))
    assert len(seen) > 12


def test_own_templates(spark):
    own = [license_scan.Template("our house licence allows everything".split(), "house licence".split(), "house", False)]
    docs = spark.createDataFrame([(1, "Our house licence allows everything!"), (2, "our house")], "doc_id long, text string")
    rows = license_scan.scan(docs, license_scan.build_index(docs, own=own)).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {1: "house", 2: ""}
