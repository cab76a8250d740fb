import random

import numpy as np
import pytest

from glyphgrove.llm import secret_scan
from tests.llm.conftest import ODD


def make(seed, n):
    rng = random.Random(seed)
    plain = ["understanding", "internationally", "the", "system", "configuration", "of", "responsibilities", "and",
             "characteristics", "misunderstandings", "telecommunications", "words"]
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    rows, spans = [], {}
    for i in range(n):
        parts = [rng.choice(plain) for _ in range(40)]
        kind = rng.randint(0, 5)
        value = {0: hexes(40), 1: hexes(18), 2: "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16))}.get(kind)
        if value:
            head = {0: 'token = "', 1: "password=", 2: ""}[kind]
            parts.insert(20, f"{head}{value}" + ('"' if kind == 0 else ""))
        elif kind == 3:
            parts.insert(20, "".join(rng.choice("0123456789") for _ in range(16)))
        text = " ".join(parts)
        rows.append((i, text, "src/a"))
        spans[i] = (text.index(value), text.index(value) + len(value)) if value else None
    return rows, spans


@pytest.fixture(scope="module")
def model(spark):
    rows, _ = make(1, 400)
    return secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_held_out_secrets_are_found_and_nothing_else(spark, model):
    rows, spans = make(2, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: (r["start"], r["stop"]) for r in secret_scan.findings(docs, model).collect()}
    assert found == {k: v for k, v in spans.items() if v}


def test_redaction(spark, model):
    rows, spans = make(3, 60)
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    out = {r["doc_id"]: r for r in secret_scan.redact(docs, model).collect()}
    for i, text, _ in rows:
        want = text if not spans[i] else text[: spans[i][0]] + "[SECRET]" + text[spans[i][1] :]
        assert out[i]["text"] == want and out[i]["n_chars"] == len(want)


def test_training_repeats(spark, model):
    rows, _ = make(1, 400)
    again = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7))
    assert all((a == b).all() for a, b in zip(model.threshold, again.threshold, strict=True))


def test_odd_rows(odd, nothing, model):
    assert secret_scan.findings(odd, model).count() == 0
    out = secret_scan.redact(odd, model)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(str(o[1]) for o in ODD)
    empty = secret_scan.train(nothing)
    assert empty.feature == [] and secret_scan.findings(odd, empty).count() == 0


def test_short_and_odd_values_after_key_words_are_candidates():
    def values(text):
        return [text[a:b] for a, b in secret_scan._spans(text)]

    assert values("password=hunter42 and pwd: 'p@ss w0rd' or Secret = \"a!b#c$d\", done") == ["hunter42", "p@ss w0rd", "a!b#c$d"]
    assert values("token=p@ss!0123456789abcdef0123, plain words") == ["p@ss!0123456789abcdef0123"]
    long = "0123456789abcdef0123456789abcdef01234567"
    assert values(f"{long} token={long}. pwd=abc") == [long, long]


def test_corpus_counts_all_texts_and_languages(spark):
    rows = [(k, "the common words " * 50 + "7+7+7", "en") for k in range(40)] + [(k, "zwölf wörter selten", "de") for k in range(2)]
    known = secret_scan.corpus(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"common", "selten"} <= known.words
    assert known.transitions[26, 27] > known.transitions[26, 26] and known.transitions[27, 26] > known.transitions[27, 27]


def test_hostile_texts_take_linear_time():
    import time

    known = secret_scan.Corpus(frozenset({"token", "words"}), np.zeros((28, 28)), frozenset({"tok", "wor"}))
    for text in ("token" * 200_000, "token= " * 140_000, "token='" * 140_000, 'token="x ' * 110_000, "a:" * 500_000,
                 "token" + " " * 1_000_000 + "=", "=" * 1_000_000):
        start = time.time()
        assert len(text) > 900_000 and sum(1 for _ in secret_scan._spans(text)) < 200_000
        assert time.time() - start < 4, text[:20]
    start = time.time()
    assert len(list(secret_scan._found("token" * 200_000, "", known))) == 1
    assert time.time() - start < 4


def test_precision_and_recall_on_planted_findings_of_several_kinds(spark):
    """Secrets of four kinds and look-alikes of four kinds, in texts the model has not seen."""
    rng = random.Random(9)
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = ["understanding", "internationally", "the", "system", "of", "responsibilities", "characteristics", "words"]
    secret = {
        "hex": lambda: f'token = "{pick(hexes, 40)}"', "key": lambda: "AKIA" + pick("ABCDEFGH0123456789", 16),
        "mixed": lambda: f"password={pick(mixed, 24)}", "github": lambda: "ghp_" + pick(mixed, 36)}
    harmless = {
        "uuid": lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), "number": lambda: pick("0123456789", 20),
        "words": lambda: "-".join(rng.choice(plain) for _ in range(4)), "path": lambda: "/".join(rng.choice(plain) for _ in range(4))}

    def texts(n, first):
        rows, kinds = [], {}
        for i in range(first, first + n):
            kind = rng.choice([*secret, *harmless])
            words = [rng.choice(plain) for _ in range(30)]
            words.insert(15, (secret | harmless)[kind]())
            rows.append((i, " ".join(words), "src/a"))
            kinds[i] = kind
        return rows, kinds

    schema = "doc_id long, text string, source string"
    trained, _ = texts(500, 0)
    model = secret_scan.train(spark.createDataFrame(trained, schema))
    rows, kinds = texts(400, 1000)
    found = {r["doc_id"] for r in secret_scan.findings(spark.createDataFrame(rows, schema), model).collect()}
    caught = sum(i in found for i, k in kinds.items() if k in secret) / sum(k in secret for k in kinds.values())
    wrong = sum(kinds[i] in harmless for i in found) / len(found)
    assert caught >= 0.95 and wrong <= 0.03, (caught, wrong)
    prose = [(5000 + k, " ".join(rng.choice(plain) for _ in range(300)), "src/a") for k in range(50)]
    assert secret_scan.findings(spark.createDataFrame(prose, schema), model).count() == 0


def test_redaction_without_a_path(spark, model):
    rows, _ = make(3, 20)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    with_path = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, model).collect()}
    b = {r["doc_id"]: r["text"] for r in secret_scan.redact(with_path, model).collect()}
    assert a == b
