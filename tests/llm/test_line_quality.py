from glyphgrove.llm import line_quality
from tests.llm.conftest import ODD


LETTERS = str.maketrans("0123456789", "abcdefghij")


def brute(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    inside = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def facts(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_counts_equal_brute_force(documents, texts):
    for r in line_quality.judge(documents).collect():
        assert facts(r) == brute(texts[r["doc_id"]])
        n, repeated = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def rows_with_a_common_line():
    # digits count as equal, so the numbers are spelled in letters
    body = lambda k, n: " ".join(f"w{k}q{j}".translate(LETTERS) for j in range(n))
    rows = []
    for k in range(40):
        # host a: every text holds the notice; in a few it is nearly all there is
        notice = "Please  SUBSCRIBE to our newsletter 2024 " + " ".join(f"legal{j}" for j in range(60))
        rows.append((k, f"{body(k, 20 if k < 5 else 200)}\n{notice}\n", "a"))
        rows.append((100 + k, f"{body(100 + k, 80)}\n{'only here ' * 5}", "b"))
    rows += [(200 + k, "same text " + body(7, 90), "c") for k in range(60)]
    return rows


def test_frequent_lines_deplete_documents(spark):
    docs = spark.createDataFrame(rows_with_a_common_line(), "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in line_quality.judge(docs, line_docs=20).collect()}
    assert all(not found[k]["kept"] for k in range(5))
    assert all(found[k]["kept"] and found[k]["left_words"] == 200 for k in range(5, 40))
    # a host with few texts and a text copied many times lose nothing
    assert all(found[k]["kept"] and found[k]["left_words"] == found[k]["n_words"] for k in range(200, 260))
    cleaned = {r["doc_id"]: r["text"] for r in line_quality.without_frequent_lines(docs).collect()}
    assert "SUBSCRIBE" not in cleaned[9] and cleaned[200] == rows_with_a_common_line()[80][1]


def test_odd_rows(odd, nothing):
    found = line_quality.judge(odd).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert facts(r) in [brute(o[1]) for o in ODD if o[0] == r["doc_id"]]
    cleaned = line_quality.without_frequent_lines(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == len(ODD)
    assert line_quality.judge(nothing).count() == 0


def test_clean_texts_change_no_other_row(spark):
    rows = rows_with_a_common_line()
    schema = "doc_id long, text string, source string"
    more = [(10_000 + k, " ".join(f"z{k}y{j}".translate(LETTERS) for j in range(80)), "a") for k in range(2500)]
    before = {r["doc_id"]: r for r in line_quality.judge(spark.createDataFrame(rows, schema)).collect()}
    after = {r["doc_id"]: r for r in line_quality.judge(spark.createDataFrame(rows + more, schema)).collect()}
    assert all(after[k] == r for k, r in before.items()) and not before[0]["kept"]
    assert all(after[r[0]]["kept"] for r in more)
