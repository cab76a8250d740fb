import hashlib

from hypothesis import given
from hypothesis import strategies as st

from glyphgrove.llm import chat

PIECES = st.lists(st.sampled_from(["#", "##", "###", "</turn>", "</", "\\", " ", "\n", "a", "é", "### user: ", ":"]), max_size=8).map("".join)
ROWS = "conv_id long, turn long, role string, text string, formatted int"


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "so: odd\n#role"]), PIECES), max_size=6))
def test_turns_are_read_back(turns):
    rendered = chat.turn_template(turns)
    assert chat.read_back(rendered) == turns
    formatted, spans, rewrites = chat.locate(turns, chat.turn_template)
    assert formatted == rendered and rewrites == []
    for (role, text), (start, stop, a, b) in zip(turns, spans, strict=True):
        assert chat.read_back(rendered[start:stop]) == [(role, text)]
        assert chat.unescape(rendered[a:b]) == text


def test_a_template_that_rewrites_history_is_found():
    def last_only(turns):
        return "".join(f"[{r}] {t if k == len(turns) - 1 else '...'}\n" for k, (r, t) in enumerate(turns))

    _, _, rewrites = chat.locate([("user", "hello"), ("assistant", "there"), ("user", "again")], last_only)
    assert rewrites == [1, 2]


def want(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(docs, **options):
    found = chat.digests(chat.format_conversations(docs, **options)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found}


def test_digests_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()]
    assert got(docs) == want(rows)


def test_odd_rows_and_long_conversations(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", None, 1), (2, None, None, "", 1),
            (None, 0, "assistant", "no id", 1), (None, 0, "user", "### x </turn>\n\\", 1), (3, 0, "assistant", "y" * 100_000, 1)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k} </turn>", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, ROWS)
    for section in (1, 64, 1000):
        assert got(docs, section=section) == want([r[:4] for r in rows])
    assert got(docs.limit(0)) == {}


def test_black_box_templates_see_the_whole_conversation(spark):
    def numbered(turns):
        return "HEAD\n" + "".join(f"{k} {r}: {t}\n" for k, (r, t) in enumerate(turns))

    def shortened(turns):
        return "".join(f"{r}: {t if k >= len(turns) - 70 else '...'}\n" for k, (r, t) in enumerate(turns))

    turns = [("assistant" if k % 2 else "user", f"turn {k}") for k in range(80)]
    docs = spark.createDataFrame([(9, k, r, t, 0) for k, (r, t) in enumerate(turns)], ROWS)
    for template, rewrites in ((numbered, []), (shortened, list(range(70, 80)))):
        found = chat.format_conversations(docs, template).collect()
        assert [(r["section"], r["formatted"], r["rewrites"]) for r in found] == [(0, template(turns), rewrites)]
    assert len(chat.format_conversations(docs, numbered, local=True).collect()) == 2
