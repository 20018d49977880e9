from collections import defaultdict

from millrace.llm import chat

MESSAGES = [
    (1, 0, "user", "First point here\nSecond point"),
    (1, 1, "assistant", "Answer one\n\n\n\nmore"),
    (1, 2, "user", "a wrote:\n> first   POINT here\nI disagree"),
    (1, 3, "assistant", ">> First point here\n> I disagree\nWhy so"),
    (1, 4, "user", "> never said this\nok"),
    (1, 5, None, "> > answer ONE\nnested only"),
    (1, 6, "user", "> Why so\n> Second point\nboth"),
    (2, 0, "user", "> First point here\nother conversation"),
    (2, 1, "user", "same\n> same"),
    (2, 2, "user", "same"),
    (2, 3, "user", "> same"),
    (3, None, "user", None),
    (3, 0, "user", ""),
    (None, 0, "user", "Null talk"),
    (None, 1, "user", ">Null talk\nyes"),
    (4, 0, "user", "x"),
    (4, 0, "user", "x"),
    (5, 0, "user", "a > b stays\n> "),
]
SCHEMA = "conv_id long, turn long, role string, text string, position string, piece string, level string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA)


def test_links_parents_and_text(spark):
    out = chat.conversations(frame(spark, MESSAGES)).collect()
    assert len(out) == len(MESSAGES)
    got = {(r["conv_id"], r["position"]): r for r in out}
    told = lambda c, p: (got[c, p]["parent"], got[c, p]["level"], got[c, p]["n_linked"], got[c, p]["text"])
    assert told(1, 0) == (None, None, 0, "First point here\nSecond point")
    assert told(1, 1) == (0, None, 0, "Answer one\n\n\n\nmore")
    assert told(1, 2) == (0, 1, 1, "I disagree")
    assert told(1, 3) == (2, 1, 2, "Why so")
    assert told(1, 4) == (3, None, 0, "ok")
    assert told(1, 5) == (1, 2, 1, "nested only")
    assert told(1, 6) == (3, 1, 2, "both")
    assert told(2, 0) == (None, None, 0, "other conversation")
    assert told(2, 1)[:3] == (0, None, 0)
    assert told(2, 3) == (2, 1, 1, "")
    assert told(None, 1) == (0, 1, 1, "yes")
    assert told(5, 0) == (None, None, 0, "a > b stays")
    assert got[1, 5]["formatted"] == "<|unknown|>\nnested only\n<|end|>\n"
    assert [got[4, k]["parent"] for k in (0, 1)] == [None, 0] and got[3, 0]["turn"] is None
    assert all(r["parent"] is None or r["parent"] < r["position"] for r in out)


def test_a_long_conversation_over_many_pieces_as_plain_code(spark):
    rows, said, want = [], defaultdict(int), {}
    for t in range(600):
        line = f"point {t % 37}"
        if t % 3 == 2:
            quote = f"point {(t * 7) % 41}"
            rows.append((7, t, "user", f"> {quote}\n{line}"))
            want[t] = said.get(quote, t - 1)
        else:
            rows.append((7, t, "user", line))
            want[t] = t - 1 if t else None
        said[line] = t
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chat.conversations(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["turn"]: r["parent"] for r in out} == want and [r["position"] == r["turn"] for r in out].count(False) == 0


def test_passages_and_sentences_link_however_they_are_wrapped(spark):
    rows = [
        (1, 0, "user", "The bones lie in the\nupper layer. We dig there next week.\n\nThanks"),
        (1, 1, "user", "Bring a map. Also bring water! Who drives?"),
        (1, 2, "user", "Thanks"),
        (1, 3, "user", "> The bones lie in\n> the upper layer. We dig there\n> next week.\nGood"),
        (1, 4, "user", "> Also bring water!\nYes"),
        (1, 5, "user", ">> bring a map.   Also\n>> bring WATER!\nBoth"),
        (1, 6, "user", "> Thanks\n\n> Bring a map. Also bring\n> water! Who drives?\nMe"),
        (1, 7, "user", "> The bones lie in the\n> upper layer. We never\n> dig there.\nWhy"),
        (1, 8, "user", "> The bones lie in the upper\nlayer.\nCut"),
        (2, 0, "user", "Alpha part one. Beta.\nThanks"),
        (2, 1, "user", "Thanks"),
        (2, 2, "user", "> Alpha part\n> one. Beta.\n> Thanks\nok"),
    ]
    got = {(r["conv_id"], r["position"]): (r["parent"], r["level"], r["n_linked"], r["text"]) for r in chat.conversations(frame(spark, rows)).collect()}
    assert got[1, 3] == (0, 1, 3, "Good") and got[1, 4] == (1, 1, 1, "Yes") and got[1, 5] == (1, 2, 2, "Both")
    assert got[1, 6][:3] == (2, 1, 3) and got[1, 7] == (0, 1, 1, "Why") and got[1, 8][0] == 7
    assert got[2, 2] == (0, 1, 3, "ok")


def test_empty_table(spark):
    assert chat.conversations(frame(spark, MESSAGES).limit(0)).count() == 0
