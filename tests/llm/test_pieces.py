import random

import pytest
import sentencepiece

from millrace.llm import pieces
from tests.llm import edge

POOL = ["a", "b", "the", " ", "  ", "     ", "\n", "\t", "é", "日", "本", "😀", "ing", "tion", "er", "1", "2024", ".", "▁", "in", "<s>", "\r", "\x00"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_are_the_models_own(library):
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choices(POOL, k=r.randint(0, 60)))
        ids = pieces.encode(text)
        assert ids == library.encode(text), text
        assert pieces.decode(ids) == text.replace("▁", " ")


def test_streaming_in_any_chunks_and_a_bounded_window():
    model = pieces._loaded(pieces.MODEL)[0]
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choices(POOL, k=r.randint(1, 60)))
        stream, rest, out = pieces.Stream(model), model.prefix + text.replace("▁", " "), []
        while rest:
            k = r.randint(1, 9)
            out += stream.feed(rest[:k])
            rest = rest[k:]
        assert out + stream.finish() == pieces.encode(text)
    stream, most = pieces.Stream(model), 0
    for c in "abcdefghij" * 3000:
        stream.feed(c)
        most = max(most, len(stream.text))
    assert most < 2 * model.longest


def test_ids_are_the_same_when_states_are_forgotten_all_the_time(library):
    model = pieces.Model(pieces.MODEL)
    model.prepare(states=50)
    r = random.Random(4)
    for _ in range(200):
        text = edge.words(r.random(), 20) + "".join(r.choices(POOL, k=r.randint(1, 60)))
        stream = pieces.Stream(model)
        ids = stream.feed(model.prefix) + stream.feed(text.replace("▁", " ")) + stream.finish()
        assert ids == library.encode(text) and len(model.made) <= 60


def test_ids_are_committed_as_soon_as_all_surviving_paths_meet():
    model, stream, early = pieces._loaded(pieces.MODEL)[0], None, 0
    text = " " + edge.words(9, 400)
    stream = pieces.Stream(model)
    for k, c in enumerate(text):
        early += len(stream.feed(c))
        # Nothing stays open but what a piece may still cross, and its way to the last commit.
        open_ = stream.state
        assert open_.meeting() == 0 and all(open_.text[i:] in model.beginnings or i == len(open_.text) for i in open_.alive)
    rest = stream.finish()
    assert early + len(rest) == len(pieces.encode(text[1:])) and len(rest) <= 4


def invented(seed, n):
    r = random.Random(seed)
    syllables = ("the", "ing", "er", "on", "an", "re", "nd", "ha", "tion", "es", "or", "ti", "en", "at", "ed", "nt", "sh", "ly", "ble", "wh")
    return ["".join(r.choices(syllables, k=r.randint(1, 5))) for _ in range(n)]


def test_beginnings_of_words_that_go_on_alike_share_a_state(library):
    model = pieces.Model(pieces.MODEL)
    model.prepare()
    words, ends = invented(7, 20_000), set()
    stream = pieces.Stream(model)
    for word in words:
        stream.feed(" " + word)
        ends.add(id(stream.state))
        stream.finish()
    # 24,404 states were made of these words, and 7,108 of them at an end, when each was told by all that was read since the last commit.
    assert len(ends) < 5_000 and len(model.made) < 16_000
    keys = {(s.text, s.back, s.first) for s in model.made}
    assert len(keys) == len(model.made) and all(s.first is None or s.alive[0] == 0 for s in model.made)
    text = " ".join(words)
    assert pieces.encode(text) == library.encode(text)


def test_a_partition_can_leave_nothing_behind(spark):
    pieces.release()
    model, memory = pieces._loaded(pieces.MODEL)
    text = " ".join(invented(10, 500))
    ids = pieces.encode(text)
    assert memory and len(model.made) > 100 and model.joint.cache_info().currsize
    pieces.release()
    assert not memory and not memory.older and model.made == [model.root] == [memory.stream.state]
    assert not model.root and not model.joint.cache_info().currsize and not model.edges.cache_info().currsize
    assert pieces.encode(text) == ids
    docs = edge.plain(spark, [(k, text, "en", "s", 1) for k in range(4)]).repartition(2)
    assert [r["ids"] for r in pieces.encoded(docs, lasting=False).collect()] == [ids] * 4


def test_pieces_follow_each_other_as_merging_tells():
    r = random.Random(8)
    seen = set()
    for _ in range(300):
        # Scores with ties, and wholes that score more than their parts.
        texts = {"".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(r.randint(3, 25))}
        model = object.__new__(pieces.Model)
        model.merging, model.prefix, model.bytes, model.unknown = True, "", None, 0
        model.scores = {p: float(-r.randint(1, 8) if r.random() < 0.3 else -len(p) * 10 - k) for k, p in enumerate(sorted(texts))}
        model.ids = {p: k + 1 for k, p in enumerate(model.scores)}
        model.prepare()
        for left in [*texts, "d"]:
            for right in [*texts, "d"]:
                told = model.joint(left, right)
                assert told == (model.merged(left + right) == [left, right]), (model.scores, left, right)
                seen.add((told, *(e and e[0] for e in (model.edges(left), model.edges(right)))))
    assert len(seen) > 8


def test_long_texts_are_cut_into_portions_between_stretches():
    model, r = pieces._loaded(pieces.MODEL)[0], random.Random(9)
    for _ in range(500):
        text = "".join(r.choices([*POOL, " " * 30, "x" * 30, "!" * 30, "\n\n"], k=r.randint(0, 60)))
        portions = list(model.portions(text, r.randint(1, 20)))
        assert [x for p in portions for x in p] == model.stretch.findall(text) and "".join(map("".join, portions)) == text


def test_unigram_models_take_the_greatest_sum():
    model = object.__new__(pieces.Model)
    model.merging, model.prefix, model.bytes, model.unknown = False, "", None, 0
    scores = {"a": -1.0, "b": -1.5, "ab": -2.2, "aba": -2.0, "bab": -2.4, "ba": -2.0}
    model.scores, model.ids = scores, {p: i + 1 for i, p in enumerate(scores)}
    model.prepare()
    model.worst = -12.0
    r = random.Random(3)

    def best(text):
        top = [(0.0, ())]
        for end in range(1, len(text) + 1):
            ways = [
                (top[s][0] + scores.get(text[s:end], -12.0), (*top[s][1], text[s:end]))
                for s in range(max(0, end - 3), end) if text[s:end] in scores or end - s == 1
            ]
            top.append(max(ways, key=lambda w: w[0]))
        return top[-1][0]

    spelled = {i: p for p, i in model.ids.items()}
    for _ in range(300):
        text = "".join(r.choices("abx", weights=(5, 5, 1), k=r.randint(1, 40)))
        stream = pieces.Stream(model)
        ids = stream.feed(text[:7]) + stream.feed(text[7:]) + stream.finish()
        assert sum(scores.get(spelled.get(i, ""), -12.0) for i in ids) == pytest.approx(best(text))


def test_awkward_documents_round_trip(spark, library):
    docs, texts = edge.documents(spark)
    out = pieces.encoded(docs, keep=("doc_id",))
    got = sorted(repr((r["doc_id"], r["ids"], r["n_ids"], r["round_trip"])) for r in out.collect())
    ids = lambda t: library.encode(t) if t else []
    assert got == sorted(repr((d, ids(t), len(ids(t)), True)) for d, t in texts)
    back = pieces.decoded(out.select("doc_id", "ids"))
    assert sorted(repr(tuple(r)) for r in back.collect()) == sorted(repr((d, t or "")) for d, t in texts)
    assert pieces.encoded(docs.limit(0)).count() == 0
