"""SentencePiece encoding and decoding by a streaming Viterbi search.

The trellis has a node for each place between two characters, and an edge for
each piece that spells the characters between two nodes. A node keeps one
backpointer: the best way to reach it. Nodes from which some piece goes on past
the last character read survive; they lie within the longest piece's length. When
the backpointer paths of all surviving nodes run through one node, no later text
can change what lies before it: its ids are committed, and what was kept for them
is dropped. So a text of any length is encoded in bounded memory, character by
character, and no cut is ever made at an arbitrary place.

What "best" means depends on the model's type. For a unigram model it is the
greatest sum of scores. A BPE model merges pairs in order of rank, and greatest
sums would give other ids than the model does. There a piece may follow another
only if merging their joint text gives just these two pieces back; each node
then has exactly one admissible way to reach it, and the path is the one that
merging the whole text gives. Both are the same search with other edge weights.

All that the search keeps is told by the characters since the last commit, the
surviving paths through them and, for BPE where a piece may still begin right there,
the piece before them. Such states are remembered with the step that each character
takes from them: where words go on alike, a step is one look into a dictionary. Where two characters meet that no piece has side by side, all paths
meet. What the search committed between two such places is remembered too, as
most words recur. Both memories are bounded; what they forget is searched again.

Defined results: null and empty texts have no ids; characters in no piece become
byte pieces, or the unknown piece if the model has none; the model's space mark
U+2581 in a text reads as a space, as in the model's own library, so that texts
round-trip up to it; a null doc_id passes through; repeated rows get equal
results; an empty table gives no rows; other columns are ignored, so their names
cannot clash. Texts are encoded whole.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._arrow import slices

#: A parameter of all functions below; the file must be on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: States of the search that a worker remembers, about half a kilobyte each.
STATES = 1 << 18
#: Stretches between certain meeting places, and characters in them, that it remembers twice.
STRETCHES, CHARACTERS = 1 << 18, 1 << 22
#: Characters of a text whose stretches are listed at once.
PORTION = 1 << 18
_UNKNOWN_COST = 10.0


def _stretches(pieces: Iterable[str]) -> re.Pattern:
    """Finds the stretches between nodes that all paths cross: where two characters meet that no piece has side by side.

    Only such nodes are used as a pattern finds fast: before a space, around line
    ends, and after a run of letters. Letters that some piece has before another
    character count as other characters.
    """
    pairs = {(p[i], p[i + 1]) for p in pieces for i in range(len(p) - 1)}
    if any(b == " " and a != " " for a, b in pairs):
        return re.compile(r"(?s).+")
    lines = "" if any("\n" in x for x in pairs) else "\n"
    odd: set[str] = set()
    letter = re.compile(r"[^\W\d_]")
    while found := {a for a, b in pairs if letter.match(a) and a not in odd and (not letter.match(b) or b in odd)}:
        odd |= found
    letters = r"[^\W\d_" + "".join(map(re.escape, sorted(odd))) + "]"
    other = rf"(?:(?!{letters})[^ {lines}])"
    return re.compile(("\n|" if lines else "") + rf" *{letters}+| *{other}+{letters}*| +")


class Model:
    """Pieces, scores and type of a SentencePiece model file with the identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        reader = SentencePieceProcessor(model_file=path)
        proto.ParseFromString(reader.serialized_model_proto())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and space marks before words are supported")
        self.merging = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.prefix = " " if rules.add_dummy_prefix else ""
        kinds = proto.SentencePiece
        plain = {i: p for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.ids = {p.piece.replace(MARK, " "): i for i, p in plain.items()}
        self.scores = {p.piece.replace(MARK, " "): p.score for p in plain.values()}
        self.bytes = [reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None
        self.unknown = reader.unk_id()
        self.spelled = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
            else p.piece.replace(MARK, " ").encode() if i in plain
            else " ⁇ ".encode() if p.type == kinds.UNKNOWN else b""
            for i, p in enumerate(proto.pieces)
        ]
        self.prepare()

    def prepare(self, states: int = STATES) -> None:
        """What the search needs of ids and scores; no states are known yet."""
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - _UNKNOWN_COST
        #: Proper beginnings of pieces, and characters that some piece has side by side.
        self.beginnings = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.joint = lru_cache(1 << 16)(self._joint)
        self.edges = lru_cache(1 << 16)(self._edges)
        self.states, self.made = states, []
        self.forget()
        self.stretch = _stretches(self.ids)

    def forget(self) -> None:
        for state in self.made:
            state.clear()
        #: States in order, states by key, and tuples and ids that many states share.
        self.made, self.known, self.once = [], {}, {}
        self.root = self.state("", (0,), () if self.merging else (0.0,), (0,), None)

    def merges(self, text: str) -> Iterator[tuple[float, int, list[str]]]:
        """BPE of a short text by its definition: merge the best adjacent pair, leftmost first, while there is one.

        Yields each merge's score, the place of the part made, and all parts then.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield best, at, parts

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        for _, _, parts in self.merges(text):  # noqa: B007
            pass
        return parts

    def _edges(self, piece: str) -> tuple[bool, list, list] | None:
        """How merging a piece by itself changes its last part, and its first: scores and the part after each; None if it is not whole.

        The flag tells that no merge has a greater score than one before it.
        """
        falling, lowest, last, first, parts = True, math.inf, [], [], list(piece)
        for score, at, parts in self.merges(piece):
            falling &= score <= lowest
            lowest = score
            if at == len(parts) - 1:
                last.append((score, parts[-1]))
            if at == 0:
                first.append((score, parts[0]))
        none = (-math.inf, "")
        return (falling, [*last, none], [*first, none]) if len(parts) == 1 else None

    def _joint(self, left: str, right: str) -> bool:
        """merged(left + right) == [left, right].

        Both sides merge as they do alone until a merge crosses, so only the two parts that
        meet count: where scores fall, the next change of either tells when it is its turn.
        """
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return False
        if not (a[0] and b[0]):
            return self.merged(left + right) == [left, right]
        get, lasts, firsts = self.scores.get, iter(a[1]), iter(b[2])
        x, y, (p, last), (q, first) = left[-1], right[0], next(lasts), next(firsts)
        while True:
            crossing = get(x + y, -math.inf)
            if crossing > p and crossing >= q:
                return False
            if p < q:
                y, (q, first) = first, next(firsts)
            elif p == -math.inf:
                return True
            else:
                x, (p, last) = last, next(lasts)

    def portions(self, text: str, size: int = PORTION) -> Iterator[list[str]]:
        """The stretches of a text, those of about `size` characters at a time."""
        at, end = 0, size
        while end < len(text):
            *sure, cut = self.stretch.findall(text, at, end)
            if sure:
                yield sure
                at = end - len(cut)
            end = at + max(size, 2 * len(cut))
        yield self.stretch.findall(text, at)

    def spell(self, pieces: Iterable[str]) -> bytes:
        """The pieces' ids as 32-bit integers."""
        out = array("i")
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def state(self, text: str, back: tuple, cost: tuple, alive: tuple, first: str | None) -> State:
        """The state with these fields, which it has once."""
        found = self.known.get((first, text, back))
        if found is None:
            back, alive = self.once.setdefault(back, back), self.once.setdefault(alive, alive)
            found = self.known[first, text, back] = State(self, text, back, cost, alive, first)
            self.made.append(found)
        return found


class State(dict):
    """The open end of the trellis; as a dictionary, character -> (ids that it commits or None, the state it leads to).

    The empty string leads to the root, and commits all. text: the characters since the last
    commit; back: per node on the path of a surviving node where its last piece begins, 0 for
    other nodes; cost: per node, of unigram models; alive: the surviving nodes, in order; first:
    the piece before the text, where that matters. What does not matter for later steps is left
    out of them, so that many beginnings of words lead to one state.
    """

    __slots__ = ("model", "text", "back", "cost", "alive", "first")

    def __init__(self, model: Model, text: str, back: tuple, cost: tuple, alive: tuple, first: str | None):
        self.model, self.text, self.back, self.cost, self.alive, self.first = model, text, back, cost, alive, first

    def read(self, c: str) -> tuple[bytes | None, State]:
        """The step of one more node: what all surviving paths then share is committed."""
        m, text, cost, first, kept = self.model, self.text + c, self.cost, self.first, []
        back = [*self.back, -1]
        n, best = len(text), math.inf
        start, ids, beginnings = -1, m.ids, m.beginnings
        for at in self.alive:
            piece = text[at:]
            if piece in beginnings:
                kept.append(at)
            if piece in ids or at == n - 1:
                if not m.merging:
                    total = cost[at] - m.scores.get(piece, m.worst)
                    if total < best:
                        best, start = total, at
                elif start < 0:
                    before = text[back[at] : at] if at else first
                    # A piece that follows another admissibly is whole by itself, too.
                    if at == n - 1 or (m.edges(piece) if before is None else m.joint(before, piece)):
                        start = at
        kept.append(n)
        back[n] = start
        if not m.merging:
            cost = (*cost, best)
        node, done = meeting(back, kept) if kept[0] else 0, None
        if node:
            pieces = path(text, back, node)
            done, first = m.spell(pieces), pieces[-1]
            done = m.once.setdefault(done, done)
            if node < n and first[-1] + text[node] not in m.pairs:
                first = None  # whatever is before, no piece crosses
        if kept[0] > node:
            first = None  # no later piece begins right after it
        told = [0] * (n - node + 1)
        for at in kept:
            while at > node and not told[at - node]:
                told[at - node] = back[at] - node
                at = back[at]
        cost = tuple([x - cost[node] for x in cost[node:]]) if node and cost else cost
        return done, m.state(text[node:], tuple(told), cost, tuple([at - node for at in kept]), first)

    def meeting(self) -> int:
        """The latest node that the paths of all surviving nodes cross."""
        return meeting(self.back, self.alive)

    def __missing__(self, c: str) -> tuple[bytes | None, State]:
        m = self.model
        if len(m.made) >= m.states:
            m.forget()
        if not c:
            ids = m.spell(path(self.text, self.back, len(self.text)))
            step = m.once.setdefault((ids, None), (ids, m.root))
        elif not self.text and self.first and self.first[-1] + c not in m.pairs:
            step = m.root[c]
        else:
            step = self.read(c)
        self[c] = step
        return step


def path(text: str, back: Sequence[int], node: int) -> list[str]:
    """The pieces on the path to a node."""
    out = []
    while node:
        out.append(text[back[node] : node])
        node = back[node]
    return out[::-1]


def meeting(back: Sequence[int], alive: Sequence[int]) -> int:
    met = alive[0]
    for node in alive[1:]:
        while node != met:
            if node > met:
                node = back[node]
            else:
                met = back[met]
    return met


class Stream:
    """Encodes characters as they come: feed() and finish() yield the ids that are certain by then."""

    def __init__(self, model: Model):
        self.state = model.root

    @property
    def text(self) -> str:
        """The characters whose ids are open."""
        return self.state.text

    def bytes_of(self, characters: str) -> list[bytes]:
        out, state = [], self.state
        for c in characters:
            ids, state = state[c]
            if ids:
                out.append(ids)
        self.state = state
        return out

    def rest(self) -> bytes:
        ids, self.state = self.state[""]
        return ids

    def feed(self, characters: str) -> list[int]:
        return np.frombuffer(b"".join(self.bytes_of(characters)), np.int32).tolist()

    def finish(self) -> list[int]:
        return np.frombuffer(self.rest(), np.int32).tolist()


class Memory(dict):
    """Stretch -> its ids; a stretch not known is searched."""

    def __init__(self, model: Model):
        super().__init__()
        self.stream = Stream(model)
        self.forget()

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = b"".join(self.stream.bytes_of(stretch)) + self.stream.rest()
        if len(self) >= STRETCHES or self.characters >= CHARACTERS:
            self.older, self.characters = dict(self), 0
            self.clear()
        self.characters += len(stretch)
        self[stretch] = ids
        return ids


    def forget(self) -> None:
        self.clear()
        self.older, self.characters = {}, 0
        self.stream = Stream(self.stream.state.model)


@lru_cache(4)
def _loaded(path: str) -> tuple[Model, Memory]:
    model = Model(path)
    return model, Memory(model)


def release(path: str = MODEL) -> None:
    """Forgets all that was remembered, which gives its memory back; the model stays loaded."""
    model, memory = _loaded(path)
    model.forget()
    model.joint.cache_clear()
    model.edges.cache_clear()
    memory.forget()


def _encoded(text: str | None, path: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    model, memory = _loaded(path)
    portions = model.portions(model.prefix + text.replace(MARK, " "))
    return np.frombuffer(b"".join([b"".join(map(memory.__getitem__, x)) for x in portions]), np.int32)


def encode(text: str | None, path: str = MODEL) -> list[int]:
    return _encoded(text, path).tolist()


def decode(ids: Iterable[int], path: str = MODEL) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    model, _ = _loaded(path)
    text = b"".join(map(model.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def encoded(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",), lasting: bool = True) -> DataFrame:
    """Columns `keep`, and n_ids, ids, round_trip (whether decoding the ids gives the text back).

    lasting: whether a worker remembers stretches and states from one partition to the next. That
    saves time; if not, other work of the same workers has the memory.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            parts, lengths, same = [], [0], []
            for text in batch.column("text").to_pylist():
                ids = _encoded(text, path)
                parts.append(ids)
                lengths.append(len(ids))
                same.append(decode(ids.tolist(), path) == (text or "").replace(MARK, " "))
            flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array(lengths[1:], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), flat),
                    pa.array(same, pa.bool_()),
                ],
                [*keep, "n_ids", "ids", "round_trip"],
            )
        if not lasting:
            release(path)

    kinds = dict(docs.dtypes)
    told = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(batches, f"{told}, n_ids int, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, and text: the decoded `ids`; null ids give the empty text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            texts = [decode(x or (), path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    kinds = dict(tokens.dtypes)
    return tokens.select(*keep, "ids").mapInArrow(batches, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
