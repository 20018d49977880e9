"""Quality rules by weak supervision.

Each rule looks at counts of one document and votes bad, good or abstains. No
rule decides alone. Expectation-maximisation over the votes of all documents
estimates, without labels, how often each rule casts each vote on good and on
bad documents, and with it the rule's accuracy; a document's posterior
probability of being good then replaces the test that all rules must pass.

The model needs only how many documents cast each combination of votes. There
are at most 3**rules combinations, so what reaches the driver is bounded
whatever the size of the corpus, and it counts every document.

Counting runs on Arrow batches in Python: finding repeated windows in a text
needs its word ids side by side, which numpy does in a few passes.

Defined results: null text has no words and is not kept; an empty table gives
no rows; repeated rows get equal results; other columns are ignored, so their
names cannot clash. Texts are always read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _store
from millrace.llm._arrow import slices

BAD, ABSTAIN, GOOD = 0, 1, 2
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_lower", "n_shouts", "n_stops", "n_digits",
)


def repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside windows of three words that occur twice or more, the first occurrence included."""
    if len(ids) < 4:
        return 0
    if kinds < 2_000_000:  # three ids fit 63 bits
        windows = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)
        windows = pairs[:-1].astype(np.int64) * kinds + ids[2:]
    ranked = np.sort(windows)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= hit
    return int(inside.sum())


def count(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    data = (text or "").encode()
    words = data.split()  # for bytes: at space, and 9 to 13
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    without = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(words),
        len(text or "") - without(b" \t\n\x0b\x0c\r"),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(ids, len(known)),
        len(lines),
        len(known),
        without(UPPER),
        without(LOWER),
        data.count(b"!!"),
        without(b".,;:?"),
        without(b"0123456789"),
    )


def counts(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """Column `keep` and COUNTS of every row. keep may be a struct that holds the text."""
    inside = keep != "doc_id"

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            texts = batch.column(keep).field("text") if inside else batch.column("text")
            found = np.array([count(x) for x in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(keep), *[pa.array(found[:, k]) for k in range(len(COUNTS))]], [keep, *COUNTS]
            )

    kind = dict(docs.dtypes)[keep]
    return docs.select(keep, *[] if inside else ["text"]).mapInArrow(batches, f"{keep} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """Votes bad where SQL condition `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: str
    good: str

    @property
    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN {BAD} WHEN {self.good} THEN {GOOD} ELSE {ABSTAIN} END")


# Most rules see one defect and otherwise abstain: the lack of one defect is no
# sign of quality. The last three see signs of prose, which defects disturb.
RULES = (
    Rule("symbols", "n_symbols > 0.2 * n_words", "false"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "false"),
    Rule("capitals", "n_upper > n_lower", "false"),
    Rule("shouting", "n_shouts > 0.2 * n_words", "false"),
    Rule("copied_lines", "n_dup_lines > 0.5 * n_lines AND n_lines >= 4", "false"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words", "false"),
    # From 2,000 words on as the root of the length: vocabularies grow more slowly than texts.
    Rule("variety", "n_distinct < least(0.1 * n_words, sqrt(20.0 * n_words))", "false"),
    Rule("digits", "n_digits > 0.3 * word_chars", "false"),
    Rule("prose_surface", "false", "n_symbols <= 0.1 * n_words AND n_shouts <= 0.05 * n_words AND n_words > 0"),
    Rule("prose_words", "false", "4 * n_upper < n_lower AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_repeat_words <= 0.3 * n_words"),
    Rule("prose_stops", "n_stops = 0", "n_stops BETWEEN 0.03 * n_words AND 0.5 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_words > 0"),
)


@dataclass(frozen=True)
class VoteModel:
    """prior: of bad. rates[class, rule, vote], class 0: bad, 1: good. posterior(votes): of good."""

    prior: float
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        rule = np.arange(votes.shape[1])
        told = np.log(self.rates)[:, rule[None, :], votes].sum(axis=2)
        gap = told[1] - told[0] + np.log((1 - self.prior) / self.prior)
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))

    @property
    def accuracy(self) -> np.ndarray:
        """Per rule: how often a vote that is cast is right."""
        right = self.prior * self.rates[0, :, BAD] + (1 - self.prior) * self.rates[1, :, GOOD]
        wrong = self.prior * self.rates[0, :, GOOD] + (1 - self.prior) * self.rates[1, :, BAD]
        return right / (right + wrong)


def fit(votes: np.ndarray, n: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over combinations of votes, each cast by n documents.

    Starts from: bad where any rule says bad. Rates are smoothed by one document
    per vote, and a rule is held to be better than chance: no vote of bad may be
    likelier on good documents, nor a vote of good on bad ones.
    """
    bad = np.where((votes == BAD).any(axis=1), 0.95, 0.05)
    model, told = None, -np.inf
    for _ in range(rounds):
        rates = np.empty((2, votes.shape[1], 3))
        for k, weight in enumerate((bad * n, (1 - bad) * n)):
            for v in (BAD, ABSTAIN, GOOD):
                rates[k, :, v] = ((votes == v) * weight[:, None]).sum(axis=0) + 1
        rates /= rates.sum(axis=2, keepdims=True)
        for v, k in ((BAD, 0), (GOOD, 1)):
            mean = rates[:, :, v].mean(axis=0)
            wrong = rates[k, :, v] < rates[1 - k, :, v]
            rates[:, wrong, v] = mean[wrong]
        rates /= rates.sum(axis=2, keepdims=True)
        prior = ((bad * n).sum() + 1) / (n.sum() + 2)
        model = VoteModel(float(prior), rates)
        bad = 1 - model.posterior(votes)
        now = float((bad * n).sum())
        if abs(now - told) < tolerance * max(1.0, now):
            break
        told = now
    return model


def _voted(counted: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return counted.withColumn("votes", F.concat(*[r.vote.cast("string") for r in rules]))


def _posteriors(voted: DataFrame) -> DataFrame:
    """votes and p_good: at most 3 ** rules rows, from the votes of all documents."""
    cast = sorted(voted.groupBy("votes").count().collect(), key=lambda r: r["votes"])
    rows = []
    if cast:
        votes = np.array([[int(v) for v in r["votes"]] for r in cast])
        good = fit(votes, np.array([r["count"] for r in cast], float)).posterior(votes)
        rows = [(r["votes"], float(p)) for r, p in zip(cast, good)]
    return voted.sparkSession.createDataFrame(rows, "votes string, p_good double")


def _verdicts(voted: DataFrame, known: DataFrame, least: float) -> DataFrame:
    return (
        voted.join(F.broadcast(known), "votes")
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, COUNTS, base_failed, votes (one digit per rule), p_good, kept."""
    voted = _store.materialise(_voted(counts(docs), rules), "quality")
    return _verdicts(voted, _posteriors(voted), least)


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Counts twice rather than shuffle texts."""
    known = _posteriors(_voted(counts(docs), rules))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return _verdicts(_voted(counts(rows, "_row"), rules), known, least).filter("kept").select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", *COUNTS[:5], "base_failed", "kept", "p_good", "votes")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
