import hashlib
import random
import re

from millrace.llm import _store, secrets
from tests.llm import edge


def brute(text):
    text = text or ""
    found = []
    for order, rule in enumerate(secrets.RULES, 1):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end()))
    found.sort()
    named = lambda xs: ",".join(f"{secrets.RULES[o - 1].kind}:{s}:{e}" for s, o, e in xs)
    base = [x for x in found if x[1] <= 3]
    counts = [sum(x[1] == k for x in found) for k in (1, 2, 3)]
    return (*counts, hashlib.sha256(named(base).encode()).hexdigest(), named(found))


def test_digest_as_brute_force_with_awkward_rows(spark):
    docs, texts = edge.documents(spark)
    out = secrets.digest(secrets.scan(docs, _store.fresh_path(spark, "ledger")))
    got = sorted(map(repr, ((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in out.collect())))
    assert got == sorted(repr((d, *brute(t))) for d, t in texts)
    assert any("assign" in x for x in got) and any("access" in x for x in got) and any("hex" in x for x in got)


def test_empty_table(spark):
    docs, _ = edge.documents(spark)
    assert secrets.digest(secrets.scan(docs.limit(0), _store.fresh_path(spark, "ledger"))).count() == 0


def test_only_unseen_blobs_and_changed_rules_are_scanned(spark):
    ledger = _store.fresh_path(spark, "ledger")
    old = edge.plain(spark, [(1, "token=abcdef1", None, None, 0), (2, "token=abcdef1", None, None, 0)])
    new = edge.plain(spark, [(3, "token=abcdef1", None, None, 0), (4, "passwd: zzzzzz9", None, None, 0)])
    scans = lambda: spark.read.parquet(f"{ledger}/scans")
    secrets.scan(old, ledger)
    assert scans().count() == 1
    told = lambda out: sorted((r["path"], len(r["spans"])) for r in out.collect())
    assert told(secrets.scan(new, ledger)) == [(1, 1), (2, 1), (3, 1), (4, 1)] and scans().count() == 2
    changed = (*secrets.BASE_RULES[:2], secrets.Rule("hex", r"[0-9a-f]+", 0, 3), *secrets.EXTRA_RULES)
    assert told(secrets.scan(new, ledger, changed)) == [(1, 2), (2, 2), (3, 2), (4, 1)]
    last = scans().filter("size(rules) = 1")
    assert last.count() == 2 and last.first()["rules"] == [changed[2].version]


def test_findings_go_to_every_path_that_ever_held_the_blob(spark):
    ledger = _store.fresh_path(spark, "ledger")
    run = lambda rows: sorted((repr(r["path"]), len(r["spans"])) for r in secrets.scan(edge.plain(spark, [(p, t, None, None, 0) for p, t in rows]), ledger).collect())
    assert run([(1, "token=abcdef1"), (None, "token=abcdef1"), (2, "none")]) == [("1", 1), ("2", 0), ("None", 1)]
    # The path changes its text; an old text comes back at another path; rows that repeat are kept.
    assert run([(1, "other")]) == [("1", 0)]
    assert run([(3, "token=abcdef1"), (3, "token=abcdef1"), (1, "token=abcdef1")]) == [("1", 1), ("3", 1), ("3", 1), ("None", 1)]
    assert spark.read.parquet(f"{ledger}/paths").count() == 5 and spark.read.parquet(f"{ledger}/scans").count() == 3


def test_a_blob_that_most_paths_hold(spark):
    rows = [(k, "token=abcdef1 same", None, None, 0) for k in range(300)] + [(1000 + k, f"secret: value{k:04}", None, None, 0) for k in range(30)]
    out = secrets.scan(edge.plain(spark, rows), _store.fresh_path(spark, "ledger")).collect()
    assert sorted(r["path"] for r in out) == sorted(r[0] for r in rows) and all(len(r["spans"]) == 1 for r in out)


def test_tight_patterns_find_the_same_places():
    r = random.Random(3)
    for rule in secrets.RULES:
        for _ in range(400 if rule.tight else 0):
            text = "".join(r.choices(["AKIA", "A", "0", "f", "g", "9" * 9, "AB12" * 4, "abcdef01" * 2, " ", "KIA"], k=r.randint(0, 12)))
            base = [m.span() for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least]
            assert base == [m.span() for m in re.finditer(rule.tight, text)], text


def test_places_in_a_text_of_many_matches(spark):
    text = " é ".join(f"token={'k' * (3 + i % 7)}{i} {i:024x}" for i in range(3000)) + " 😀"
    docs = edge.plain(spark, [(1, text, None, None, 0), (2, "x" * 10, None, None, 0)])
    out = secrets.digest(secrets.scan(docs, _store.fresh_path(spark, "ledger")))
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in out.collect()}
    assert got == {1: brute(text), 2: brute("x" * 10)}
