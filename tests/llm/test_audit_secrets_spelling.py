"""Filter audit, secret scan and spelling variants: brute force, and nulls, long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import filter_audit, queries, secret_scan, spelling
from quillstone.llm.common import Scratch

EXTRA = "row string, id string, mask int, part string, body string, word string, n int, key string, found string, number string, digest string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, {EXTRA}"
ODD = ("r", "i", 1, "p", "b", "w", 2, "k", "f", "u", "d")
LONG = " ".join(f"Word{i % 977} and{i % 13}" for i in range(60_000))


def table(spark, rows):
    return spark.createDataFrame([(*r, *ODD) for r in rows], SCHEMA)


def audited(rows, labels):
    """The contract by plain loops: every order over every document."""
    first, parts = {}, defaultdict(list)
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, lang, _ in rows:
        t, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        said = [x for x in labels if x[0] is not None and x[0] == i]
        parts[lang or ""].append(({f for f in fails if fails[f]}, any(q == 1 for _, q, _ in said), any(x == 1 for _, _, x in said)))
    out = {}
    for part, docs in parts.items():
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed_by[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return out


def test_audit_against_all_orders(spark):
    rng = random.Random(3)
    words = ["lorem", "Ipsum", "DOLOR", "a#b", "x|y", "sit", "été", "数据"]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 20, 99, 100, 150]))) for _ in range(20)] + [" ".join(f"w{i}" for i in range(120)), "ABC " * 200, None, "", LONG]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "s") for _ in range(150)]
    labels = [(rng.choice([*range(40), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(30)]
    said = spark.createDataFrame([(*x, "n", "p") for x in labels], "doc_id bigint, quality int, toxic int, part string, mask string")
    found = filter_audit.audit(table(spark, rows), said).collect()
    want = audited(rows, labels)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in found} == want and len(found) == len(want) == 3 * 600
    assert filter_audit.audit(table(spark, rows).limit(0), said).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.audit(table(spark, rows[:9]), said.limit(0)).collect())


def test_audit_of_other_filters(spark):
    rows = table(spark, [(1, "aa bb", "x", "s"), (2, "aa", "x", "s"), (3, "cc", "x", "s")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(rows, none, {"S": lambda t, w: F.size(w) < 2, "C": lambda t, w: t.startswith("c")}).collect()
    assert {(r.filter_order, r.step, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found} == {("SC", 1, 2, 0, 1, 3), ("SC", 2, 0, 1, 0, 1), ("CS", 1, 1, 0, 0, 1), ("CS", 2, 1, 1, 1, 3)}
    with pytest.raises(ValueError, match="one letter"):
        filter_audit.audit(rows, none, {"long": None})


def spans_by_hand(text):
    out = []
    for k, p in enumerate([secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX]):
        at = 0
        while m := re.compile(p, re.I | re.A if k == 0 else 0).search(text, at):
            value = m[2] if k == 0 else m[0]
            if len(value) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end(), value))
            at = m.end()
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "api_key", "APIKEY", "paſſwd", "=", ":", " ", '"', "'", "abc", "ab12cd34ef56ab12cd34ef56", "AKIA", "ABCDEFGH12345678", "é", "🙂", "x9_", "secret", ".", "Kk"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    found = secret_scan.found_in(text)
    assert [x[:4] for x in found if x[1] < 3] == spans_by_hand(text)
    base = [(a, b) for a, k, b, _, _ in found if k < 3]
    for a, k, b, value, _ in found:
        if k == 3:
            assert text[a:b] == value and len(value) >= 20 and not any(x < b and a < y for x, y in base)


LIVE, SHOWN, KNOWN = "Zk3v9QpLx7Rt2WmB5nYd8", "EXAMPLE0example1EXAMPLE2", "aaaa1111aaaa1111aaaa-"


def test_ownership_adds_spans(spark):
    rows = [(1, f"🙂 {LIVE} here", "en", "s1"), (2, f"once more {LIVE}", "en", "s1"), (3, f"token = '{KNOWN}'", "en", "s1"), (4, f"leaked {KNOWN} again", "en", None)]
    rows += [(10 + i, f"see {SHOWN} in the manual; password: changeme", "en", f"m{i}") for i in range(4)] + [(20, "bbbb2222bbbb2222bbbb-", "en", "s9")]
    rows += [(30, None, "en", "s"), (31, "", None, "s"), (None, f"key {LIVE}", "en", "s1"), (32, "prose of letters and 12345678901234567890123 digits", "en", "s"), (2, f"once more {LIVE}", "en", "s1"), (33, LONG, "en", "s")]
    found = secret_scan.scan_secrets(table(spark, rows)).select("row.*", "spans").collect()
    assert len(found) == len(rows) and "body" in found[0] and "text" not in found[0]
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append([(s.kind, s.start, s.end, s.example) for s in r.spans])
    assert by[1] == [[("owned", 2, 23, False)]] and by[2] == [[("owned", 10, 31, False)]] * 2 and by[None] == [[("owned", 4, 25, False)]]
    assert by[3] == [[("assign", 0, 30, False)]] and by[4] == [[("owned", 7, 28, False)]]  # plain to look at, but assigned elsewhere
    assert all(by[10 + i] == [[("assign", 44, 62, True)]] for i in range(4)) and by[20] == by[30] == by[31] == by[32] == by[33] == [[]]
    one = next(s for r in found if r.doc_id == 3 for s in r.spans)
    assert bytes(one.digest) == hashlib.sha256(KNOWN.encode()).digest() and (one.owners, one.repositories) == (2, 2)
    assert secret_scan.scan_secrets(table(spark, rows).limit(0)).count() == 0
    assert secret_scan.scan_secrets(table(spark, rows).select("text"), repo_col="text", owner_col="text").count() == len(rows)


def test_secrets_with_a_hot_value(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.when(F.col("id") % 3 == 0, f"token={KNOWN}").otherwise(F.concat(F.lit("token=owner"), F.col("id"))).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_secret_owners(spark, str(tmp_path)).collect()
    assert len(found) == 3000 and all(r.n_assign == 1 and r.n_examples == (r.doc_id % 3 == 0) and r.spans.startswith("assign:0:") for r in found)
    assert {r.base_sha256 for r in found} == {hashlib.sha256(s.encode()).hexdigest() for s in {r.spans for r in found}}


def spelled(rows, typo_every=97, least_n=3):
    total = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    total = {w: n for w, n in total.items() if len(w) >= 5 and n >= least_n}

    def near(a, b):
        if abs(len(a) - len(b)) == 1:
            a, b = sorted((a, b), key=len)
            return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1

    friends = {w: [v for v in total if near(w, v)] for w in total}
    best = {w: min(f, key=lambda v: (-total[v], v)) for w, f in friends.items() if f}
    form = {w: best[w] if w in best and total[best[w]] >= 2 * total[w] else None for w in total}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), total[w], len(friends[w]), total[form[w]] if form[w] else None) for w in total}


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["aabbaa", "aabba", "abbaa", "colour", "color", "ÉTÉÉÉÉ", "étéééé", "mississippi", "zzzzz", "zzzzzz"]

    def bent(w):
        k, c = rng.randrange(len(w)), rng.choice("abzéÿ")
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    rows = [(rng.choice([*range(50), None]), rng.choice([" ", "-", "1"]).join(bent(bent(rng.choice(base))) for _ in range(60)), "en", "s") for _ in range(80)]
    rows += [(1, None, "en", "s"), (2, "", "en", "s"), rows[0], rows[0], (3, LONG, "en", "s"), (4, "数据数据数据数据 ×÷×÷×", "en", "s")]
    docs = table(spark, rows)
    for every in (97, 3):
        want = spelled(rows, every)
        found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, typo_every=every).collect()}
        assert found == want and len(want) > 100 and max(v[3] for v in want.values()) > 10
    assert spelling.variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least 2"):
        spelling.variants(docs, factor=1)


def test_roots_of_long_chains(spark):
    chains = [(f"a{i}", f"a{i + 1}") for i in range(37)] + [("b0", "b1"), ("c0", "a20")]
    found = dict(map(tuple, spelling.roots(spark.createDataFrame(chains, "word string, form string"), Scratch(spark, "test")).collect()))
    assert found == {**{f"a{i}": "a37" for i in range(37)}, "b0": "b1", "c0": "a37"}
