from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest

from tradelake.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, text string, part string"


def brute(rows, labels):
    """Every order applied document by document."""
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    docs = []
    for r in rows:
        i, text, part = r["doc_id"], r["text"] or "", r["lang"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(
            o["doc_id"] is not None and i is not None and o["doc_id"] < i and (o["text"] or "") == text for o in rows
        )
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": smaller,
        }
        docs.append((part, {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before, c = set(order[: step - 1]), Counter()
                for p, fails, g, t in docs:
                    if p != part:
                        continue
                    gone = bool(before & fails)
                    removed = f in fails and not gone
                    c["kept"] += not gone and not removed
                    c["removed"] += removed
                    c["redundant"] += f in fails and gone
                    c["unique_fails"] += fails == {f}
                    c["good_lost"] += removed and g
                    c["toxic_lost"] += removed and t
                out[part, "".join(order), step] = (f, [c[m] for m in A.MEASURES])
                shares[part, f] += c["removed"]
    return {k: (*v, shares[k[0], f]) for k, (f, v) in out.items()}


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): (*(r[m] for m in A.MEASURES), r["shapley"]) for r in df.collect()}


def test_edge_rows_against_brute_force(spark, edge):
    labels = [(1, 1, 0), (2, None, 1), (7, 0, 0), (7, 1, None), (None, 1, 1), (99, 1, 1), (6, 1, 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS)
    got = A.audit(edge, table)
    assert got.count() == 600 * len({r["lang"] or "" for r in edge.collect()})
    assert as_dict(got) == brute(edge.collect(), labels)


def test_copies_with_null_and_repeated_ids(spark):
    rows = [(3, "same", "en"), (3, "same", "en"), (5, "same", "de"), (None, "same", "en"), (2, "other", None), (9, "other", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], LABELS)
    assert as_dict(A.audit(docs, none)) == brute(docs.collect(), [])


def test_empty_table(spark, none):
    assert A.audit(none, spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("n", [1, 7, (1 << 40) + 3])
def test_sums_do_not_run_over(n):
    table = A.packed_outcomes()
    total = sum(n * v for v in table.values())
    want = n * sum(A.step_outcomes(*k).astype(object) for k in table)
    assert (A.unpack(total).astype(object) == want).all()


def test_sums_of_many_parts_are_passed_on():
    values = [(f"p{i % 5}", 1) for i in range(100)]
    got = Counter()
    for part, n in A._held_sums(iter(values), flush_at=2):
        got[part] += n
    assert got == {f"p{i}": 20 for i in range(5)}
