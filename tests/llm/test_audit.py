"""Filter audit against SQL and a plain simulation of all orders."""

from __future__ import annotations

import itertools
import os
import re
from collections import Counter

import pytest

from tests.compare import check
from tidemark.llm import audit, queries


def test_matches_sql(spark, sf_dir):
    assert check(queries.op12_audit, queries.ORACLE_SQL["op12_audit"], spark, sf_dir) is None


def simulate(docs, labels):
    """Every order, document by document."""
    out, shapley = {}, Counter()
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[ \t-\r]+", text) if w]
        f = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        fails.append((source or "", f, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in fails}:
            left = [x for x in fails if x[0] == part]
            for k, c in enumerate(order):
                gone, stay = [x for x in left if x[1][c]], [x for x in left if not x[1][c]]
                failing = [x for x in fails if x[0] == part and x[1][c]]
                out[part, order, k + 1] = (len(stay), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, c] += len(gone)
                left = stay
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


LONG = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (5, LONG, "a"), (3, LONG, "b"), (9, LONG, None), (3, LONG, "a"), (None, LONG, "a"), (None, LONG, "a"), (1, None, ""), (2, "", "a"), (4, "\x0b \t", "b"), (6, "SHOUT # me", "a"), (7, "same " * 80, "a"), (8, LONG.upper(), "a"),
    (10, LONG + " |", "c"), (11, "é" * 70_000 + " x" * 50_000, "c"), (12, "A" + "b" * 18, "c"), (13, "A" + "b" * 19, "c"), (14, " ".join(["x"] * 18 + [f"y{k}" for k in range(32)]), "c"), (2, "other id 2", "a"), (15, " ".join(["w"] * 60), None),
]
LABELS = [(5, 1, 0), (3, 1, 1), (3, 0, 0), (9, None, 1), (None, 1, 1), (6, 0, 1), (7, 1, None), (99, 1, 1)]


@pytest.fixture
def odd(spark, tmp_path):
    spark.createDataFrame([(*d, 1, 2, 3) for d in DOCS], "doc_id long, text string, source string, fails int, n int, words int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, "p") for x in LABELS], "doc_id long, quality int, toxic int, part string").repartition(2).write.parquet(f"{tmp_path}/labels.parquet")
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark conversations".split():
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_odd_rows_match_a_simulation(spark, odd):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in queries.op12_audit(spark, odd).collect()}
    assert got == simulate(DOCS, LABELS)


def test_odd_rows_match_sql(spark, odd):
    assert check(queries.op12_audit, queries.ORACLE_SQL["op12_audit"], spark, odd) is None


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    assert audit.audit(one, labels).count() == 600


def test_lattice(spark):
    classes = spark.createDataFrame([("p", 0b101, 7, 2, 1)], "part string, fails int, n long, good long, toxic long")
    rows = audit.edges(classes, 3).collect()
    assert len(rows) == 12 and sum(r.removed > 0 for r in rows) == 4  # 3 x 4 edges; bit 0 or 2 with neither before
    assert {r.next: r.shapley for r in rows} == {0: 7 * 3, 1: 0, 2: 7 * 3}
    assert audit.edges(classes.withColumn("fails", classes.fails - 5), 5).count() == 80 and audit.steps(spark).count() == 600
    with pytest.raises(ValueError):
        audit.edges(classes, 8)


def test_no_python_and_no_cross_join(spark, sf_dir):
    plan = queries.op12_audit(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
