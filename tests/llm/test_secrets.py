"""Secret scans against SQL and Python's own regular expressions."""

from __future__ import annotations

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from tests.compare import check
from tidemark.llm import queries, secrets

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m))


TEXTS = [
    None, "", "nothing here", "password=abc12", "password=abc123", "PassWord\" : 'x+/_.=-y' and token=abcdef", "password=token: abcdefgh", "api_key=ABCDEFG apikey:1234567 api__key=1234567", "AKIA" + "A1" * 8, "AKIA" + "A" * 15,
    "xAKIAAKIA" + "B" * 13, "é𝄞ü secret = s3cr3tvalue 𝄞 deadbeef" * 3, "f" * 24, "f" * 23, "F" * 30, "token=" + "ab12" * 8 + "\ntoken=" + "cd34" * 8, "\n".join(f"AKIA{k:016d}x password: {k:08d}" for k in range(700)),
    "passwd" * 3 + "==abcdef", "token=abcıdef toKen=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "0123456789abcdef" * 9_000, "secret=" + "x" * 100_000, "token: a token=abcdefgh",
]


def test_matches_sql(spark, sf_dir):
    assert check(queries.op11_secrets, queries.ORACLE_SQL["op11_secrets"], spark, sf_dir) is None


@pytest.fixture
def odd(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, TEXTS[4]) for k in range(50)] + [(3, TEXTS[4]), (4, TEXTS[4]), (None, TEXTS[4]), (None, None), (None, TEXTS[16])]
    spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, blob string, version int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_odd_rows(spark, odd):
    assert check(queries.op11_secrets, queries.ORACLE_SQL["op11_secrets"], spark, odd) is None
    got = queries.op11_secrets(spark, odd).collect()
    assert len(got) == len(TEXTS) + 55
    for r in got:
        if r.doc_id is None or r.doc_id in (3, 4):
            continue
        want = base_spans(TEXTS[r.doc_id] if r.doc_id < 100 else TEXTS[4])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[2] == n for w in want) for n in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in BASE] == [f"{n}:{a}:{b}" for a, _, n, b in want]
    extra = {r.doc_id: r.spans for r in got if r.doc_id in (19, 20)}
    assert extra[19] == "private_key:0:31" and extra[20] == "github:0:40"


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, version int, text string")
    old = [secrets.Rule("assign", 1, secrets.BASE[0].pattern, 2, 6), secrets.Rule("hex", 1, "[0-9a-f]{32,}")]
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger", old)
    ledger.add(batch(("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("a", 2, "f" * 26), ("c", 1, None)))
    assert ledger.scans().count() == 3 and ledger.versions(version="int").count() == 4
    ledger.add(batch(("d", 1, "token=abcdef"), ("e", 1, "new")))  # one blob is seen
    assert ledger.scans().count() == 4 and all(sorted(r.rules) == ["assign@1", "hex@1"] for r in ledger.scans().collect())
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger", [old[0], secrets.Rule("hex", 2, "[0-9a-f]{24,}")])
    ledger.add(batch(("a", 3, "f" * 26), ("f", 1, "token=abcdef")))  # blobs seen, one rule is new
    more = [r for r in ledger.scans().collect() if "hex@2" in r.rules]
    assert len(more) == 2 and all(r.rules == ["hex@2"] for r in more)
    ledger.add(batch(("a", 3, "f" * 26)))
    ledger.add(batch())
    assert sum("hex@2" in r.rules for r in ledger.scans().collect()) == 2
    got = {(r.path, r.version): r.s for r in ledger.report(ledger.versions(version="int")).select("path", "version", secrets.joined(F.col("spans"), ["assign", "hex"]).alias("s")).collect()}
    assert got == {("a", 1): "assign:0:12", ("b", 1): "assign:0:12", ("a", 2): "hex:0:26", ("c", 1): "", ("d", 1): "assign:0:12", ("e", 1): "", ("a", 3): "hex:0:26", ("f", 1): "assign:0:12"}


def test_batch_that_was_lost_is_not_read(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.add(spark.createDataFrame([("a", 1, "x")], "path string, version int, text string"))
    name = os.listdir(f"{tmp_path}/ledger/scans")[0]
    os.remove(f"{tmp_path}/ledger/scans/{name}/_SUCCESS")
    assert ledger.scans().count() == 0 and ledger.versions(version="int").count() == 1


def test_rules_are_checked(spark, tmp_path):
    for bad in ([secrets.BASE[0], secrets.BASE[0]], [secrets.Rule("a:b", 1, "x")]):
        with pytest.raises(ValueError):
            secrets.Ledger(spark, f"{tmp_path}", bad)


def test_sums_before(spark):
    for n in (1, 127, 128, 129, 1000):
        got = spark.range(1).select(secrets._sums_before(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("long")))).first()[0]  # noqa: SLF001
        assert got == [k * (k + 1) // 2 for k in range(n)]


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op11_secrets(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
