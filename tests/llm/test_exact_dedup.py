import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortwise.llm.exact_dedup import exact_dedup
from tests.llm.helpers import awkward_texts, documents


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    out = Counter()
    for members in groups.values():
        ids = [i for i in members if i is not None]
        keep = max(ids) if ids else None
        for i in members:
            out[(i, keep, len(members))] += 1
    return out


@pytest.mark.parametrize("bits", [64, 1 << 22])
def test_against_brute_force(spark, bits):
    rows = awkward_texts()
    got = exact_dedup(documents(spark, rows), filter_bits=bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == brute(rows)
    kept = Counter((r.keep_id, r.byte_length) for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t, *_ in rows})


def test_same_prefix_and_length(spark):
    texts = ["x" * 100 + c for c in "abca"]
    got = {r.doc_id: r for r in exact_dedup(documents(spark, texts)).collect()}
    assert got[0].keep_id == 3 and got[0].group_size == 2 and not got[0].kept and got[3].kept
    assert got[1].kept and got[1].group_size == 1


def test_carried_columns_and_empty_table(spark):
    df = documents(spark, ["a", None])
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    got = {r.doc_id: r.sha for r in exact_dedup(df, carry={"sha": digest}).collect()}
    assert got == {0: hashlib.sha256(b"a").hexdigest(), 1: hashlib.sha256(b"").hexdigest()}
    assert exact_dedup(df.limit(0)).count() == 0


def test_native_plan(spark):
    plan = exact_dedup(documents(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
