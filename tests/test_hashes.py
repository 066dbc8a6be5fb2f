"""Hashes of approvals, with the evidence that they rest on, and texts on both ways to JSON."""

import hashlib
import json

from pyspark.sql import functions as F

from wattline.operators import archive as ar, decisions as de

TEXTS = ["plain (GWh) ~!#[]^_`{|}", 'a "b" \\c', "tab\tline\nend", "三峡 é", "", "[x]", "ends\n"]


def test_hash_of_all_texts_and_whole_chains(spark):
    """One join gives the hash, whether the chain is whole, and the first evidence; missing evidence breaks a chain, but is not in the hash."""
    candidates = spark.createDataFrame([(f"c{i}", x, float(i)) for i, x in enumerate(TEXTS)], "candidate_id string, snippet string, generation_gwh double")
    links = spark.createDataFrame([("c0", "e2"), ("c0", "e1"), ("c0", "e1"), ("c1", "e1"), ("c1", "gone"), ("c2", "e3"), ("c3", "gone")], "candidate_id string, evidence_id string")
    evidence = spark.createDataFrame([("e1", "d1", "h1"), ("e2", "d2", 'h"2'), ("e3", "d2", "old")], "evidence_id string, document_id string, content_hash string")
    documents = spark.createDataFrame([("d1", "h1"), ("d2", 'h"2')], "document_id string, content_hash string")
    own = {"c0": ["e1", "e2"], "c1": ["e1"], "c2": ["e3"]}
    about = {r.evidence_id: r.asDict() for r in evidence.collect()}
    dump = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
    want = {}
    for i, x in enumerate(TEXTS):
        c, parts = f"c{i}", {"snippet": x, "generation_gwh": float(i)}
        if c in own:
            parts |= {"evidence_ids": own[c], "evidence_versions": sorted((about[e] for e in own[c]), key=dump)}
        want[c] = hashlib.sha256(dump(parts).encode()).hexdigest()
    got = {r.candidate_id: r for r in ar.candidate_hash(candidates, links, evidence, documents).collect()}
    assert {c: r.candidate_hash for c, r in got.items()} == want
    assert {c: (r.whole, r.evidence_id) for c, r in got.items()} == {"c0": (True, "e1"), "c1": (False, "e1"), "c2": (False, "e3"), "c3": (False, None)} | {f"c{i}": (None, None) for i in range(4, len(TEXTS))}
    approvals = {r.candidate_id: r.candidate_hash for r in de.approval_hashes(candidates, links, evidence, documents).collect()}
    assert approvals == {c: want[c] if c == "c0" else None for c in want}


def test_numbers_without_an_exponent(spark):
    values = [0.0, -0.5, 1234.25, 1e7, 1e16, 1e-5, 123456789.5]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", ar.json_number(F.col("x")).alias("j")).collect()
    assert [r.j for r in rows] == [json.dumps(r.x) for r in rows]
