from collections import Counter


import __spark_entry__ as entry
import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_decontaminate import windows
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute as brute_links
from tests.llm.test_simhash import fingerprint


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_each_stage_on_its_own_input(spark, sf, docs, tmp_path):
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    steps = [docs]
    for name, stage in P.STAGES:
        stage(spark, steps[-1], sf).write.parquet(f"{tmp_path}/{name}")
        steps.append(spark.read.parquet(f"{tmp_path}/{name}"))
    before = [pairs(s) for s in steps[:-1]]
    assert all(s.columns == docs.columns for s in steps[:-1])
    # language: what goes is what the model rejects, and little of that is clean
    assert not before[1] - before[0]
    assert sum(before[1].values()) > 0.97 * sum(before[0].values())
    assert before[2] == brute_lines(list(before[1].elements()))
    texts = dict(before[2].keys())
    linked = brute_links({i: fingerprint(t) for i, t in texts.items()})
    assert before[3] == Counter({(i, t): 1 for i, t in texts.items() if linked[i] == i})
    found = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    hits = {i: brute_hits(t, found) for i, t in before[3]}
    kept = dict(before[4].keys())
    assert set(kept) == {i for i, h in hits.items() if not h[4]}
    for i, t in before[3]:
        if i in kept:
            assert (kept[i] == t) == (hits[i][1] == 0)
    last = steps[-1].collect()
    assert {r.doc_id: r.decoded for r in last} == {i: t or "" for i, t in kept.items()}
    assert Counter(map(str, P.run(spark, sf).collect())) == Counter(map(str, last))


def test_stages_on_odd_rows(spark, sf, odd, nothing):
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, odd, sf).count() <= odd.count()
        assert stage(spark, nothing, sf).count() == 0
    assert P.STAGES[-1][1](spark, odd, sf).count() == odd.count()
    assert P.STAGES[-1][1](spark, nothing, sf).count() == 0


def test_registered():
    got = entry.queries()
    assert "pipeline" in got and sum(k.startswith("op") for k in got) >= 10
    for n in range(1, 11):
        assert [k for k in got if k.startswith(f"op{n}_")]
    assert set(entry.oracle_sql()) <= set(got)
