import json
import math

import pytest

from tessella.operators import chunking as C
from tessella.operators import indexing as I

V = "chunk_id string, vector array<float>, seq int"


def test_vector_state(spark):
    lines = [(0, '{"chunk_id":"c1","vector":[1,2]}'), (1, ""), (2, '{"chunk_id":"c2","vector":[3,4]}'), (3, '{"chunk_id":"c1","vector":[5,6]}'), (4, "{broken"), (5, '{"chunk_id":"c9","vector":[5,6]}')]
    v = I.vector_lines(spark.createDataFrame(lines, "seq int, line string"))
    assert {r.chunk_id: r.vector for r in I.latest_vectors(v).collect()} == {"c1": [5, 6], "c2": [3, 4]}
    chunks = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chunk_id string")
    assert [r.chunk_id for r in I.pending_embed(chunks, v).collect()] == ["c3"]
    uploads = spark.createDataFrame([("c1", True), ("c2", False)], "chunk_id string, uploaded boolean")
    assert sorted(r.chunk_id for r in I.pending_upload(chunks, uploads).collect()) == ["c2", "c3"]


def docs(spark, text="# A\nx\n# B\n| a |\n"):
    return C.chunk_documents(spark.createDataFrame([("a.md", "U", text)], "source string, utility string, text string"))


def test_pipeline_is_idempotent(spark):
    chunks = docs(spark)
    none = spark.createDataFrame([], V)
    uploads = spark.createDataFrame([], "chunk_id string, uploaded boolean")
    made, rows, marks = I.run_pipeline(chunks, none, uploads)
    got = {r.chunk_id: r for r in rows.collect()}
    assert len(got) == made.count() == marks.count() == 2
    for r in got.values():
        assert (r.page_start, r.page_end, r.energy_utility_name) == (0, 0, "U")
        assert json.loads(r.metadata_json)["char_count"] == len(r.content) and ': ' in r.metadata_json
        assert math.isclose(sum(x * x for x in r.content_vector), 1, rel_tol=1e-5)
    again = I.run_pipeline(chunks, none, marks)
    assert all(df.count() == 0 for df in again)
    index = I.upsert(rows, rows.limit(1))
    assert index.count() == 2
    s = I.stats(chunks, made, marks).first()
    assert (s.chunks, s.with_tables, s.with_figures, s.utilities, s.vectors_cached, s.uploaded) == (2, 1, 0, "U", 2, 2)
    found, missing = I.reindex(chunks.select("chunk_id").union(spark.createDataFrame([("zz",)], "chunk_id string")), chunks, made.selectExpr("*", "0 AS seq"))
    assert found.count() == 2 and [r.chunk_id for r in missing.collect()] == ["zz"]
    assert {(r.value, r.n) for r in I.facets(chunks, "content_type").collect()} == {("text", 1), ("table", 1)}


def test_embedder_is_called_again(spark):
    calls = []

    def flaky(texts):
        if len(calls) < 2:
            calls.append(1)
            raise I.RateLimited
        assert len(texts) <= 4
        return [[1.0]] * len(texts)

    rows = spark.createDataFrame([(str(k), "t") for k in range(9)], "chunk_id string, content string").coalesce(1)
    assert I.embed(rows, flaky).count() == 9

    def limited(texts):
        raise I.RateLimited

    with pytest.raises(Exception, match="still limited"):
        I.embed(rows, limited).collect()


def test_embedding_holds_few_texts(spark):
    def resident(texts):
        with open("/proc/self/statm") as f:
            return [[int(f.read().split()[1]) * 4096 / 1e6]] * len(texts)

    rows = spark.range(3000).selectExpr("cast(id AS string) AS chunk_id", "repeat('a ', 50000) AS content").coalesce(1)  # 300 MB in one task
    assert max(r.vector[0] for r in I.embed(rows, resident).collect()) < 350
    assert I.embed(rows.limit(1), kind="double").schema["vector"].dataType.simpleString() == "array<double>"
