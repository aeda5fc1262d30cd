import json

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import indexing as I
from tessella.operators import retrieval as R
from tessella.operators import sessions as S
from tessella.sources import files
from tessella.streaming import ingest


def listing(spark, *names):
    return spark.createDataFrame([(n, 1, 2) for n in names], "path string, mtime long, size long")


def names(df):
    return sorted(r.file for r in df.collect())


def test_listings(spark):
    ls = listing(spark, "c/a.pdf", "c/read-a.pdf", "c/read-b.pdf", "c/.keep", "c/x/y.pdf", "root.pdf")
    assert names(files.all_files(ls)) == ["a.pdf", "b.pdf"]
    assert names(files.uploaded_files(ls)) == ["a.pdf"]
    assert names(files.uploaded_files(ls, True)) == ["a.pdf", "read-a.pdf", "read-b.pdf"]
    assert names(files.processed_files(ls)) == ["a.pdf", "b.pdf"]
    assert [r.client for r in files.clients(ls).collect()] == ["c"]
    wanted = spark.createDataFrame([("c", "a.pdf"), ("c", "b.pdf"), ("c", "z.pdf"), ("d", "a.pdf")], "client string, file string")
    assert sorted((r.path, r.mime) for r in files.view_files(wanted, ls).collect()) == [("c/a.pdf", "application/pdf"), ("c/read-b.pdf", "application/pdf")]
    assert [r.path for r in files.new_clients(spark.createDataFrame([("c",), ("n",), (" ",)], "client string"), ls).collect()] == ["n/.keep"]
    have = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "file string, mtime long, size long")
    now = spark.createDataFrame([("a", 1, 2), ("b", 9, 2), ("c", 1, 2)], "file string, mtime long, size long")
    assert names(files.pending_files(now, have)) == ["b", "c"]
    assert names(files.missing_locally(now, have)) == ["c"] and files.missing_locally(now, have, True).count() == 3


def test_sources_and_sinks(spark, tmp_path):
    for name, text in (("U 1/a.md", "# A\nx\n"), ("U 1/b+c.md", ""), ("V/sub/d.md", "y"), ("V/e.txt", "no")):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = {(r.source, r.utility, r.text) for r in files.read_markdown(spark, str(tmp_path / "in")).collect()}
    assert {g[:2] for g in got} >= {("a.md", "U 1"), ("d.md", "sub")} and ("a.md", "U 1", "# A\nx\n") in got
    ls = files.listing(spark, str(tmp_path / "in"))
    assert {"V/sub/d.md", "V/e.txt"} <= {r.path for r in ls.collect()}
    assert files.read_binary(spark, str(tmp_path / "in"), "*.txt").first().content == b"no"
    (tmp_path / "cache.json").write_text(json.dumps([{"chunk_id": "1"}, {"chunk_id": "2"}]))
    assert files.read_chunk_cache(spark, str(tmp_path / "cache.json"), "chunk_id string").count() == 2
    files.write_table(spark.range(3).withColumn("u", F.lit("x")), str(tmp_path / "t"), ["u"])
    files.append_rows(spark.range(2).withColumn("u", F.lit("x")), str(tmp_path / "a"))
    files.append_rows(spark.range(2).withColumn("u", F.lit("x")), str(tmp_path / "a"))
    files.write_json(spark.range(2), str(tmp_path / "j"))
    assert (spark.read.parquet(str(tmp_path / "t")).count(), spark.read.parquet(str(tmp_path / "a")).count(), spark.read.json(str(tmp_path / "j")).count()) == (3, 4, 2)
    files.create_index(spark, "ix", "chunk_id string")
    assert files.index_exists(spark, "ix")
    files.delete_index(spark, "ix")
    files.delete_index(spark, "ix")
    assert not files.index_exists(spark, "ix")


def test_ingest_stream_is_incremental(spark, tmp_path):
    folder, out, ck = tmp_path / "in" / "U", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# A\nx\n")
    run = lambda: ingest.ingest(ingest.markdown_stream(spark, str(tmp_path / "in")), out, ck)
    run()
    first = ingest.latest_chunks(spark, out).collect()
    run()
    assert ingest.latest_chunks(spark, out).collect() == first and first[0].energy_utility_name == "U"
    (folder / "b.md").write_text("z")
    run()
    assert sorted(r.content for r in ingest.latest_chunks(spark, out).collect()) == ["x", "z"]


def test_a_document_that_loses_its_text_loses_its_chunks(spark, tmp_path):
    out, docs = str(tmp_path / "out"), "source string, utility string, text string"
    for batch, rows in enumerate([[("a.md", "U", "# A\nx"), ("b.md", "U", "y")], [("a.md", "U", "")]]):
        ingest._save(spark, spark.createDataFrame(rows, docs), out, batch)
    assert [r.content for r in ingest.latest_chunks(spark, out).collect()] == ["y"]


def test_folder_is_chunked_once_and_indexed(spark, tmp_path):
    folder, store = tmp_path / "in" / "U", str(tmp_path / "store")
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# A\nred apple\n")
    (folder / "b.md").write_text("blue sky")
    job = lambda **o: ingest.index_folder(spark, str(tmp_path / "in"), store, **o)
    assert job() == {"embedded": 2, "indexed": 2, "left": 0}
    assert job() == {"embedded": 0, "indexed": 0, "left": 0}
    (folder / "b.md").write_text("green grass")
    (folder / "c.md").write_text("")
    assert job()["indexed"] == 1
    chunks = ingest.chunk_folder(spark, str(tmp_path / "in"), f"{store}/cache")
    assert sorted(r.content for r in chunks.collect()) == ["green grass", "red apple"]
    ix = ingest.read_index(spark, store)
    assert ix.count() == 3 and R.chat_default(ix, "apple", I.hash_embedding).hits.count() == 3
    assert job(recreate=True) == {"embedded": 0, "indexed": 2, "left": 0} and ingest.read_index(spark, store).count() == 2
    assert job(recreate=True, clear_vectors=True) == {"embedded": 2, "indexed": 2, "left": 0}
    (folder / "a.md").unlink()
    assert [r.content for r in ingest.chunk_folder(spark, str(tmp_path / "in"), f"{store}/cache", force=True).collect()] == ["green grass"]
    assert ingest.clear_cache(spark, f"{store}/cache") and not files.exists(spark, f"{store}/cache") and not ingest.clear_cache(spark, f"{store}/cache")


def test_clients_are_ingested_to_an_index(spark, tmp_path):
    folder, store = tmp_path / "in" / "U", str(tmp_path / "store")
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# A\nx\n")
    run = lambda: ingest.ingest_clients(ingest.markdown_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck"))
    run()
    run()
    (folder / "b.md").write_text("z")
    run()
    assert sorted(r.content for r in ingest.read_index(spark, store).collect()) == ["x", "z"]
    assert {r.source: r.n for r in ingest.latest_files(spark, f"{store}/cache").collect()} == {"a.md": 1, "b.md": 1}


def test_nightly_job_counts_and_deletes(spark, tmp_path):
    folder = tmp_path / "SessionData"
    assert ingest.nightly(spark, str(folder), str(tmp_path / "out"), "now") == {"rows_inserted": 0, "blobs_deleted": 0}
    folder.mkdir()
    for k in range(3):
        (folder / f"s{k}.json").write_text(json.dumps({"session_id": f"s{k}", "messages": [{"msgId": str(m)} for m in range(k)]}))
    (folder / "bad.json").write_text("{broken")
    assert ingest.nightly(spark, str(folder), str(tmp_path / "out"), "now") == {"rows_inserted": 3, "blobs_deleted": 3}
    assert [x.name for x in folder.iterdir() if not x.name.startswith(".")] == ["bad.json"]


def test_files_rename_json_lines_and_databases(spark, tmp_path):
    root = tmp_path / "up"
    (root / "c").mkdir(parents=True)
    (root / "c" / "a.pdf").write_bytes(b"new")
    (root / "c" / "read-a.pdf").write_bytes(b"old")
    assert files.rename_to_processed(spark, str(root), "c", "a.pdf") == "c/read-a.pdf" and files.rename_to_processed(spark, str(root), "c", "a.pdf") is None
    assert (root / "c" / "read-a.pdf").read_bytes() == b"new" and not (root / "c" / "a.pdf").exists()
    (root / "x.json").write_text('{"a": 1}')
    (root / "y.json").write_text("{a")
    assert sorted((r.path[-6:], r.raw) for r in files.read_json(spark, str(root)).collect()) == [("x.json", '{"a": 1}'), ("y.json", None)]
    assert [r.path for r in files.by_prefix(listing(spark, "c/a", "d/a"), "c/").collect()] == ["c/a"]
    lines = [json.dumps({"chunk_id": f"c{k % 7}", "vector": [k, 0.5]}) for k in range(3000)]
    (root / "v.jsonl").write_text("\n".join(lines[:2500] + ["", "{cut"] + lines[2500:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = I.latest_vectors(I.vector_lines(files.read_vector_lines(spark, str(root / "v.jsonl")))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.chunk_id: r.vector[0] for r in got} == {f"c{k % 7}": float(k) for k in range(2493, 2500)}
    url, rows = f"jdbc:derby:{tmp_path}/db;create=true", spark.createDataFrame([("q1", "a", "2024-01-01 00:00:00"), ("q1", "b", "2024-01-02 00:00:00")], "question string, answer string, created_at string")
    files.write_database(rows, url, "sessions", createTableColumnTypes="question VARCHAR(100), answer VARCHAR(100), created_at VARCHAR(40)")
    files.write_database(rows.limit(1), url, "sessions")
    back = files.read_database(spark, url, "sessions")
    assert back.count() == 3 and [(r.answer, r.cnt) for r in S.faq(back).collect()] == [("b", 3)]


def test_backup_stream_equals_batch(spark, tmp_path):
    raw = json.dumps({"session_id": "s", "messages": [{"msgId": "1", "question": "q", "answer": "a"}]})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.json").write_text(raw)
    ingest.backup(spark.readStream.text(str(tmp_path / "in"), wholetext=True).withColumnRenamed("value", "raw"), str(tmp_path / "out"), str(tmp_path / "ck"), "now")
    assert spark.read.parquet(str(tmp_path / "out")).drop("batch").collect() == S.flatten(spark.createDataFrame([(raw,)], "raw string"), "now").collect()


def test_text_functions(spark):
    odd = "\x1c\x85  a　b  \t"
    df = spark.createDataFrame([(odd, "a\r\nb\rc\x0bd\n", "x.y.md", "ab. cd. e")], "s string, l string, f string, r string")
    r = df.select(T.strip(F.col("s")).alias("s"), T.squeeze(F.col("s")).alias("q"), T.lines(F.col("l")).alias("l"), T.stem(F.col("f")).alias("f"), T.last_index(F.col("r"), ". ").alias("i"), T.last_index(F.col("r"), "zz").alias("n")).first()
    assert (r.s, r.q, r.l, r.f, r.i, r.n) == (odd.strip(), " ".join(odd.split()), ["a", "b", "c", "d"], "x.y", 6, -1)
    g = spark.createDataFrame([("a/b c",)], "s string").select(T.safe_name(F.col("s")).alias("a"), T.session_file(F.col("s")).alias("b")).first()
    assert tuple(g) == ("a_b_c", "a_b_c.json")
