import io
import json
import zipfile

from pyspark.sql import functions as F

from folioforge.sources import readers as R
from folioforge.sources import writers as W
from folioforge.streaming import events as S


def run(query_df, name, spark):
    q = query_df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def event(i, n, run_id="r", ts="2024-01-01T00:00:00"):
    return {"event_id": i, "tenant_id": "t", "run_id": run_id, "event_type": "x", "sequence": n, "ts": ts, "payload": "p"}


def test_stream_deduplicates(spark, tmp_path):
    put(tmp_path / "in/a.json", [event("1", 1), event("1", 1), event("2", 2)])
    got = run(S.deduplicated(S.file_events(spark, str(tmp_path / "in"))), "dedup", spark)
    assert sorted(r["event_id"] for r in got.collect()) == ["1", "2"]


def test_stream_accepts_sequences(spark, tmp_path):
    put(tmp_path / "in/a.json", [event("1", 1, ts="2024-01-01T00:00:01"), event("2", 1, ts="2024-01-01T00:00:02"), event("3", 3, ts="2024-01-01T00:00:03"), event("4", 2, ts="2024-01-01T00:00:04")])
    got = run(S.accepted_sequences(S.file_events(spark, str(tmp_path / "in"))), "accepted", spark)
    assert sorted((r["sequence"], r["delivery"]) for r in got.collect()) == [(1, "ACCEPTED"), (1, "DUPLICATE"), (2, "ACCEPTED"), (3, "GAP")]


def test_stream_limits(spark, tmp_path):
    put(tmp_path / "in/a.json", [event(str(i), i, ts=f"2024-01-01T00:00:{i:02d}") for i in range(1, 6)])
    got = run(S.limited(S.file_events(spark, str(tmp_path / "in")), limit=2, seconds=60), "limited", spark)
    assert [r["allowed"] for r in got.orderBy("ts").collect()] == [True, True, False, False, False]


def test_sink_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("1", "ok"), ("1", "ok"), ("2", "ok"), ("3", None)], "event_id string, payload string")
    sink = S.idempotent_sink(f"{tmp_path}/out", f"{tmp_path}/ledger", bad=lambda d: F.col("payload").isNull(), dead=f"{tmp_path}/dead")
    for number in (0, 0, 1):
        sink(rows, number)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert spark.read.parquet(f"{tmp_path}/dead/batch=0").count() == 1


def test_snapshots(spark, tmp_path):
    page = {"page_no": 1, "text": "ab", "raw_text_digest": "wrong", "lines": [{"line_id": "l", "text": "a"}, {"line_id": "l", "text": "b"}], "tables": [{"table_id": "t", "header": ["h"], "rows": [["1"]]}]}
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": "v1", "snapshot_id": "s", "dossier_id": "d", "document_id": None, "pages": [page]}))
    s = R.read_snapshots(spark, str(tmp_path / "s.json"))
    assert sorted(r["issue"] for r in R.snapshot_issues(s).collect()) == ["BAD_DIGEST", "DUPLICATE_LINE", "MISSING_ID"]
    assert R.snapshot_lines(s).count() == 2 and R.snapshot_tables(s).count() == 1 and R.snapshot_pages(s).first()["text"] == "ab"


def test_shapes_and_members(spark):
    p = spark.createDataFrame([('{"schema_version":"1","snapshot_id":"s"}',), ('{"pages":[]}',), ('{"members":[{"document_id":"a"},{"document_id":"b"}],"request_id":"r"}',), ("{}",)], "payload string")
    assert [r[0] for r in p.select(R.input_shape()).collect()] == ["SNAPSHOT_V1", "LEGACY_OCR", "PROCESSING_REQUEST", "UNKNOWN"]
    _, missing = R.request_members(p.where("payload LIKE '%members%'"), spark.createDataFrame([("a",)], "document_id string"))
    assert [r["document_id"] for r in missing.collect()] == ["b"]


def test_notes_and_nodes(spark):
    d = spark.createDataFrame([("body\n[1] one\nmore\n[1] last\n[2] two",), ("plain",)], "t string").select(R.split_notes(F.col("t")).alias("s")).select("s.*")
    assert [tuple(r) for r in d.collect()] == [("body\n[1] one\nmore", "[1] last\n[2] two"), ("plain", "")]
    n = R.page_nodes(spark.createDataFrame([(1, 1, "Điều 1. A\nSố: 5\ntext")], "f int, page int, t string"), ["f"], "page", "t")
    assert [(r["node_type"], r["parent_no"]) for r in n.orderBy("node_no").collect()] == [("CLAUSE", None), ("FIELD", 1), ("PARAGRAPH", 1)]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:r><w:t>Điều 1</w:t><w:footnoteReference w:id="5"/></w:r></w:p><w:p/></w:body></w:document>')
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:id="5"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = {r["path"][-6:]: (r["text"], r["error"]) for r in R.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Điều 1[1]\n[1] note", None), "b.docx": (None, "BadZipFile")}


def test_freeze_and_replace(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = W.freeze(d, f"{tmp_path}/one", "k", ["k", "v"])
    second = W.freeze(d.where("k = 1").union(spark.createDataFrame([(3, "c")], d.schema)), f"{tmp_path}/two", "k", ["k", "v"])
    assert sorted(map(tuple, W.changed(first, second, "k").collect())) == [(2, "REMOVED"), (3, "ADDED")]
    W.replace_partitions(d, f"{tmp_path}/t", ["k"])
    W.replace_partitions(spark.createDataFrame([(1, "z")], d.schema), f"{tmp_path}/t", ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "z"), (2, "b")]


def test_guarded_reader(spark):
    d = spark.createDataFrame([("t", "d1", "v1"), ("t", "d2", "v1"), ("u", "d1", "v1"), ("t", "d3", "v2")], "tenant_id string, dossier_id string, pin string")
    gone = spark.createDataFrame([("t", "d2")], "tenant_id string, dossier_id string")
    assert [r["dossier_id"] for r in R.guarded(d, gone, "t", {"pin": "v1"}).collect()] == ["d1"]
