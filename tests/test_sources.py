"""Files in and out."""

import pytest

from slicelake.operators.deid import write_deidentified
from slicelake.sources import files as S


def test_evidence_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/evidence"
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "evidence_id string, value double")
    assert S.write_evidence_once(rows, path) == 2
    assert S.write_evidence_once(rows, path) == 0
    with pytest.raises(ValueError, match="other content"):
        S.write_evidence_once(rows.selectExpr("evidence_id", "value + 1 as value"), path)
    assert spark.read.parquet(path).count() == 2
    twice = spark.createDataFrame([("c", 1.0), ("c", 1.0)], "evidence_id string, value double")
    assert S.write_evidence_once(twice, path) == 1
    with pytest.raises(ValueError, match="other content"):
        S.write_evidence_once(spark.createDataFrame([("d", 1.0), ("d", 2.0)], "evidence_id string, value double"), path)
    assert spark.read.parquet(path).count() == 3


def test_a_changed_page_needs_a_new_name(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    pages = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1")], "page_id string, sop_uid string")
    assert (S.write_page_index(pages, path), S.write_page_index(pages, path)) == (2, 0)
    with pytest.raises(ValueError, match="page exists"):
        S.write_page_index(pages.where("sop_uid = '1'"), path)


def test_seals(spark):
    from slicelake.operators.ledger import verify_locks

    sealed = spark.createDataFrame([("a", "h", 1), ("b", "h", 1), ("c", "h", 1)], "review string, hash string, size int")
    now = spark.createDataFrame([("a", "h", 1), ("b", "x", 1)], "review string, hash string, size int")
    assert {tuple(r) for r in verify_locks(sealed, now).collect()} == {("a", "ok"), ("b", "changed"), ("c", "missing")}


def test_sessions_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text('{"id": "s1", "reader": "r", "mode": "single", "studies": [{"uid": "1.2", "date": "20260101", "series": [{"uid": "1.2.3", "modality": "CT", "disposition": "read"}]}], "claims": [{"id": "c1", "text": "t", "priority": "high"}], "pages": []}')
    found = S.read_sessions(spark, f"file://{tmp_path}/in")
    assert found["series"].first().series_uid == "1.2.3"
    assert found["claims"].first().claim_id == "c1"
    assert found["pages"].count() == 0
    manifest = S.file_manifest(spark, f"file://{tmp_path}/in")
    assert S.folder_signature(manifest).first().files == 1


def test_long_files_are_hashed_in_chunks(spark, tmp_path):
    import hashlib
    import random

    inside = tmp_path / "in" / "a folder, of 50%"
    inside.mkdir(parents=True)
    rng = random.Random(5)
    content = {"empty.dcm": b"", "edge.dcm": rng.randbytes(1000), "over.dcm": rng.randbytes(1001), "zip.gz": rng.randbytes(5000), "long one.dcm": bytes(20 << 20) + b"x", "zeros.dcm": bytes(3000)}
    for name, body in content.items():
        (inside / name).write_bytes(body)
    (inside / "other.txt").write_bytes(b"of another kind")
    got = {r.path.rsplit("/", 1)[1]: (r["size"], r.hash) for r in S.file_manifest(spark, f"file://{tmp_path}/in", whole=1000).collect()}
    want = {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in content.items() if body}  # files of no bytes aren't listed
    assert got == want | {"other.txt": (15, hashlib.sha256(b"of another kind").hexdigest())}
    assert S.digest_in_chunks(str(inside / "over.dcm"), chunk=7) == want["over.dcm"][1]
    long = S.file_manifest(spark, f"file://{tmp_path}/in", "*.dcm", whole=1000).where("size > 1000")
    assert {r.path.rsplit("/", 1)[1] for r in long.collect()} == {"over.dcm", "long one.dcm", "zeros.dcm"}
    assert S.file_manifest(spark, f"file://{tmp_path}/in", "*.none").count() == 0


def test_deidentified_output_must_be_new(spark, tmp_path):
    rows = spark.createDataFrame([("1", "S001", "a")], "study_uid string, series_dir string, name string")
    write_deidentified(rows, f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="already exists"):
        write_deidentified(rows, f"file://{tmp_path}/out")
