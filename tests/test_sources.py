import json

import pytest

from stratoloom.sources import readers as R
from stratoloom.sources import sinks as K
from stratoloom.sources import tables_json as J


def test_workspace_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\x00")
    (tmp_path / "node_modules/c.js").write_text("1")
    got = R.scan_workspace(spark, str(tmp_path))
    assert [(r.relative_path, r.language, r.content) for r in got.collect()] == [("src/a.py", "python", "x = 1\n")]
    assert R.changed_files(got, got).count() == 0


def test_lines_and_transcripts(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text(json.dumps({"type": "user", "message": {"role": "user", "content": "hi"}}) + "\n\n" + json.dumps({"payload": {"role": "assistant", "content": [{"type": "output_text", "text": "yo"}]}}) + "\nnot json\n")
    assert [r.line_number for r in R.json_lines(spark, str(p)).orderBy("line_number").collect()] == [1, 3, 4]
    assert [(r.turn, r.role, r.text) for r in R.transcripts(spark, str(p)).orderBy("turn").collect()] == [(1, "user", "hi"), (3, "assistant", "yo")]


def test_coverage_reports(spark, tmp_path):
    (tmp_path / "l").write_text("SF:a.c\nDA:1,5\nDA:2,0\nend_of_record\n")
    (tmp_path / "c").write_text('<coverage><class filename="a.py"><lines><line number="3" hits="2"/></lines></class></coverage>')
    (tmp_path / "j").write_text('<report><package name="p"><sourcefile name="A.java"><line nr="7" mi="0" ci="4"/></sourcefile></package></report>')
    for name, want in (("l", {("a.c", 1, 5), ("a.c", 2, 0)}), ("c", {("a.py", 3, 2)}), ("j", {("p/A.java", 7, 4)})):
        assert {tuple(r) for r in R.coverage(spark, str(tmp_path / name)).collect()} == want


def test_advisories(spark, tmp_path):
    p = tmp_path / "osv.json"
    p.write_text(json.dumps({"id": "V1", "affected": [{"package": {"ecosystem": "e", "name": "n"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "1.0.0"}, {"fixed": "1.10.0"}]}]}]}))
    pk = spark.createDataFrame([("e", "n", "1.9.3"), ("e", "n", "1.10.0"), ("e", "n", "0.9")], "ecosystem string, package string, version string")
    assert [r.version for r in R.affected(pk, R.advisories(spark, str(p))).collect()] == ["1.9.3"]


def test_strict_tables(spark):
    specs = [J.ColumnSpec("ts", "timestamp", True), J.ColumnSpec("value", "number", True), J.ColumnSpec("ok", "boolean", default="true"), J.ColumnSpec("n", "integer")]
    rows = ['{"ts": "2024-01-01T00:00:00Z", "value": 1.5, "n": 5.0}', '{"value": "x", "n": 1.5, "zz": 1}', "[1]", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    got = {r.i: (r.data, r.errors) for r in J.validate(df, "j", specs, reject_unknown=True).collect()}
    assert got[0][1] == [] and got[0][0]["ok"] == "true"
    assert set(got[1][1]) == {"ts: required", "value: not number", "n: not integer", "unknown: zz"}
    assert got[2][1] and got[3][1]
    with pytest.raises(ValueError):
        J.ColumnSpec("Bad", "text")
    with pytest.raises(ValueError):
        J.ColumnSpec("ok", "decimal")


def test_upsert_and_reports(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "k int, v string, s int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, s int")
    assert {(r.k, r.v) for r in K.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.k, r.v) for r in K.upsert(old, new, ["k"], keep="s").collect()} == {(1, "a"), (2, "b"), (3, "d")}
    t = spark.createDataFrame([("x|y", 2.0), (None, 1.5)], "name string, n double")
    for fmt in K.FORMATS:
        assert "2" in K.render(t, fmt, "T")
    assert "x\\|y" in K.render(t, "markdown")
    with pytest.raises(ValueError):
        K.render(t, "pdf")
    assert K.ontology_facts(spark.createDataFrame([("a'b", "c")], "src string, dst string")).first().value == "is_a('a\\'b', 'c')."
