"""Folders kept alike: added, changed, removed and unchanged files, and second runs."""

import hashlib

from finloom.sources import sync as S


def held(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_folders(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for folder, files in ((a, {"same.json": b"1", "new.json": b"2", "changed.json": b"3", "deep/x y+1.json": b"4", "other.txt": b"9"}), (b, {"same.json": b"1", "changed.json": b"0", "gone.json": b"5", "keep.txt": b"6"})):
        for name, content in files.items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(content)
    before = held(b)
    assert S.synchronised(spark, f"file://{a}", f"file://{b}", "*.json", dry_run=True) == {"written": 3, "removed": 1, "unchanged": 1} and held(b) == before
    assert S.synchronised(spark, f"file://{a}", f"file://{b}", "*.json") == {"written": 3, "removed": 1, "unchanged": 1}
    assert held(b) == {n: c for n, c in held(a).items() if n.endswith(".json")} | {"keep.txt": b"6"}
    assert S.synchronised(spark, f"file://{a}", f"file://{b}", "*.json") == {"written": 0, "removed": 0, "unchanged": 4}
    rows = {r["name"]: r["sha256"] for r in S.manifest(spark, f"file://{b}", "*.json").collect()}
    assert rows["deep/x y+1.json"] == hashlib.sha256(b"4").hexdigest() and len(rows) == 4
    fresh = tmp_path / "c"
    assert S.synchronised(spark, f"file://{a}", f"file://{fresh}", "*.json")["written"] == 4 and len(held(fresh)) == 4
    assert S.synchronised(spark, f"file://{tmp_path / 'none'}", f"file://{fresh}", "*.json")["removed"] == 4 and held(fresh) == {}


def test_manifests(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    actual = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, sha256 string")
    assert sorted((r["name"], r["issue"]) for r in S.stale_files(stored, actual).collect()) == [("b", "changed"), ("c", "missing"), ("d", "unlisted")]
    docs = spark.createDataFrame([("x", ["c"], "n"), ("y", [], "n"), ("z", None, " "), ("w", ["c"], None)], "k string, cards array<string>, notes string")
    whole, rest = S.complete_documents(docs, "k", ["cards", "notes"])
    assert [r["k"] for r in whole.collect()] == ["x"] and whole.columns == docs.columns
    assert {r["k"]: r["missing"] for r in rest.collect()} == {"y": ["cards"], "z": ["cards", "notes"], "w": ["notes"]}
