"""S1 fallbacks, S6 clear, S8 replays and several files."""

import os

from quarry.session import checkpoint_dir
from quarry.sources.delimited import read_delimited
from quarry.sources.sinks import clear_results, load_result, save_result
from quarry.streaming.ingest import ingest_available, ingested


def write(path, data: bytes):
    os.makedirs(path.parent, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def test_dialects(spark, tmp_path):
    comma = read_delimited(spark, write(tmp_path / "a.csv", "nom,âge\nÉva,3\n".encode()))
    semi = read_delimited(spark, write(tmp_path / "b.csv", "nom;age\nÉva;3\n".encode("latin-1")))
    undecodable = read_delimited(spark, write(tmp_path / "c.csv", "a;b,c\n\xc9va;3\n".encode("latin-1")))
    assert [tuple(r) for r in comma.collect()] == [("Éva", "3")] and comma.columns == ["nom", "âge"]
    assert [tuple(r) for r in semi.collect()] == [("Éva", "3")]
    assert undecodable.columns == ["a", "b,c"]


def test_clear_one_run(spark):
    root = f"{checkpoint_dir(spark)}/clear-test"
    for f in ("x", "y"):
        save_result(spark.range(3), root, "t", f)
    assert clear_results(spark, root, "t", "x") and not clear_results(spark, root, "t", "x")
    assert load_result(spark, root, "t", "x").count() == 0 and load_result(spark, root, "t", "y").count() == 3


def test_ingest_once_per_file(spark, tmp_path):
    landing = tmp_path / "in"
    write(landing / "a.csv", b"k,v,e\n1,NA,\n2,x,\n")
    write(landing / "b.csv", b"k,v,e\n3,y,\n")
    out = str(tmp_path / "out")
    ingest_available(spark, str(landing), out_dir=out)
    write(landing / "c.csv", b"k,v,e\n4,z,\n")
    ingest_available(spark, str(landing), out_dir=out)  # goes on after the last committed file
    rows = ingested(spark, out, "clean")
    assert "e" not in rows.columns and sorted(r["k"] for r in rows.collect()) == ["1", "2", "3", "4"]
    prof = ingested(spark, out, "profile")
    assert prof.select("batch").distinct().count() == 3 and prof.filter("column = 'v'").agg({"missing": "sum"}).first()[0] == 1


def test_unlike_files_keep_their_own_columns(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    write(landing / "a.csv", b"a,c\n1,x\n2,y\n")
    write(landing / "b.csv", b"c,a,b\nz,3,q\n")
    write(landing / "c.csv", "nom;a\nÉva;9\n".encode("latin-1"))
    write(landing / "d.csv", b"")
    write(landing / "e.csv", b"a,note\n" + b"".join(b"%d,%s\n" % (i, b"k" if i == 100 else b"") for i in range(100, 130)))
    ingest_available(spark, str(landing), out_dir=out)
    rows = ingested(spark, out, "clean")
    assert set(rows.columns) == {"a", "b", "c", "nom", "batch"}  # the sparse note goes
    got = {r["a"]: (r["c"], r["b"], r["nom"]) for r in rows.collect()}
    assert got["1"] == ("x", None, None) and got["3"] == ("z", "q", None) and got["9"] == (None, None, "Éva")
    files = {r["path"].rsplit("/", 1)[1]: r for r in ingested(spark, out, "files").collect()}
    assert "d.csv" not in files  # a file without a byte is no arrival
    assert files["e.csv"]["removed"] == ["note"] and files["b.csv"]["columns"] == ["c", "a", "b"]
    prof = ingested(spark, out, "profile")
    assert prof.filter("column = 'note'").first()["missing"] == 29 and prof.select("batch").distinct().count() == 4
