import hashlib

from rentgrid.sources.integrity import check_manifest, file_table, merge_manifest


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"x" * 50)
    (tmp_path / "a large.bin").write_bytes(bytes(range(256)) * 10_000)
    (tmp_path / "large.bin.gz").write_bytes(b"y" * 1_500_000)
    files = file_table(spark, str(tmp_path), largest=100)
    want = {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir()}
    assert {r["path"]: (r["size"], r["sha256"]) for r in files.collect()} == want

    known = spark.createDataFrame([(n, s, h) for n, (s, h) in want.items()], "path string, size long, sha256 string")
    with open(tmp_path / "a large.bin", "r+b") as f:
        f.write(b"changed at equal size")
    got = {r["path"]: r["state"] for r in check_manifest(file_table(spark, str(tmp_path), largest=100), known).collect()}
    assert got == {"small.bin": "ok", "a large.bin": "hash-errado", "large.bin.gz": "ok"}


def test_a_file_without_hash_is_not_gone(spark):
    columns = "path string, sha256 string, size long, accessed_at string, query string"
    old = spark.createDataFrame([("p", "h", 5, "d1", "q1"), ("gone", "h", 5, "d1", "q1")], columns)
    new = spark.createDataFrame([("p", None, 7, "d2", "q2")], columns)
    got = {r["path"]: tuple(r)[1:] for r in merge_manifest(old, new).collect()}
    assert got["p"] == (None, 7, "d2", "q2", None, "h")
    assert got["gone"] == ("h", 5, "d1", "q1", None, None)


def test_files_of_some_size_are_streamed_by_default(spark, tmp_path):
    """A file read whole is held in one cell and copied there, so its size is bounded by 32 MiB and not by a gibibyte."""
    import hashlib

    content = b"0123456789abcdef" * (1 << 21) + b"x"
    (tmp_path / "big.bin").write_bytes(content)
    (tmp_path / "small.bin").write_bytes(b"s")
    files = file_table(spark, str(tmp_path))
    assert "MapInArrow" in files._jdf.queryExecution().toString()
    got = {r["path"]: (r["size"], r["sha256"]) for r in files.collect()}
    assert got == {"big.bin": (len(content), hashlib.sha256(content).hexdigest()), "small.bin": (1, hashlib.sha256(b"s").hexdigest())}
