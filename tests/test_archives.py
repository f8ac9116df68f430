"""The archive source: parts of files, guards, and archives that are none."""

import random
import zipfile

from inkstone.sources.archives import read_archives


def test_entries_by_parts(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("dir/", b"")
            for i in range(40):
                data = rng.randbytes(rng.randint(0, 3000))
                z.writestr(f"dir/{i}.bin", data)
                want[f"{k}.zip", i + 1, f"dir/{i}.bin"] = data
    for split in (500, 10_000, 1 << 30):
        rows = read_archives(spark, str(tmp_path), split).collect()
        assert {(r.path.rpartition("/")[2], r.ord, r.name): bytes(r.data) for r in rows if not r.is_dir} == want
        assert len(rows) == len(want) + 3 and {r.status for r in rows} == {"done"}


def test_guards(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("big", b"x" * 5000), ("../up", b"u"), ("/abs", b"a"), ("ok", b"fine"), ("broken", b"y" * 400)):
            z.writestr(name, data)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = raw.index(b"broken") + len("broken")
    raw[at : at + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    (tmp_path / "b.zip").write_bytes(b"no archive at all")
    (tmp_path / "c.zip").write_bytes(b"")  # not in the scan
    got = {(r.path[-5], r.name): (r.status, None if r.data is None else bytes(r.data)) for r in read_archives(spark, str(tmp_path), most=1000).collect()}
    assert got == {("a", "big"): ("too_large", b""), ("a", "ok"): ("done", b"fine"), ("a", "broken"): ("unreadable", b""), ("b", None): ("no_archive", None)}
