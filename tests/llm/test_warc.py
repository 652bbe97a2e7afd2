import gzip
import hashlib
import io

import pyarrow as pa
from pyarrow import fs as pafs

from quillmere.llm.warc import archived, indexed_records, inflated, normalise, read_back, record, records, write_monolith


def brute(rows, least=1000):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in bodies:
        ids = [x for x, y in bodies if y == b and x is not None]
        first = max(ids, default=None) if len(b) >= least else i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), *(("response", None) if i == first else ("revisit", first))))
    return sorted(out, key=str)


def pages():
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(i, f"http://a/{i}", big) for i in (4, 9, 2)] + [(5, None, other), (6, "u\r\nv%", other), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    return rows + [(10, "u", None), (11, "u", ""), (12, "u", "WARC/1.1\r\n\r\n"), (9, "u", big), (None, "u", big), (None, "u", "n" * 2000)]


def test_matches_brute_force(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    for limit in (1, 1 << 20):
        archives = archived(df, f"file://{tmp_path}/{limit}", limit=limit)
        got = sorted((tuple(r) for r in read_back(archives).collect()), key=str)
        assert got == brute(rows)
        assert sum(r.n for r in archives.collect()) == len(rows)
    assert read_back(archived(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_normaliser_keeps_records_and_makes_members(tmp_path):
    whole = [record(i, f"http://x/{i}", b"z" * (i * 700_000), "00" * 20, None) for i in range(4)]
    source, target = f"file://{tmp_path}/a.warc.gz", f"file://{tmp_path}/b.warc.gz"
    assert write_monolith(source, iter(whole)) == 4
    assert normalise(source, target) == 4
    assert [w for _, w in indexed_records(target)] == whole
    assert gzip.decompress((tmp_path / "a.warc.gz").read_bytes()) == b"".join(whole) == gzip.decompress((tmp_path / "b.warc.gz").read_bytes())
    assert (tmp_path / "b.warc.gz").read_bytes().count(b"\x1f\x8b\x08") >= 4
    assert normalise(target, f"file://{tmp_path}/c.warc.gz") == 4
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.endswith(".part")) == []
    with pafs.LocalFileSystem().open_input_stream(f"{tmp_path}/b.warc.gz", compression=None) as f:
        assert b"".join(w for _, w in records(inflated(f))) == b"".join(whole)
    assert list(records(iter([]))) == [] and list(records(inflated(io.BytesIO(b"")))) == []
    assert pa.__version__
