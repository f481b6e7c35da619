import hashlib
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from patentframe import __main__ as cli
from patentframe import config
from patentframe.sources import archive, download, readers
from tests.test_units import PLAIN, XML, application


def test_config_sources(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"chunk_size": 500, "output": "a"}))
    c = config.load(str(f), {"output": "b", "input": None}, {"PATENTFRAME_CHUNK_OVERLAP": "50", "PATENTFRAME_SPLIT_CLAIMS": "false", "HOME": "x"})
    assert (c.chunk_size, c.output, c.chunk_overlap, c.split_claims, c.input) == (500, "b", 50, False, "")
    g = tmp_path / "d.json"
    g.write_text(json.dumps({"output": "c", "retries": 7}))
    both = config.load([str(f), str(g)], {}, {})
    assert (both.chunk_size, both.output, both.retries) == (500, "c", 7)
    for bad in ({"partition_by": "title"}, {"nonsense": 1}, {"reject_scope": "all"}, {"chunk_size": 10}, {"split_claims": "maybe"}, {"parallel": 0}, {"products": "x"}):
        with pytest.raises(ValueError):
            config.load(None, bad, {})


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text(XML)
    (tmp_path / "xml" / "b.xml").write_text(PLAIN)
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text(json.dumps(application()))
    run = lambda command, source, target: cli.main([command, "--input", str(tmp_path / source), "--output", str(tmp_path / target)])
    assert run("parse", "xml", "records") == run("import", "json", "apps") == run("chunk", "apps", "chunks") == 0
    assert spark.read.parquet(str(tmp_path / "records")).count() == 3 and spark.read.parquet(str(tmp_path / "records-rejects")).count() == 1
    assert {r["section"] for r in spark.read.parquet(str(tmp_path / "chunks")).collect()} == {"Title", "Abstract", "Claims", "Background", "Summary", "Description"}
    again = ["import", "--input", str(tmp_path / "json"), "--output", str(tmp_path / "parts"), "--partition-by", "filing_year,decision", "--log", str(tmp_path / "log")]
    assert cli.main(again) == 0 and (tmp_path / "parts" / "filing_year=2014" / "decision=PENDING").is_dir()
    assert json.loads((tmp_path / "log").read_text())["outcomes"] == {"inserted": 1}
    cli.main(["config", "--chunk-size", "700"])
    assert '"chunk_size": 700' in capsys.readouterr().out


def _zip(**files):
    to = io.BytesIO()
    with zipfile.ZipFile(to, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return to.getvalue()


@pytest.fixture
def server():
    """Product 14: a whole archive (its first request fails), one with a wrong checksum, one that isn't there."""
    data, asked = _zip(**{"a/one.xml": XML, "two.zip": _zip(**{"plain.xml": PLAIN})}), []
    item = lambda i, name, sha: {"itemId": i, "itemName": name, "fileSize": "1 KB", "fileChecksum": sha}
    good = hashlib.sha1(data).hexdigest()
    product = {"id": 14, "name": "p", "deliveries": [{"deliveryId": 1, "deliveryName": "d", "items": [item(1, "good.zip", good), item(2, "bad.zip", "0" * 40), item(3, "gone.zip", good)]}]}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = {"/products/14": json.dumps(product).encode()}.get(self.path)
            if self.path.endswith(("/item/1/download", "/item/2/download")):
                body = data
            if body is None or (self.path.endswith("/item/1/download") and asked.count(self.path) == 1):
                self.send_error(503)
                return
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()
    s.server_close()


def test_download_unpack_and_parse(spark, tmp_path, server):
    url, asked = server
    out = str(tmp_path / "out")
    args = ["run", "--base-url", url, "--products", "14,15", "--output", out, "--retries", "1"]
    assert cli.main(args) == 0
    rows = {r["file_path"]: r for r in spark.read.parquet(f"{out}/downloads").collect()}
    assert {k: (r["outcome"], r["tries"]) for k, r in rows.items()} == {"data/good.zip": ("ok", 2), "data/bad.zip": ("mismatch", 2), "data/gone.zip": ("failed", 2), None: ("catalog", None)}
    assert [p.name for p in (tmp_path / "out" / "files" / "data").iterdir() if not p.name.startswith(".")] == ["good.zip"]
    assert sorted(p.name for p in (tmp_path / "out" / "extracted").rglob("*.xml")) == ["one.xml", "plain.xml"]
    assert spark.read.parquet(f"{out}/records").count() == 3
    before = asked.count("/products/14/delivery/1/item/1/download")
    assert cli.main(args) == 0  # what is there with its checksum isn't asked for again
    assert asked.count("/products/14/delivery/1/item/1/download") == before
    assert {r["outcome"] for r in spark.read.parquet(f"{out}/downloads").where("file_path = 'data/good.zip'").collect()} == {"skipped"}


def test_download_of_one_file(spark, tmp_path, server):
    url, _ = server
    out = str(tmp_path / "one")
    assert cli.main(["download-file", "--file-url", url + "/products/14", "--file-name", "p.json", "--output", out]) == 0
    assert json.loads((tmp_path / "one" / "p.json").read_text())["id"] == 14
    assert cli.main(["download-file", "--output", str(tmp_path / "none")]) == 0 and spark.read.parquet(str(tmp_path / "none" / "file-download")).count() == 0


def test_download_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "file_path string, checksum string, url string")
    assert download.download(none, str(tmp_path)).count() == 0
    null = spark.createDataFrame([("a", None, "nonsense")], none.schema)
    assert download.download(null, str(tmp_path), retries=0).first()["outcome"] == "failed"


def test_large_and_linked_members(spark, tmp_path, monkeypatch):
    """Rows come in several batches, equal paths keep the last, contents may be opened by path, links are told."""
    import tarfile

    monkeypatch.setattr(archive, "BATCH", 1000)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for k in range(40):
            info = tarfile.TarInfo(f"m{k % 30}")
            info.size, info.mtime = 400, 1000 + k
            t.addfile(info, io.BytesIO(bytes([k]) * 400))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "m1"
        t.addfile(link)
    found = readers.read_archives(spark, str(tmp_path))
    for source in (found, found.drop("content")):
        got = {r["path"]: r for r in archive.expand(source).collect()}
        assert len(got) == 31 and got["l"]["link"] == "m1" and got["l"]["problem"] is None
        for k in range(30):
            last = k + 30 if k < 10 else k
            assert bytes(got[f"m{k}"]["content"]) == bytes([last]) * 400 and got[f"m{k}"]["mtime"] == 1000 + last
    monkeypatch.setattr(archive, "BATCH", 32 << 20)  # in one walk, then as files with their times and the link
    wrote = archive.materialise(archive.expand(found), str(tmp_path / "out")).collect()
    assert sorted(r["written"] for r in wrote) == [0] + [400] * 30
    (made,) = (tmp_path / "out").iterdir()
    assert (made / "l").is_symlink() and (made / "l").read_bytes() == bytes([31]) * 400 and (made / "m1").stat().st_mtime == 1031 and (made / "m1").stat().st_mode & 0o777 == 0o644
