"""Operators on small inputs with expected rows worked out by hand."""

import datetime as dt
import io
import json
import random
import re
import subprocess
import sys
import tarfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patentframe.functions import scalars
from patentframe.operators import applications, catalog, chunking, documents, entities, exchange, graph, metrics
from patentframe.sources import archive, readers
from patentframe.streaming import ingest

ROOT = Path(__file__).resolve().parents[1]


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").select("k", make(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["k"])]


def test_dates(spark):
    day = dt.datetime(2014, 3, 26)
    values = ["20140326", "2014-03-26", "", "  ", "garbage", "20141399", " 20140326", None, "2014-02-30"]
    assert column(spark, values, scalars.patent_date) == [day, day] + [None] * 7


def test_file_sizes(spark):
    values = ["1.5 GB", "12 MB", "1,024 KB", "12.0 XB", "", "abc", "-1 MB", None, " 7 ", "3.25kib", "2T", "99999999999999999999 GB"]
    assert column(spark, values, scalars.file_size) == [1610612736, 12582912, 1048, 0, 0, 0, 0, 0, 7, 3328, 2 * 1024**4, 0]
    assert column(spark, values[:3], lambda c: scalars.file_size(c, strict_compat=True)) == [1610612736, 0, 1048]


def test_archive_names(spark):
    names = ["a.ZIP", "b.tar.gz", "c.TGZ", "d.tar", "e.xml"]
    assert column(spark, names, scalars.archive_kind) == ["zip", "tar.gz", "tgz", "tar", "unknown"]
    assert column(spark, names, scalars.archive_stem) == ["a", "b", "c", "d", "e.xml"]


def test_wide_spaces_go(spark):
    assert column(spark, ["\u00a0 a\u2003b\u3000\n", "\x85x\u2028", None], scalars.trim_space) == ["a\u2003b", "x", None]


CLAIMS = ["1. A foo. 2. The foo of claim 1, wherein.", "No numbers here", "What is claimed: 1. A. 2. B.", "  plain  ", "9. x 10. y"]


def test_claims(spark):
    assert column(spark, CLAIMS, chunking.split_claims) == [["1. A foo.", "2. The foo of claim 1, wherein."], ["No numbers here"], ["What is claimed:", "1. A.", "2. B."], ["  plain  "], ["9. x", "10. y"]]
    compat = column(spark, CLAIMS, lambda c: chunking.split_claims(c, compat=True))
    assert compat[2] == ["What is claimed: 1.", "A. 2.", "B."] and compat[0] == ["1. A foo.", "2. The foo of claim 1, wherein."]
    assert column(spark, CLAIMS, lambda c: chunking.split_claims(c, on=False)) == [[x] for x in CLAIMS]
    assert column(spark, ["12. x", "x 1. y", ""], scalars.claim_number) == [12, None, None]
    assert column(spark, ["1. A\x01B 2. C", "x12. y", "3.4. z"], chunking.split_claims) == [["1. A\x01B", "2. C"], ["x", "12. y"], ["3.", "4. z"]]


def boundary_model(text, size, window, line_break):
    out = []
    for s in range(0, max(1, len(text)), size):
        end = min(s + size, len(text))
        if end < len(text):
            hits = [m.end() for m in re.finditer(f"(?=([.?!]|{line_break}))", text[end - window : end]) if True]
            if hits:
                end = end - window + hits[-1] + 1
        out.append((s, end, text[s:end]))
    return out


def test_boundary_chunks_against_model(spark):
    rng = random.Random(3)
    values = ["", "short"] + ["".join(rng.choice("abcé. \n?") if rng.random() < 0.2 else "x" for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for line_break in ("\n\n", "\n"):
        got = column(spark, values, lambda c: chunking.boundary_chunks(c, 50, 20, line_break))
        assert [[tuple(x) for x in row] for row in got] == [boundary_model(v, 50, 20, line_break) for v in values]
    whole = column(spark, values, lambda c: chunking.boundary_chunks(c, 50, 20, contiguous=True))
    assert ["".join(x["text"] for x in row) for row in whole] == values


def test_recursive_splitter():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "longer-word ", "\n", "\n\n", "z" * 40]) for _ in range(80))
        chunks = chunking.split_recursive(text, 100, 20)
        assert all(0 < len(c) <= 100 for c in chunks)
        assert set("".join(text.split())) == set("".join("".join(chunks).split()))
        assert all(word in " ".join(chunks) for word in text.split() if len(word) <= 80)


def test_splitters(spark):
    """Golden pieces of the recursive splitter, worked out by hand; sentences; models that aren't here."""
    assert chunking.split_recursive("aa bb cc dd", 5, 2) == ["aa bb", "bb cc", "cc dd"]
    assert chunking.split_recursive("one two\n\nthree four five\n\nsix", 10, 0) == ["one two", "three four", "five", "six"]
    assert chunking.split_recursive("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"] and chunking.split_recursive("  ", 3, 1) == []
    long = chunking.split_recursive("x" * 300_000, 1000, 200)
    assert all(len(c) <= 1000 for c in long) and len(long) == 375 and long[0][-200:] == long[1][:200]
    assert chunking.split_sentences("One. Two! Three? Four", 10, 5) == ["One. Two!", "Three?", "Four"]
    assert "".join(chunking.split_sentences("A b. C d! E", 4, 0)).replace(" ", "") == "Ab.Cd!E"
    pages = spark.createDataFrame([("a", json.dumps({"Summary": "One two. Three four. Five."}))], "k string, page_content string")
    assert [r["chunk"] for r in chunking.chunk_documents(pages, ["k"], True, 12, 0, "sentences").orderBy("chunk_index").collect()] == ["One two.", "Three four.", "Five."]
    with pytest.raises(ValueError, match="unknown splitter"):
        chunking.chunk_documents(pages, ["k"], splitter="none")
    for name in ("spacy", "nltk", "sentence_transformers"):
        with pytest.raises(ValueError, match="needs the package"):
            chunking.splitter_named(name)("text", 10, 0)


def test_chunk_documents(spark):
    pages = [("a", json.dumps({"Claims": "1. One. 2. Two.", "Title": "T", "Summary": None, "Abstract": ""})), ("b", "not json")]
    got = {(r["k"], r["section"], r["chunk_index"]): (r["chunk"], r["total_chunks"], r["claim_number"]) for r in chunking.chunk_documents(spark.createDataFrame(pages, "k string, page_content string"), ["k"]).collect()}
    assert got == {("a", "Claims", 0): ("1. One.", 2, 1), ("a", "Claims", 1): ("2. Two.", 2, 2), ("a", "Title", 0): ("T", 1, None), ("b", "", 0): ("not json", 1, None)}


XML = """<?xml version="1.0"?><x:root xmlns:x="urn:x"><x:exchange-document country="EP" doc-number="0012" kind="A1" status="C"><x:bibliographic-data>
<x:patent-classifications><x:patent-classification><x:classification-scheme scheme="CPCI"/><x:classification-symbol>
\tB  </x:classification-symbol></x:patent-classification><x:patent-classification><x:classification-scheme scheme="CPCI"/><x:classification-symbol>A</x:classification-symbol></x:patent-classification>
<x:patent-classification><x:classification-scheme scheme="CPCI"/><x:classification-symbol>A</x:classification-symbol></x:patent-classification><x:patent-classification><x:classification-scheme scheme="IPC"/><x:classification-symbol>Z</x:classification-symbol></x:patent-classification></x:patent-classifications>
<x:references-cited><x:citation><x:patcit><x:document-id><x:country>US</x:country><x:doc-number>007</x:doc-number><x:kind>B</x:kind></x:document-id></x:patcit><x:category>X</x:category><x:category> </x:category><x:rel-passage><x:category>Y</x:category></x:rel-passage></x:citation><x:citation><x:nplcit/></x:citation></x:references-cited></x:bibliographic-data>
<x:patent-family><x:family-member><x:publication-reference data-format="docdb"><x:document-id><x:country>EP</x:country><x:doc-number>0012</x:doc-number><x:kind>A1</x:kind></x:document-id></x:publication-reference>
<x:publication-reference data-format="docdb"><x:document-id><x:country>WO</x:country><x:doc-number>9</x:doc-number><x:kind>A</x:kind></x:document-id></x:publication-reference>
<x:publication-reference data-format="epodoc"><x:document-id><x:country>QQ</x:country></x:document-id></x:publication-reference></x:family-member></x:patent-family></x:exchange-document>
<x:exchange-document country="EP" doc-number="13" kind="A1"/></x:root>"""
PLAIN = '<r><exchange-document country="EP" doc-number="14" kind="A1" status="D"><bibliographic-data><patent-classifications><patent-classification><classification-symbol>A</classification-symbol></patent-classification></patent-classifications></bibliographic-data></exchange-document><exchange-document country="EP" doc-number="15" kind="A1" status="D"/></r>'


def test_exchange_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.XML").write_text(XML)
    (tmp_path / "two.xml").write_text(PLAIN)
    (tmp_path / "other.txt").write_text("x")
    docs = readers.read_exchange_documents(spark, str(tmp_path))
    good, bad = exchange.split_rejects(docs)
    rows = {r["patent_id"]: r.asDict(recursive=True) for r in exchange.patent_records(good).collect()}
    assert bad.count() == 1 and sorted(rows) == ["EP0012A1", "EP14A1", "EP15A1"]
    assert rows["EP0012A1"] == {"patent_id": "EP0012A1", "status": "C", "cpc_list": ["A", "B"], "citations": [{"cited_id": "US007B", "categories": ["X", "Y"]}], "family_patents": ["WO9A"]}
    assert rows["EP14A1"]["cpc_list"] == [] and rows["EP15A1"]["family_patents"] == []
    assert sorted(r["patent_id"] for r in exchange.patent_records(exchange.split_rejects(docs, "file")[0]).collect()) == ["EP14A1", "EP15A1"]
    exchange.write_records(exchange.patent_records(good), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_exchange_odd_documents(spark, tmp_path):
    """Lists at any depth, direct children only where the layout says so, markup in texts, comments, and malformed documents."""
    doc = lambda inside, attrs="country='EP' doc-number='1' kind='A' status='C'": f"<p:exchange-document {attrs}>{inside}</p:exchange-document>"
    cls = "<q><patent-classification><classification-scheme scheme='CPCI'/><classification-symbol> B<b>1</b>&amp;2 </classification-symbol></patent-classification></q>"
    deep = "<patent-classification><x><classification-scheme scheme='CPCI'/></x><classification-symbol>C</classification-symbol></patent-classification>"
    cite = "<k><references-cited><citation><category>A</category><x><category>no</category></x><patcit><document-id><country> DE </country><kind/></document-id></patcit></citation><x><citation/></x></references-cited></k>"
    files = {"a.xml": doc(cls + cite) + "\n<!-- " + doc("in a comment") + " -->" + doc(cls + deep) + doc("<x>"), "b.xml": "<r>" + doc("", "country=\"a>b\" doc-number='' kind='A' status='C'") + "<exchange-document>", "d/c.XML": doc(cls) + "</r>"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = readers.read_exchange_documents(spark, str(tmp_path)).collect()
    assert sorted((r["file"][-5:], r["country"], r["problem"] is None, [c["symbol"] for c in r["classifications"] or []]) for r in docs if r["country"]) == [("a.xml", "EP", True, [" B1&2 "]), ("a.xml", "EP", True, [" B1&2 ", "C"]), ("b.xml", "a>b", True, []), ("c.XML", "EP", True, [" B1&2 "])]
    assert sorted((r["file"][-5:], (r["problem"] or "")[:9]) for r in docs if not r["country"]) == [("a.xml", "malformed"), ("b.xml", "")]
    good, bad = exchange.split_rejects(readers.read_exchange_documents(spark, str(tmp_path)))
    rows = sorted((r["patent_id"], r["cpc_list"], [tuple(c) for c in r["citations"]]) for r in exchange.patent_records(good).collect())
    assert rows == [("EP1A", [], []), ("EP1A", ["B1&2"], []), ("EP1A", ["B1&2"], [("DE", ["A"])])] and bad.count() == 3
    assert exchange.split_rejects(readers.read_exchange_documents(spark, str(tmp_path)), "file")[0].count() == 1
    missing = spark.createDataFrame([(str(tmp_path / "a.xml"),), (str(tmp_path / "gone.xml"),)], "path string")
    assert [tuple(r) for r in readers.unreadable(missing).collect()] == [(str(tmp_path / "gone.xml"), "unreadable: FileNotFoundError")]
    nulls = exchange.parse_xml(spark.createDataFrame([(1, None), (2, "")], "k int, xml string")).collect()
    assert all(r["problem"] and r["country"] is None for r in nulls)


def application(**more):
    base = {
        "application_number": "14112715", "publication_number": "US1", "patent_number": "None", "title": "T", "decision": "PENDING", "date_produced": "20140723", "date_published": "20140807", "filing_date": "20140326",
        "patent_issue_date": "", "abandon_date": "", "main_cpc_label": "A61B5128", "cpc_labels": ["A61B5128"], "main_ipcr_label": "A61B512", "ipcr_labels": ["A61B512"], "uspc_class": "600", "uspc_subclass": "558000",
        "examiner_id": "75147.0", "examiner_name_last": "SMITH", "examiner_name_first": "JOHN", "examiner_name_middle": "", "abstract": "Test abstract", "background": "b", "claims": "1. c", "summary": "s", "full_description": "d",
        "inventor_list": [{"inventor_name_last": "DOE", "inventor_name_first": "J"}],
    }
    return base | more


def test_import_keeps_valid_rows(spark):
    """A row that isn't valid keeps no other out, equal rows give one, and a hot key's rows don't meet in a window."""
    rows = [application(application_number="1", title=None), application(application_number="2"), application(application_number="3"), application(application_number="2"), application(publication_number=None), application(publication_number="")]
    from patentframe import schemas

    flat = spark.createDataFrame(rows, schemas.APPLICATION_JSON)
    good, others = applications.import_applications(flat)
    assert [r["metadata"]["application_number"] for r in good.collect()] == ["2"]
    assert sorted((r["application_number"], r["outcome"]) for r in others.collect()) == [("1", "rejected"), ("14112715", "skipped"), ("14112715", "skipped"), ("2", "duplicate"), ("3", "duplicate")]
    assert {r["outcome"]: r["n"] for r in applications.count_outcomes(good, others).collect()} == {"inserted": 1, "rejected": 1, "skipped": 2, "duplicate": 2}
    assert "Window" not in good._jdf.queryExecution().optimizedPlan().toString()


def test_import_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files = {
        "a": application(), "b": application(publication_number="US2", filing_date="bad"), "c": application(publication_number=""), "d": application(publication_number="US3", decision="Accepted", abandon_date="20150101"),
        "e": application(publication_number="US4", cpc_labels=None), "f": application(application_number="2"), "g": application(publication_number="US5", inventor_list=[]), "old": application(publication_number="US0"),
    }
    for k, v in files.items():
        (folder / f"{k}.json").write_text(json.dumps(v))
    (folder / "broken.json").write_text("{invalid: json}")
    existing = applications.nest(spark.createDataFrame([application(publication_number="US0")], readers.read_applications(spark, str(folder)).schema))
    good, others = applications.import_applications(readers.read_applications(spark, str(folder)), existing)
    rows = {r["metadata"]["publication_number"]: r for r in good.collect()}
    assert sorted(rows) == ["US1", "US5"] and rows["US1"]["inventors"][0]["inventor_name_last"] == "DOE" and rows["US1"]["dates"]["filing_date"] == dt.datetime(2014, 3, 26)
    assert sorted((r["publication_number"] or "", r["outcome"], ",".join(r["why"]) if r["outcome"] == "rejected" else "") for r in others.collect()) == [
        ("", "broken", ""), ("", "skipped", ""), ("US0", "existing", ""), ("US1", "duplicate", ""), ("US2", "rejected", "filing_date"), ("US3", "rejected", "accepted_but_abandoned"), ("US4", "rejected", "cpc_labels"),
    ]
    doc = documents.documents(good).where("metadata.publication_number = 'US1'").first()
    assert doc["metadata"]["examiner_name"] == "JOHN SMITH" and doc["metadata"]["filing_year"] == 2014 and len(doc["metadata"]) == 19 and json.loads(doc["page_content"])["Description"] == "d"
    out = [str(tmp_path / x) for x in ("target", "rejects", "ckpt")]
    for _ in range(2):
        ingest.ingest(ingest.applications_stream(spark, str(folder)), *out).awaitTermination()
        assert spark.read.parquet(out[0]).count() == 3
    assert [len(b) for b in documents.batches(spark.range(7), 3)] == [3, 3, 1]


def test_tsv_feather_catalog_and_archives(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("id\tcitation_date\n1\t2018-01-01\n2\t2017-12-30\n")
    assert [r["id"] for r in readers.read_tsv(spark, str(tmp_path / "x.tsv")).where("cast(citation_date as date) > date'2017-12-30'").collect()] == [1]
    import pyarrow as pa
    from pyarrow import feather

    feather.write_feather(pa.table({"a": [1, 2], "b": ["x", None]}), str(tmp_path / "x.feather"))
    assert [tuple(r) for r in readers.read_feather(spark, [str(tmp_path / "x.feather")]).collect()] == [(1, "x"), (2, None)]
    product = {"id": 3, "name": "p", "deliveries": [{"deliveryId": 4, "deliveryName": "d", "items": [{"itemId": 5, "itemName": "f.zip", "fileSize": "1.5 KB", "fileChecksum": "a9993e364706816aba3e25717850c26c9cd0d89d"}]}, {"deliveryId": 9, "deliveryName": "e", "items": []}]}
    (tmp_path / "p.json").write_text(json.dumps(product, indent=1))
    tasks = catalog.items(readers.read_catalog(spark, str(tmp_path / "p.json")), "http://h")
    row = tasks.first()
    assert (row["expected_size"], row["url"], row["file_path"]) == (1536, "http://h/products/3/delivery/4/item/5/download", "data/f.zip") and tasks.count() == 1
    files = spark.createDataFrame([("data/f.zip", bytearray(b"abc"))], "path string, content binary")
    assert catalog.to_download(tasks, files).count() == 0 and catalog.verified(files, tasks).first()["is_ok"]
    assert catalog.to_download(tasks, spark.createDataFrame([("data/f.zip", bytearray(b"abd"))], "path string, content binary")).count() == 1


def test_archives(spark, tmp_path):
    def zipped(**files):
        to = io.BytesIO()
        with zipfile.ZipFile(to, "w") as z:
            for k, v in files.items():
                z.writestr(k.replace("__", "/"), v)
        return to.getvalue()

    folder = tmp_path / "arch"
    (folder / "below").mkdir(parents=True)
    (folder / "a.ZIP").write_bytes(zipped(**{"x.txt": "1", "dir__": "", "in.zip": zipped(**{"x.txt": "2", "y.txt": "3"})}))
    with tarfile.open(folder / "below" / "b.tar.gz", "w:gz") as t:
        for name in ("ok.txt", "../evil", "late.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
        link = tarfile.TarInfo("link")
    with tarfile.open(folder / "c.tgz", "w:gz") as t:
        link.type, link.linkname = tarfile.SYMTYPE, "../../etc"
        t.addfile(link)
    (folder / "d.tar").write_bytes(b"not a tar")
    (folder / "e.txt").write_text("x")
    assert readers.read_archives(spark, str(folder)).count() == 3
    got = archive.expand(readers.read_archives(spark, str(folder), deep=True)).collect()
    rows = {(r["archive"].rsplit("/")[-1], r["path"]): (bytes(r["content"]) if r["content"] is not None else None, r["problem"], r["depth"]) for r in got}
    assert rows["a.ZIP", "x.txt"] == (b"2", None, 1) and rows["a.ZIP", "y.txt"] == (b"3", None, 1)
    assert rows["b.tar.gz", "ok.txt"] == (b"hi", None, 0) and rows["b.tar.gz", "../evil"][1] == "unsafe path" and ("b.tar.gz", "late.txt") not in rows
    assert rows["c.tgz", "link"][1] == "unsafe link"
    assert [v[1] for k, v in rows.items() if k[0] == "d.tar"] == ["broken: ReadError"]


@pytest.mark.parametrize(("own", "want"), [(["ORG", None, None], ["ORG"] * 3), ([None, None, "ORG", None], ["CORE", "CORE", "ORG", "ORG"]), ([None, None], ["CORE", "CORE"])])
def test_coref(spark, own, want):
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(own)], "chain int, idx int, label string")
    assert [r["chain_label"] for r in entities.coref_labels(rows, ["chain"], ["idx"]).orderBy("idx").collect()] == want


def test_mentions(spark):
    text = "NASA was established in 1958. " * 500
    found = entities.extract(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), ["doc_id"], "text", size=2000)
    rows = found.collect()
    assert sum(r["label"] == "ORG" for r in rows) >= 450 and all(text[r["start"] : r["end"]] == r["text"] for r in rows)
    spans = spark.createDataFrame([(1, 0, 4, "ORG"), (1, 10, 12, "DATE")], "doc_id long, start int, end int, label string")
    m = spark.createDataFrame([(1, 2, 3), (1, 4, 10), (2, 0, 1)], "doc_id long, start int, end int")
    assert sorted((r["doc_id"], r["start"], r["label"] or "") for r in entities.covering_labels(m, spans, ["doc_id"]).collect()) == [(1, 2, "ORG"), (1, 4, ""), (2, 0, "")]
    again = spark.createDataFrame([(1, 0, 4, 0, "a"), (1, 0, 4, 1, "b"), (1, 5, 6, 1, "c")], "doc_id long, start int, end int, source int, text string")
    assert sorted(r["text"] for r in entities.first_mentions(again, ["doc_id"], ["source"]).collect()) == ["a", "c"]


def test_composed_entities(spark):
    """Chains' labels come first, by chunk and place; a span has one mention; what no chunk holds is left out."""
    found = spark.createDataFrame([(1, "Ann", "PERSON", 0, 3), (1, "NASA", "ORG", 20, 24), (1, "Bob", "PERSON", 60, 63)], "d long, text string, label string, start int, end int")
    mentions = spark.createDataFrame([(1, 0, 0, 5, 8, "her"), (1, 0, 1, 0, 3, "Ann"), (1, 0, 2, 30, 33, "she"), (1, 1, 0, 20, 24, "NASA"), (1, 1, 1, 55, 57, "it"), (1, 2, 0, 20, 24, "again"), (1, 2, 1, 40, 42, "we"), (1, 3, 0, 48, 52, "cut")], "d long, chain int, idx int, start int, end int, text string")
    chunks = spark.createDataFrame([(1, 0, 0, 50), (1, 1, 50, 90)], "d long, chunk_id int, start int, end int")
    got = sorted((r["start"], r["text"], r["label"]) for r in entities.compose(mentions, found, chunks, ["d"]).collect())
    assert got == [(0, "Ann", "PERSON"), (5, "her", "CORE"), (20, "NASA", "ORG"), (30, "she", "PERSON"), (40, "we", "ORG"), (55, "it", "ORG"), (60, "Bob", "PERSON")]
    long = spark.createDataFrame([(1, 0, 10_000), (1, 7, 7), (2, 3, 4)], "d long, start int, end int")
    assert sorted((r["d"], r["start"], r["label"] or "") for r in entities.covering_labels(long, found, ["d"]).collect()) == [(1, 0, "PERSON"), (1, 7, ""), (2, 3, "")]


def test_graph(spark):
    rows = [(1, '{"relations":[{"e_1":"a","rel":"part of","e_2":"b"},{"e_1":"a","rel":"part of","e_2":"b"}]}'), (2, "{bad"), (3, '{"relations":[]}'), (4, None), (5, '{"relations":[{"e_1":"it\'s","rel":"x"}]}')]
    e = graph.edges(graph.relations(spark.createDataFrame(rows, "k int, j string"), ["k"], "j"))
    assert [tuple(r) for r in e.collect()] == [("a", "part of", "b")] and graph.nodes(e).count() == 2
    said = e.select(graph.merge_statement(F.lit("it's"), F.col("rel"), F.col("e_2")).alias("s")).first()["s"]
    assert said == "MERGE (a:Entity {name: 'it\\'s'}) MERGE (b:Entity {name: 'b'}) MERGE (a)-[:PART_OF]->(b)"
    old = spark.createDataFrame([("a", 1)], "name string, v int")
    assert sorted(map(tuple, graph.merge(old, spark.createDataFrame([("a", 2), ("c", 3)], "name string, v int"), ["name"]).collect())) == [("a", 1), ("c", 3)]


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "size long, ok boolean")
    assert tuple(metrics.totals(none, "size").first()) == (0, 0)
    assert metrics.session_status(none, F.col("ok")).first()["status"] == "empty"
    numbered = metrics.row_numbers(spark.range(0, 1000, 7).withColumnRenamed("id", "k"), "k").collect()
    assert sorted((r["k"], r["n_before"]) for r in numbered) == [(7 * n, n) for n in range(143)]


def test_optional_parts_may_be_missing(tmp_path):
    import shutil

    for name in ("patentframe", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "patentframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exchange_cpc' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
