"""Queries over the driver's tables: each derives the input of an operator from them and applies it; SQL beside it."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars
from ..operators import applications, catalog, chunking, documents, entities, exchange, graph, metrics
from ..sources import archive, files, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS citation_date FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-12-30'")
def scan_cast_filter(spark, sf_dir):
    day = F.lit("1997-12-31").cast("timestamp_ntz")  # the bound on the column itself reaches the scan
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= day)
    return rows.select("o_orderkey", F.col("o_orderdate").cast("date").alias("citation_date"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def prefix_rows(spark, sf_dir):
    return readers.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def union_batches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.where("o_orderkey % 3 = 0").unionByName(o.where("o_orderkey % 2 = 0"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS day FROM orders""")
def patent_date_normalise(spark, sf_dir):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(kind == 0, F.date_format(d, "yyyyMMdd")).when(kind == 1, F.date_format(d, "yyyy-MM-dd")).when(kind == 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.date_format(d, "yyyyMMdd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.iso_text(scalars.patent_date(raw)).alias("day"))


@query("""
SELECT s_key AS n, CASE s_key % 7
  WHEN 0 THEN s_key * 1073741824 + s_key % 10 * 1073741824 // 10 WHEN 1 THEN s_key * 1048576
  WHEN 2 THEN s_key * 1024 + 24 * 1024 // 1000 WHEN 3 THEN 0 WHEN 4 THEN s_key WHEN 5 THEN 0 ELSE s_key * 1024 + 5 * 1024 // 10 END AS bytes
FROM (SELECT s_suppkey AS s_key FROM supplier)""")
def file_sizes(spark, sf_dir):
    k, n = F.col("s_suppkey") % 7, F.col("s_suppkey").cast("string")
    tenths = (F.col("s_suppkey") % 10).cast("string")
    texts = [F.concat(n, F.lit("."), tenths, F.lit(" GB")), F.concat(n, F.lit(" MB")), F.concat(n, F.lit(",024 KB")), F.concat(n, F.lit(".0 XB")), F.concat(F.lit(" "), n, F.lit(" bytes")), F.concat(F.lit("-"), n, F.lit(" MB")), F.concat(n, F.lit(".5kib\t"))]
    raw = texts[0]
    for j, t in enumerate(texts[1:], 1):
        raw = F.when(k == j, t).otherwise(raw)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), scalars.file_size(raw).alias("bytes"))


def _flat_orders(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o,
        F.when(o % 11 != 0, o.cast("string")).alias("application_number"),
        F.when(o % 13 != 0, F.date_format("o_orderdate", "yyyyMMdd")).alias("filing_date"),
        F.when(o % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("abandon_date"),
        F.when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("PENDING").alias("decision"),
    )


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'application_number' END, CASE WHEN o_orderkey % 13 = 0 THEN 'filing_date' END,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'accepted_but_abandoned' END) AS why
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR (o_orderkey % 3 = 0 AND o_orderstatus = 'F')""")
def reject_reasons(spark, sf_dir):
    required = {"application_number": F.col("application_number"), "filing_date": scalars.patent_date(F.col("filing_date"))}
    rules = {"accepted_but_abandoned": applications.abandoned(scalars.patent_date(F.col("abandon_date")), F.col("decision"))}
    marked = _flat_orders(spark, sf_dir).withColumn("why", applications.reasons(required, rules))
    return marked.where(F.size("why") > 0).select("o_orderkey", joined("why", ",").alias("why"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'F') GROUP BY ALL")
def validate_applications(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(o % 3 == 0, F.col("o_orderdate")).alias("abandon_date"), F.when(F.col("o_orderstatus") == "F", "Accepted").otherwise("x").alias("decision"))
    return rows.where(~applications.abandoned(F.col("abandon_date"), F.col("decision"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority AS publication_number FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def skip_missing_key(spark, sf_dir):
    p = F.col("o_orderpriority")
    key = F.when(p == "1-URGENT", F.lit("")).when(p != "2-HIGH", p)
    return applications.with_key(table(spark, sf_dir, "orders").select("o_orderkey", key.alias("publication_number")))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_existing(spark, sf_dir):
    return applications.not_existing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first_seen(spark, sf_dir):
    # an aggregate by digest combines before the shuffle; no text and no hot group moves
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def _application_rows(spark, sf_dir):
    """Flat application JSON columns from orders, customers and nations; parts of an order as inventors."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))
    country = lambda x: F.when(x["l_suppkey"] % 5 == 0, F.lit("")).when(x["l_suppkey"] % 7 != 0, F.concat(F.lit("C"), (x["l_suppkey"] % 9).cast("string")))
    inventors = F.transform("items", lambda x: F.struct(F.concat(F.lit("L"), x["l_partkey"].cast("string")).alias("inventor_name_last"), F.lit("F").alias("inventor_name_first"), F.lit(None).cast("string").alias("inventor_city"), F.lit(None).cast("string").alias("inventor_state"), country(x).alias("inventor_country")))
    key = F.col("o_orderkey").cast("string")
    day = lambda k: F.when(F.col("o_orderkey") % k == 0, F.date_format("o_orderdate", "yyyyMMdd"))
    none = F.lit(None).cast("string")
    named = {
        "application_number": key, "publication_number": F.concat(F.lit("US"), key), "patent_number": none, "title": F.col("o_orderpriority"), "decision": F.col("o_orderstatus"),
        "date_produced": none, "date_published": none, "filing_date": day(1), "patent_issue_date": day(2), "abandon_date": day(5),
        "main_cpc_label": F.col("c_mktsegment"), "cpc_labels": F.when(F.col("o_orderkey") % 4 != 0, F.array("c_mktsegment", "n_name")), "main_ipcr_label": none, "ipcr_labels": F.array("n_name"), "uspc_class": none, "uspc_subclass": none,
        "examiner_id": F.concat(F.col("o_custkey").cast("string"), F.lit(".0")), "examiner_name_last": F.col("n_name"), "examiner_name_first": F.col("c_name"), "examiner_name_middle": none,
        "abstract": F.col("o_orderpriority"), "claims": F.concat(F.lit("1. A "), "c_name"), "background": none, "summary": F.lit('a "quoted" text'), "full_description": F.col("c_mktsegment"),
        "inventor_list": inventors,
    }
    joined_ = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined_.select(*(x.alias(k) for k, x in named.items()))


_NESTED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS application_number, o_orderstatus AS decision, CAST(o_orderdate AS DATE) AS filed, c_mktsegment AS main_cpc_label, n_name AS examiner FROM {_NESTED}")
def nest_application(spark, sf_dir):
    nested = applications.nest(_application_rows(spark, sf_dir))
    return nested.select("metadata.application_number", "metadata.decision", F.col("dates.filing_date").cast("date").alias("filed"), "classification.main_cpc_label", F.col("examiner.examiner_name_last").alias("examiner"))


@query(f"""
WITH i AS (SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list_distinct(list('C' || l_suppkey % 9) FILTER (l_suppkey % 5 <> 0 AND l_suppkey % 7 <> 0))), '|') AS countries FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS application_number, 'US' || o_orderkey AS publication_number, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS filing_date,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS patent_issue_date, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS abandon_date,
  CASE WHEN o_orderkey % 4 <> 0 THEN c_mktsegment || '|' || n_name ELSE '' END AS cpc_labels, n_name AS ipcr_labels, o_custkey || '.0' AS examiner_id, c_name || ' ' || n_name AS examiner_name,
  coalesce(i.n, 0) AS inventor_count, coalesce(countries, '') AS inventor_countries, year(o_orderdate) AS filing_year
FROM {_NESTED} LEFT JOIN i ON o_orderkey = l_orderkey""")
def metadata_document(spark, sf_dir):
    got = documents.documents(applications.nest(_application_rows(spark, sf_dir))).select("metadata.*")
    lists = [joined(k).alias(k) for k in ("cpc_labels", "ipcr_labels", "inventor_countries")]
    return got.select("application_number", "publication_number", "filing_date", "patent_issue_date", "abandon_date", "examiner_id", "examiner_name", "inventor_count", "filing_year", *lists)


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS application_number, CAST(to_json({{'Title': o_orderpriority, 'Abstract': o_orderpriority, 'Claims': '1. A ' || c_name, 'Background': NULL,
  'Summary': 'a "quoted" text', 'Description': c_mktsegment}}) AS VARCHAR) AS page_content FROM {_NESTED}""")
def page_content_json(spark, sf_dir):
    got = documents.documents(applications.nest(_application_rows(spark, sf_dir)))
    return got.select("metadata.application_number", "page_content")


@query("""
SELECT l_orderkey AS order_key, coalesce(array_to_string(list_sort(list_distinct(list('C' || l_suppkey % 9) FILTER (l_suppkey % 5 <> 0))), '|'), '') AS countries FROM lineitem GROUP BY 1""")
def inventor_countries(spark, sf_dir):
    country = F.when(F.col("l_suppkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), (F.col("l_suppkey") % 9).cast("string")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(country.alias("inventor_country"))).alias("inventors"))
    return rows.select(F.col("l_orderkey").alias("order_key"), joined(documents.distinct_countries(F.col("inventors"))).alias("countries"))


def _exchange_xml(spark, sf_dir, deep: bool = False):
    """An exchange-document of each order, with line items as classifications, citations and family members.

    ``deep`` puts the lists below other elements, under a prefix that is declared nowhere.
    """
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    part, supp, line = (F.col(f"l_{k}") for k in ("partkey", "suppkey", "linenumber"))
    scheme = F.when(line % 3 == 0, F.lit("IPC")).otherwise(F.lit("CPCI"))
    cls = text("<patent-classification><classification-scheme scheme=\"", scheme, "\"/><classification-symbol> A", part % 50, "\n</classification-symbol></patent-classification>")
    broken = F.when(part % 97 == 0, F.lit("<patent-classification><classification-symbol>A</classification-symbol></patent-classification>")).otherwise(F.lit(""))
    number = text("<document-id><country>EP</country><doc-number>", F.lpad((supp % 100).cast("string"), 4, "0"), "</doc-number><kind>A1</kind></document-id>")
    patcit = F.when(line % 2 == 0, text("<patcit>", number, "</patcit>")).otherwise(F.lit("<nplcit/>"))
    cite = text("<citation>", patcit, "<category>X</category><category> </category><rel-passage><category>Y", line, "</category></rel-passage></citation>")
    kind = F.when(line % 4 == 0, F.lit("epodoc")).otherwise(F.lit("docdb"))
    member = text("<family-member><publication-reference data-format=\"", kind, "\">", number, "</publication-reference></family-member>")
    # by number, so that small shuffles aren't merged into few tasks: parsing costs far more than its bytes tell
    lines = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    li = lines.groupBy("l_orderkey").agg(*(F.sort_array(F.collect_list(F.struct("l_linenumber", c.alias("x")))).alias(k) for k, c in {"cls": F.concat(cls, broken), "cite": cite, "member": member}.items()))
    all_of = lambda k: F.coalesce(F.array_join(F.transform(k, lambda s: s["x"]), ""), F.lit(""))
    o = F.col("o_orderkey")
    head = text("<exchange-document country=\"EP\" doc-number=\"", F.lpad((o % 100).cast("string"), 4, "0"), "\" kind=\"A1\"", F.when(o % 10 != 0, text(" status=\"", F.col("o_orderstatus"), "\"")).otherwise(F.lit("")), ">")
    body = text("<bibliographic-data><patent-classifications>", all_of("cls"), "</patent-classifications><references-cited>", all_of("cite"), "</references-cited></bibliographic-data><patent-family>", all_of("member"), "</patent-family></exchange-document>")
    rows = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    xml = F.concat(head, body)
    if deep:
        for name in ("patent-classifications", "references-cited", "patent-family"):
            xml = F.regexp_replace(xml, f"<{name}>(.*?)</{name}>", f"<other><p:deeper n=\"1\"><{name}>$1</{name}></p:deeper></other>")
        xml = F.regexp_replace(xml, "(</?)(patent-classification|citation|family-member|exchange-document)(?=[\\s/>])", "$1x:$2")
    return rows.select(o, (o % 500).alias("file"), xml.alias("xml"))


def _records(spark, sf_dir, deep: bool = False):
    accepted, _ = exchange.split_rejects(exchange.parse_xml(_exchange_xml(spark, sf_dir, deep)))
    return exchange.patent_records(accepted, ("o_orderkey",))


_ID = "'EP' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 4, '0') || 'A1'"


@query(f"""
WITH i AS (SELECT l_orderkey, bool_or(l_partkey % 97 = 0) AS bad, list_sort(list_distinct(list('A' || l_partkey % 50) FILTER (l_linenumber % 3 <> 0))) AS cpc FROM lineitem GROUP BY 1)
SELECT o_orderkey, {_ID} AS patent_id, o_orderstatus AS status, CASE WHEN bad THEN '' ELSE coalesce(array_to_string(cpc, '|'), '') END AS cpc_list
FROM orders LEFT JOIN i ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0""")
def exchange_cpc(spark, sf_dir):
    return _records(spark, sf_dir).select("o_orderkey", "patent_id", "status", joined("cpc_list").alias("cpc_list"))


@query("""
SELECT o_orderkey, 'EP' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 4, '0') || 'A1' AS cited_id, 'X|Y' || l_linenumber AS categories
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0 AND l_linenumber % 2 = 0""")
def exchange_citations(spark, sf_dir):
    rows = _records(spark, sf_dir).select("o_orderkey", F.explode("citations").alias("c"))
    return rows.select("o_orderkey", "c.cited_id", joined(F.array_sort("c.categories")).alias("categories"))


@query(f"""
WITH f AS (SELECT o_orderkey, list_sort(list_distinct(list('EP' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 4, '0') || 'A1') FILTER (l_linenumber % 4 <> 0 AND l_suppkey % 100 <> o_orderkey % 100))) AS ids
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, {_ID} AS patent_id, coalesce(array_to_string(ids, '|'), '') AS family_patents FROM orders LEFT JOIN f USING (o_orderkey) WHERE o_orderkey % 10 <> 0""")
def exchange_family(spark, sf_dir):
    return _records(spark, sf_dir).select("o_orderkey", "patent_id", joined("family_patents").alias("family_patents"))


@query(f"""
WITH i AS (SELECT l_orderkey, bool_or(l_partkey % 97 = 0) AS bad, list_sort(list_distinct(list('A' || l_partkey % 50) FILTER (l_linenumber % 3 <> 0))) AS cpc, count(*) FILTER (l_linenumber % 2 = 0) AS cited,
  list_sort(list_distinct(list('EP' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 4, '0') || 'A1') FILTER (l_linenumber % 4 <> 0 AND l_suppkey % 100 <> l_orderkey % 100))) AS ids FROM lineitem GROUP BY 1)
SELECT o_orderkey, {_ID} AS patent_id, CASE WHEN bad THEN '' ELSE coalesce(array_to_string(cpc, '|'), '') END AS cpc_list, CAST(coalesce(cited, 0) AS INTEGER) AS citations, coalesce(array_to_string(ids, '|'), '') AS family_patents
FROM orders LEFT JOIN i ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0""")
def exchange_any_depth(spark, sf_dir):
    return _records(spark, sf_dir, deep=True).select("o_orderkey", "patent_id", joined("cpc_list").alias("cpc_list"), F.size("citations").alias("citations"), joined("family_patents").alias("family_patents"))


def _write_texts(rows, folder: str, end: str, begin: str = "", close: str = ""):
    """One file a task of (group, text) rows, below a folder by group; its path."""
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        parts: dict = {}
        for b in batches:
            for group, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.setdefault(group, []).append(text)
        paths = [f"{folder}/{group}/f{TaskContext.get().partitionId():05d}{end}" for group in parts]
        for path, texts in zip(paths, parts.values()):
            files.write_parts(path, [(begin + "".join(texts) + close).encode()])
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    return rows.mapInArrow(write, "path string")


@query("""
SELECT 'EP' || c_custkey || 'B' AS patent_id, 'S' || c_nationkey AS status, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'A' || c_custkey % 50 END AS cpc_list FROM customer WHERE c_custkey % 7 <> 0""")
def exchange_files(spark, sf_dir):
    """Documents in files of several folders, some in upper case, with prefixes, self-closing and without attributes."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("<e:exchange-document country='EP' doc-number='"), k.cast("string"), F.lit("' kind=\"B\" status=\"S"), F.col("c_nationkey").cast("string"), F.lit("\""))
    inside = F.concat(F.lit("><a><e:patent-classification><classification-scheme scheme='CPCI'/><classification-symbol>A"), (k % 50).cast("string"), F.lit("</classification-symbol></e:patent-classification></a></e:exchange-document>\n"))
    one = F.when(k % 14 == 0, F.lit("<e:exchange-document>x</e:exchange-document>")).when(k % 7 == 0, F.lit("<e:exchange-document country='EP'/>")).when(k % 9 == 0, F.concat(text, F.lit("/>"))).otherwise(F.concat(text, inside))
    folder = files.work_dir(spark, "xml-files")
    rows = table(spark, sf_dir, "customer").repartition(4, "c_custkey").select((k % 3).cast("string").alias("g"), one.alias("x"))
    _write_texts(rows, folder, ".XML", "<?xml version='1.0'?><e:exchange-documents xmlns:e='urn:e'>", "</e:exchange-documents>").write.format("noop").mode("overwrite").save()
    accepted, _ = exchange.split_rejects(readers.read_exchange_documents(spark, folder))
    return exchange.patent_records(accepted).select("patent_id", "status", joined("cpc_list").alias("cpc_list"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS note FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-12-30'")
def tsv_scan(spark, sf_dir):
    folder = files.work_dir(spark, "tsv")
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("note")).write.option("header", True).option("sep", "\t").csv(folder)
    return readers.read_tsv(spark, folder, "o_orderkey long, day date, note string").where("day > date'1997-12-30'")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def feather_scan(spark, sf_dir):
    folder = files.work_dir(spark, "feather")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if batches:
            path, sink = f"{folder}/f{TaskContext.get().partitionId():05d}.feather", pa.BufferOutputStream()
            with pa.ipc.new_file(sink, batches[0].schema) as f:
                for b in batches:
                    f.write_batch(b)
            files.write_parts(path, [sink.getvalue().to_pybytes()])
            yield pa.RecordBatch.from_pydict({"path": [path]})

    written = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").repartition(4).mapInArrow(write, "path string")
    written.write.parquet(f"{folder}/list")
    return readers.read_feather(spark, spark.read.parquet(f"{folder}/list"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS application_number, s_name AS title, s_suppkey % 5 = 0 AS broken FROM supplier")
def json_files(spark, sf_dir):
    """One object a file in one folder; broken ones keep their place, other files and folders aren't read."""
    folder = files.work_dir(spark, "json")
    k = F.col("s_suppkey").cast("string")
    made = F.to_json(F.struct(k.alias("application_number"), F.col("s_name").alias("title")))
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("{invalid: "), k, F.lit(" "), F.col("s_name"))).otherwise(made).alias("x"))

    def write(batches):
        import pyarrow as pa

        for b in batches:
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                files.write_parts(f"{folder}/a{key}.json", [text.encode()])
                files.write_parts(f"{folder}/below/a{key}.json", [b"{}"]) if int(key) % 50 == 0 else None
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    got = readers.read_applications(spark, folder)
    broken = F.col("_corrupt_record").isNotNull()
    told = [F.regexp_extract("_corrupt_record", r"^\{invalid: (\d+) (.*)$", n) for n in (1, 2)]
    return got.select(F.when(broken, told[0]).otherwise(F.col("application_number")).alias("application_number"), F.when(broken, told[1]).otherwise(F.col("title")).alias("title"), broken.alias("broken"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS application_number, year(o_orderdate) AS filing_year, c_mktsegment AS main_cpc_label FROM {_NESTED} WHERE o_orderstatus = 'F' AND c_mktsegment <> 'BUILDING'")
def stored_applications(spark, sf_dir):
    """Stored in folders by decision; the query opens one of them and reads two columns."""
    folder = files.work_dir(spark, "stored")
    nested = applications.nest(_application_rows(spark, sf_dir))
    exchange.write_records(nested.select("*", F.col("metadata.decision").alias("decision")), folder, ("decision",))
    rows = readers.read_stored(spark, folder, "decision = 'F' and classification.main_cpc_label <> 'BUILDING'")
    return rows.select("metadata.application_number", F.year("dates.filing_date").alias("filing_year"), "classification.main_cpc_label")


@query("""
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'HOT' ELSE 'US' || o_custkey END AS pub,
  o_orderkey % 4 = 0 AS bad, o_custkey % 5 = 0 AS known, unnest(range(CASE WHEN o_orderkey % 6 = 1 THEN 2 ELSE 1 END)) AS copy FROM orders),
o AS (SELECT *, CASE WHEN pub IS NULL OR pub = '' THEN 'skipped' WHEN pub <> 'HOT' AND known THEN 'existing' WHEN bad THEN 'rejected' ELSE 'valid' END AS what FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY lpad(CAST(k AS VARCHAR), 12, '0'), copy) AS nth FROM o WHERE what = 'valid')
SELECT lpad(CAST(k AS VARCHAR), 12, '0') AS application_number, pub AS publication_number, what AS outcome FROM o WHERE what <> 'valid'
UNION ALL SELECT lpad(CAST(k AS VARCHAR), 12, '0'), pub, CASE WHEN nth = 1 THEN 'inserted' ELSE 'duplicate' END FROM n""")
def import_outcomes(spark, sf_dir):
    """Null, empty and hot keys, rows that aren't valid before valid ones, equal rows, and keys that are stored already."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pub = F.when(o % 17 == 0, F.lit(None)).when(o % 19 == 0, F.lit("")).when(o % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("US"), c.cast("string")))
    text = lambda x: F.lit(x).cast("string")
    named = {n: text("x") for n in applications.REQUIRED} | {n: text(None) for n in (*schemas.DATE_FIELDS, "main_cpc_label", "main_ipcr_label", "uspc_class", "uspc_subclass", "examiner_name_middle")}
    named |= {n: F.array(F.lit("A")) for n in ("cpc_labels", "ipcr_labels")} | {"filing_date": text("20140326"), "publication_number": pub, "application_number": F.lpad(o.cast("string"), 12, "0")}
    named |= {"title": F.when(o % 4 != 0, F.lit("T")), "inventor_list": F.array().cast(f"array<{schemas.INVENTOR}>")}
    orders = table(spark, sf_dir, "orders")
    flat = orders.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(o % 6 == 1, 2).otherwise(1)))).select(*(x.alias(k) for k, x in named.items()))
    stored = orders.where(c % 5 == 0).select(F.struct(F.concat(F.lit("US"), c.cast("string")).alias("publication_number")).alias("metadata"))
    good, others = applications.import_applications(flat, stored)
    inserted = good.select("metadata.application_number", "metadata.publication_number", F.lit("inserted").alias("outcome"))
    return inserted.unionByName(others.select("application_number", "publication_number", "outcome"))


_CHAINS = "SELECT user_id, event_id, event_id % 4 AS chain, event_id // 4 AS idx, CAST(event_id * 7 % 3000 AS INTEGER) AS s, CAST(event_id * 7 % 3000 + 1 + event_id % 5 AS INTEGER) AS e, event_type FROM events"


def _spans(spark, sf_dir):
    """Events as mentions of chains and, every third, as entities of a user's text."""
    i = F.col("event_id")
    at = (i * 7 % 3000).cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (i % 4).alias("chain"), F.floor(i / 4).alias("idx"), at.alias("start"), (at + 1 + (i % 5).cast("int")).alias("end"), "event_type")
    mentions = rows.where("event_id % 3 <> 0").withColumn("text", F.concat(F.lit("m"), F.col("event_id").cast("string")))
    found = rows.where("event_id % 3 = 0").select("user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"), F.col("event_type").alias("label"), "start", "end")
    return mentions, found


@query(f"""
WITH r AS ({_CHAINS}), m AS (SELECT * FROM r WHERE event_id % 3 <> 0), n AS (SELECT * FROM r WHERE event_id % 3 = 0)
SELECT m.user_id, m.event_id, min({{'s': n.s, 'e': n.e, 'l': n.event_type}}).l AS label FROM m LEFT JOIN n ON m.user_id = n.user_id AND n.s < m.e AND n.e > m.s GROUP BY ALL""")
def covering_labels(spark, sf_dir):
    mentions, found = _spans(spark, sf_dir)
    return entities.covering_labels(mentions, found, ["user_id"]).select("user_id", "event_id", "label")


@query(f"""
WITH r AS ({_CHAINS}), m AS (SELECT *, s // 1000 AS chunk FROM r WHERE event_id % 3 <> 0 AND e <= (s // 1000 + 1) * 1000), n AS (SELECT * FROM r WHERE event_id % 3 = 0),
o AS (SELECT m.user_id, m.event_id, m.chain, m.idx, m.s, m.e, m.chunk, min({{'s': n.s, 'e': n.e, 'l': n.event_type}}).l AS own FROM m LEFT JOIN n ON m.user_id = n.user_id AND n.s < m.e AND n.e > m.s GROUP BY ALL),
z AS (SELECT o.*, coalesce(o.own, z.own) AS label FROM o LEFT JOIN o z ON z.user_id = o.user_id AND z.chain = o.chain AND z.idx = 0 AND z.chunk = o.chunk),
k AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY user_id, s, e ORDER BY chain, idx) = 1),
c AS (SELECT user_id, 'm' || event_id AS text, coalesce(first_value(label IGNORE NULLS) OVER (PARTITION BY user_id, chain ORDER BY chunk, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'CORE') AS label, s, e FROM k),
p AS (SELECT user_id, 'e' || event_id AS text, event_type AS label, s, e FROM n QUALIFY row_number() OVER (PARTITION BY user_id, s, e ORDER BY event_type, 'e' || event_id) = 1)
SELECT user_id, text, label, s AS start, e AS stop FROM c UNION ALL SELECT user_id, text, label, s, e FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c.s = p.s AND c.e = p.e)""")
def entity_composed(spark, sf_dir):
    mentions, found = _spans(spark, sf_dir)
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    chunks = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_id")).select("*", (F.col("chunk_id") * 1000).alias("start"), ((F.col("chunk_id") + 1) * 1000).alias("end"))
    return entities.compose(mentions, found, chunks, ["user_id"]).withColumnRenamed("end", "stop")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 9")
def first_batch_element(spark, sf_dir):
    batch = metrics.batch_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000).where("batch = 0")
    return batch.orderBy("o_orderkey").offset(9).limit(1).select("o_orderkey", "o_totalprice")


@query("""
SELECT n_name || CASE n_nationkey % 4 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.tgz' ELSE '.tar' END AS archive, CASE n_nationkey % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'tgz' ELSE 'tar' END AS kind,
  n_nationkey % 3 <> 0 AS is_deep, 'in/' || n_nationkey || '.txt' AS path, CAST(strlen(n_comment) AS BIGINT) AS written, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 416 END AS mode
FROM (SELECT *, coalesce(n_name, '') AS n_comment FROM nation)""")
def archive_files(spark, sf_dir):
    """Archives of all kinds in a folder and below it; their members are unpacked with their permissions and met again as files."""
    folder, out = files.work_dir(spark, "archives"), files.work_dir(spark, "members")

    def write(batches):
        import pyarrow as pa

        for b in batches:
            for k, name in zip(*(c.to_pylist() for c in b.columns)):
                end, to = (".ZIP", ".tar.gz", ".tgz", ".tar")[k % 4], io.BytesIO()
                if end == ".ZIP":
                    with zipfile.ZipFile(to, "w") as z:
                        z.writestr(f"in/{k}.txt", name)
                else:
                    with tarfile.open(fileobj=to, mode="w" if end == ".tar" else "w:gz") as t:
                        info = tarfile.TarInfo(f"in/{k}.txt")
                        info.size, info.mode = len(name.encode()), 0o640
                        t.addfile(info, io.BytesIO(name.encode()))
                files.write_parts(f"{folder}/{'below/' if k % 3 else ''}{name}{end}", [to.getvalue()])
                files.write_parts(f"{folder}/{name}.xml", [b"<no archive/>"])
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name")).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    flat = readers.read_archives(spark, folder).select("path", F.lit(True).alias("top"))
    deep = readers.read_archives(spark, folder, deep=True)
    found = archive.expand(deep).join(deep.select(F.col("path").alias("archive"), "kind"), "archive").join(flat.withColumnRenamed("path", "archive"), "archive", "left")
    wrote = archive.materialise(archive.expand(deep), out)
    rows = found.join(wrote, ["archive", "path"])
    name = F.url_decode(F.element_at(F.split("archive", "/"), -1))
    return rows.select(name.alias("archive"), "kind", F.col("top").isNull().alias("is_deep"), "path", "written", F.when(F.col("kind") == "zip", 0).otherwise(F.col("mode")).alias("mode"))


@query("""
SELECT o_orderkey % 500 AS file, count(*) AS n FROM orders WHERE o_orderkey % 500 NOT IN (SELECT o_orderkey % 500 FROM orders WHERE o_orderkey % 10 = 0) GROUP BY 1""")
def file_level_reject(spark, sf_dir):
    accepted, _ = exchange.split_rejects(exchange.parse_xml(_exchange_xml(spark, sf_dir)), scope="file")
    return accepted.groupBy("file").agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT conv_id, string_agg((turn + 1) || '. ' || text, ' ' ORDER BY turn) AS x FROM conversations GROUP BY 1),
p AS (SELECT conv_id, list_filter(list_transform(string_split(regexp_replace(x, '(\d+\.\s)', chr(1) || '\1', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS c FROM t),
u AS (SELECT conv_id, len(c) AS total_chunks, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS chunk_index FROM p)
SELECT conv_id, chunk_index, total_chunks, chunk, try_cast(nullif(regexp_extract(chunk, '^(\d+)\.', 1), '') AS INTEGER) AS claim_number FROM u""")
def claims_split(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    numbered = F.transform("turns", lambda t: F.concat((t["turn"] + 1).cast("string"), F.lit(". "), t["text"]))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(numbered, " ").alias("x"))
    return chunking.positions(rows, ["conv_id"], chunking.split_claims(F.col("x"))).withColumn("claim_number", scalars.claim_number(F.col("chunk")))


@query("""
SELECT * FROM (SELECT doc_id, 'text' AS section, text FROM documents UNION ALL SELECT doc_id, 'lang', CASE WHEN lang <> 'de' THEN lang END FROM documents
  UNION ALL SELECT doc_id, 'source', CASE WHEN source = 'src0' THEN '' ELSE source END FROM documents) WHERE text <> ''""")
def section_explode(spark, sf_dir):
    named = {"text": F.col("text"), "lang": F.when(F.col("lang") != "de", F.col("lang")), "source": F.when(F.col("source") == "src0", "").otherwise(F.col("source"))}
    return chunking.sections(table(spark, sf_dir, "documents"), ["doc_id"], named)


@query(r"""
WITH s AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text), 1), 2000)) AS s0 FROM documents),
f AS (SELECT *, least(s0 + 2000, n) AS full_end, substring(text, CAST(least(s0 + 2000, n) - 199 AS BIGINT), 200) AS tail FROM s),
e AS (SELECT doc_id, text, s0, CASE WHEN full_end < n AND regexp_matches(tail, '[.?!]|\n\n') THEN full_end - 200 + length(regexp_extract(tail, '(?s)^(.*)(?:[.?!]|\n\n)', 1)) + 1 ELSE full_end END AS stop FROM f)
SELECT doc_id, CAST(s0 AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, substring(text, CAST(s0 + 1 AS BIGINT), CAST(stop - s0 AS BIGINT)) AS chunk FROM e""")
def boundary_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.boundary_chunks(F.col("text"), 2000, 200)).alias("c"))
    return rows.select("doc_id", "c.start", F.col("c.end").alias("stop"), F.col("c.text").alias("chunk"))


@query("""
SELECT event_id, user_id, coalesce(first_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'CORE') AS chain_label
FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN event_type END AS label FROM events)""")
def coref_labels(spark, sf_dir):
    m = table(spark, sf_dir, "events").withColumn("label", F.when(F.col("event_id") % 7 == 0, F.col("event_type")))
    return entities.coref_labels(m, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "chain_label")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def first_mentions(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("start"), F.date_trunc("day", "ts").alias("end"))
    return entities.first_mentions(m, ["user_id"], ["event_id"]).select("user_id", F.col("start").alias("event_type"), "event_id")


@query("""SELECT doc_id, 'ORG' AS label, unnest(regexp_extract_all(text, '[A-Z]{3,}', 0)) AS text FROM documents""")
def entity_mentions(spark, sf_dir):
    return entities.extract_native(table(spark, sf_dir, "documents"), ["doc_id"], "text", "ORG", "[A-Z]{3,}")


#: All matches of the deterministic back end in texts t (k, base, x), with their places: what lies between them is measured.
_FOUND = r"""
p AS (SELECT * FROM (VALUES ('DATE', '\b(?:1[89]|20)\d\d\b'), ('MONEY', '\$\d+(?:\.\d+)?[MBK]?'), ('ORG', '\b[A-Z]{3,}\b')) v(label, rx)),
g AS (SELECT k, base, label, regexp_extract_all(x, rx) AS m, list_transform(string_split_regex(x, rx), lambda s: length(s)) AS gaps FROM t, p WHERE regexp_matches(x, rx)),
h AS (SELECT k, base, label, m, gaps, list_transform(m, lambda s: length(s)) AS sizes FROM g),
f AS (SELECT k, base, label, m[i] AS text, CAST(base + list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS INTEGER) AS start, sizes[i] AS size FROM h, unnest(range(1, len(m) + 1)) u(i))"""


@query(r"""
WITH s AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text), 1), 2000)) AS s0 FROM documents),
fe AS (SELECT *, least(s0 + 2000, n) AS full_end, substring(text, CAST(least(s0 + 2000, n) - 199 AS BIGINT), 200) AS tail FROM s),
e AS (SELECT doc_id, text, s0, CASE WHEN full_end < n AND regexp_matches(tail, '[.?!]|\n\n') THEN full_end - 200 + length(regexp_extract(tail, '(?s)^(.*)(?:[.?!]|\n\n)', 1)) + 1 ELSE full_end END AS stop FROM fe),
t AS (SELECT doc_id AS k, s0 AS base, substring(text, CAST(s0 + 1 AS BIGINT), CAST(stop - s0 AS BIGINT)) AS x FROM e),""" + _FOUND + """
SELECT k AS doc_id, CAST(base // 2000 AS INTEGER) AS chunk_id, text, label, start, CAST(start + size AS INTEGER) AS stop FROM f""")
def entity_spans(spark, sf_dir):
    return entities.extract(table(spark, sf_dir, "documents"), ["doc_id"], "text", size=2000, window=200).withColumnRenamed("end", "stop")


@query("SELECT DISTINCT 'u' || user_id AS e_1, event_type AS rel, 'k' || event_id % 17 AS e_2 FROM events WHERE event_id % 5 <> 0")
def relations_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("e_1"), F.col("event_type").alias("rel"), F.concat(F.lit("k"), (F.col("event_id") % 17).cast("string")).alias("e_2"))
    made = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.array(one, one).alias("relations"))))
    return graph.edges(graph.relations(e.select("event_id", made.alias("json")), ["event_id"], "json"))


@query("""
SELECT DISTINCT name FROM (SELECT 'u' || user_id AS name FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT 'k' || event_id % 17 FROM events WHERE event_id % 5 <> 0)""")
def relations_nodes(spark, sf_dir):
    return graph.nodes(relations_edges(spark, sf_dir))


@query("""SELECT DISTINCT 'MERGE (a:Entity {name: ''u' || user_id || '''}) MERGE (b:Entity {name: ''k' || event_id % 17 || '''}) MERGE (a)-[:' || upper(event_type) || ']->(b)' AS statement
FROM events WHERE event_id % 5 <> 0""")
def merge_statements(spark, sf_dir):
    e = relations_edges(spark, sf_dir)
    return e.select(graph.merge_statement(F.col("e_1"), F.col("rel"), F.col("e_2")).alias("statement"))


def _catalog(spark, sf_dir):
    """A product of each supplier: its parts' lines as items, a delivery for each return flag."""
    li = table(spark, sf_dir, "lineitem")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    item = F.struct(number.alias("itemId"), F.concat(F.lit("f"), number.cast("string"), F.lit(".zip")).alias("itemName"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5 KB")).alias("fileSize"), F.sha1(number.cast("string")).alias("fileChecksum"), F.lit(None).cast("string").alias("itemPublicationDatetime"))
    flag = F.ascii("l_returnflag").cast("long")
    deliveries = li.groupBy("l_suppkey", flag.alias("deliveryId")).agg(F.collect_list(item).alias("items"))
    one = F.struct("deliveryId", F.lit("d").alias("deliveryName"), F.lit(None).cast("string").alias("deliveryExpiryDatetime"), "items")
    products = deliveries.groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_list(one).alias("deliveries")).withColumn("name", F.lit("p"))
    return catalog.items(catalog.parse(products.select(F.to_json(F.struct("id", "name", "deliveries")).alias("json")), "json"))


@query("""
SELECT l_suppkey AS product, CAST(ascii(l_returnflag) AS BIGINT) AS delivery, 'f' || (l_orderkey * 10 + l_linenumber) || '.zip' AS filename, CAST(l_quantity AS INTEGER) * 1024 + 512 AS expected_size,
  sha1(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)) AS checksum, 'https://example.org/products/' || l_suppkey || '/delivery/' || ascii(l_returnflag) || '/item/' || (l_orderkey * 10 + l_linenumber) || '/download' AS url
FROM lineitem""")
def catalog_items(spark, sf_dir):
    return _catalog(spark, sf_dir).select("product", "delivery", "filename", "expected_size", "checksum", "url")


@query("SELECT CAST(sum(CAST(l_quantity AS INTEGER) * 1024 + 512) AS BIGINT) AS total_bytes, count(*) AS total_files FROM lineitem")
def catalog_totals(spark, sf_dir):
    return metrics.totals(_catalog(spark, sf_dir), "expected_size")


@query("SELECT doc_id, text IS NOT NULL AND doc_id % 3 <> 0 AS is_ok FROM documents")
def checksum_verify(spark, sf_dir):
    expected = F.when(F.col("doc_id") % 3 == 0, F.upper(F.sha1("text"))).otherwise(F.sha1("text"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.checksum_ok(F.col("text"), expected).alias("is_ok"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'tgz' WHEN 3 THEN 'tar' ELSE 'unknown' END AS kind,
  'f' || p_partkey || CASE WHEN p_partkey % 5 = 4 THEN '.xml' ELSE '' END AS stem FROM part""")
def archive_kinds(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, (".ZIP", ".tar.gz", ".tgz", ".Tar", ".xml"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string"), suffix).alias("name"))
    return rows.select("p_partkey", scalars.archive_kind(F.col("name")).alias("kind"), scalars.archive_stem(F.col("name")).alias("stem"))


@query("SELECT event_type, event_id % 2 = 0 AS success, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL")
def metric_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("success", F.col("event_id") % 2 == 0)
    return metrics.counters(rows, ["event_type", "success"], "user_id")


@query("""
SELECT event_type, CASE WHEN value > 50 THEN 3 WHEN value > 10 THEN 2 WHEN value > 1 THEN 1 ELSE 0 END AS bucket, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY ALL""")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [1, 10, 50]).drop("total")


@query("SELECT count(*) AS n_total, count(*) FILTER (user_id % 9 <> 0) AS n_ok, count(*) FILTER (user_id % 9 = 0) AS n_failed, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'success' END AS status FROM events")
def session_status(spark, sf_dir):
    return metrics.session_status(table(spark, sf_dir, "events"), F.col("user_id") % 9 != 0)


@query("SELECT arg_min(event_type, event_id) FILTER (event_id % 9 = 4) AS first_error, count(*) FILTER (event_id % 9 = 4) AS errors FROM events")
def first_error(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 4, F.col("event_type")).alias("error"))
    return metrics.first_error(rows, "event_id", "error")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch FROM orders")
def batch_index(spark, sf_dir):
    return metrics.batch_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT o_orderstatus AS decision, o_custkey % 10 AS examiner, count(*) AS n FROM orders GROUP BY ALL")
def decision_by_examiner(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("decision"), (F.col("o_custkey") % 10).alias("examiner")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM documents GROUP BY ALL")
def text_length_stats(spark, sf_dir):
    n = F.char_length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).cast("long").alias("chars"), F.max(n).cast("long").alias("longest"))


@query()
def recursive_splitter(spark, sf_dir):
    rows = chunking.split_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return chunking.positions(rows, ["doc_id"], F.col("chunks"))


@query(f"""
WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS application_number, unnest([{{'section': 'Title', 'chunk': o_orderpriority}}, {{'section': 'Abstract', 'chunk': o_orderpriority}}, {{'section': 'Claims', 'chunk': '1. A ' || c_name}},
  {{'section': 'Summary', 'chunk': 'a "quoted" text'}}, {{'section': 'Description', 'chunk': c_mktsegment}}], recursive := true) FROM {_NESTED})
SELECT application_number, section, 1 AS total_chunks, 0 AS chunk_index, chunk, CASE WHEN section = 'Claims' THEN 1 END AS claim_number FROM s""")
def chunk_pipeline(spark, sf_dir):
    docs = documents.documents(applications.nest(_application_rows(spark, sf_dir))).select("metadata.application_number", "page_content")
    return chunking.chunk_documents(docs, ["application_number"])


def _nested_archive(name: str, text: str) -> bytes:
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr(zipfile.ZipInfo(f"{name}.txt"), text)
    with tarfile.open(fileobj=outer, mode="w") as t:
        info = tarfile.TarInfo(f"in/{name}.zip")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
    return outer.getvalue()


@query("SELECT p_partkey || '.tar' AS archive, 'in/' || p_partkey || '.txt' AS path, 1 AS depth, CAST(strlen(p_name) AS BIGINT) AS size FROM part")
def archive_expand(spark, sf_dir):
    def pack(batches):
        import pyarrow as pa

        for b in batches:
            keys = [str(k) for k in b.column(0).to_pylist()]
            made = [_nested_archive(k, x) for k, x in zip(keys, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pydict({"path": [f"{k}.tar" for k in keys], "content": pa.array(made, pa.binary())})

    made = table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(pack, "path string, content binary")
    return archive.expand(made).select("archive", "path", "depth", "size")


@query("WITH t AS (SELECT doc_id AS k, 0 AS base, text AS x FROM documents WHERE text IS NOT NULL)," + _FOUND + """,
n AS (SELECT k, text AS e_1, lead(text) OVER (PARTITION BY k ORDER BY start, size, label) AS e_2 FROM f)
SELECT k AS doc_id, e_1, 'followed_by' AS rel, e_2 FROM n WHERE e_2 IS NOT NULL""")
def kg_from_text(spark, sf_dir):
    found = entities.pattern_backend()
    return graph.build(table(spark, sf_dir, "documents"), ["doc_id"], "text", lambda t: [m[0] for m in found(t)], graph.chain_relations)
