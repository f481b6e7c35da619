"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import _common as C
from . import bpe, fingerprint, linededup, media, packing, quality, secrets, simhash, warc, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wavelet.write_shards(_table(spark, sf_dir, "documents"), C.new_dir(spark, "wavelet"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_shards(spark, manifest)


def op2_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_runs(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"), C.new_dir(spark, "media"))


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(_table(spark, sf_dir, "pages"), C.new_dir(spark, "warc"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_wavelet_shards, op2_iblt_fingerprints, op3_byte_bpe, op4_line_runs, op5_best_fit_packing, op6_media_shards, op7_simhash_tiles, op8_warc_revisits, op9_quality_classifier, op10_secret_scan)
}

#: The other operators' results hold library tokens, XXH64 or SHA-1 digests in base 32, sketches, images, places in bins,
#: scores or offsets of matches, which DuckDB's SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_line_runs": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS at_ FROM documents),
n AS (SELECT doc_id, at_, regexp_replace(x, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1 AS pos,
  len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+')) AS w FROM l WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]')),
r AS (SELECT *, count(*) OVER (PARTITION BY x) > 1 AS again FROM n),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS s, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM r),
win AS (SELECT a.doc_id, a.pos AS p, b.pos AS q FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.again AND b.again AND a.island = b.island AND b.pos BETWEEN a.pos AND a.pos + 59 AND b.s - a.s + a.w >= 50),
runs AS (SELECT win.doc_id, p, q, min(at_) AS low, max(at_) AS high, string_agg(x, chr(10) ORDER BY pos) AS k FROM win JOIN c ON c.doc_id = win.doc_id AND pos BETWEEN p AND q GROUP BY win.doc_id, p, q),
firsts AS (SELECT *, min({'d': doc_id, 'p': p}) OVER (PARTITION BY k) AS f FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS at_ FROM firsts WHERE doc_id <> f.d OR p >= f.p + q - p + 1),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(at_ AS VARCHAR), ',' ORDER BY at_) AS removed FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY at_) AS text FROM l ANTI JOIN gone USING (doc_id, at_) GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
