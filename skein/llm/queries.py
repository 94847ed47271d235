"""The registered queries of the training-data operators: thin digests over the operators, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.line_dedup import remove_repeated_lines

    kept = remove_repeated_lines(_docs(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import judge_quality

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "low", "high", "log_perplexity_word", "low_word", "high_word"]
    return judge_quality(_docs(spark, sf_dir)).select(*cols)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.suffix_array import remove_repeated_bytes

    return remove_repeated_bytes(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.suffix_tree import remove_repeated_windows

    def digest(batches):
        for doc_id, n_words, n_removed, kept in common.row_groups(batches, "doc_id", "n_words", "n_removed", "kept"):
            yield {"doc_id": doc_id, "n_words": n_words, "n_removed": n_removed, "kept_sha256": [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in kept]}

    kept = remove_repeated_windows(_docs(spark, sf_dir)).withColumn("kept", F.col("kept").cast("binary"))
    return common.map_docs(kept, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.repair import read_shards, write_shards
    from skein.llm.tables import shared_path

    path = shared_path(spark, "repair")
    write_shards(_docs(spark, sf_dir), path, _tokenizer("byte_bpe_50k.json"))
    return read_shards(spark, path)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import language_id

    docs = _docs(spark, sf_dir)
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.pieces import decode_pieces, encode_pieces

    path = _tokenizer("piece_bpe_32k.model")
    return decode_pieces(encode_pieces(_docs(spark, sf_dir), path), path).select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.flac import media_features, to_media

    return media_features(to_media(_docs(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_suffix_array": op4_suffix_array,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_repair": op6_repair,
    "op7_language_id": op7_language_id,
    "op8_pieces": op8_pieces,
    "op9_simhash": op9_simhash,
    "op10_flac": op10_flac,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": """WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
 p AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS more FROM l),
 s AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS n FROM p WHERE more IS NOT NULL) WHERE n > 1),
 c AS (SELECT l.doc_id, l.i, l.line, EXISTS (SELECT 1 FROM s WHERE s.doc_id = l.doc_id AND s.i = l.i) OR EXISTS (SELECT 1 FROM s WHERE s.doc_id = l.doc_id AND s.i = l.i - 1) AS gone FROM l),
 r AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c WHERE gone) GROUP BY doc_id, run),
 t AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_runs, CAST(max(n) AS BIGINT) AS longest_run FROM r GROUP BY doc_id)
 SELECT c.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(any_value(n_runs), 0) AS n_runs, coalesce(any_value(longest_run), 0) AS longest_run,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM c LEFT JOIN t ON c.doc_id = t.doc_id GROUP BY c.doc_id""",
    "op4_suffix_array": """WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
 b AS (SELECT doc_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS i, unnest(l) AS x FROM d),
 w AS (SELECT doc_id, i, x, string_agg(x, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS k FROM b),
 f AS (SELECT doc_id, i, x, length(k) = 100 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS later FROM w),
 c AS (SELECT doc_id, i, x, coalesce(i - max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone FROM f),
 e AS (SELECT doc_id, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
 g AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (opens) AS BIGINT) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op5_suffix_tree": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 b AS (SELECT doc_id, CAST(unnest(range(1, len(w) + 1)) AS BIGINT) AS i, unnest(w) AS word FROM d),
 f AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS later FROM (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d))),
 c AS (SELECT b.doc_id, b.i, b.word, coalesce(b.i - max(CASE WHEN later THEN f.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i) < 50, false) AS gone FROM b LEFT JOIN f ON b.doc_id = f.doc_id AND b.i = f.i),
 g AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
}
