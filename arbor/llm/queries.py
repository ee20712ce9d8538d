"""The training-data operators applied to the tables, as registered in the entry module."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, exact, flac, lbl, lines, minhash, mixing, pii, quality
from .common import load

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
MAX_TOKENS = 2048


def digests(codec: bpe.Codec, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """For each text: the number of its ids, and the SHA-256 of the ids in decimal and of what they decode to."""
    decimal = bpe.joined(pa.array([b"%d " % i for i in range(len(codec.vocab))], pa.binary()).take(pa.array(ids)), ends)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids_sha = [sha(memoryview(x.as_buffer())[:-1]) for x in decimal]
    return [pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array([sha(x.as_buffer()) for x in codec.decode(ids, ends)], pa.string())]


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    found = bpe.encode_to(docs, path, pattern, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("_id", "doc_id")


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = flac.with_pcm(flac.with_media(load(spark, sf_dir, "documents")))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media, blocks in zip(batch.column("media"), batch.column("blocks")):
                pcm = blocks.values.field("pcm")
                raw = b"".join(x.as_buffer() for x in pcm)
                samples = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
                crossings = int(np.count_nonzero(np.diff(np.signbit(samples))))
                feature = f"frames={len(pcm)};sum={samples.sum()};energy={(samples * samples).sum()};peak={np.abs(samples).max()};crossings={crossings}"
                stream = media.as_buffer()
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
            columns = zip(*out) if out else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, columns, kinds)], names=names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored.mapInArrow(measured, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.fold("doc_id", 7) == 2
    scored = lbl.score(load(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(load(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(load(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_summary(load(spark, sf_dir, "documents"))
    kept = F.size("kept_lines")
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.col("n_blank") - kept).cast("long").alias("n_removed"),
        F.array_join(F.col("kept_lines").cast("array<string>"), ",").alias("kept_lines"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").where(quality.fold("doc_id", 5) != 0)
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select(
        "doc_id", (quality.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(load(spark, sf_dir, "documents"))
    return taken.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents"))
    tagged = lambda k: F.transform(k, lambda m: F.struct(F.lit(k).alias("k"), m["s"].alias("s"), m["e"].alias("e")))
    found = found.withColumn("_base", F.concat(*map(tagged, pii.KINDS)))
    return found.select(
        F.col("_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined("_base"), 256).alias("base_sha256"), pii.joined("_spans").alias("spans"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(load(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
sets AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS s FROM l),
classes AS (
  SELECT s, len(s) AS n, min((doc_id, line)) AS f FROM sets WHERE len(s) > 0 GROUP BY s),
words AS (SELECT f, n, unnest(s) AS w FROM classes),
df AS (SELECT w, count(*) AS c FROM words GROUP BY w),
prefix AS (
  SELECT f, n, w FROM words JOIN df USING (w)
  QUALIFY row_number() OVER (PARTITION BY f ORDER BY c, w) <= n - ceil(n * 80 / 100.0) + 1),
pairs AS (
  SELECT DISTINCT a.f AS a, b.f AS b FROM prefix a JOIN prefix b ON a.w = b.w AND b.f < a.f
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
gone AS (
  SELECT DISTINCT a FROM pairs JOIN classes x ON x.f = a JOIN classes y ON y.f = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
kept AS (
  SELECT f[1] AS doc_id, string_agg(CAST(f[2] AS VARCHAR), ',' ORDER BY f[2]) AS kept_lines, count(*) AS k
  FROM classes WHERE f NOT IN (SELECT a FROM gone) GROUP BY 1)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE len(s) > 0) - coalesce(any_value(k), 0) AS n_removed, coalesce(any_value(kept_lines), '') AS kept_lines
FROM documents d JOIN sets USING (doc_id) LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""

OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac": op1_flac,
    "op2_lm_score": op2_lm_score,
    "op3_minhash": op3_minhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_exact_dedup": op10_exact_dedup,
}
SQL: dict[str, str] = {"op3_minhash": OP3_SQL, "op5_line_dedup": OP5_SQL, "op10_exact_dedup": OP10_SQL}
