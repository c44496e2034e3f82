"""The registered queries of this subpackage, each with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .contamination import find_leaks
from .divergence import source_divergence
from .language import identify_languages
from .lines import drop_repeated_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .pii import digest_columns, find_pii
from .repeats import remove_repeats
from .sharding import shard_by_bytes
from .token_files import token_digests, write_token_files
from .toxicity import classify
from .vectors import near_vectors
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies of every document, on shingles of four words."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.drop("_key", "_component")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document, whole or edited."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_key")


def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def op4_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur elsewhere."""
    left = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return left.select(
        "doc_id",
        "n_bytes",
        removed.cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op6_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return digest_columns(find_pii(table(spark, sf_dir, "documents")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents, read back from the token-id files."""
    import public_tokenizers

    places = write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return token_digests(places)


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that are not held out."""
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans")
    )


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of nearly equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occur earlier."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings")).drop("width")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language against each other and against the language."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the labelled rows that are not held out."""
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_tensored,
        op2_benchmark_leaks,
        op3_cube_mix,
        op4_embedding_tiles,
        op5_suffix_repeats,
        op6_pii_boosting,
        op7_token_files,
        op8_toxicity_crf,
        op9_byte_shards,
        op10_line_winnowing,
        op11_embedding_whitening,
        op12_source_divergence,
        op13_language_svm,
    )
}

_OP1 = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \t-\r]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM tokens WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_OP4 = """
WITH RECURSIVE unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
), least AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""

# The checksum is worked out byte by byte from its table of 256 values.
_OP9 = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda x: CAST('0x' || x AS BIGINT)) AS b
  FROM documents
), sized AS (
  SELECT doc_id, len(b) + 1 AS size,
    xor(list_reduce(b, lambda crc, x: xor(crc >> 8, t[(xor(crc, x) & 255) + 1]),
        CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM bytes, tab
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    sum(size) OVER () AS total
  FROM sized
), cut AS (
  SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

_OP10 = """
WITH lines AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i,
         unnest(string_split(text, chr(10))) AS line
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT doc_id, i, line,
         lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2,
         lead(i, 2) OVER w IS NOT NULL AS whole
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i,
         row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, i) > 1 AS repeated
  FROM windows WHERE whole
), marked AS (
  SELECT l.doc_id, l.i, l.line, bool_or(coalesce(r.repeated, false)) AS gone
  FROM lines l LEFT JOIN ranked r
    ON r.doc_id = l.doc_id AND r.i BETWEEN l.i - 2 AND l.i
  GROUP BY 1, 2, 3
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS rest
  FROM marked GROUP BY 1
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10
), v AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), occurs AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), sums AS (
  SELECT lang, source, sum(c) AS n FROM occurs GROUP BY 1, 2
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (k.total + 2) // (v.n + 2 * v.v) AS usual
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang)
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN occurs o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY 1, 2, 3
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - usual) * (p - usual) // (p + usual)
  FROM p WHERE c > 0 AND p > usual
), ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_minhash_tensored": _OP1,
    "op4_embedding_tiles": _OP4,
    "op9_byte_shards": _OP9,
    "op10_line_winnowing": _OP10,
    "op12_source_divergence": _OP12,
}
