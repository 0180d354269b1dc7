"""The registered queries of this subpackage; each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .decontaminate import contaminated
from .extract import extract_pages
from .language import language_id
from .lines import dedup_lines
from .media import media_columns
from .mixing import mix
from .near_dup import near_duplicates
from .phrases import collocations
from .quality import quality
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .token_output import token_output
from .vector_codes import vector_codes

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), BYTE_BPE)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), BYTE_BPE)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_token_counts": op2_token_counts,
    "op3_media_columns": op3_media_columns,
    "op4_language_id": op4_language_id,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_main_text": op12_main_text,
    "op13_vector_codes": op13_vector_codes,
}
#: Counts all phrases of one to four words, cuts and ranks them.
_COLLOCATIONS = """
WITH docs AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, array_to_string(w[k : k + d - 1], ' ') AS phrase, d, count(*) AS f
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM listed), (VALUES (1), (2), (3), (4)) AS t(d)
    WHERE k + d - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
candidates AS MATERIALIZED (SELECT lang, phrase, d, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE d > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.d, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp FROM candidates c, (VALUES (1), (2), (3)) AS t(k) WHERE k < d),
scores AS (SELECT cuts.*, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * cuts.a) // (x.f + y.f) AS score FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = lp JOIN grams y ON y.lang = cuts.lang AND y.phrase = rp),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(w[k : k + m - 1], ' ') AS phrase, max(a) AS longer FROM candidates, (VALUES (2), (3)) AS t(m), (VALUES (1), (2), (3)) AS s(k) WHERE m < d AND k + m - 1 <= d GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN inner_parts i ON i.lang = least.lang AND i.phrase = least.phrase WHERE i.longer IS NULL OR CAST(i.longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranks.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranks JOIN totals USING (lang) WHERE rank <= 2000
"""


def _vector_codes() -> str:
    """Lloyd's rounds one after another, every distance computed; vectors have one length."""
    nearest = """a{k} AS MATERIALIZED (SELECT id, part, min(struct_pack(d := d, entry := entry)) AS best
    FROM (SELECT id, part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN b{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
    moved = """b{n} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n + n) % n)) // n, c) AS c FROM b{k} LEFT JOIN
    (SELECT part, best.entry AS entry, pos, sum(v) AS s, count(*) AS n FROM x JOIN a{k} USING (id, part) GROUP BY ALL) USING (part, entry, pos))"""
    rounds = ",\n".join(f"{nearest.format(k=k)},\n{moved.format(k=k, n=k + 1)}" for k in range(6))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS id, vec_id, label, embedding AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT id, (i - 1) // (len(e) // 8) AS part, (i - 1) % (len(e) // 8) AS pos, CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v
    FROM (SELECT id, e, unnest(range(1, len(e) + 1)) AS i FROM kept)),
b0 AS (SELECT part, id AS entry, pos, v AS c FROM x WHERE id < 16),
{rounds},
{nearest.format(k=6)},
book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b6),
coded AS (SELECT id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), book
"""


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_collocations": _COLLOCATIONS, "op13_vector_codes": _vector_codes()}
