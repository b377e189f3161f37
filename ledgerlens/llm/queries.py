"""Queries over the documents tables, one for each operator, and the SQL that gives their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
passages AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS p FROM starts),
least AS (SELECT p, min(doc_id) AS m FROM passages GROUP BY p),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM passages JOIN least USING (p) WHERE m < doc_id) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, d.w, coalesce(gone.js, []) AS js FROM d LEFT JOIN gone USING (doc_id)
), texts AS (
  SELECT doc_id, len(w) AS n, len(js) AS r,
    CASE WHEN len(js) = 0 THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(js, j)), lambda j: w[j]) END AS k
  FROM kept)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM texts
"""


@_query(_OP2)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    out = dedup_substrings(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP1 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), m AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(m.least < k.doc_id, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@_query(_OP1)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM s LEFT JOIN least ON doc_id = a
"""


@_query(_OP4)
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    out = near_duplicates(_read(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("component_id") == F.col("doc_id"))


#: Target weights of the sources of the test tables.
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}


def mix_sql(documents: str = "documents") -> str:
    weight = "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}" for s, w in WEIGHTS.items()) + " ELSE 1 END"
    return f"""
src AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS i, source, {weight} AS weight, n FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source)),
lists AS (SELECT list(weight ORDER BY i) AS ws, sum(weight)::BIGINT AS q FROM src),
edf AS (
  SELECT 0 AS t, list_transform(ws, lambda x: 0) AS done, 0 AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, ws, q, list_sort(list_filter(list_transform(range(1, len(ws) + 1),
          lambda i: [ceil((done[i] + 1) * q / ws[i])::BIGINT, i, floor(done[i] * q / ws[i])::BIGINT]), lambda c: c[3] <= t))[1][2] AS p
        FROM edf, lists WHERE t < q)
), slots AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf WHERE t > 0),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS r FROM {documents} d),
mixed AS (
  SELECT d.*, r // 32 AS mix_block, src.weight AS w, q, (r // 32) // src.weight * q + slot AS mix_slot
  FROM ranked d JOIN src ON d.source IS NOT DISTINCT FROM src.source JOIN slots s ON s.i = src.i AND s.nth = (r // 32) % src.weight, lists
), short AS (SELECT min((n // 32) // weight * q + slot) AS m FROM src JOIN slots s ON s.i = src.i AND s.nth = (n // 32) % weight, lists)
"""


MIX_COLUMNS = """mix_block::BIGINT AS mix_block, floor(mix_block * q / w)::BIGINT AS mix_release, ceil((mix_block + 1) * q / w)::BIGINT AS mix_deadline,
  mix_slot::BIGINT AS mix_slot, (mix_slot * 32 + r % 32)::BIGINT AS mix_position, mix_slot < m AS mix_exact"""


@_query(f"WITH RECURSIVE {mix_sql()} SELECT doc_id, source, {MIX_COLUMNS} FROM mixed, short")
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


def _chat_sql() -> str:
    from .chat_format import Template

    t = Template()
    esc = "replace(text, '\\', '\\\\')"
    role = "replace(role, '\\', '\\\\')"
    for c in t.controls():
        esc, role = (f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')" for x in (esc, role))
    moves = ", ".join(f"'{a}>{b}'" for a, bs in t.follows.items() for b in bs)
    ends = ", ".join(f"'{e}'" for e in t.ends)
    marks = " ".join(f"WHEN role = '{name}' THEN {2 * len(tag) + 7}" for name, (tag, _) in t.roles.items())
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), s AS (
  SELECT *, length({esc}) + CASE {marks} ELSE length({role}) + 21 END AS size, row_number() OVER o - 1 AS i, row_number() OVER b = 1 AS last,
    coalesce(lag(role) OVER o, '') || '>' || role NOT IN ({moves}) AS bad
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), b AS (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(size) + 7)::BIGINT AS formatted_chars, NOT bool_or(bad) AND bool_or(last AND role IN ({ends})) AS valid, min(i) FILTER (WHERE bad)::INT AS bad_turn
FROM s GROUP BY conv_id
"""


@_query(_chat_sql())
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, loss_text, parsed

    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    out = format_chats(rows.unionAll(planted)).withColumn("turns", parsed(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
sizes AS (SELECT unnest([3, 8, 101]) AS k),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
p AS (SELECT doc_id, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS p FROM g),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k, p) AS c FROM p),
cover AS (SELECT doc_id, k, count(DISTINCT j) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS j FROM r WHERE c > 1 AND k < 100) GROUP BY doc_id, k),
long AS (SELECT DISTINCT doc_id FROM r WHERE c > 1 AND k = 101),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c8.n, 0)::BIGINT AS n_covered_words, long.doc_id IS NOT NULL AS too_long
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN (FROM cover WHERE k = 3) c3 USING (doc_id) LEFT JOIN (FROM cover WHERE k = 8) c8 USING (doc_id) LEFT JOIN long USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT * EXCLUDE (too_long), NOT base_failed AND 100 * n_covered_words <= 30 * n_words AND NOT too_long AS kept FROM f
"""


@_query(_OP9)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents")).drop("longest_repeat")


#: A SentencePiece model file; the driver reads it.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@_query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, load_pieces, rank_scores

    return count_tokens(_read(spark, sf_dir, "documents"), rank_scores(load_pieces(PIECES)))


@_query()
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train_toxicity

    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _read(spark, sf_dir, "labels")))


@_query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score_quality, train_quality

    docs = _read(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _read(spark, sf_dir, "labels")))
