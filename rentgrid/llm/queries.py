"""The registered queries of the text operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import bpe
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (h) WHERE win.doc_id > firsts.m),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM hit)),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY k) AS s
         FROM word LEFT JOIN gone USING (doc_id, k) WHERE gone.k IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import substring
    return substring.removed_words(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import simhash
    return simhash.groups(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import quality
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, words, [5, 2, 1][(i % 3) + 1]::BIGINT AS weight FROM s),
o AS (SELECT *, sum(words) OVER () - 3 * coalesce(sum(words) OVER (ORDER BY words * 3.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY words * 3.0 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT arg_min(rest, (words * 3.0 / weight, coalesce(source, chr(1114111)))) AS rest, arg_min(open_weight, (words * 3.0 / weight, coalesce(source, chr(1114111)))) AS open_weight
      FROM o WHERE 3 * words * open_weight >= rest * weight),
t AS (SELECT w.source, words, CASE WHEN 3 * words * l.open_weight < l.rest * weight THEN (3 * words)::DOUBLE
             ELSE l.rest::DOUBLE * weight / l.open_weight END AS target FROM w, l),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
p AS (SELECT d.doc_id, d.size, q.words, q.target, CASE WHEN q.words = 0 THEN 0 ELSE q.quota // q.words END AS times,
             CASE WHEN q.words = 0 THEN 0 ELSE q.quota % q.words END AS more,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, words AS source_size, target, (times * size + greatest(0, least(size, more - before)))::BIGINT AS taken FROM p""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import mixing
    return mixing.shares(table(spark, sf_dir, "documents"))


@query("op6_chat", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '(\\*(?:\[/?INST\]|</?s>|<</?SYS>>|\[ROLE=[^\]\s]*\]|\[/ROLE\]))', '\\\1', 'g') AS written FROM c),
m AS (SELECT *, length(written) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
                ELSE 16 + length(url_encode(role)) END AS chars FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""")
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import chat
    return chat.digests(table(spark, sf_dir, "conversations"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import language
    return language.languages(table(spark, sf_dir, "documents"))


@query("op8_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import topk
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import toxicity
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import forest
    return forest.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _levels(name: str, start: str, also: str = "") -> str:
    """A recursive table of all levels of digests, three to a parent."""
    return f"""{name} AS ({start} UNION ALL
   SELECT {also}k + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM {name} WHERE len(hs) > 1)"""


def _fold(name: str, start: str, levels: str, on: str) -> str:
    """A recursive table that folds every row through the levels."""
    return f"""{name} AS ({start} UNION ALL
   SELECT f.r, f.source, f.k + 1, f.i // 3, sha256(array_to_string(hs[f.i - f.i % 3 + 1:f.i], '') || f.node || array_to_string(hs[f.i + 2:f.i - f.i % 3 + 3], '')),
          f.proof || array_to_string(hs[f.i - f.i % 3 + 1:f.i], '') || array_to_string(hs[f.i + 2:f.i - f.i % 3 + 3], '')
   FROM {name} AS f JOIN {levels} AS l ON l.k = f.k AND {on} WHERE len(l.hs) > 1)"""


def _written(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""


@query("op12_merkle", f"""
WITH RECURSIVE c AS (SELECT *, xor({_CRC32}, 4294967295::BIGINT) % 2 = 0 AS hit FROM documents),
e AS (SELECT doc_id, source, sha256({" || ".join(map(_written, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
             sha256({" || ".join(map(_written, ("doc_id", "source", "lang", "n_chars", "(CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END)")))}) AS seen
      FROM c),
d AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM e),
t AS (SELECT source, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS hs FROM d GROUP BY source),
{_levels("lv", "SELECT source, 0 AS k, hs FROM t", "source, ")},
sub AS (SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM lv WHERE len(hs) = 1),
{_levels("up", "SELECT 0 AS k, list(subroot ORDER BY source NULLS FIRST) AS hs FROM sub")},
{_fold("f", "SELECT r, source, 0 AS k, i, seen AS node, '' AS proof FROM d", "lv", "l.source IS NOT DISTINCT FROM f.source")},
h AS (SELECT source, max(k) AS k FROM lv GROUP BY source),
done AS (SELECT f.* FROM f JOIN h ON h.source IS NOT DISTINCT FROM f.source AND h.k = f.k),
{_fold("g", "SELECT done.r, done.source, 0 AS k, sub.i, done.node, done.proof FROM done JOIN sub ON sub.source IS NOT DISTINCT FROM done.source", "up", "true")},
root AS (SELECT hs[1] AS root, k FROM up WHERE len(hs) = 1)
SELECT d.doc_id, d.leaf, sub.subroot, root.root, sha256(g.proof) AS proof_sha256, g.node AS folded_root, g.node = root.root AS verified
FROM g JOIN root ON root.k = g.k JOIN d ON d.r = g.r JOIN sub ON sub.source IS NOT DISTINCT FROM d.source""")
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import merkle
    return merkle.checked(table(spark, sf_dir, "documents"))


def piece_model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import alignment
    return alignment.alignments(table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())


@query("op13_vectors", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
n AS (SELECT r, vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE ok),
l AS (SELECT a.r, b.r AS o, b.vec_id AS other FROM n AS a JOIN n AS b ON a.r <> b.r AND list_inner_product(a.e, b.e) >= 0.95),
w AS (SELECT r, r AS o, vec_id AS other FROM v UNION SELECT w.r, l.o, l.other FROM w JOIN l ON l.r = w.o),
c AS (SELECT r, min(other) AS component_id FROM w GROUP BY r)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.r = v.r)::BIGINT AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN c USING (r)""")
def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rentgrid.llm import vectors
    return vectors.groups(table(spark, sf_dir, "embeddings"))
