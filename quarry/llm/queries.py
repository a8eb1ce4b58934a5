"""The registered queries of this subpackage, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, chat, codes, exact_dedup, licenses, line_dedup, lm, mixing, near_dedup, toxicity, urls, variants
from quarry.plans.registry import register
from quarry.sources.files import literal_rows
from quarry.sources.tables import table

#: The vocabulary of op6 and of the pipeline's last stage.
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


@register("op9_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""")
def op9_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(table(spark, sf, "documents", "doc_id", "text"))


@register("op6_bpe")
def op6_bpe(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, BPE_FILE), BPE_FILE)
    return coded.select("doc_id", F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
                        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op10_license_scan")
def op10_license_scan(spark, sf):
    return licenses.license_report(table(spark, sf, "documents", "doc_id", "text"))


@register("op4_lm_scoring")
def op4_lm_scoring(spark, sf):
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    return lm.score(table(spark, sf, "documents", "doc_id", "text"), train=part != 2, held_out=part == 2)


@register("op8_near_dedup")
def op8_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents", "doc_id", "text"), shingle=2, threshold=(80, 100))


@register("op3_line_dedup", r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, trim(regexp_replace(ls[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
s AS (SELECT doc_id, i, norm, len(norm) - len(replace(norm, ' ', '')) + 1 AS w,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM l WHERE norm <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY q) AS upto FROM s),
span AS (SELECT a.doc_id, a.q AS first, min(b.q) AS last FROM c a JOIN c b
         ON a.doc_id = b.doc_id AND b.q >= a.q AND b.upto - (a.upto - a.w) >= 50 GROUP BY ALL
         UNION SELECT b.doc_id, max(a.q), b.q FROM c a JOIN c b
         ON a.doc_id = b.doc_id AND b.q >= a.q AND b.upto - (a.upto - a.w) >= 50 GROUP BY b.doc_id, b.q),
body AS (SELECT span.doc_id, first, last, string_agg(norm, chr(10) ORDER BY q) AS t
         FROM span JOIN c ON c.doc_id = span.doc_id AND q BETWEEN first AND last GROUP BY ALL),
late AS (SELECT doc_id, first, last FROM body
         QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT c.doc_id, c.i FROM late JOIN c ON c.doc_id = late.doc_id AND c.q BETWEEN first AND last),
kept AS (SELECT l.doc_id, l.i FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i),
cut AS (SELECT kept.doc_id, string_agg(ls[kept.i], chr(10) ORDER BY kept.i) AS text, count(*) AS n FROM kept
        JOIN raw USING (doc_id) GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(cut.text, '') END AS text,
       CAST(coalesce(len(raw.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(raw.ls) - coalesce(cut.n, 0), 0) AS INTEGER) AS n_deleted
FROM documents d LEFT JOIN raw USING (doc_id) LEFT JOIN cut USING (doc_id)""")
def op3_line_dedup(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents", "doc_id", "text"))


@register("op2_source_mix", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
                            md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
x AS (SELECT max(tokens) AS top, CAST(max(tokens) AS DOUBLE) / min(tokens) AS ratio FROM s WHERE tokens > 0),
b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(CASE WHEN ratio <= 2 THEN 0 ELSE 1 END AS DOUBLE) AS hi FROM x
      UNION ALL SELECT i + 1, CASE WHEN pow(ratio, 1 - (lo + hi) / 2) <= 2 THEN lo ELSE (lo + hi) / 2 END,
                       CASE WHEN pow(ratio, 1 - (lo + hi) / 2) <= 2 THEN (lo + hi) / 2 ELSE hi END FROM b, x WHERE i < 60),
a AS (SELECT hi FROM b WHERE i = 60),
r AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(CAST(top AS DOUBLE) / tokens, 1 - hi) ELSE 1 END AS repeats FROM s, x, a),
p AS (SELECT source, floor(repeats) AS epochs, floor((repeats - floor(repeats)) * tokens) AS rest FROM r),
o AS (SELECT doc_id, source, n_tokens, sum(n_tokens) OVER (PARTITION BY source ORDER BY h, n_tokens ROWS UNBOUNDED PRECEDING) AS used FROM d)
SELECT doc_id, o.source, n_tokens, CAST(epochs + CASE WHEN used <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source""")
def op2_source_mix(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "n_tokens", "copies")


def scored_toxicity(docs, labels):
    """``docs`` with ``toxicity``, learned from the labels whose crc32(doc_id) mod 5 is not 0."""
    return toxicity.score(docs, labels, train=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@register("op7_toxicity")
def op7_toxicity(spark, sf):
    scored = scored_toxicity(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
                         F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@register("op5_nearest_neighbours")
def op5_nearest_neighbours(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


#: The rules that op1 is given.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@register("op1_url_filter")
def op1_url_filter(spark, sf):
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return urls.judge(table(spark, sf, "pages", "page_id", "url"), table(spark, sf, "labels", "doc_id", "quality", "toxic"),
                      URL_RULES, bad=bad)


def _rounds_sql(n: int) -> str:
    """The CTEs of one round: parts a{n} with their nearest entry of b{n}, and the moved entries b{n + 1}."""
    d = " + ".join(f"(x{i} - y{i}) * (x{i} - y{i})" for i in range(4))
    kept = ", ".join(f"x{i}" for i in range(4))
    means = ", ".join(f"CAST(floor(sum(x{i}) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m{i}" for i in range(4))
    moved = ", ".join(f"coalesce(m{i}, y{i}) AS y{i}" for i in range(4))
    return f"""
a{n} AS (SELECT row, part, {kept}, min(CAST({d} AS BIGINT) * 64 + entry) AS best FROM x JOIN b{n} USING (part) GROUP BY ALL),
b{n + 1} AS (SELECT b.part, b.entry, {moved} FROM b{n} b LEFT JOIN
             (SELECT part, best % 64 AS entry, {means} FROM a{n} GROUP BY ALL) m USING (part, entry))"""


@register("op12_vector_codes", f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
                  list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT row, p AS part, {', '.join(f'e[4 * p + {i + 1}] AS x{i}' for i in range(4))} FROM v, range(16) AS t(p)),
b0 AS (SELECT part, row - 1 AS entry, {', '.join(f'x{i} AS y{i}' for i in range(4))} FROM x WHERE row <= 64),
{_rounds_sql(0)},{_rounds_sql(1)},{_rounds_sql(2)},
c AS (SELECT row, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY row),
h AS (SELECT sha256(string_agg(concat_ws(',', y0, y1, y2, y3), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN v USING (row), h""")
def op12_vector_codes(spark, sf):
    return codes.compressed_report(table(spark, sf, "embeddings", "vec_id", "embedding", "label"))


def thinned(words):
    """Runs (doc_id, word) that lose one letter where 199 divides crc32(``<doc_id>:<word>``); those left with 6 letters or more."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return words.select("word", h.alias("h")).select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("word")).alias("word")) \
        .where(F.char_length("word") >= 6)


@register("op11_spelling_variants")
def op11_spelling_variants(spark, sf):
    runs = variants.letter_runs(table(spark, sf, "documents", "doc_id", "text"))
    return variants.variant_groups(variants.frequent_words(thinned(runs)))


#: A conversation whose texts are control strings; it is formatted beside those of the table.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@register("op13_chat_format", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, k, w, 'g')) + length(role) - length(replace(replace(role, chr(27), ''), chr(10), '')) AS r,
             length(regexp_replace(text, k, w, 'g')) AS t
      FROM c, (SELECT '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])' AS k, '\1\4\2\5\\\3\6' AS w))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + r + t) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op13_chat_format(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    packed = chat.pack(rows.unionByName(literal_rows(spark, PROBE, rows.schema)), BPE_FILE)
    return chat.read_back(packed, BPE_FILE)
