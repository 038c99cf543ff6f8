"""The queries of this subpackage: each operator on its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import bpe, chat, codebooks, decontaminate, fill_middle, language, neighbours, pii, quality, simhash, token_counts, token_files, url_filter
from lattiq.llm.common import table

#: Fixed values of the URL rules.
RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def _merges() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents into which a benchmark item leaked, with the item and how much of it tiles cover."""
    found = decontaminate.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_covered", "n_words", F.size("tiles").cast("bigint").alias("n_tiles"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(spark, table(spark, sf_dir, "documents"))


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, table(spark, sf_dir, "documents"), _merges(), public_tokenizers.PATTERN, keep_ids=False, digests=True)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark, table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), _merges(), public_tokenizers.PATTERN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose label (of the id equal to the page's) is of low quality or toxic count as bad."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, RULES)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.render(chat.fold(chat.events_of(turns.unionByName(more)))))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(spark, table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.digests(spark, table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_quality_classifier, op3_pii, op4_byte_level_bpe, op5_nearest_neighbours,
        op6_simhash, op7_token_counts, op8_url_filter, op9_chat_format, op10_token_files,
        op11_fill_in_middle, op12_vector_codes, op13_language_id,
    )
}

#: The turns of a conversation are ordered by turn, role and text, as in the operator.
_OP9 = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|system\\|>|\\|user\\|>|\\|assistant\\|>|s>|/s>|<SYS>>|</SYS>>|INST\\]|/INST\\])', '\\1\\\\\\2\\3', 'g') AS body FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(body) + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _weight(n: str, bad: str, rate: str, of: str) -> str:
    rho = f"(sum(({bad} - {n} * {rate}) ** 2) FILTER ({n} > 1) - sum({rate} * (1 - {rate}) * {n}) FILTER ({n} > 1)) / nullif(sum({rate} * (1 - {rate}) * {n} * ({n} - 1)) FILTER ({n} > 1), 0)"
    return f"(SELECT CASE WHEN rho IS NULL THEN 10 WHEN rho <= 0.001 THEN 999 ELSE least(1000, greatest(1, (1 - rho) / rho)) END AS w FROM (SELECT {rho} AS rho FROM {of}))"


_HOST = rf"regexp_replace(host, '{url_filter._AROUND}', '', 'g')"
_UNDER = f"regexp_extract({_HOST}, '([^.]+\\.({url_filter.listed(url_filter.SUFFIXES)}))$'"
_DOMAIN = rf"CASE WHEN regexp_matches({_HOST}, '{url_filter._ADDRESS}') THEN {_HOST} WHEN {_UNDER}, 1) <> '' THEN {_UNDER}, 1) WHEN regexp_extract({_HOST}, '([^.]+\.[^.]+)$', 1) <> '' THEN regexp_extract({_HOST}, '([^.]+\.[^.]+)$', 1) ELSE {_HOST} END"
_SUFFIX = rf"CASE WHEN regexp_matches({_HOST}, '{url_filter._ADDRESS}') THEN '' WHEN {_UNDER}, 2) <> '' THEN {_UNDER}, 2) ELSE regexp_extract({_HOST}, '([^.]*)$', 1) END"
_FITS = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN" for r in sorted(RULES, key=lambda r: -len(r.name))]
_OP8 = f"""
WITH pg AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lab AS (SELECT doc_id AS page_id, CASE WHEN avg(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) >= 0.5 THEN 1 ELSE 0 END AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, count(*) AS n, sum(bad)::DOUBLE AS bad FROM pg JOIN lab USING (page_id) GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n)::DOUBLE AS dn, sum(bad) AS dbad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM d GROUP BY ALL),
t AS (SELECT coalesce((sum(sbad) + 1) / (sum(sn) + 2), 0.5) AS rate, coalesce(sum(sn), 0) AS total FROM s),
sw AS (SELECT least(w, total + 2) AS ws FROM {_weight("sn", "sbad", "rate", "s, t")}, t), s2 AS (SELECT suffix, (sbad + ws * rate) / (sn + ws) AS smean, sn + ws AS behind FROM s, t, sw),
d1 AS (SELECT d.*, smean, behind FROM d JOIN s2 USING (suffix)), d2 AS (SELECT domain, (dbad + least(w, behind) * smean) / (dn + least(w, behind)) AS dmean, dn + least(w, behind) AS behind FROM d1, {_weight("dn", "dbad", "smean", "d1")}),
h1 AS (SELECT h.*, dmean, behind FROM h JOIN d2 USING (domain)), h2 AS (SELECT host, bad + least(w, behind) * dmean AS a, n - bad + least(w, behind) * (1 - dmean) AS b FROM h1, {_weight("n", "bad", "dmean", "h1")}),
r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound FROM h2)
SELECT page_id, host, path, CASE {" ".join(f"{f} '{r.name}'" for f, r in zip(_FITS, sorted(RULES, key=lambda r: -len(r.name)), strict=True))} END AS rule,
CASE {" ".join(f"{f} '{r.verdict}'" for f, r in zip(_FITS, sorted(RULES, key=lambda r: -len(r.name)), strict=True))} WHEN lower_bound > 0.4 THEN 'block' ELSE 'allow' END AS verdict FROM pg LEFT JOIN r USING (host)
"""
_H = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8) AS BIGINT)"
_OP11 = f"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{fill_middle.UNIT}') AS u, {", ".join(f"{_H.format(1 + 8 * i)} AS h{i + 1}" for i in range(4))} FROM documents),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n FROM u), c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR {" OR ".join(f"contains(t, '{m}')" for m in fill_middle.MARKS)} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def _op12(rounds: int = 6) -> str:
    """Six rounds and a last assignment, each by all distances."""
    near = "(SELECT p.vec_id, p.label, p.part, p.x, min(list_sum(list_transform(list_zip(p.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 16 + b.entry) AS best FROM p JOIN b{} b USING (part) GROUP BY ALL)"
    out = """
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM k, range(8) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16))"""
    for r in range(rounds):
        out += f""",
a{r} AS MATERIALIZED {near.format(r)},
s{r} AS (SELECT part, best % 16 AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) q(i) GROUP BY ALL),
m{r} AS (SELECT part, entry, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))"""
    return out + f""",
z AS MATERIALIZED {near.format(rounds)},
f AS (SELECT vec_id, label, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM z GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM f"""


#: crc32 of doc_id as text, a byte and its eight shifts at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda h: [CAST(ascii(h) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
_OP13 = f"""
WITH low AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, regexp_replace(' ' || lower(text) || ' ', '[^\\p{{L}}]+', ' ', 'g') AS t FROM documents),
pos AS MATERIALIZED (SELECT r, c, lead(c) OVER w AS c2, lead(c, 2) OVER w AS c3 FROM (SELECT r, unnest(str_split(t, '')) AS c, unnest(range(1, length(t) + 1)) AS i FROM low WHERE t <> ' ') WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS MATERIALIZED (SELECT r, gram, count(*) AS n FROM (SELECT r, unnest([CASE WHEN c <> ' ' THEN c END, c || c2, CASE WHEN c2 <> ' ' THEN c || c2 || c3 END]) AS gram FROM pos) WHERE gram IS NOT NULL GROUP BY ALL),
q AS MATERIALIZED (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS rank FROM g QUALIFY rank < 300),
prof AS MATERIALIZED (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS place FROM g JOIN low USING (r) WHERE lang IS NOT NULL AND {_CRC} % 5 <> 0 GROUP BY lang, gram QUALIFY place < 300),
size AS (SELECT r, count(*) AS m FROM q GROUP BY r),
hit AS (SELECT r, lang, sum(abs(rank - place)) AS far, count(*) AS k FROM q JOIN prof USING (gram) GROUP BY ALL),
dist AS (SELECT r, l.lang, m, CAST(coalesce(far, 0) + 300 * (m - coalesce(k, 0)) AS BIGINT) AS d FROM size CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN hit USING (r, lang)),
best AS (SELECT r, m, min(d) AS d, arg_min(lang, (d, lang)) AS lang FROM dist GROUP BY ALL)
SELECT doc_id, {_CRC} % 5 = 0 AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - CAST(d AS DOUBLE) / (300 * m), 0) AS score FROM low LEFT JOIN best USING (r)
"""
ORACLE_SQL: dict[str, str] = {"op8_url_filter": _OP8, "op9_chat_format": _OP9, "op11_fill_in_middle": _OP11, "op12_vector_codes": _op12(), "op13_language_id": _OP13}
