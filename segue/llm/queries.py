"""The operators as queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from segue.llm import centroids, decontaminate, langid, lines, merkle, mixing, packing, quality, simhash, spans, sql, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.verdicts(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digests(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_language, op3_mix, op4_quality_rules, op5_warc, op6_line_dedup, op7_toxicity,
                                   op8_simhash, op9_substring_dedup, op10_decontamination, op11_centroids, op12_packing, op13_manifest)}
QUERIES["pipeline"] = corpus_pipeline.run

_PAGES = """SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)"""


def _fits(rule: str) -> str:
    host, path = rule.split("/", 1)
    return f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}'))"


_RULED = "CASE " + " ".join(f"WHEN {_fits(rule)} THEN '{rule}'" for _, rule in sorted(urls.RULES, key=lambda r: -len(r[1]))) + " END"
_BLOCKING = ", ".join(f"'{rule}'" for verdict, rule in urls.RULES if verdict == "block")

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BLANK_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words_before(at: str) -> str:
    b = mixing.BLOCK_WORDS
    chosen = lambda k: f"(({k}) * part + start) // blocks"
    first, following = chosen(f"{at} // {b}"), chosen(f"{at} // {b} + 1")
    return f"(({first} - start // blocks) * {b} + (({following}) - ({first})) * ({at} % {b}))"


_NUMBER = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _estimates() -> str:
    """Steps of expectation-maximisation over the counted votes, one row of accuracies each."""
    names = list(quality.RULES)
    odds = " + ".join(f"v_{n} * ln(a_{n} / (1 - a_{n}))" for n in names)
    start = "SELECT " + ", ".join(f"{quality.START}e0 AS a_{n}" for n in names)
    steps = [f"step0 AS MATERIALIZED ({start})"]
    for k in range(quality.STEPS):
        new = ", ".join(
            f"coalesce(least(greatest(sum(CASE WHEN v_{n} > 0 THEN n * p WHEN v_{n} < 0 THEN n * (1 - p) END) / sum(CASE WHEN v_{n} <> 0 THEN n END), "
            f"{quality.LOWEST}e0), {quality.HIGHEST}e0), {quality.START}e0) AS a_{n}" if not k else
            f"coalesce(least(greatest(sum(CASE WHEN v_{n} > 0 THEN n * p WHEN v_{n} < 0 THEN n * (1 - p) END) / sum(CASE WHEN v_{n} <> 0 THEN n END), "
            f"{quality.LOWEST}e0), {quality.HIGHEST}e0), any_value(a_{n}), {quality.START}e0) AS a_{n}" for n in names)
        steps.append(f"step{k + 1} AS MATERIALIZED (SELECT {new} FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM patterns, step{k}))")
    return ",\n".join(steps)


_VOTES = ", ".join(f"{rule} AS v_{name}" for name, rule in quality.RULES.items())
_QUALITY = rf"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {_BLANK_ENDS}) <> '') AS l FROM documents),
windows AS (SELECT row_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
twice AS (SELECT row_id, unnest(range(i, i + 5)) AS p FROM windows JOIN (SELECT row_id, k FROM windows GROUP BY 1, 2 HAVING count(*) > 1) USING (row_id, k)),
repeats AS (SELECT row_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY 1),
measured AS MATERIALIZED (SELECT row_id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
   len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
   len(regexp_extract_all(text, '!!')) AS n_shouts, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
   len(regexp_extract_all(text || chr(10), '[.!?][\x20\x09-\x0D]')) AS n_ends FROM docs LEFT JOIN repeats USING (row_id)),
voted AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_VOTES} FROM measured),
patterns AS MATERIALIZED (SELECT {', '.join(f'v_{n}' for n in quality.RULES)}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL),
{_estimates()}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
   base_failed, NOT base_failed AND 1 / (1 + exp(-({' + '.join(f'v_{n} * ln(a_{n} / (1 - a_{n}))' for n in quality.RULES)}))) >= {quality.KEEP}e0 AS kept FROM voted, step{quality.STEPS}"""

_MIX = f"""WITH sized AS MATERIALIZED (SELECT doc_id, len({_WORDS}) AS size, source IS NULL AS ns, coalesce(source, '') AS source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name FROM documents),
sizes AS (SELECT ns, source, sum(size) AS source_size, (ARRAY{list(mixing.WEIGHTS)})[(row_number() OVER (ORDER BY ns, source) - 1) % {len(mixing.WEIGHTS)} + 1] * 1e0 AS weight FROM sized GROUP BY 1, 2),
placed AS (SELECT *, {mixing.BUDGET}e0 * sum(source_size) OVER () AS budget, {mixing.CAP}e0 * source_size AS lim,
   {mixing.BUDGET}e0 * sum(source_size) OVER () - coalesce(sum({mixing.CAP}e0 * source_size) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
   FROM sizes WINDOW w AS (ORDER BY {mixing.CAP}e0 * source_size / weight, ns, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, rest * weight >= lim * weight_left AS is_full FROM placed),
targets AS MATERIALIZED (SELECT ns, source, source_size, CASE WHEN is_full THEN lim ELSE weight * (budget - coalesce(sum(CASE WHEN is_full THEN lim END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target FROM capped),
all_seats AS (SELECT CAST(round(sum(target) / {mixing.BLOCK_WORDS}) AS BIGINT) AS seats FROM targets),
seated AS (SELECT ns, source FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, ns, source, j) AS place FROM (SELECT *, unnest(range(1, seats + 1)) AS j FROM targets, all_seats)), all_seats a
   WHERE place <= a.seats AND target > 0),
quotas AS (SELECT t.*, count(s.source) AS source_quota, greatest(CAST(ceil(source_size / {mixing.SHARD_WORDS}e0) AS BIGINT), 1) AS shards FROM targets t LEFT JOIN seated s USING (ns, source) GROUP BY ALL),
dealt AS MATERIALIZED (SELECT *, {_NUMBER.format(f"'shard {mixing.SEED}/' || name")} % shards AS shard, {_NUMBER.format(f"'place {mixing.SEED}/' || name")} AS place FROM sized JOIN quotas USING (ns, source)),
shards AS (SELECT ns, source, shard, sum(size) AS shard_size, any_value(source_quota) AS source_quota FROM dealt GROUP BY 1, 2, 3),
shard_seats AS (SELECT ns, source, shard FROM (SELECT *, row_number() OVER (PARTITION BY ns, source ORDER BY shard_size / (2e0 * j - 1) DESC, shard, j) AS p FROM (SELECT *, unnest(range(1, source_quota + 1)) AS j FROM shards))
   WHERE p <= source_quota AND shard_size > 0),
cut AS (SELECT ns, source, shard, shard_size, greatest(CAST(ceil(shard_size / {mixing.BLOCK_WORDS}e0) AS BIGINT), 1) AS blocks, (SELECT count(*) FROM shard_seats x WHERE x.ns = s.ns AND x.source = s.source AND x.shard = s.shard) AS quota FROM shards s),
lined AS (SELECT *, sum(size) OVER (PARTITION BY ns, source, shard ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS until,
   least(quota, blocks * {mixing.CAP}) // blocks AS rounds, least(quota, blocks * {mixing.CAP}) % blocks AS part, {_NUMBER.format(f"'start {mixing.SEED}/' || source || '/' || CAST(shard AS VARCHAR)")} % blocks AS start
   FROM dealt JOIN cut USING (ns, source, shard))
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, CAST(rounds * size + {_words_before('until')} - {_words_before('(until - size)')} AS BIGINT) AS taken FROM lined"""

_SUBSTRINGS = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(doc_id, 9223372036854775807) AS id, {_WORDS} AS w FROM documents),
windows AS MATERIALIZED (SELECT row_id, id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT row_id, id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
owners AS (SELECT k, min(id) AS owner FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT row_id, unnest(range(i, i + 13)) AS p FROM windows JOIN owners USING (k) WHERE id > owner),
kept AS (SELECT d.row_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY d.p) AS text FROM (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs) d
   LEFT JOIN gone g ON g.row_id = d.row_id AND g.p = d.p GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row_id)"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LEAKS = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
marks AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
spots AS (SELECT row_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM marks))),
hits AS MATERIALIZED (SELECT row_id, n, i, item FROM spots JOIN marks USING (n, k)),
covered AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT row_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)"""

SQL = {
    "op1_url_filters": f"""WITH split AS ({_PAGES}), ruled AS (SELECT *, {_RULED} AS rule FROM split),
bad AS (SELECT host FROM ruled GROUP BY host HAVING 2 * count(*) FILTER (WHERE rule IN ({_BLOCKING})) > count(*))
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKING}) OR (rule IS NULL AND host IN (SELECT host FROM bad)) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op6_line_dedup": r"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
cut AS (SELECT row_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT c.*, r.k IS NOT NULL AND c.doc_id <> r.keeper AS dropped FROM keyed c LEFT JOIN repeated r USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY row_id""",
    "op5_warc": """WITH known AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
origin AS (SELECT html, min(page_id) AS first FROM known GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, record_type, refers_to FROM (
SELECT page_id, html, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', bits::INT + 1, 1), '' ORDER BY i) FROM (
    SELECT i, list_sum(list_transform(range(5), lambda b: ((strpos('0123456789abcdef', substr(sha1(html), ((5 * i + b) // 4)::INT + 1, 1)) - 1) >> (3 - (5 * i + b) % 4)::INT & 1) << (4 - b)::INT)) AS bits
    FROM range(32) t(i))) AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM known JOIN origin USING (html))""",
    "op3_mix": _MIX, "op4_quality_rules": _QUALITY, "op9_substring_dedup": _SUBSTRINGS, "op10_decontamination": _LEAKS,
    "op11_centroids": sql.CENTROIDS, "op13_manifest": sql.MANIFEST,
}
