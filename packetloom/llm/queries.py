"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    decontamination,
    exact_dedup,
    filter_audit,
    lattice_lm,
    near_dedup,
    packing,
    phrases,
    repetition,
    secret_scan,
    site_quality,
    token_output,
    toxicity,
    url_rules,
)
from packetloom.llm.common import documents

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.digest(token_output.write_token_matrices(documents(spark, sf_dir)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no urls, so its source stands for the host and its language for the path."""
    return site_quality.judge_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_rows(spark, list(URL_RULES)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(documents(spark, sf_dir))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(documents(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = (
    op1_token_output, op2_best_fit_packing, op3_decontamination, op4_toxicity, op5_site_quality,
    op6_secret_scan, op7_url_rules, op8_near_dedup, op9_repetition_rules, op10_lattice_lm,
    op11_exact_dedup, op12_phrase_mining, op13_filter_audit,
)

OP7_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
sites AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM sites JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""


def op9_sql() -> str:
    """The counts by positions and windows; equal windows are found by their words instead of by hashes."""
    grams = {3: "n_repeat_words", **{n: f"dup_{n}gram_chars" for n in repetition.NGRAM_LIMITS}}
    parts = []
    for n in grams:
        parts.append(f"""
w{n} AS (SELECT doc_id, i, hash(words[i:i + {n - 1}]) AS a, md5(array_to_string(words[i:i + {n - 1}], ' ')) AS b
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n} + 2)) AS i FROM texts WHERE len(words) >= {n})),
r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b) AS times FROM w{n}) WHERE times > 1),
c{n} AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM (
    SELECT DISTINCT r.doc_id, r.i + k AS place FROM r{n} r, range(0, {n}) AS s(k)) x
  JOIN positions p ON p.doc_id = x.doc_id AND p.i = x.place GROUP BY doc_id)""".replace("SELECT doc_id, count(*) AS n, sum(length(word)) AS chars", "SELECT x.doc_id AS doc_id, count(*) AS n, sum(length(word)) AS chars").replace("p.i = x.place GROUP BY doc_id", "p.i = x.place GROUP BY x.doc_id"))
    counts = ", ".join(f"coalesce(c{n}.{'n' if n == 3 else 'chars'}, 0)::BIGINT AS {name}" for n, name in grams.items())
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = t.doc_id" for n in grams)
    over = " OR ".join([f"dup_line_chars > {repetition.LINE_LIMIT} * word_chars", *(f"dup_{n}gram_chars > {most} * word_chars" for n, most in repetition.NGRAM_LIMITS.items())])
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
positions AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS turn FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines WHERE turn > 1 GROUP BY doc_id),
{",".join(parts)},
counted AS (SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(dup.chars, 0)::BIGINT AS dup_line_chars, {counts}
  FROM texts t LEFT JOIN dup ON dup.doc_id = t.doc_id {joins}),
judged AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND NOT ({over}) AS kept FROM judged
"""


OP11_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS turn, count(*) OVER (PARTITION BY h) AS group_size FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, turn = 1 AS kept, h AS text_sha256 FROM r
"""

OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM words, range(1, 6) s(m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT f.lang, f.m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp FROM f, range(1, 5) s(k) WHERE k < f.m),
scored AS (SELECT c.lang, c.m, c.phrase, c.a, k, lp, rp, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT g.lang, array_to_string(string_split(g.phrase, ' ')[i:i + m2 - 1], ' ') AS phrase, g.a FROM f g, range(2, 5) s(m2), range(1, 6) t(i) WHERE m2 < g.m AND i + m2 - 1 <= g.m),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT t.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, len(words) < 100 AS A, 100 * len(list_distinct(words)) < 80 * len(words) AS B,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, t.doc_id > min(t.doc_id) OVER (PARTITION BY text) AS E
  FROM t LEFT JOIN labels ON labels.doc_id = t.doc_id),
m AS (SELECT part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END) || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS mask,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE length(replace(replace(replace(replace(replace('ABCDE', a.x, ''), b.x, ''), c.x, ''), d.x, ''), e.x, '')) = 0),
h AS (SELECT part, filter_order, step, substr(filter_order, step::INT, 1) AS x, n, good, toxic, mask,
  length(translate(substr(filter_order, 1, step::INT - 1), mask, '')) = step - 1 AS there FROM m, o, range(1, 6) s(step)),
g AS (SELECT part, filter_order, step::INT AS step, x, sum(CASE WHEN there AND contains(mask, x) THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN NOT there AND contains(mask, x) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN there AND NOT contains(mask, x) THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN there AND contains(mask, x) THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN there AND contains(mask, x) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_rules": OP7_SQL, "op9_repetition_rules": op9_sql(), "op11_exact_dedup": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_filter_audit": OP13_SQL}
