"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolweave.llm import (
    collocations, decontamination, html_templates, kneser_ney, license_scan, near_duplicates, packing, prefix_trie, quality_rules,
    suffix_dedup, token_counts, toxicity, url_filters,
)
from symbolweave.llm.text import id_and_text, table


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The base figures and the verdict on every document."""
    judged = quality_rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licenses every document names."""
    return license_scan.scan(table(spark, folder, "documents"))


# (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The rule and the verdict for every page's address."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, folder, "pages"), rules)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, by a model of the labelled ones that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    learned = labels.filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, toxicity.fit(docs, learned))


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), size=2)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What of every document no document before it has, in strings of 50 bytes."""
    return suffix_dedup.repeated_bytes(table(spark, folder, "documents"))


def op7_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every document, by a model of those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(toxicity.held_out(F.col("doc_id"), 5), F.lit(False))
    model = kneser_ney.train(docs.filter(~held_out))
    return kneser_ney.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def sample_edits() -> Column:
    """Three edits of every document: words put in, characters taken out, characters replaced."""
    size = F.length(F.coalesce("text", F.lit("")))

    def edit(share: float, length: int, replacement: str) -> Column:
        return F.struct(F.floor(size * share).cast("int").alias("start"), F.lit(length).alias("length"),
                        F.lit(replacement).alias("replacement"))

    return F.array(edit(0.25, 0, " as edited in 2024 "), edit(0.5, 12, ""), edit(0.75, 5, "X-1  y"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after three edits."""
    return token_counts.edited_counts(table(spark, folder, "documents"), sample_edits(),
                                      public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of all beginnings of conversations that share their families' first turns."""
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, folder, "conversations")))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of two and three words in every language of the documents."""
    return collocations.collocations(table(spark, folder, "documents"))


def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_templates.extract(table(spark, folder, "pages"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_url_filters": op8_url_filters,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_html_extraction": op13_html_extraction,
}
_LIMITS = {r.measure: r for r in quality_rules.RULES}


def _broken(measure: str, value: str) -> str:
    """SQL for a rule of the table: its measure's name if the value is outside."""
    rule = _LIMITS[measure]
    outside = [f"({value}) < {rule.least}"] if rule.least is not None else []
    outside += [f"({value}) > {rule.most}"] if rule.most is not None else []
    return f"CASE WHEN {' OR '.join(outside)} THEN '{measure}' END"


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_FAILED = ", ".join(_broken(m, v) for m, v in (
    ("mean_word_chars", "word_chars / greatest(n_words, 1)"),
    ("longest_word_share", "coalesce(list_max(list_transform(w, lambda x: length(x))), 0) / greatest(word_chars, 1)"),
    ("symbols_per_word", "n_symbols / greatest(n_words, 1)"),
    ("exclamations_per_word", "(length(t) - length(replace(t, '!', ''))) / greatest(n_words, 1)"),
    ("stop_word_share", f"len(list_filter(w, lambda x: x IN ({_STOP}))) / greatest(n_words, 1)"),
    ("dup_line_share", "n_dup_lines / greatest(len(l), 1)"),
    ("pipe_line_share", "len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) > 2)) / greatest(len(l), 1)"),
))

ORACLES = {
    "op4_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS shingle
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, CASE WHEN r.to_id = l.a THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON r.to_id = l.a OR r.to_id = l.b
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.to_id) AS component_id,
  r.doc_id = min(r.to_id) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op6_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), found AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM found) GROUP BY doc_id
), facts AS (
  SELECT d.*, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_filter([{_FAILED}], lambda x: x IS NOT NULL) AS failed
  FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules
FROM judged
""",
    "op8_url_filters": """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT s.page_id, s.host, s.path, max_by(h || p, length(h || p)) AS rule,
  coalesce(max_by(v, length(h || p)), 'allow') AS verdict
FROM split s LEFT JOIN rules r
  ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)
GROUP BY s.page_id, s.host, s.path
""",
    "op11_prefix_trie": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), sized AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS head_id, CAST(conv_id AS VARCHAR) AS s FROM own GROUP BY conv_id
), heads AS (
  SELECT conv_id, n, head_id, xor(list_reduce(list_prepend(4294967295,
      list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 6 AS h
  FROM sized, crc
), front AS (
  SELECT a.conv_id, a.h, coalesce(b.n, 0) AS head_n, a.head_id FROM heads a LEFT JOIN heads b ON b.conv_id = a.head_id
), turns AS (
  SELECT f.conv_id, o.k AS at, o.role, o.text FROM front f JOIN own o ON o.conv_id = f.head_id AND o.k <= f.h
  UNION ALL
  SELECT f.conv_id, o.k - f.h + least(f.h, f.head_n), o.role, o.text FROM front f JOIN own o ON o.conv_id = f.conv_id AND o.k > f.h
), paths AS (
  SELECT f.conv_id, coalesce(list(md5(length(t.role) || ':' || t.role || t.text) ORDER BY t.at) FILTER (t.at IS NOT NULL), []) AS p,
    coalesce(list(length(t.text) ORDER BY t.at) FILTER (t.at IS NOT NULL), []) AS sizes
  FROM front f LEFT JOIN turns t ON t.conv_id = f.conv_id GROUP BY f.conv_id
), members AS (
  SELECT conv_id, p, d, array_to_string(p[1:d], '') AS node, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(p[1:d]) AS p,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(p) = d), '')) AS ends_sha256
  FROM members GROUP BY node, d
), families AS (
  SELECT array_to_string(p[1:d - 1], '') AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), below AS (
  SELECT array_to_string(n.p[1:e], '') AS node, e AS d, count(*) FILTER (f.node IS NULL) AS n_leaves,
    sum((n_convs - 1) * size)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM nodes) n LEFT JOIN families f ON f.node = n.node AND f.d = n.d GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children,
  b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node AND b.d = n.d
LEFT JOIN families f ON f.node = n.node AND f.d = n.d
LEFT JOIN nodes u ON u.node = array_to_string(n.p[1:n.d - 1], '') AND u.d = n.d - 1
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), occurring AS (
  SELECT lang, w[i : i + k - 1] AS p
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k))
), f AS (
  SELECT lang, p, count(*) AS a FROM occurring GROUP BY lang, p
), spoken AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), candidates AS (
  SELECT lang, p, a FROM f WHERE len(p) > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r,
    ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)]
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), held AS (
  SELECT DISTINCT s.lang, s.p FROM candidates s
  JOIN (SELECT lang, a, unnest([p[1:2], p[2:3]]) AS p FROM candidates WHERE len(p) = 3) g
    ON g.lang = s.lang AND g.p = s.p AND 100 * g.a >= 50 * s.a
), ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, array_to_string(w.p, ' ')) AS rank,
    array_to_string(w.p, ' ') AS phrase, w.a, l, r, n, score
  FROM worst w JOIN spoken s ON s.lang = w.lang LEFT JOIN held h ON h.lang = w.lang AND h.p = w.p WHERE h.p IS NULL
)
SELECT * FROM ranked WHERE rank <= 2000
""",
}
