"""The registered queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.chat import format_turns, read_back, text_part
from pagequarry.llm.decontam import contaminated
from pagequarry.llm.divergence import audit
from pagequarry.llm.fim import fill_in_middle, restored
from pagequarry.llm.hmm import score
from pagequarry.llm.jaccard import jaccard_components
from pagequarry.llm.licenses import scan_licenses
from pagequarry.llm.mixing import mix
from pagequarry.llm.neardup import near_duplicates
from pagequarry.llm.pages import main_text
from pagequarry.llm.quality import quality
from pagequarry.llm.repeats import without_repeats
from pagequarry.llm.tokens import tokenized


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op2_chat_format(spark: SparkSession, d: str) -> DataFrame:
    """All conversations, and one that says the template's own marks."""
    columns = ["conv_id", "turn", "role", "text"]
    marks = "\\### Assistant: </turn> ok"
    rows = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, d, "conversations").select(*columns).unionByName(rows)
    return read_back(format_turns(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))


def op3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return main_text(_table(spark, d, "pages"))


def op4_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(_table(spark, d, "documents"))


def op5_repeated_passages(spark: SparkSession, d: str) -> DataFrame:
    return without_repeats(_table(spark, d, "documents"), with_text=False).drop("kept")


def op6_benchmark_leaks(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return contaminated(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op7_token_files(spark: SparkSession, d: str) -> DataFrame:
    return tokenized(_table(spark, d, "documents"))


def op8_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line, paragraph or text that is a licence or its notice."""
    return scan_licenses(_table(spark, d, "documents"))


def op9_markov_scores(spark: SparkSession, d: str) -> DataFrame:
    return score(_table(spark, d, "documents"))


def op10_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_table(spark, d, "documents")).drop("source")


def op11_source_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit(_table(spark, d, "documents"))


def op12_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the cut documents, and of the texts put together again from them."""
    cut = restored(fill_in_middle(_table(spark, d, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{'restored' if c == 'text' else c}_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("text"))


def op13_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_components(_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_main_text": op3_main_text,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_token_files": op7_token_files,
    "op8_license_scan": op8_license_scan,
    "op9_markov_scores": op9_markov_scores,
    "op10_source_mix": op10_source_mix,
    "op11_source_audit": op11_source_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS key
  FROM documents),
per AS (
  SELECT src, min(source) AS source, sum(size)::DOUBLE AS source_size,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY min(source) NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sized GROUP BY src),
ordered AS (
  SELECT *, 2.0 * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM per),
flagged AS (SELECT *, most * open_w <= (total - below) * w AS is_full FROM ordered),
goal AS (
  SELECT src, source_size, CASE WHEN is_full THEN most ELSE
    w * (total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0))
      / sum(CASE WHEN NOT is_full THEN w END) OVER () END::DOUBLE AS target
  FROM flagged),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goal),
units AS (SELECT src, key, doc_id, sum(size) AS unit FROM sized GROUP BY ALL),
placed AS (
  SELECT u.*, p.epochs, p.source_size, p.target, floor(p.target)::BIGINT - p.epochs * p.source_size::BIGINT AS rest,
    sum(unit) OVER (PARTITION BY u.src ORDER BY u.key, u.doc_id NULLS FIRST) - unit AS before
  FROM units u JOIN parts p USING (src))
SELECT s.doc_id, s.size, p.source_size::BIGINT AS source_size, p.target,
  (p.epochs * s.size + CASE WHEN p.before + p.unit <= p.rest THEN s.size
    WHEN p.before >= p.rest THEN 0 ELSE s.size * (p.rest - p.before) // p.unit END)::BIGINT AS taken
FROM sized s JOIN placed p ON s.src = p.src AND s.key = p.key AND s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, role IS NULL AS no_role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), false, '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, len(text) + len(regexp_replace(text, '[^\\<#]', '', 'g')) AS n_text,
    CASE WHEN no_role THEN 2 ELSE len(role) + len(regexp_replace(role, '[^\\<#:]', '', 'g')) END AS n_role FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + n_text + n_role)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

#: Distinct shingles ``s`` of each row of ``documents`` and its words ``w``.
_SHINGLES_SQL = r"""
  SELECT doc_id, w, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {id} AS doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM {table})
"""

_NEAR_SQL = f"""
WITH RECURSIVE docs AS ({_SHINGLES_SQL.format(id="doc_id", table="documents")}),
sets AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM docs WHERE len(s) > 0) GROUP BY s),
one AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM docs d LEFT JOIN sets t ON list_sort(d.s) = t.s LEFT JOIN comp c ON c.rep = t.rep
"""

_LEAKS_SQL = f"""
WITH docs AS ({_SHINGLES_SQL.format(id="doc_id", table="documents")}),
items AS ({_SHINGLES_SQL.format(id="item_id", table="benchmark")}),
item_rows AS (SELECT doc_id AS item_id, least(len(w), 5) AS width, len(s) AS n, unnest(s) AS x FROM items),
doc_rows AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS x
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM docs, (SELECT DISTINCT width FROM item_rows)))
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, count(*) AS n_shared
FROM doc_rows JOIN item_rows USING (width, x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
"""

_AUDIT_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS g FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(g)::HUGEINT AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(g, 0) AS g, 1 + (1000000000::HUGEINT * (coalesce(g, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (c + 5)) // (l.n + 5 * l.v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(t.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) t
  ON t.lang = a.lang AND t.source = a.source AND t.item = b.source),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE g > 0 AND p > q))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_MIDDLE_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in [0, 1, 2, 3]] AS d FROM hashed),
cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 90 THEN 'plain'
      WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

_JACCARD_SQL = f"""
WITH RECURSIVE docs AS ({_SHINGLES_SQL.format(id="doc_id", table="documents").replace(">= 5", ">= 4").replace("- 3)", "- 2)").replace("i + 4", "i + 3")}),
sets AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM docs WHERE len(s) > 0) GROUP BY s),
one AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM docs d LEFT JOIN sets t ON list_sort(d.s) = t.s LEFT JOIN comp c ON c.rep = t.rep
"""

ORACLE: dict[str, str] = {
    "op2_chat_format": _CHAT_SQL,
    "op4_near_duplicates": _NEAR_SQL,
    "op6_benchmark_leaks": _LEAKS_SQL,
    "op10_source_mix": _MIX_SQL,
    "op11_source_audit": _AUDIT_SQL,
    "op12_fill_in_middle": _MIDDLE_SQL,
    "op13_ngram_jaccard": _JACCARD_SQL,
}
