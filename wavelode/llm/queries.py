"""The registered queries of this subpackage, thin digests of the operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, divergence, embedding_dedup, exact_dedup, html_extraction, language_id, line_dedup, mixing, pieces, quality, secrets, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it; see mixing.mix."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':20'), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
caps AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, place) AS nth
  FROM caps
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT min_by(level, nth) FROM levels WHERE level * weight <= cap)) AS target FROM levels),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM targets),
runs AS (
  SELECT d.source, d.h, sum(d.size) AS words,
         sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM docs d GROUP BY d.source, d.h)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (d.size * (n.base + CASE WHEN r.upto <= n.target - n.base * n.source_size THEN 1
          WHEN r.upto - r.words <= n.target - n.base * n.source_size
               AND (n.target - n.base * n.source_size - r.upto + r.words) * 2 >= r.words THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
JOIN runs r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts; see exact_dedup.exact_dedup."""
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
WITH docs AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM docs WINDOW g AS (PARTITION BY text_sha256)
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component; see embedding_dedup.near_vectors."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different line with its near lines and class; see line_dedup.line_classes."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).drop("line")


OP3_SQL = r"""
WITH RECURSIVE occurrences AS (
  SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM documents),
lines AS (
  SELECT line, md5(line) AS line_md5, count(*) AS n, min(doc_id) AS first_doc, octet_length(encode(line)) AS size
  FROM occurrences WHERE line <> '' GROUP BY line),
links AS MATERIALIZED (
  SELECT a.line_md5 AS a, b.line_md5 AS b
  FROM lines a JOIN lines b ON b.size BETWEEN a.size - 2 AND a.size + 2 AND a.line_md5 <> b.line_md5
  WHERE a.size >= 20 AND b.size >= 20 AND levenshtein(a.line, b.line) <= 2),
reach AS (
  SELECT DISTINCT a, a AS b FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (
  SELECT r.a, min(r.b) AS class_id, min(m.first_doc) AS class_doc FROM reach r JOIN lines m ON m.line_md5 = r.b GROUP BY r.a),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT l.line_md5, l.n, l.first_doc, coalesce(d.n_links, 0) AS n_links,
       coalesce(c.class_id, l.line_md5) AS class_id, coalesce(c.class_doc, l.first_doc) AS class_doc
FROM lines l LEFT JOIN degrees d ON d.a = l.line_md5 LEFT JOIN classes c ON c.a = l.line_md5
"""


def op3_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated and near lines; see line_dedup.deduplicated."""
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those not held out; see language_id.language_id."""
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again; see pieces.digests."""
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.Vocabulary.load())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; see quality.quality."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; see toxicity.toxicity."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component; see simhash.near_dedup."""
    rows = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; see html_extraction.extract."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, as pairs and by terms; see divergence.audit."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS lang_n
  FROM groups LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN vocabulary USING (lang)),
dense AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
  FROM totals JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
whole AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM (
    SELECT d.lang, d.source, d.term, d.p, 1 + (1000000000::HUGEINT * (w.c + 1)) // (t.lang_n + t.v) AS q
    FROM dense d JOIN whole w USING (lang, term) JOIN totals t USING (lang, source) WHERE d.c > 0) WHERE p > q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM every LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM terms)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets and the weak parts that complete one another; see secrets.find."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    """Positions are summed lengths of what stands between matches and of the matches themselves."""
    patterns = dict(zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.IDENT, secrets.OPAQUE, secrets.ENDPOINT), strict=True))
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    keep = {
        "assign": f"length(regexp_extract(hit, {quoted(patterns['assign'])}, 1)) >= 6", "ident": f"length(regexp_extract(hit, {quoted(patterns['ident'])}, 1)) >= 4",
        "opaque": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')",
    }
    spans = lambda p: f"SELECT r, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM (SELECT r, regexp_extract_all(text, {quoted(p)}) AS hits, string_split_regex(text, {quoted(p)}) AS gaps FROM docs)"
    placed = lambda p: f"(SELECT r, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS s FROM ({spans(p)}))"
    all_ = " UNION ALL ".join(f"SELECT r, {i} AS k, s, s + length(hit) AS e FROM {placed(p)} WHERE {keep.get(k, 'true')}" for i, (k, p) in enumerate(patterns.items()))
    near = lambda kinds: f"EXISTS (SELECT 1 FROM parts o WHERE o.r = p.r AND o.scope = p.scope AND o.k IN ({kinds}) AND o.s <= p.e + {secrets.REACH} AND o.e >= p.s - {secrets.REACH})"
    names = f"{list(secrets.KINDS)}[k + 1]"
    joined = f"coalesce(string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k, e), '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({all_}),
apart AS (
  SELECT * FROM found f WHERE k IN (0, 1, 2, 5)
    OR (k = 3 AND NOT EXISTS (SELECT 1 FROM found o WHERE o.r = f.r AND o.k < 3 AND o.s < f.e AND o.e > f.s))),
clear AS (
  SELECT * FROM apart UNION ALL
  SELECT * FROM found f WHERE k = 4 AND NOT EXISTS (SELECT 1 FROM apart o WHERE o.r = f.r AND o.s < f.e AND o.e > f.s)),
breaks AS (SELECT r, s FROM {placed(secrets.BREAK)}),
parts AS MATERIALIZED (SELECT c.*, (SELECT count(*) FROM breaks b WHERE b.r = c.r AND b.s < c.s) AS scope FROM clear c),
said AS (
  SELECT * FROM parts p WHERE k < 3 OR (k = 4 AND ({near("1")} OR ({near("3")} AND {near("5")})))
    OR (k = 3 AND ({near("0, 2")} OR ({near("4")} AND {near("5")}))) OR (k = 5 AND {near("1, 3")} AND {near("0, 2, 4")}))
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3), '')) AS base_sha256, {joined} AS spans
FROM docs d LEFT JOIN said q ON q.r = d.r GROUP BY d.r, d.doc_id
"""


OP12_SQL = _op12_sql()


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest repair and the repaired text's hash; see conversations.repair."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.audit_digests(conversations.damaged(rows), rows)


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _op13_sql() -> str:
    """A row's values by state, from the last row back: twelve digits of cost, the audit, a mark, the repaired lines.
    The least such text is the least cost and, of that, the ASCII-least audit. g: no insertion before the row;
    h: up to one; v: up to two."""
    edge = lambda cost, letter, to, line="''": f"(printf('%012d', {cost} + {to}[:12]::BIGINT) || '{letter}' || split_part({to}[13:], chr(1), 1) || chr(1) || {line} || substr({to}, strpos({to}, chr(1)) + 1))"
    said = lambda role: f"'{role}:' || text || chr(10)"
    nexts, roles = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    g = []
    for s in range(4):
        keeps = [f"CASE WHEN free AND initial = '{i}' THEN {edge('short', 'K', f'n{t}', 'role || chr(58) || text || chr(10)')} END" for i, t in kept[s]]
        rerole = f"CASE WHEN free THEN {edge('2 + short', 'R', f'n{nexts[s]}', said(roles[s]))} END"
        g.append(_least(edge("3", "D", f"n{s}"), rerole, *keeps) + f" AS g{s}")
    insert = lambda s, layer: edge("2", "I", f"{layer}{nexts[s]}", f"'{roles[s]}:' || chr(10)")
    h = [_least(f"g{s}", insert(s, "g")) + f" AS h{s}" for s in range(4)]
    v = [_least(f"g{s}", insert(s, "h")) + f" AS v{s}" for s in range(4)]
    return rf"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM range(256) r(n)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
crc AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS d FROM keyed k, bytes),
harm AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE d <> 0),
line AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM harm),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, count(*) OVER (PARTITION BY conv_id) AS total,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM line),
faults AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
rows AS (SELECT *, NOT (blank OR duplicate) AS free, truncated::BIGINT AS short FROM faults),
back AS (
  SELECT DISTINCT conv_id, total + 1 AS i, '000000000000' || chr(1) AS v0, '000000000004II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10) AS v1,
    '000000000002I' || chr(1) || 'assistant:' || chr(10) AS v2, '000000000000' || chr(1) AS v3 FROM rows
  UNION ALL
  SELECT conv_id, i, {", ".join(v)} FROM (SELECT *, {", ".join(h)} FROM (SELECT *, {", ".join(g)} FROM (
    SELECT r.*, b.v0 AS n0, b.v1 AS n1, b.v2 AS n2, b.v3 AS n3 FROM back b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)))),
best AS (SELECT conv_id, v0 FROM back WHERE i = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0[:12]::BIGINT, 0) AS cost,
  coalesce(split_part(v0[13:], chr(1), 1), '') AS audit, sha256(coalesce(regexp_replace(substr(v0, strpos(v0, chr(1)) + 1), '\n\z', ''), '')) AS repaired_sha256
FROM every e LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP13_SQL = _op13_sql()


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op3_line_texts": op3_line_texts,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pieces": op6_pieces,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_html": op10_html,
    "op11_divergence": op11_divergence,
    "op12_secrets": op12_secrets,
    "op13_conversations": op13_conversations,
}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op3_line_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op11_divergence": OP11_SQL, "op12_secrets": OP12_SQL, "op13_conversations": OP13_SQL}
