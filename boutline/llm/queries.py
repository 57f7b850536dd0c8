"""Registered queries: each applies one operator with its production parameters to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from boutline.llm import byte_pairs, factorization, license_diagonals, merkle_manifest, toxic_passages, url_templates
from boutline.llm.leaked_questions import leaked_questions
from boutline.llm.near_copies import near_copies
from boutline.llm.repeated_lines import drop_repeated_lines
from boutline.llm.repetition import quality_rules
from boutline.llm.secret_literals import secrets
from boutline.llm.shared_passages import shared_passages
from boutline.llm.source_divergence import source_divergence
from boutline.llm.stored import held_out, table
from boutline.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op9_near_copies")
def _near_copies(spark, folder):
    return near_copies(table(spark, folder, "documents"))


@query("op4_repeated_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, ord, line, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def _repeated_lines(spark, folder):
    done = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_toxic_passages")
def _toxic_passages(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = held_out("doc_id", 4, 2)
    model = toxic_passages.fit(docs, labels.where(~out))
    return toxic_passages.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted", "passages")


@query("op10_leaked_questions")
def _leaked_questions(spark, folder):
    return leaked_questions(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_byte_pairs")
def _byte_pairs(spark, folder):
    import public_tokenizers

    return byte_pairs.digests(table(spark, folder, "documents"), byte_pairs.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


@query("op2_factorization")
def _factorization(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = held_out("doc_id", 5, 0)
    machine = factorization.fit(docs, labels.where(~out))
    return factorization.score(docs, machine).select("doc_id", out.alias("held_out"), "score", "predicted")


# The rules that the query is to apply.
RULES = [url_templates.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
                                          ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


@query("op3_url_templates", url_templates.oracle(RULES))
def _url_templates(spark, folder):
    return url_templates.judge_urls(table(spark, folder, "pages"), RULES)


@query("op6_secret_literals")
def _secret_literals(spark, folder):
    return secrets(table(spark, folder, "documents"))


@query("op8_repetition", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, coalesce(text, '') AS text FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM i WHERE i + 7 <= len(ws)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM s) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n_repeat_words, sum(length(ws[j])) AS repeat_chars
  FROM (SELECT DISTINCT doc_id, i + k AS j FROM r, range(0, 8) AS t(k)) c JOIN w USING (doc_id) GROUP BY doc_id),
far AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(ws[i:i + 200], ' ')) AS s FROM i WHERE i + 200 <= len(ws)) GROUP BY doc_id, s HAVING count(*) > 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(repeat_chars, 0) AS BIGINT) AS repeat_chars, far.doc_id IS NOT NULL AS is_far
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN far ON far.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND repeat_chars <= 0.3e0 * word_chars + 1e-9 AND NOT is_far AS kept FROM b""")
def _repetition(spark, folder):
    return quality_rules(table(spark, folder, "documents")).drop("longest_repeat")


@query("op1_shared_passages")
def _shared_passages(spark, folder):
    return shared_passages(table(spark, folder, "documents"))


def _field(c: str, value: str | None = None) -> str:
    text = f"CAST({value or c} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


# crc32 is worked out bit by bit, and the trees level by level.
@query("op13_merkle_manifest", f"""
WITH RECURSIVE crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS c FROM documents),
own AS (SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in merkle_manifest.FIELDS)}) AS leaf, coalesce(c % 7 = 0, false) AS tampered,
  sha256({" || ".join(_field(c, "n_chars + 1" if c == "n_chars" else None) for c in merkle_manifest.FIELDS)}) AS altered FROM crc),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, leaf, CASE WHEN tampered THEN altered ELSE leaf END AS claim,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM own),
t AS (SELECT tree, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, lvl, i // 2, n),
s AS (SELECT tree, lvl AS height, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, h FROM s
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
r AS (SELECT lvl AS height, h AS root FROM u WHERE n = 1),
step AS (SELECT l.tree, l.i, k.lvl, (l.i >> k.lvl) & 1 AS side, t.h FROM l JOIN s USING (tree) JOIN range(0, 64) AS k(lvl) ON k.lvl < s.height
    LEFT JOIN t ON t.tree = l.tree AND t.lvl = k.lvl AND t.i = xor(l.i >> k.lvl, 1)
  UNION ALL SELECT l.tree, l.i, s.height + k.lvl, (s.i >> k.lvl) & 1, u.h FROM l JOIN s USING (tree) CROSS JOIN r JOIN range(0, 64) AS k(lvl) ON k.lvl < r.height
    LEFT JOIN u ON u.lvl = k.lvl AND u.i = xor(s.i >> k.lvl, 1)),
way AS (SELECT tree, i, string_agg(h, '' ORDER BY lvl) AS joined FROM step GROUP BY tree, i),
f AS (SELECT tree, i, 0 AS lvl, claim AS h FROM l
  UNION ALL SELECT f.tree, f.i, f.lvl + 1, sha256(CASE WHEN step.side = 1 THEN coalesce(step.h, '') || f.h ELSE f.h || coalesce(step.h, '') END)
  FROM f JOIN step ON step.tree = f.tree AND step.i = f.i AND step.lvl = f.lvl)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.root, sha256(coalesce(way.joined, '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM l JOIN s USING (tree) CROSS JOIN r LEFT JOIN way ON way.tree = l.tree AND way.i = l.i
JOIN f ON f.tree = l.tree AND f.i = l.i AND f.lvl = s.height + r.height""")
def _merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    altered = F.when(held_out("doc_id", 7, 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claim = merkle_manifest.leaf("doc_id", "source", "lang", altered, "text")
    return merkle_manifest.proofs(merkle_manifest.build_manifest(docs, claim))


@query("op12_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, any_value(l.total) AS lang_total FROM d LEFT JOIN l ON l.lang = d.lang GROUP BY d.lang, d.source),
o AS (SELECT c.lang, c.source, CAST(sum(c.n) AS BIGINT) AS total FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY c.lang, c.source),
s AS (SELECT g.lang, g.source, g.v, g.lang_total, coalesce(o.total, 0) AS total FROM g LEFT JOIN o ON o.lang = g.lang AND o.source = g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.total + s.v) AS p,
  1 + 1000000000 * (k.n + 1) // (s.lang_total + s.v) AS q FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p AS a
  JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
t AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM t WHERE part = 'pair' OR rank <= 200""")
def _source_divergence(spark, folder):
    return source_divergence(table(spark, folder, "documents"))


def _license_rows() -> str:
    """The templates as rows of SQL."""
    both = [(t, "true", license_diagonals.PHRASE_RUN) for t in license_diagonals.PHRASES] + [(t, "false", license_diagonals.NOTICE_RUN) for t in license_diagonals.NOTICES]
    return ", ".join(f"({i}, '{t.label}', {exact}, {size}, '{t.text}')" for i, (t, exact, size) in enumerate(both))


def _likeness(span: str) -> str:
    plain = f"regexp_replace({span}, '[^\\x00-\\x7F]', '?', 'g')"
    return f"1e0 - levenshtein({plain}, text) / CAST(greatest(length({span}), length(text), 1) AS DOUBLE)"


# A run is compared as words here, where the operator compares hashes.
@query("op11_license_diagonals", f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
g AS (SELECT t, label, exact, k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws
  FROM (VALUES {_license_rows()}) AS v(t, label, exact, k, text)),
tr AS (SELECT t, exact, k, len(ws) AS n, len(ws) - k + 1 AS needed, unnest(range(0, len(ws) - k + 1)) AS pos, ws FROM g),
tg AS (SELECT t, exact, k, n, needed, pos, array_to_string(ws[pos + 1:pos + k], ' ') AS run FROM tr),
di AS (SELECT id, ws, k, unnest(range(0, len(ws) - k + 1)) AS place FROM d, (SELECT DISTINCT k FROM g) AS ks WHERE len(ws) >= k),
dg AS (SELECT id, k, place, array_to_string(ws[place + 1:place + k], ' ') AS run FROM di),
v AS (SELECT id, t, exact, n, needed, place - pos AS diagonal, count(*) AS votes FROM dg JOIN tg USING (k, run) GROUP BY id, t, exact, n, needed, place - pos),
m AS (SELECT *, min(diagonal) OVER near AS low, max(diagonal) OVER near AS high, sum(votes) OVER near AS everyone, max(votes * 1000000000000 - diagonal) OVER near AS most
  FROM v WHERE NOT exact WINDOW near AS (PARTITION BY id, t ORDER BY diagonal RANGE BETWEEN {license_diagonals.DRIFT} PRECEDING AND {license_diagonals.DRIFT} FOLLOWING)),
p AS (SELECT id, t, n, diagonal AS low, diagonal AS high, diagonal FROM v WHERE exact AND votes = needed
  UNION ALL SELECT id, t, n, low, high, diagonal FROM m WHERE everyone >= {license_diagonals.VOTES}e0 * needed AND votes * 1000000000000 - diagonal = most),
c AS (SELECT p.id, t, label, exact, greatest(low, 0) AS start, least(high + n, len(d.ws)) AS stop, array_to_string(g.ws, ' ') AS text,
  array_to_string(d.ws[greatest(low, 0) + 1:least(high + n, len(d.ws))], ' ') AS wide,
  array_to_string(d.ws[greatest(diagonal, 0) + 1:least(diagonal + n, len(d.ws))], ' ') AS narrow FROM p JOIN d USING (id) JOIN g USING (t)),
a AS (SELECT *, CASE WHEN exact THEN CASE WHEN narrow = text THEN 1e0 ELSE 0e0 END ELSE greatest({_likeness("wide")}, {_likeness("narrow")}) END AS likeness FROM c),
s AS (SELECT *, max(stop) OVER (PARTITION BY id, exact ORDER BY start, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a
  WHERE likeness >= CASE WHEN exact THEN 1e0 ELSE {license_diagonals.LIKENESS}e0 END),
i AS (SELECT *, sum(CASE WHEN exact OR reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY id, exact ORDER BY start, t ROWS UNBOUNDED PRECEDING) AS island FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY id, exact, island ORDER BY likeness DESC, t) AS best FROM i),
r AS (SELECT id, count(*) FILTER (WHERE exact) AS n_base, min(start) FILTER (WHERE exact) AS first_word, max(start) FILTER (WHERE exact) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(likeness) AS score
  FROM b WHERE best = 1 GROUP BY id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score FROM d LEFT JOIN r USING (id)""")
def _license_diagonals(spark, folder):
    return license_diagonals.licenses(table(spark, folder, "documents")).drop("spans")
