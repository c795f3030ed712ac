"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, fertility, kneser_ney, linededup, merkle, packing, secrets, simhash, substrings, toolcalls, warc, wrapper
from .common import table


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.verdicts(table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1 what SQL can express, in a pass of its own: the base counts and what they fail. A test holds op1's columns against it."""
    return fertility.base(table(spark, sf_dir, "documents"))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS win FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
a AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM a, range(5) AS t(o) GROUP BY rid),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l USING (rid) LEFT JOIN r USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""


#: Of the tool that op2 takes each user's turn for a call of.
ASK = {
    "ask": {
        "type": "object",
        "properties": {"after": {"type": "object"}, "text": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages with tool calls: a user's turn is a call by an assistant, an assistant's the tool's result for the turn before.

    A call asks for the result of the call two turns before. In conversations of number 1 modulo 5 it asks for that two turns after instead,
    and in those of number 2 modulo 5 the call of turn 0 asks for that of turn 2 as well, so both are in a cycle. System turns stay as they are.
    """
    conv, turn, text = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    name = lambda t: F.concat_ws("-", conv, t.cast("string"))
    kind = F.coalesce(F.pmod(F.col("conv_id").cast("long"), F.lit(5)), F.lit(0))
    asked = F.when(kind == 1, turn + 2).when((kind == 2) & (turn == 0), F.lit(2).cast("long")).when(turn >= 2, turn - 2)
    after = F.when(asked.isNotNull(), F.struct(name(asked).alias("$ref")))
    call = F.concat(F.lit("<tool_call>"), F.to_json(F.struct(name(turn).alias("id"), F.lit("ask").alias("name"), F.struct(turn.alias("turn"), text.alias("text"), after.alias("after")).alias("arguments"))), F.lit("</tool_call>"))
    result = F.concat(F.lit("<tool_response>"), F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.struct(text.alias("text")).alias("content"))), F.lit("</tool_response>"))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))


def op2_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolcalls.link(tool_messages(table(spark, sf_dir, "conversations")), ASK)
    return found.select(
        "conv_id", "call_id", "name", "call_turn", "result_turn", "status", "level", F.array_join("errors", "; ").alias("errors"),
        F.sha2(F.col("call_json").cast("binary"), 256).alias("call_sha256"),
    )


OP2_SQL = """
WITH RECURSIVE c AS (
  SELECT *, conv_id || '-' || turn AS id, CASE WHEN conv_id % 5 = 1 THEN turn + 2 WHEN conv_id % 5 = 2 AND turn = 0 THEN 2 WHEN turn >= 2 THEN turn - 2 END AS asked FROM conversations WHERE role = 'user'
),
r AS (SELECT *, conv_id || '-' || (turn - 1) AS id FROM conversations WHERE role = 'assistant'),
lv AS (
  SELECT c.id, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.conv_id = c.conv_id AND o.turn = c.asked)
  UNION ALL SELECT c.id, lv.level + 1 FROM c JOIN lv ON c.conv_id || '-' || c.asked = lv.id
)
SELECT c.conv_id, c.id AS call_id, 'ask' AS name, c.turn AS call_turn, r.turn AS result_turn,
  CASE WHEN lv.level IS NULL THEN 'cyclic' WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, lv.level,
  CASE WHEN length(c.text) < 20 THEN '/text: limits' ELSE '' END AS errors,
  sha256('{"arguments":{' || coalesce('"after":{"$ref":"' || c.conv_id || '-' || c.asked || '"},', '') || '"text":' || to_json(c.text) || ',"turn":' || c.turn
    || '},"id":"' || c.id || '","name":"ask","result":' || coalesce('{"text":' || to_json(r.text) || '}', 'null') || '}') AS call_sha256
FROM c LEFT JOIN r ON c.id = r.id LEFT JOIN lv ON c.id = lv.id
UNION ALL
SELECT r.conv_id, r.id, NULL, NULL, r.turn, 'orphan', NULL, '', NULL FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = r.id)
"""


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = warc.plan_records(table(spark, sf_dir, "pages"))
    return warc.records(warc.read_chunks(warc.write_archives(planned), with_payload=False))


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1
)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

def op4_assignment_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_found(table(spark, sf_dir, "documents"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4 what SQL can express, in a pass of its own: base spans by number and place. A test holds op4's columns against it."""
    return secrets.base(table(spark, sf_dir, "documents"))


_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_FOUND = "SELECT rid, {k} AS kind, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS g, regexp_split_to_array(text, '{p}') AS pieces FROM d"
_LENGTHS = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
SECRET_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
k AS ({_FOUND.format(k=0, p=_ASSIGN, g=1)} UNION ALL {_FOUND.format(k=1, p="AKIA[A-Z0-9]+", g=0)} UNION ALL {_FOUND.format(k=2, p="[0-9a-f]{24,}", g=0)}),
s AS (SELECT rid, kind, m[i] AS w, g[i] AS g, CAST({_LENGTHS.format("pieces[1:i]")} + {_LENGTHS.format("m[1:i - 1]")} AS BIGINT) AS a FROM k, unnest(range(1, len(m) + 1)) AS u(i)),
f AS (SELECT * FROM s WHERE kind = 2 OR kind = 0 AND length(g) >= 6 OR kind = 1 AND length(w) >= 20),
n AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(list_extract(['assign', 'access', 'hex'], kind + 1) || ':' || a || ':' || (a + length(w)), ',' ORDER BY a, kind) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN n USING (rid)
"""


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + 9], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM i),
g AS (SELECT doc_id, s, k.k, array_to_string(w[s:s + k.k - 1], ' ') AS win FROM d, k, unnest(range(1, len(w) - k.k + 2)) AS u(s)),
m AS (SELECT doc_id, s, i.k, item_id FROM g JOIN i ON g.win = i.win AND g.k = i.k),
h AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM m, unnest(range(0, m.k)) AS u(o) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


#: The made pages hold one article element each, of headings and paragraphs with <b> and <br>. Wrappers are of hosts with different pages.
OP7_SQL = r"""
WITH a AS (SELECT *, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) AS host, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS inner_html FROM pages),
b AS (SELECT page_id, url, host, html, list_transform(regexp_split_to_array(replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<br>', ' '), '</?(?:p|h1)>'),
  lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT *, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b),
h AS (SELECT host, count(DISTINCT html) AS n FROM t GROUP BY host)
SELECT page_id, url, text, length(text) AS n_chars, CASE WHEN n > 1 THEN 'wrapper' ELSE 'marks' END AS decided_by FROM t JOIN h USING (host)
"""


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.train(docs))


def unigram_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8 what SQL can express: folds, counts and the base score, to four places."""
    return op8_kneser_ney(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: CRC-32 of doc_id as text, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
UNIGRAM_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({_CRC} % 7 = 2, false) AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), chr(10)) AS w FROM documents),
t AS (SELECT rid, held_out, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, d.held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c) AS BIGINT) AS n_known, n.n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n.n + 1.0::DOUBLE * (n.v + 1)))), 4) AS base_score
FROM t JOIN d USING (rid) LEFT JOIN c ON t.x = c.x, n GROUP BY d.rid, doc_id, d.held_out, n.n
"""


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(table(spark, sf_dir, "documents"), with_kept=False)
    n_removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


OP10_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, substr(h, CAST(2 * i + 1 AS BIGINT), 400) AS s FROM d, unnest(range(0, n - 199)) AS u(i) WHERE n >= 200),
k AS (SELECT rid, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS begins FROM k),
r AS (SELECT rid, i, sum(begins) OVER (PARTITION BY rid ORDER BY i) AS run FROM g),
sp AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY rid, run),
q AS (SELECT rid, run, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY run), 0) AS before FROM sp),
p AS (SELECT q.rid, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY run) AS kept FROM q JOIN d ON q.rid = d.rid GROUP BY q.rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN p ON d.rid = p.rid
"""



def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignments(table(spark, sf_dir, "documents"), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf(n_chars=F.col("n_chars") + 1)).otherwise(merkle.leaf())
    found = merkle.proofs(merkle.build(docs, leaves={"tampered": tampered}), extra="tampered string")
    back = merkle.folded(F.col("tampered"), F.col("siblings"), F.col("right"))
    columns = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"), back.alias("folded_root"))
    return columns.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_UP = "(SELECT tree, CAST(l + 1 AS INTEGER), pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2) FROM {t} WHERE n > 1 GROUP BY tree, l, pos // 2)"


def _siblings(t: str, of: str) -> str:
    """Siblings of nodes of the lowest level of t, by level, with the side that they stand on."""
    return f"""SELECT o.k, list(CASE WHEN s.node IS NULL THEN 'N' WHEN (o.pos >> v.l) % 2 = 1 THEN 'L' || s.node ELSE 'R' || s.node END ORDER BY v.l) AS sib FROM {of} AS o
  JOIN (SELECT DISTINCT tree, l FROM {t} WHERE n > 1) AS v ON v.tree = o.tree LEFT JOIN {t} AS s ON s.tree = v.tree AND s.l = v.l AND s.pos = xor(o.pos >> v.l, 1::BIGINT) GROUP BY o.k"""


OP12_SQL = f"""
WITH RECURSIVE a AS (SELECT row_number() OVER () AS k, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS tampered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM a),
t AS (SELECT tree, 0 AS l, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM o UNION ALL {_UP.format(t="t")}),
s AS (SELECT tree AS k, 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, node AS subroot FROM t WHERE n = 1),
u AS (SELECT tree, 0 AS l, pos, subroot AS node, count(*) OVER () AS n FROM s UNION ALL {_UP.format(t="u")}),
x AS ({_siblings("t", "o")}), y AS ({_siblings("u", "s")}),
p AS (SELECT doc_id, leaf, tampered, subroot, (SELECT node FROM u WHERE n = 1) AS root, list_concat(coalesce(x.sib, []), coalesce(y.sib, [])) AS sib FROM o JOIN s ON s.k = o.tree LEFT JOIN x ON x.k = o.k LEFT JOIN y ON y.k = o.tree),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sib, lambda b: b[2:]), '')) AS proof_sha256,
  list_reduce(list_concat([tampered], sib), lambda c, b: CASE b[1] WHEN 'L' THEN sha256(b[2:] || c) WHEN 'R' THEN sha256(c || b[2:]) ELSE sha256(c) END) AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM f
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP13_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

QUERIES = {
    "op1_fertility": op1_fertility,
    "op2_tool_linking": op2_tool_linking,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_assignment_lexing": op4_assignment_lexing,
    "op5_wu_manber": op5_wu_manber,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_wrapper_induction": op7_wrapper_induction,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_bit_sliced": op9_bit_sliced,
    "op10_suffix_sort": op10_suffix_sort,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
    "quality_base_counts": quality_base_counts,
    "secret_base_counts": secret_base_counts,
    "unigram_base_scores": unigram_base_scores,
}

ORACLES = {
    "op2_tool_linking": OP2_SQL,
    "op3_warc_chunks": OP3_SQL,
    "op5_wu_manber": OP5_SQL,
    "op7_wrapper_induction": OP7_SQL,
    "op10_suffix_sort": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
    "quality_base_counts": QUALITY_SQL,
    "secret_base_counts": SECRET_SQL,
    "unigram_base_scores": UNIGRAM_SQL,
}
