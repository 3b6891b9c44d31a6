"""Queries of answers, commands, prompts and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import chat, validate
from korrel.functions import text as t
from korrel.queries import sql as s
from korrel.sources import bindings as b


def _cut(spark: SparkSession, d: str) -> DataFrame:
    """Every message, and its first three quarters as an answer that was cut off."""
    m = b.messages(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    head = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") * 0.75).cast("int"))
    return m.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit("whole").alias("part"), F.col("text").alias("text")), F.struct(F.lit("head").alias("part"), head.alias("text")))).alias("x")).select("conv_id", "turn", "x.part", "x.text")


def complete_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers up to their last whole sentence."""
    text, trimmed = chat.completed(F.col("text"))
    return _cut(spark, d).select("conv_id", "turn", "part", trimmed.alias("trimmed"), F.sha2(text, 256).alias("text_sha256"))


#: Requests that are made of customer names, by key: six forms, a question, and views.
_SAID = (
    ("'/wissen ' || n", lambda n: F.concat(F.lit("/wissen "), n)), ("'Bitte füge in deinen Wissensgraphen „' || n || '“ hinzu.'", lambda n: F.concat(F.lit("Bitte füge in deinen Wissensgraphen „"), n, F.lit("“ hinzu."))),
    ("'Füge bitte  ' || n || ' zu  meinen Wissensbaum hinzu!'", lambda n: F.concat(F.lit("Füge bitte  "), n, F.lit(" zu  meinen Wissensbaum hinzu!"))), ("'NIMM ' || n || '! in den wissensgraph auf'", lambda n: F.concat(F.lit("NIMM "), n, F.lit("! in den wissensgraph auf"))),
    ("'ergänze meinen Wissensgraph um ’' || n || '’?'", lambda n: F.concat(F.lit("ergänze meinen Wissensgraph um ’"), n, F.lit("’?"))), ("'Speichere »' || n || '« im Wissensbaum'", lambda n: F.concat(F.lit("Speichere »"), n, F.lit("« im Wissensbaum"))),
    ("'Was ist ' || n || '?'", lambda n: F.concat(F.lit("Was ist "), n, F.lit("?"))), ("'Öffne mir den Wissensraum!'", lambda n: F.lit("Öffne mir den Wissensraum!")), ("'Vergleiche Vektor-RAG mit Graph-RAG.'", lambda n: F.lit("Vergleiche Vektor-RAG mit Graph-RAG.")),
)


def _said(spark: SparkSession, d: str) -> DataFrame:
    c, n = b.table(spark, d, "customer"), F.col("c_name").cast("string")
    text = F.lit("")
    for k, (_, make) in enumerate(_SAID):
        text = F.when(F.col("c_custkey") % len(_SAID) == k, make(n)).otherwise(text)
    return c.select("c_custkey", text.alias("said"))


def knowledge_commands(spark: SparkSession, d: str) -> DataFrame:
    """What requests ask for: a topic to add or a view to open."""
    a = _said(spark, d).withColumn("a", chat.action(F.col("said")))
    return a.select("c_custkey", F.col("a.kind").alias("kind"), F.col("a.topic").alias("topic"), F.col("a.view").alias("view"))


def comparable_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages for comparison."""
    return b.table(spark, d, "pages").select("page_id", chat.comparable(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as contexts of prompts, with a history before and a question after."""
    doc = b.table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    told = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(chat.HISTORY), F.lit("\n"), F.substring(text, 1, 3000), F.lit("\n\n"))).otherwise(F.lit(""))
    asked = F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit(chat.ASKED), F.lit(" Was steht in "), F.col("doc_id").cast("string"), F.lit("?"))).otherwise(F.lit(""))
    return doc.select("doc_id", F.concat(told, F.lit(chat.CONTEXT), text, asked).alias("user"))


def shortened_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts cut to a local model's budget."""
    cut = chat.shortened(F.lit("x" * 500), F.col("user"))
    return _prompts(spark, d).select("doc_id", F.length(cut).cast("long").alias("n_chars"), F.sha2(cut, 256).alias("prompt_sha256"))


def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    """Question, context and history of prompts."""
    p = _prompts(spark, d).withColumn("p", chat.prompt_parts(F.col("user")))
    return p.select("doc_id", F.col("p.question").alias("question"), F.sha2("p.context", 256).alias("context_sha256"), F.sha2("p.history", 256).alias("history_sha256"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Events as published states, some of them broken in one field."""
    e = b.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    sign = lambda c: F.concat(F.lit("p"), c.cast("string"))
    players = F.transform(F.sequence(F.lit(1).cast("long"), k % 22 + 1), lambda i: F.struct(sign(F.when(k % 13 == 0, F.lit(1).cast("long")).otherwise(i)).alias("id"), F.lit("Ada").alias("name"), F.lit("#0aF3c9").alias("color"), (i * 100).alias("score"), i.alias("streak"), F.lit(True).alias("answered")))
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.lit("Titel").alias("title")) for i in ("a", "b")])
    asked = F.struct(F.lit("q1").alias("id"), F.lit("Wer?").alias("prompt"), options.alias("options"))
    shown = F.struct(F.when(k % 7 == 0, "c").otherwise("a").alias("correctId"), F.lit("weil").alias("explanation"), F.lit("x").alias("classification"), F.array(F.lit("n1"), F.when(k % 9 == 0, "n1").otherwise("n2")).alias("graphNodeIds"))
    phase = F.when(k % 4 == 0, "lobby").when(k % 4 == 1, "question").when(k % 4 == 2, "reveal").otherwise("finished")
    made = F.struct(
        F.lit(1).alias("version"), F.when(k % 17 == 0, "abc").otherwise("AB12CD").alias("roomCode"), F.col("event_id").alias("revision"), F.lit("host").alias("hostId"), phase.alias("phase"), (k % 12).alias("questionIndex"), F.lit(10).alias("totalQuestions"),
        F.when(phase.isin("question", "reveal"), asked).alias("question"), F.when(phase == "question", F.lit(1000.0)).alias("deadlineMs"), players.alias("players"), (k % 5).alias("answerCount"),
        F.when((phase == "reveal") | (k % 11 == 0), shown).alias("reveal"), F.lit(5.0).alias("updatedAt"),
    )
    return e.select("event_id", made.alias("s"))


def validate_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether each state may be published."""
    return _states(spark, d).select("event_id", validate.state(F.col("s"), F.lit(" ab12cd ")).alias("valid"))


def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of messages as requests, answers, suggestions and decisions, and whether their room is open."""
    m = b.messages(spark, d).withColumn("who", F.concat(F.lit("user-"), F.lpad(F.col("conv_id").cast("string"), 6, "0")))
    text = F.coalesce("text", F.lit(""))
    asked = F.struct(F.col("who").alias("participantId"), text.alias("question"), F.lit("").alias("context"), F.lit(None).cast("string").alias("history"))
    idea = F.struct(F.col("who").alias("id"), F.col("who").alias("playerId"), F.col("role").alias("playerName"), text.alias("topic"))
    said = F.struct(F.col("who").alias("id"), F.lit("Thema").alias("topic"), F.when(F.col("turn") % 3 != 0, F.lit(True)).alias("accepted"), text.alias("message"))
    reply = F.struct(F.col("who").alias("playerId"), F.lit("q 1").alias("questionId"), F.lit("a").alias("optionId"), F.col("turn").cast("double").alias("at"))
    open_ = validate.room_active(F.lit("AB12CD"), F.when(F.col("turn") % 2 == 0, "AB12CD").otherwise("XXXXXX"), F.when(F.col("turn") % 5 != 0, F.lit(100)), F.col("turn") * 30)
    return m.select("conv_id", "turn", validate.request(asked).alias("request_ok"), validate.suggestion_payload(idea).alias("suggestion_ok"), validate.decision_payload(said).alias("decision_ok"), validate.answer_payload(reply).alias("answer_ok"), open_.alias("open"))


def page_identity(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and keys of pages."""
    p = b.table(spark, d, "pages").withColumn("title", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    some = F.when(F.col("page_id") % 2 == 0, F.col("page_id"))
    return p.select("page_id", t.page_key(some, F.col("title")).alias("key"), t.file_size(F.length("html") * (F.col("page_id") % 5) * 97).alias("size"), t.language_tag(F.concat(F.lit(" DE_at_"), F.col("page_id").cast("string"))).alias("tag"))


_CHARS = s.WS_CLASS
_COMPACT = lambda x: f"trim(regexp_replace({x}, '{_CHARS}+', ' ', 'g'))"
_TRIM = lambda x: f"regexp_replace({x}, '^{_CHARS}+|{_CHARS}+$', '', 'g')"
_QUOTED = chat.QUOTES.replace("'", "''")
_TOPIC = lambda x: f"trim(regexp_replace(regexp_replace({_COMPACT(x)}, '^[{_QUOTED}]+|[{_QUOTED}]+$', '', 'g'), '[.!?]+$', ''))"
_END, _CUTS = (p.replace("'", "''") for p in (chat.SENTENCE_END, chat.SENTENCE_CUT))
_literal = lambda p: f"'(?i){p}'"
_TOLD = f"CASE WHEN m > 0 THEN replace(left(before, m - 1), '{chat.HISTORY}', '') ELSE chr(32) END"
_FORM = "CASE " + " ".join(f"WHEN regexp_matches(said, '(?i){p}') THEN {_TOPIC('regexp_extract(said, ' + _literal(p) + ', 1)')}" for p in chat.ADD) + " END"
_USER = f"""u AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{chat.HISTORY}' || chr(10) || left(coalesce(text, ''), 3000) || chr(10) || chr(10) ELSE '' END || 'KONTEXT:' || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 4 <> 1 THEN chr(10) || chr(10) || 'FRAGE: Was steht in ' || doc_id || '?' ELSE '' END AS u FROM documents),
cut AS (SELECT *, CASE WHEN contains(u, chr(10) || chr(10) || 'FRAGE:') THEN length(u) - length(string_split(u, chr(10) || chr(10) || 'FRAGE:')[-1]) - 8 ELSE -1 END AS spot FROM u)"""
_PAGES = "SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages"

QUERIES = {
    "complete_answer": (complete_answer, f"WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations), p AS (SELECT conv_id, turn, 'whole' AS part, x FROM m UNION ALL SELECT conv_id, turn, 'head', left(x, CAST(floor(length(x) * 0.75) AS BIGINT)) FROM m), c AS (SELECT * EXCLUDE x, {_COMPACT('x')} AS x FROM p), k AS (SELECT *, x = '' OR regexp_matches(x, '{_END}') AS done, trim(regexp_extract(x, '{_CUTS}', 1)) AS head FROM c) SELECT conv_id, turn, part, NOT done AS trimmed, sha256(CASE WHEN done THEN x WHEN length(head) >= 24 THEN head ELSE '{chat.UNFINISHED}' END) AS text_sha256 FROM k"),
    "knowledge_commands": (knowledge_commands, f"WITH c AS (SELECT c_custkey, {_COMPACT('CASE ' + ' '.join(f'WHEN c_custkey % {len(_SAID)} = {k} THEN {x}' for k, (x, _) in enumerate(_SAID)) + ' END')} AS said FROM (SELECT c_custkey, c_name AS n FROM customer)), f AS (SELECT *, {_FORM} AS topic, regexp_replace(said, '[.!?]+$', '') AS plain FROM c), v AS (SELECT *, CASE WHEN regexp_matches(plain, '(?i){chat.EXPLORER}') THEN 'explorer' WHEN regexp_matches(plain, '(?i){chat.ARENA[0]}') OR regexp_matches(plain, '(?i){chat.ARENA[1]}') THEN 'arena' END AS view FROM f) SELECT c_custkey, CASE WHEN length(topic) BETWEEN 2 AND 160 THEN 'add-wikipedia' WHEN view IS NOT NULL THEN 'open-view' END AS kind, CASE WHEN length(topic) BETWEEN 2 AND 160 THEN topic END AS topic, CASE WHEN topic IS NULL THEN view END AS view FROM v"),
    "comparable_titles": (comparable_titles, f"SELECT page_id, trim(regexp_replace(strip_accents(lower({_TOPIC('title')})), '[^a-z0-9ß]+', ' ', 'g')) AS title FROM ({_PAGES})"),
    "shortened_prompts": (shortened_prompts, f"WITH {_USER}, z AS (SELECT doc_id, u, CASE WHEN spot >= 0 THEN substr(u, spot + 1) ELSE right(u, 800) END AS tail FROM cut), k AS (SELECT doc_id, CASE WHEN length(u) <= 10000 THEN u ELSE left(u, greatest(1000, 10000 - length(tail) - {len(chat.NOTICE)})) || chr(10) || chr(10) || '{chat.NOTICE.strip()}' || tail END AS x FROM z) SELECT doc_id, length(x) AS n_chars, sha256(x) AS prompt_sha256 FROM k"),
    "prompt_parts": (prompt_parts, f"WITH {_USER}, z AS (SELECT doc_id, {_TRIM('CASE WHEN spot >= 0 THEN substr(u, spot + 9) ELSE u END')} AS q, CASE WHEN spot >= 0 THEN left(u, spot) ELSE '' END AS before FROM cut), k AS (SELECT *, instr(before, 'KONTEXT:' || chr(10)) AS m FROM z) SELECT doc_id, left(q, 1200) AS question, sha256(left({_TRIM('CASE WHEN m > 0 THEN substr(before, m + 9) ELSE chr(32) END')}, 5000)) AS context_sha256, sha256(right({_TRIM(_TOLD)}, 1800)) AS history_sha256 FROM k"),
    "validate_states": (validate_states, "SELECT event_id, k % 17 <> 0 AND event_id >= 1 AND k % 12 < 10 AND k % 22 + 1 <= 20 AND (k % 13 <> 0 OR k % 22 = 0) AND k % 5 <= k % 22 + 1 AND CASE k % 4 WHEN 0 THEN k % 11 <> 0 WHEN 1 THEN k % 11 <> 0 WHEN 2 THEN k % 7 <> 0 AND k % 9 <> 0 ELSE k % 11 <> 0 OR k % 9 <> 0 END AS valid FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"),
    "validate_requests": (validate_requests, "WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations) SELECT conv_id, turn, length(trim(x)) BETWEEN 1 AND 1200 AS request_ok, length(trim(role)) BETWEEN 1 AND 24 AND length(trim(x)) BETWEEN 1 AND 80 AS suggestion_ok, turn % 3 <> 0 AND length(trim(x)) BETWEEN 1 AND 500 AS decision_ok, false AS answer_ok, turn % 2 = 0 AND turn % 5 <> 0 AND turn * 30 <= 100 AS open FROM m"),
    "page_identity": (page_identity, f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'id:' || page_id ELSE 'title:' || {_COMPACT(s.normalize('trim(title)'))} END AS key, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN replace(printf('%.1f', n / 1024.0::DOUBLE), '.', ',') || ' KB' ELSE replace(printf('%.1f', n / 1048576.0::DOUBLE), '.', ',') || ' MB' END AS size, 'de-at_' || page_id AS tag FROM (SELECT *, length(html) * (page_id % 5) * 97 AS n FROM ({_PAGES}))"),
}
