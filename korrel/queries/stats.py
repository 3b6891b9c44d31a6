"""Queries of scores, statistics and ordered groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import chat
from korrel.operators import scoring, stats, windows
from korrel.queries import sql as s
from korrel.sources import bindings as b

_T = f"WITH trials AS ({b.TRIALS_SQL})"


def agg_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up of trials by condition."""
    t = b.trials(spark, d)
    return stats.by_condition(t, t.select("condition").distinct())


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """Upper medians of latency."""
    return stats.upper_medians(b.trials(spark, d))


def mean_latency(spark: SparkSession, d: str) -> DataFrame:
    """Mean latency, half up."""
    return stats.mean_context(b.trials(spark, d))


def wilson_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy with its interval by run and condition."""
    return stats.accuracy_intervals(b.trials(spark, d), "run_id", "condition")


def paired_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """The first condition against every other one on equal runs and questions."""
    t = b.trials(spark, d)
    names = t.select("condition").distinct()
    first = names.agg(F.min("condition").alias("a"))
    contrasts = first.join(names.withColumnRenamed("condition", "b"), F.col("a") != F.col("b"))  # one row against the names
    return stats.paired(t, ["run_id", "question_id"], contrasts)


def _rated(spark: SparkSession, d: str) -> DataFrame:
    """Trials with the scores of two blind raters."""
    t, k = b.trials(spark, d), F.col("context_chars")
    scores = lambda r: F.when(k % r == 0, "korrekt").when(k % r == 1, "falsch")
    return t.select("ord", F.concat(F.lit("t"), F.col("ord").cast("string")).alias("id"), "run_id", "condition", F.col("score").alias("auto_score"), F.lit(None).cast("string").alias("manual_score"), scores(3).alias("blind_a"), scores(4).alias("blind_b"), F.when(k % 2 == 0, "x").otherwise("y").alias("engine"))


def rating_states(spark: SparkSession, d: str) -> DataFrame:
    """Unrated, agreed and disputed trials, with the consensus applied."""
    t = stats.effective(stats.consensus(stats.rating_state(_rated(spark, d))))
    return t.select("id", "unrated_a", "unrated_b", "conflict", "agreed", "score")


def rating_updates(spark: SparkSession, d: str) -> DataFrame:
    """Trials after later ratings, given by odd events, were set."""
    t = _rated(spark, d)
    later = t.filter("ord % 2 = 1").select("id", F.when(F.col("ord") % 3 == 0, "a").otherwise("b").alias("slot"), F.lit("teilweise").alias("score"), "ord")
    return stats.rated(t, later).select("id", "blind_a", "blind_b")


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """Trials of the newest run and one engine."""
    return stats.of_run(_rated(spark, d), "latest", "x").select("id", "run_id", "condition")


def cohens_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the two labels as raters."""
    labels = b.table(spark, d, "labels")
    return stats.cohens_kappa(labels.select(F.when(F.col("quality") == 1, "korrekt").otherwise("falsch").alias("a"), F.when(F.col("toxic") == 0, "korrekt").otherwise("falsch").alias("b")))


def accuracy_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Condition by weekday-like category."""
    t = b.trials(spark, d).withColumn("category", F.concat(F.lit("k"), (F.col("context_chars") % 3).cast("string")))
    return stats.accuracy_pivot(t, ["k0", "k1", "k2"])


def running_score(spark: SparkSession, d: str) -> DataFrame:
    """Score and streak of every user."""
    t = b.trials(spark, d).select(F.col("question_id").alias("player"), "ord", "correct")
    return stats.running_score(t, "player", "ord").select("player", "ord", "so_far", "streak")


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    """First event of every user."""
    return windows.keep_first(b.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Last event of every user."""
    return windows.latest(b.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """The last six messages of every conversation."""
    return windows.history(b.messages(spark, d))


def last_user(spark: SparkSession, d: str) -> DataFrame:
    """The user's previous text at every turn."""
    return windows.last_question(b.messages(spark, d)).select("conv_id", "turn", F.sha2(F.coalesce("previous", F.lit("")), 256).alias("previous_sha256"))


def followup_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Follow-up flags and rewritten questions of user turns."""
    m = windows.last_question(b.messages(spark, d)).filter("role = 'user'")
    text = F.coalesce("text", F.lit(""))
    return m.select("conv_id", "turn", chat.is_follow_up(text).alias("follow_up"), chat.wants_fallback(text).alias("fallback"), F.sha2(chat.contextualized(text, F.col("previous")), 256).alias("rewritten_sha256"))


def route_query(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval condition of every benchmark item."""
    q = b.questions(spark, d)
    return q.select(F.col("id").alias("item_id"), chat.route(F.lit(None).cast("string"), F.lit(0), F.col("text")).alias("condition"))


def _rooms(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    return e.select((F.col("user_id") % 10).alias("room"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("revision"), F.col("event_type").alias("phase"), F.col("user_id").alias("player"))


def revision_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events with a new highest revision in their room."""
    return windows.newer_only(_rooms(spark, d), "room", "revision", "event_id").select("room", "event_id", "revision")


def phase_change(spark: SparkSession, d: str) -> DataFrame:
    """Events that change their room's phase."""
    return windows.phase_changes(_rooms(spark, d), "room", "phase", "event_id").select("room", "event_id", "phase")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Event types by first appearance."""
    return windows.first_seen(b.table(spark, d, "events"), "event_type", "event_id")


def auto_score(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns scored by phrases of the benchmark language."""
    m = b.messages(spark, d).filter("role = 'assistant'")
    must, some = F.array(F.lit("der"), F.lit("the")), F.array(F.lit("and"), F.lit("und"))
    return m.select("conv_id", "turn", scoring.auto_score(F.col("text"), must, some, F.col("turn") % 7 == 6).alias("score"), scoring.is_abstention(F.col("text")).alias("abstains"))


_ABST = " OR ".join(f"contains(a, '{p}')" for p in scoring.ABSTENTIONS)
_ROOMS = "SELECT user_id % 10 AS room, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS revision, event_type AS phase FROM events"
_WS = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_FOLLOW = "(" + " OR ".join(f"regexp_matches(q, '{p}')" for p in (
    r"(?i)^(?:und|aber|warum|wieso|wie genau|wann|wo|welche davon|wer davon|was bedeutet das|was geschah dann)\b",
    r"(?i)\b(?:dessen|deren|dieses werk|dieser philosoph|diese person|der genannte|die genannte|dort|davon|dabei|damit|ihm|ihn)\b",
    r"(?i)^(?:was|wer|warum|wieso|wie|wann|wo|welche)\b[^?!.]*\b(?:er|sie)\b",
)) + ")"
_PAIR = """SELECT a, b, count(*) AS pairs, round(avg(CAST(oka AS INT)), 6) AS accuracy_a, round(avg(CAST(okb AS INT)), 6) AS accuracy_b, round((count(*) FILTER (oka) - count(*) FILTER (okb)) / count(*), 6) AS delta,
 count(*) FILTER (oka AND NOT okb) AS a_only, count(*) FILTER (okb AND NOT oka) AS b_only FROM (
  SELECT l.condition AS a, r.condition AS b, l.score = 'korrekt' AS oka, r.score = 'korrekt' AS okb
  FROM trials l JOIN (SELECT run_id, question_id, condition, arg_max(score, ord) AS score FROM trials GROUP BY ALL) r USING (run_id, question_id)
  WHERE l.condition = (SELECT min(condition) FROM trials) AND r.condition <> l.condition) GROUP BY a, b"""

_RATED = f"SELECT 't' || ord AS id, ord, run_id, condition, score AS auto, k % 2 = 0 AS x, CASE k % 3 WHEN 0 THEN 'korrekt' WHEN 1 THEN 'falsch' END AS a, CASE k % 4 WHEN 0 THEN 'korrekt' WHEN 1 THEN 'falsch' END AS b FROM (SELECT *, context_chars AS k FROM ({b.TRIALS_SQL}))"

QUERIES = {
    "rating_states": (rating_states, f"SELECT id, a IS NULL AS unrated_a, b IS NULL AS unrated_b, coalesce(a <> b, false) AS conflict, coalesce(a = b, false) AS agreed, CASE WHEN a = b THEN a ELSE auto END AS score FROM ({_RATED})"),
    "rating_updates": (rating_updates, f"SELECT id, CASE WHEN ord % 2 = 1 AND ord % 3 = 0 THEN 'teilweise' ELSE a END AS blind_a, CASE WHEN ord % 2 = 1 AND ord % 3 <> 0 THEN 'teilweise' ELSE b END AS blind_b FROM ({_RATED})"),
    "latest_run": (latest_run, f"SELECT id, run_id, condition FROM ({_RATED}) WHERE x AND run_id = (SELECT arg_max(run_id, ord) FROM ({_RATED}))"),
    "agg_by_condition": (agg_by_condition, f"{_T} SELECT condition, count(*) AS n, count(*) FILTER (score = 'korrekt') AS korrekt, count(*) FILTER (score = 'teilweise') AS teilweise, count(*) FILTER (score = 'falsch') AS falsch, count(*) FILTER (score = 'enthaltung') AS enthaltung, count(*) FILTER (scope = 'end-to-end') AS latency_n, coalesce(quantile_disc(latency_ms, 0.5) FILTER (scope = 'end-to-end'), 0) AS p50, coalesce(quantile_disc(latency_ms, 0.95) FILTER (scope = 'end-to-end'), 0) AS p95, CAST(floor(avg(context_chars) + 0.5) AS BIGINT) AS mean_context, round(avg(recall), 6) AS mean_recall, round(avg(CASE WHEN score = 'korrekt' THEN 1.0::DOUBLE ELSE 0 END) FILTER (recall >= 1), 6) AS accuracy_given_evidence, round(count(*) FILTER (score = 'korrekt') / count(*), 6) AS accuracy FROM trials GROUP BY condition"),
    "upper_median": (upper_median, f"{_T} SELECT condition, list_sort(list(latency_ms))[CAST(floor(count(latency_ms) / 2) AS BIGINT) + 1] AS median FROM trials GROUP BY condition"),
    "mean_latency": (mean_latency, f"{_T} SELECT condition, floor(round(avg(latency_ms), 9) * 100 + 0.5) / 100 AS mean_ms FROM trials GROUP BY condition"),
    "wilson_by_run": (wilson_by_run, f"{_T}, c AS (SELECT run_id, condition, count(*) AS n, count(*) FILTER (score = 'korrekt') AS correct FROM trials GROUP BY ALL), p AS (SELECT *, correct / n AS p FROM c) SELECT run_id, condition, n, correct, round(p, 6) AS accuracy, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM p"),
    "paired_mcnemar": (paired_mcnemar, f"{_T}, c AS ({_PAIR}) SELECT *, CASE WHEN a_only + b_only > 0 THEN round(least(1, 2 * list_sum([exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) + (a_only + b_only) * ln(0.5)) FOR i IN range(least(a_only, b_only) + 1)])), 6) END AS p FROM c"),
    "cohens_kappa": (cohens_kappa, "WITH r AS (SELECT CASE WHEN quality = 1 THEN 1 ELSE 0 END AS a, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS b FROM labels), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agree, (count(*) FILTER (a = 1) * count(*) FILTER (b = 1) + count(*) FILTER (a = 0) * count(*) FILTER (b = 0)) / (count(*)::DOUBLE * count(*)) AS pe FROM r) SELECT round(CASE WHEN pe >= 1 THEN 1 ELSE (agree / n - pe) / (1 - pe) END, 6) AS kappa, n, agree FROM t"),
    "accuracy_pivot": (accuracy_pivot, f"{_T} SELECT condition, " + ", ".join(f"round(coalesce(avg(CASE WHEN score = 'korrekt' THEN 1.0::DOUBLE ELSE 0 END) FILTER (context_chars % 3 = {i}), 0), 6) AS k{i}" for i in range(3)) + " FROM trials GROUP BY condition"),
    "running_score": (running_score, f"{_T}, m AS (SELECT question_id AS player, ord, CAST(correct AS INT) AS h, sum(1 - CAST(correct AS INT)) OVER (PARTITION BY question_id ORDER BY ord) AS miss, sum(CAST(correct AS INT)) OVER (PARTITION BY question_id ORDER BY ord) AS so_far FROM trials) SELECT player, ord, CAST(so_far AS BIGINT) AS so_far, CAST(sum(h) OVER (PARTITION BY player, miss ORDER BY ord) AS BIGINT) AS streak FROM m"),
    "keep_first": (keep_first, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"),
    "latest_per_key": (latest_per_key, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "chat_history": (chat_history, f"WITH m AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS text FROM conversations), k AS (SELECT * FROM m WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) SELECT conv_id, string_agg(role || ': ' || left(text, 700), chr(10) ORDER BY turn) AS history FROM k GROUP BY conv_id"),
    "last_user": (last_user, "SELECT conv_id, turn, sha256(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS previous_sha256 FROM conversations"),
    "followup_rewrite": (followup_rewrite, f"WITH m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations), c AS (SELECT *, regexp_replace(coalesce(text, ''), '^{_WS}|{_WS}$', '', 'g') AS q FROM m WHERE role = 'user'), k AS (SELECT *, {_FOLLOW} AS f, regexp_matches(q, '(?i)falls{_WS}du{_WS}(?:es{_WS})?nicht{_WS}wei(?:ß|sst|ßt)[^.!?]*(?:wissensbaum|wissensgraph(?:en)?)[^.!?]*[.!?]?$') AS b FROM c) SELECT conv_id, turn, f AS follow_up, b AS fallback, sha256(CASE WHEN f AND previous <> '' THEN previous || chr(10) || 'Anschlussfrage: ' || q ELSE q END) AS rewritten_sha256 FROM k"),
    "route_query": (route_query, "SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\\b(verbind|zusammenh|bezieh|zwischen|weg von|reihenfolge|über wen|beeinfluss|kritisiert|lehrer|schüler|nachfolger|heirat|studiert|gemeinsam)') THEN 'graph' ELSE 'vector' END AS condition FROM benchmark"),
    "revision_filter": (revision_filter, f"WITH r AS ({_ROOMS}), h AS (SELECT *, max(revision) OVER (PARTITION BY room ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM r) SELECT room, event_id, revision FROM h WHERE highest IS NULL OR revision > highest"),
    "phase_change": (phase_change, f"WITH r AS ({_ROOMS}), h AS (SELECT *, lag(phase) OVER (PARTITION BY room ORDER BY event_id) AS was FROM r) SELECT room, event_id, phase FROM h WHERE was IS DISTINCT FROM phase"),
    "first_seen": (first_seen, "SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type"),
    "auto_score": (auto_score, f"WITH m AS (SELECT conv_id, turn, {s.normalize('text')} AS a FROM conversations WHERE role = 'assistant'), x AS (SELECT *, ({_ABST}) AS abstains, CAST(contains(a, 'der') AS INT) + CAST(contains(a, 'the') AS INT) AS hits, contains(a, 'and') OR contains(a, 'und') AS ok FROM m) SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN CASE WHEN abstains THEN 'korrekt' ELSE 'falsch' END WHEN abstains THEN 'enthaltung' WHEN hits = 2 AND ok THEN 'korrekt' WHEN hits > 0 THEN 'teilweise' ELSE 'falsch' END AS score, abstains FROM x"),
}
