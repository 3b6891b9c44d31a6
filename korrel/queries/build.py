"""Queries of graph construction, live events, schedules and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.functions import validate
from korrel.operators import build, labels, schedule
from korrel.operators.documents import NO_TOPICS
from korrel.operators.retrieval import term_profiles
from korrel.plans.scratch import stored
from korrel.queries import sql as s
from korrel.sources import bindings as b
from korrel.sources import io
from korrel.streaming import live, timers


def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark item word for word."""
    docs = b.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return build.mention_edges(docs, b.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("title")))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of all documents, stored: classes and pairs read them more than once."""
    return stored(term_profiles(b.nodes(spark, d)).select("id", "term", "weight"), "profiles")


def profile_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every document by its topic profile."""
    return build.profile_classes(_profiles(spark, d))[1]


def topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Classes of documents with overlapping topics."""
    return build.topic_pairs(build.profile_classes(_profiles(spark, d))[0])


def topic_edges(spark: SparkSession, d: str) -> DataFrame:
    """The same with at most two edges each, accepted best first."""
    return build.capped(topic_pairs(spark, d), "overlap", build.TOPIC_DEGREE, build.TOPIC_DEGREE, True).select("a", "b", "overlap")


def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    """The word to show for every stem of every document."""
    return labels.surface_labels(b.nodes(spark, d).select("id", F.col("summary").alias("text")))


def topic_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What topic pairs share, in words and sentences."""
    profiles, docs = _profiles(spark, d), b.nodes(spark, d).select("id", "title", F.col("summary").alias("text"))
    pairs = stored(build.topic_pairs(build.profile_classes(profiles)[0]), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # Only labels of profile terms are asked for.
    shown = labels.surface_labels(docs.join(ids, "id").select("id", F.concat_ws(" ", "title", "text").alias("text")))
    shown = stored(shown.join(profiles.select("id", "term"), ["id", "term"], "left_semi"), "labels")
    shared = labels.shared_labels(pairs, profiles, shown)
    rows = pairs.withColumnRenamed("overlap", "score").join(shared, ["a", "b"])
    lines = labels.evidence_lines(rows.select("a", "b", "score", "labels"), docs.select("id", "text"), "Themenüberlappung", build.TOPIC_OVERLAP)
    return lines.select("a", "b", F.array_join("labels", ", ").alias("labels"), "evidence")


def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Classes of documents by the cosine of their topics, the smaller id as source."""
    p = build.profile_classes(_profiles(spark, d))[0]
    ids = p.select("id").distinct()
    return build.similarity_pairs(p, ids, ids, once=True).select("a", "b", "cosine", "shared")


def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    """The same with at most two edges from a source and four to a target, accepted best first."""
    return build.capped(similarity_pairs(spark, d), "cosine", build.PER_SOURCE, build.PER_TARGET, False).select("a", "b", "cosine")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document in chunks."""
    return build.chunks(b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """The links of every page."""
    return build.page_links(b.table(spark, d, "pages")).select("page_id", "pos", "href", "label")


def link_verify(spark: SparkSession, d: str) -> DataFrame:
    """Pages that link to a page by its title's first word."""
    pages = b.table(spark, d, "pages")
    titles = build.page_titles(pages).select("page_id", F.substring_index("title", " ", 1).alias("title"))
    return build.verified_links(build.page_links(pages), titles)


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of all pages."""
    return build.page_titles(b.table(spark, d, "pages"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples in document lines."""
    return build.triples(b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def trial_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Nations as questions under the regions as conditions."""
    names = lambda table, c, to: b.table(spark, d, table).select(F.col(c).alias(to))
    return schedule.schedule(names("nation", "n_name", "question"), names("region", "r_name", "condition"), 3, 20260616)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    return e.select((F.col("user_id") % 10).alias("room"), "event_id", F.col("user_id").alias("participant"), F.col("ts").cast("timestamp").alias("ts"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Which events a limiter of ten hours admits."""
    return live.rate_limited_batch(_requests(spark, d), window=36000.0, room_limit=8, own_limit=2)


def outbox_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """States that an outbox still sends."""
    e = b.table(spark, d, "events").select((F.col("user_id") % 10).alias("room"), "event_id", F.col("event_type").alias("phase"))
    return live.coalesced(e)


def _published(spark: SparkSession, d: str) -> DataFrame:
    """Events as commands and states of rooms, with times in milliseconds."""
    e = b.table(spark, d, "events")
    phase = F.when(F.col("event_type") == "purchase", "question").when(F.col("event_type") == "signup", "reveal").otherwise("lobby")
    command = F.when(F.col("event_type") == "purchase", "ask").when(F.col("event_type") == "signup", "reveal").when(F.col("event_type") == "view", "join").when(F.col("event_type") == "click", "answer").otherwise("leave")
    return e.select((F.col("user_id") % 10).alias("room"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), phase.alias("phase"), command.alias("command"), F.col("user_id").alias("player"))


def publish_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Revisions and strictly increasing times of every room's states, on a clock of ten-minute steps."""
    step = 600_000
    e = _published(spark, d).withColumn("at", F.floor(F.col("at") / step) * step)
    return live.published(e).select("room", "event_id", "revision", "updated_at")


def auto_reveal(spark: SparkSession, d: str) -> DataFrame:
    """Questions that end by themselves, with deadlines of an hour."""
    return live.auto_reveals(_published(spark, d), 3600.0)


def topic_inbox(spark: SparkSession, d: str) -> DataFrame:
    """The twenty suggestions that every room's inbox holds at last; a user's type is one suggestion."""
    e = b.table(spark, d, "events")
    ideas = e.select((F.col("user_id") % 10).alias("room"), F.concat_ws("-", "user_id", "event_type").alias("id"), live.cleaned_topic(F.concat(F.lit("  Thema  "), "event_type")).alias("topic"), "event_id")
    return timers.inbox(ideas)


def throttle(spark: SparkSession, d: str) -> DataFrame:
    """Events that a flush of five hours lets through."""
    return live.throttled(_published(spark, d), 5 * 3_600_000)


def quiz_game(spark: SparkSession, d: str) -> DataFrame:
    """Every room's quiz of a thousand questions."""
    return live.game(_published(spark, d), 1000)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select((F.col("user_id") % 10).alias("room"), F.col("user_id").alias("player"), F.date_format("ts", "yyyy-MM-dd").alias("question"), "event_id", (k % 2 == 0).alias("correct"), (k % 20).cast("double").alias("elapsed"))


def quiz_score(spark: SparkSession, d: str) -> DataFrame:
    """First answers of every player and day, scored."""
    return live.scored_answers(_answers(spark, d))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Players of every room by score, streak and name."""
    names = b.table(spark, d, "customer").select(F.col("c_custkey").alias("player"), F.concat(F.lit("Gast "), F.substring("c_name", -6, 6)).alias("name"))
    return live.leaderboard(live.scored_answers(_answers(spark, d)), names)


def outbox_sends(spark: SparkSession, d: str) -> DataFrame:
    """What every room's outbox sends of its events, an hour apart."""
    e = b.table(spark, d, "events")
    phase = F.when(F.col("event_type") == "purchase", "question").when(F.col("event_type") == "signup", "reveal").otherwise("lobby")
    command = F.when(F.col("event_type") == "click", "sync").otherwise("state")
    rows = e.select((F.col("user_id") % 10).alias("room"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), phase.alias("phase"), F.lit(0).alias("question"), command.alias("command"))
    return timers.sent(rows, 3_600_000)


def validate_payload(spark: SparkSession, d: str) -> DataFrame:
    """Validity of customers as senders: id, name and code."""
    c = b.table(spark, d, "customer")
    code = F.upper(F.substring(F.sha2(F.col("c_name").cast("string"), 256), 1, 6))
    return c.select("c_custkey", validate.safe_id(F.col("c_name").cast("string")).alias("id_ok"), validate.bounded(F.col("c_name").cast("string"), 1, 18).alias("name_ok"), validate.room_code(code).alias("code_ok"), validate.may_send(F.when(F.col("c_custkey") % 2 == 0, "host").otherwise("player"), F.when(F.col("c_custkey") % 3 == 0, "state").otherwise("join")).alias("may_send"))


def export_csv_line(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as lines of a file."""
    m = b.messages(spark, d)
    return m.select("conv_id", "turn", F.sha2(io.csv_line([F.col("conv_id"), F.col("turn"), F.lit(None).cast("string"), F.col("role")], F.col("text")), 256).alias("line_sha256"))


def hourly_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of every user in sessions that a pause of an hour ends."""
    e = b.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 1 HOUR"), F.lit(True))
    runs = e.withColumn("new", gap.cast("int")).withColumn("session", F.sum("new").over(w))
    return runs.groupBy("user_id", "session").agg(F.count("*").alias("n"))


_PROFILES = f"""{s.POSTINGS}, p4 AS (SELECT * FROM posts WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+')),
profiles AS (SELECT id, term, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) AS weight FROM p4 JOIN dfs USING (term), size QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 12),
classes AS (SELECT id, min(id) OVER (PARTITION BY mark) AS class FROM (SELECT id, string_agg(term || ':' || weight, ' ' ORDER BY term) AS mark FROM profiles GROUP BY id)),
kinds AS (SELECT * FROM profiles SEMI JOIN (SELECT class AS id FROM classes) USING (id))"""
_TOPICS = f"SELECT 0 AS grp, x.id AS a, y.id AS b, round(sum(least(x.weight, y.weight)) / least(any_value(t1.total), any_value(t2.total)), 6) AS score, count(*) AS shared FROM kinds x JOIN kinds y ON x.term = y.term AND x.id < y.id JOIN t t1 ON t1.id = x.id JOIN t t2 ON t2.id = y.id GROUP BY x.id, y.id HAVING shared >= {build.TOPIC_SHARED} AND score >= {build.TOPIC_OVERLAP}"
_COSINES = f"SELECT 0 AS grp, x.id AS a, y.id AS b, round(sum(x.weight * y.weight) / any_value(t1.norm * t2.norm), 6) AS score, count(*) AS shared FROM kinds x JOIN kinds y ON x.term = y.term AND x.id < y.id JOIN t t1 ON t1.id = x.id JOIN t t2 ON t2.id = y.id GROUP BY x.id, y.id HAVING shared >= {build.SHARED} AND score >= {build.COSINE}"
_LAYOUT = ", ".join(f"'{x}'" for x in NO_TOPICS)
_TITLED = "'Dokument ' || doc_id || ' ' || text"


def _labels(text: str) -> str:
    """CTEs up to labels (id, term, tf, label) of a text of documents."""
    return f"""surface AS (SELECT id, word, count(*) AS k FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, unnest({s.tokens(text)}) AS word FROM documents) GROUP BY ALL),
labels AS MATERIALIZED (SELECT id, term, CAST(sum(k) AS BIGINT) AS tf, first(word ORDER BY k DESC, length(word), word) AS label FROM (SELECT *, {s.STEM_SQL.replace("(t,", "(word,")} AS term FROM surface) WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_LAYOUT}) GROUP BY id, term)"""


_ANSWERS = """a AS (SELECT user_id % 10 AS room, user_id AS player, strftime(ts, '%Y-%m-%d') AS question, event_id, k % 2 = 0 AS correct, CAST(k % 20 AS DOUBLE) AS elapsed FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY room, player, question ORDER BY event_id) = 1), m AS (SELECT *, sum(1 - CAST(correct AS INT)) OVER (PARTITION BY room, player ORDER BY event_id) AS miss FROM f),
g AS (SELECT *, sum(CAST(correct AS INT)) OVER (PARTITION BY room, player, miss ORDER BY event_id) AS st FROM m),
scored AS (SELECT room, player, question, event_id, correct, CAST(CASE WHEN correct THEN 1000 + floor(1000 * greatest(0, 1 - elapsed / 18) + 0.5) + 100 * (st - 1) ELSE 0 END AS BIGINT) AS gain, CAST(CASE WHEN correct THEN st ELSE 0 END AS BIGINT) AS streak FROM g)"""
_LINKS = """links AS (SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, unnest(h) AS href, unnest(l) AS label FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s+href="([^"]*)"[^>]*>', 1) AS h, regexp_extract_all(html, '(?is)<a\\s+href="[^"]*"[^>]*>(.*?)</a>', 1) AS l FROM pages)),
firsts AS (SELECT page_id, pos, href, label FROM links WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY page_id, strip_accents(replace(lower(label), 'ß', 'ss')) ORDER BY pos) = 1)"""
_TITLES = "SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages"

QUERIES = {
    "mention_edges": (mention_edges, f"WITH words AS (SELECT 'b' || item_id AS id, array_to_string([w FOR w IN regexp_split_to_array({s.normalize('text')}, '[^a-z0-9]+') IF w <> ''], ' ') AS key FROM benchmark), u AS (SELECT key, min(id) AS target FROM words WHERE length(replace(key, ' ', '')) >= 3 GROUP BY key HAVING count(DISTINCT id) = 1), j AS (SELECT 'd' || doc_id AS source, ' ' || array_to_string([w FOR w IN regexp_split_to_array({s.normalize('text')}, '[^a-z0-9]+') IF w <> ''], ' ') || ' ' AS body FROM documents) SELECT source, target, CAST(length(split_part(body, ' ' || key || ' ', 1)) - length(replace(split_part(body, ' ' || key || ' ', 1), ' ', '')) AS INTEGER) AS start FROM j JOIN u ON contains(body, ' ' || key || ' ')"),
    "profile_classes": (profile_classes, f"WITH {_PROFILES} SELECT id, class FROM classes"),
    "topic_pairs": (topic_pairs, f"WITH {_PROFILES}, t AS (SELECT id, sum(weight) AS total FROM kinds GROUP BY id) SELECT x.id AS a, y.id AS b, round(sum(least(x.weight, y.weight)) / least(any_value(t1.total), any_value(t2.total)), 6) AS overlap, count(*) AS shared FROM kinds x JOIN kinds y ON x.term = y.term AND x.id < y.id JOIN t t1 ON t1.id = x.id JOIN t t2 ON t2.id = y.id GROUP BY x.id, y.id HAVING count(*) >= 2 AND overlap >= 0.22"),
    "topic_edges": (topic_edges, f"WITH RECURSIVE {_PROFILES}, t AS (SELECT id, sum(weight) AS total FROM kinds GROUP BY id), {s.greedy('best', _TOPICS, build.TOPIC_DEGREE, build.TOPIC_DEGREE, True)} SELECT a, b, score AS overlap FROM best"),
    "topic_labels": (topic_labels, f"WITH {_labels('text')} SELECT id, term, tf, label FROM labels"),
    "topic_evidence": (topic_evidence, f"WITH {_PROFILES}, t AS (SELECT id, sum(weight) AS total FROM kinds GROUP BY id), pairs AS MATERIALIZED ({_TOPICS}), {_labels(_TITLED)}, docs AS (SELECT id, summary AS text FROM nodes), shared AS MATERIALIZED (SELECT p.a, p.b, any_value(p.score) AS score, list(coalesce(la.label, lb.label, x.term) ORDER BY -least(x.weight, y.weight), x.term)[1:6] AS labels FROM pairs p JOIN profiles x ON x.id = p.a JOIN profiles y ON y.id = p.b AND y.term = x.term LEFT JOIN labels la ON la.id = p.a AND la.term = x.term LEFT JOIN labels lb ON lb.id = p.b AND lb.term = x.term GROUP BY ALL), ends AS (SELECT a, b, 'a' AS side, a AS id, [{s.STEM_SQL} FOR t IN labels] AS stems FROM shared UNION ALL SELECT a, b, 'b', b, [{s.STEM_SQL} FOR t IN labels] FROM shared), parts AS (SELECT a, b, side, text, stems, generate_subscripts(p, 1) AS nr, unnest(p) AS s FROM (SELECT ends.*, text, {s.sentences('text')} AS p FROM ends JOIN docs USING (id))), hits AS (SELECT a, b, side, nr, s, len(list_intersect(list_distinct({s.terms('s')}), list_distinct(stems))) AS n FROM parts), best AS (SELECT a, b, side, s FROM hits WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY a, b, side ORDER BY n DESC, nr) = 1), quotes AS (SELECT e.a, e.b, e.side, left(trim(regexp_replace(coalesce(x.s, d.text), '{s.WS_CLASS}+', ' ', 'g')), 145) AS q FROM ends e JOIN docs d USING (id) LEFT JOIN best x ON x.a = e.a AND x.b = e.b AND x.side = e.side) SELECT s.a, s.b, array_to_string(labels, ', ') AS labels, left('Themenüberlappung ' || format('{{:.3f}}', round(score, 3)) || ' ≥ 0.220; gemeinsam: ' || array_to_string(labels, ', ') || '. A: „' || x.q || '“ B: „' || y.q || '“', 620) AS evidence FROM shared s JOIN quotes x ON x.a = s.a AND x.b = s.b AND x.side = 'a' JOIN quotes y ON y.a = s.a AND y.b = s.b AND y.side = 'b'"),
    "similarity_pairs": (similarity_pairs, f"WITH {_PROFILES}, t AS (SELECT id, sqrt(sum(weight ** 2)) AS norm FROM kinds GROUP BY id) SELECT x.id AS a, y.id AS b, round(sum(x.weight * y.weight) / any_value(t1.norm * t2.norm), 6) AS cosine, count(*) AS shared FROM kinds x JOIN kinds y ON x.term = y.term AND x.id < y.id JOIN t t1 ON t1.id = x.id JOIN t t2 ON t2.id = y.id GROUP BY x.id, y.id HAVING count(*) >= 3 AND cosine >= 0.26"),
    "similarity_edges": (similarity_edges, f"WITH RECURSIVE {_PROFILES}, t AS (SELECT id, sqrt(sum(weight ** 2)) AS norm FROM kinds GROUP BY id), {s.greedy('best', _COSINES, build.PER_SOURCE, build.PER_TARGET, False)} SELECT a, b, score AS cosine FROM best"),
    "chunk_documents": (chunk_documents, f"WITH RECURSIVE {s.CHUNKS} SELECT id, pos, \"start\", CAST(\"start\" + length(text) AS INTEGER) AS \"end\", text FROM chunks"),
    "link_extract": (link_extract, f"WITH {_LINKS} SELECT page_id, pos, href, label FROM firsts"),
    "link_verify": (link_verify, f"WITH {_LINKS}, o AS (SELECT trim(regexp_replace({s.normalize('k')}, '\\s+', ' ', 'g')) AS key, min(page_id) AS target FROM (SELECT page_id, split_part(title, ' ', 1) AS k FROM ({_TITLES})) GROUP BY key HAVING count(*) = 1 AND key <> ''), f AS (SELECT page_id AS source, target, min(pos) AS pos FROM firsts JOIN o ON o.key = trim(regexp_replace({s.normalize('label')}, '\\s+', ' ', 'g')) WHERE page_id <> target GROUP BY ALL), r AS (SELECT source, target, CAST(row_number() OVER (PARTITION BY source ORDER BY pos, target) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 48"),
    "page_titles": (page_titles, _TITLES),
    "triples": (triples, "WITH l AS (SELECT doc_id AS id, unnest(x) AS line, generate_subscripts(x, 1) AS nr FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), p AS (SELECT id, nr, [trim(y) FOR y IN string_split(regexp_replace(line, '^\\s*(?:[-*•]|[0-9]+[.)])\\s*', ''), '|')] AS p FROM l), k AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY nr) AS INTEGER) AS pos, p[1] AS subject, p[2] AS relation, p[3] AS object FROM p WHERE len(p) = 3 AND len([y FOR y IN p IF y = '']) = 0 AND length(p[2]) < 60) SELECT * FROM k WHERE pos <= 8"),
    "trial_schedule": (trial_schedule, None),
    "rate_limit": (rate_limit, None),
    "outbox_coalesce": (outbox_coalesce, "WITH e AS (SELECT user_id % 10 AS room, event_id, event_type AS phase FROM events), c AS (SELECT *, coalesce(lag(phase) OVER w <> phase, true) AS change, lead(phase) OVER w IS NULL AS last FROM e WINDOW w AS (PARTITION BY room ORDER BY event_id)) SELECT room, event_id, phase, change FROM c WHERE change OR last"),
    "publish_stamps": (publish_stamps, "WITH e AS (SELECT user_id % 10 AS room, event_id, epoch_us(ts) // 600000000 * 600000 AS spot, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS revision FROM events) SELECT room, event_id, revision, max(spot - revision) OVER (PARTITION BY room ORDER BY event_id) + revision AS updated_at FROM e"),
    "auto_reveal": (auto_reveal, "WITH e AS (SELECT user_id % 10 AS room, event_id, event_type, epoch_us(ts) // 1000 AS spot FROM events), n AS (SELECT *, lead(spot) OVER (PARTITION BY room ORDER BY event_id) AS ended FROM e) SELECT room, event_id, spot + 3600040 AS fires_at FROM n WHERE event_type = 'purchase' AND (ended IS NULL OR ended >= spot + 3600040)"),
    "topic_inbox": (topic_inbox, "WITH RECURSIVE e AS MATERIALIZED (SELECT user_id % 10 AS room, user_id || '-' || event_type AS id, 'Thema ' || event_type AS topic, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS nr FROM events), f AS (SELECT room, CAST(0 AS BIGINT) AS nr, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS BIGINT) AS taken FROM (SELECT DISTINCT room FROM e) UNION ALL SELECT e.room, e.nr, CASE WHEN list_contains(held, e.id) THEN held ELSE list_append(held, e.id)[-20:] END, CASE WHEN list_contains(held, e.id) THEN NULL ELSE e.event_id END FROM f JOIN e ON e.room = f.room AND e.nr = f.nr + 1), l AS (SELECT room, taken FROM f WHERE taken IS NOT NULL QUALIFY row_number() OVER (PARTITION BY room ORDER BY taken DESC) <= 20) SELECT e.room, id, topic, event_id FROM e JOIN l ON l.taken = e.event_id"),
    "throttle": (throttle, None),
    "quiz_game": (quiz_game, None),
    "quiz_score": (quiz_score, f"WITH {_ANSWERS} SELECT * FROM scored"),
    "leaderboard": (leaderboard, f"WITH {_ANSWERS}, t AS (SELECT room, player, CAST(sum(gain) AS BIGINT) AS score, arg_max(streak, event_id) AS streak FROM scored GROUP BY ALL), n AS (SELECT t.*, coalesce('Gast ' || right(c_name, 6), 'Gast') AS name FROM t LEFT JOIN customer ON c_custkey = player) SELECT room, player, name, score, streak, CAST(row_number() OVER (PARTITION BY room ORDER BY score DESC, streak DESC, name, player) AS INTEGER) AS place FROM n"),
    "outbox_sends": (outbox_sends, None),
    "validate_payload": (validate_payload, "SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9._:-]{1,128}') AS id_ok, length(trim(c_name)) BETWEEN 1 AND 18 AS name_ok, regexp_full_match(upper(left(sha256(c_name), 6)), '[A-Z0-9]{6}') AS code_ok, (c_custkey % 2 = 0 AND c_custkey % 3 = 0) OR (c_custkey % 2 <> 0 AND c_custkey % 3 <> 0) AS may_send FROM customer"),
    "export_csv_line": (export_csv_line, "SELECT conv_id, turn, sha256(conv_id || ';' || turn || ';;' || role || ';\"' || replace(replace(text, '\"', '\"\"'), chr(10), ' ') || '\"') AS line_sha256 FROM conversations"),
    "hourly_sessions": (hourly_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM r GROUP BY ALL"),
}
