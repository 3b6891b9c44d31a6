"""DuckDB SQL of the text functions."""

from __future__ import annotations

from korrel.functions.text import NOT_ALNUM, STEM, STOP_WORDS
from korrel.operators.build import CHUNK, CUT_FROM

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
STEM_SQL = f"regexp_replace(t, '{STEM}', '\\1')"


WS_CLASS = r"[\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def normalize(x: str) -> str:
    """SQL of text.normalize."""
    return f"strip_accents(replace(lower({x}), 'ß', 'ss'))"


def tokens(x: str) -> str:
    """SQL of text.tokenize."""
    return f"[t FOR t IN regexp_split_to_array({normalize(x)}, '{NOT_ALNUM}') IF length(t) > 1 AND t NOT IN ({_STOP})]"


def terms(x: str) -> str:
    """SQL of text.terms."""
    return f"[{STEM_SQL} FOR t IN {tokens(x)}]"


def sentences(x: str) -> str:
    """SQL of text.sentences: a mark goes where a cut is, as RE2 knows no look-behind."""
    ws = r"[\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    marked = f"regexp_replace({x}, '([.!?»]){ws}+([A-ZÄÖÜ»0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"[s FOR s IN [regexp_replace(p, '^{ws}+|{ws}+$', '', 'g') FOR p IN string_split({marked}, chr(1))] IF s <> '']"


def postings(nodes: str) -> str:
    """CTEs nodes, posts, dfs, size and norms of a nodes query (id, title, summary)."""
    return f"""nodes AS ({nodes}), posts AS (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms("title || ' ' || coalesce(summary, '')")}) AS term FROM nodes) GROUP BY id, term
), dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term), size AS (SELECT count(*) AS n FROM nodes),
norms AS (SELECT id, sqrt(sum((tf * ln(1 + n / (1 + df))) ** 2)) AS norm FROM posts JOIN dfs USING (term), size GROUP BY id)"""


def tfidf(nodes: str, questions: str) -> str:
    """CTEs up to ranked (question_id, id, score, rank) of a questions query (question_id, text)."""
    return f"""{postings(nodes)}, questions AS ({questions}), asked AS (
  SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({terms("text")}) AS term FROM questions) GROUP BY ALL
), weights AS (SELECT question_id, term, qtf, ln(1 + n / (1 + coalesce(df, 0))) AS idf FROM asked LEFT JOIN dfs USING (term), size),
lengths AS (SELECT question_id, sqrt(sum((qtf * idf) ** 2)) AS qnorm FROM weights GROUP BY question_id),
scored AS (
  SELECT question_id, id, round(sum(qtf * tf * idf ** 2) / (any_value(norm) * any_value(qnorm)), 6) AS score
  FROM weights JOIN posts USING (term) JOIN norms USING (id) JOIN lengths USING (question_id) GROUP BY question_id, id
), ranked AS (
  SELECT question_id, id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score > 0
)"""


DOCUMENTS = "SELECT doc_id AS ord, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, 'Dokument ' || doc_id AS title, lang AS type, source AS community, text AS summary FROM documents"
ITEMS = "SELECT item_id AS question_id, text FROM benchmark"
POSTINGS, TFIDF = postings(DOCUMENTS), tfidf(DOCUMENTS, ITEMS)


def linked(names: str, questions: str) -> str:
    """CTEs up to linked (question_id, id, pos): nodes that questions name. A hit inside a longer one is dropped."""
    words = lambda x: f"array_to_string([w FOR w IN regexp_split_to_array({normalize(x)}, '[^a-z0-9#]+') IF w <> ''], ' ')"
    return f"""keys AS (SELECT min(id) AS id, key FROM (SELECT id, {words("title")} AS key FROM ({names})) WHERE key <> '' GROUP BY key),
bodies AS (SELECT question_id, ' ' || {words("text")} || ' ' AS body FROM ({questions})),
linkhits AS (SELECT question_id, id, key, instr(body, ' ' || key || ' ') AS at FROM bodies JOIN keys ON contains(body, ' ' || key || ' ')),
clear AS (SELECT * FROM linkhits h WHERE NOT EXISTS (SELECT 1 FROM linkhits y WHERE y.question_id = h.question_id AND length(y.key) > length(h.key) AND y.at < h.at + length(h.key) AND h.at < y.at + length(y.key))),
linked AS (SELECT question_id, id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY length(key) DESC, id) - 1 AS INTEGER) AS pos FROM clear)"""


def subgraph(edges: str, names: str, questions: str, depth: int = 3, beam: int = 4, most: int = 14) -> str:
    """CTEs subnodes (question_id, id, pos) and subedges (question_id, step, source, relation, target, label, level) from a CTE seeds."""
    label = terms("label || ' ' || relation || ' ' || title")
    out = [
        f"wantedterms AS (SELECT question_id, list_distinct({terms('text')}) AS wanted FROM ({questions}))",
        f"around AS (SELECT node, other, source, relation, target, label, list_distinct({label}) AS words FROM (SELECT source AS node, target AS other, * FROM ({edges}) UNION ALL SELECT target, source, * FROM ({edges})) JOIN (SELECT id AS other, title FROM ({names})) USING (other))",
        "i0 AS (SELECT question_id, id, -1 AS level, pos AS spot FROM seeds)",
    ]
    earlier = "SELECT NULL AS question_id, NULL AS source, NULL AS relation, NULL AS target"
    for k in range(depth):
        out += [
            f"n{k} AS (SELECT question_id, count(*) AS n FROM i{k} GROUP BY question_id HAVING count(*) < {most})",
            f"o{k} AS (SELECT f.question_id, node, other, source, relation, target, label, n, b.id IS NOT NULL AS known, len(list_intersect(wanted, words)) + CASE WHEN b.id IS NULL THEN 0 ELSE 2 END + {0.5 if k == 0 else 0} AS score FROM i{k} f JOIN n{k} USING (question_id) JOIN around ON node = f.id JOIN wantedterms USING (question_id) LEFT JOIN i{k} b ON b.question_id = f.question_id AND b.id = other WHERE f.level = {k - 1})",
            f"p{k} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source, relation, target, node) AS spot FROM o{k})",
            f"c{k} AS (SELECT question_id, other, min(spot) AS spot, any_value(n) AS n FROM p{k} WHERE NOT known GROUP BY question_id, other QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY min(spot)) <= least({beam}, {most} - any_value(n)))",
            f"z{k} AS (SELECT question_id, CASE WHEN any_value(n) + count(*) >= {most} THEN max(spot) END AS cut FROM c{k} GROUP BY question_id)",
            f"t{k} AS (SELECT question_id, source, relation, target, any_value(label) AS label, {k} AS level, min(spot) AS spot FROM p{k} p LEFT JOIN z{k} USING (question_id) WHERE (cut IS NULL OR spot <= cut) AND (known OR (question_id, other) IN (SELECT (question_id, other) FROM c{k})) AND NOT EXISTS (SELECT 1 FROM ({earlier}) e WHERE e.question_id = p.question_id AND e.source = p.source AND e.relation = p.relation AND e.target = p.target) GROUP BY question_id, source, relation, target)",
            f"i{k + 1} AS (SELECT * FROM i{k} UNION ALL SELECT question_id, other, {k}, spot FROM c{k})",
        ]
        earlier += f" UNION ALL SELECT question_id, source, relation, target FROM t{k}"
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(depth))
    out += [
        f"subnodes AS (SELECT question_id, id, level, CAST(row_number() OVER (PARTITION BY question_id ORDER BY level, spot) - 1 AS INTEGER) AS pos FROM i{depth})",
        f"subedges AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY level, spot) - 1 AS INTEGER) AS step, source, relation, target, label, level FROM ({every}))",
    ]
    return ",\n".join(out)


# Chunks: white space is skipped, then up to CHUNK characters are taken, cut behind the last mark that begins in their later part.
_FROM = int(CHUNK * CUT_FROM)
_MARK = f"(?s)^(.{{0,{CHUNK - _FROM}}})(?:[.!?»] |\\n| )"
_TAIL = f"substring(text, spot + {_FROM} + 1, {CHUNK - _FROM + 2})"
CHUNKS = f"""texts AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
cuts AS (
  SELECT id, text, -1 AS pos, 0 AS spot, 0 AS stop FROM texts
  UNION ALL SELECT id, text, pos + 1, spot, CASE WHEN spot + {CHUNK} < length(text) AND regexp_matches({_TAIL}, '{_MARK}') THEN spot + {_FROM} + length(regexp_extract({_TAIL}, '{_MARK}', 1)) + 1 ELSE least(length(text), spot + {CHUNK}) END
  FROM (SELECT id, text, pos, stop + length(substring(text, stop + 1)) - length(regexp_replace(substring(text, stop + 1), '^{WS_CLASS}+', '')) AS spot FROM cuts) WHERE spot < length(text)
), chunks AS (SELECT id, CAST(pos AS INTEGER) AS pos, CAST(spot AS INTEGER) AS "start", regexp_replace(substring(text, spot + 1, stop - spot), '{WS_CLASS}+$', '') AS text FROM cuts WHERE pos >= 0)"""


def greedy(name: str, pairs: str, per_a: int, per_b: int, symmetric: bool) -> str:
    """CTE of (grp, a, b, score): pairs of a query (grp, a, b, score, shared) taken best first, one after the other."""
    ends = "[p.a, p.b]" if symmetric else "['<' || p.a, '>' || p.b]"
    x, y = ("p.a", "p.b") if symmetric else ("'<' || p.a", "'>' || p.b")
    fits = f"len(list_filter(g.used, lambda u: u = {x})) < {per_a} AND len(list_filter(g.used, lambda u: u = {y})) < {per_b}"
    return f"""{name}pairs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, shared DESC, a, b) AS nr FROM ({pairs})),
{name}walk AS (SELECT grp, CAST(0 AS BIGINT) AS nr, CAST([] AS VARCHAR[]) AS used, false AS took FROM {name}pairs GROUP BY grp UNION ALL SELECT g.grp, p.nr, CASE WHEN {fits} THEN list_concat(g.used, {ends}) ELSE g.used END, {fits} FROM {name}walk g JOIN {name}pairs p ON p.grp = g.grp AND p.nr = g.nr + 1),
{name} AS (SELECT p.* FROM {name}pairs p JOIN {name}walk w ON w.grp = p.grp AND w.nr = p.nr WHERE took)"""
