"""The queries again as SQL for DuckDB, written against the input tables."""

from math import lcm

from voxtally import constants as K
from voxtally.operators import synth
from voxtally.plans.views import EMOTIONS, PROSE

TOKENS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}]+')"
SEP = "'|'"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in sorted(set(values))) + ")"


def values(rows) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )


def case(mapping: dict, of: str, otherwise: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in mapping.items())
    return f"CASE {of} {arms} ELSE {otherwise} END"


def draw(id_: str, k: int, p: int, m: int) -> str:
    return f"(((({id_}) + 1) * {p}) % 1000003 + {k}) % {m}"


def weighted(percent: dict, drawn: str) -> str:
    arms, upto = "", 0
    for name, share in percent.items():
        upto += share
        arms += f" WHEN {drawn} < {upto} THEN {q(name)}"
    return f"CASE{arms} END"


def tokens(text: str) -> str:
    return TOKENS.format(text=text)


# White space as str.strip() has it.
BLANKS = "||".join(
    f"chr({c})" for c in [
        *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
STRIPPED = f"trim(text, {BLANKS})"

# -- survey views ---------------------------------------------------------------------

SURVEY = f"""survey AS (
  SELECT doc_id AS pos, 'd' || doc_id AS response_id, text,
         {array(K.DEPARTMENTS)}[doc_id % 11 + 1] AS department, lang AS language,
         {array(K.THEMES)}[doc_id % 10 + 1] AS survey_theme
  FROM documents)"""

MESSAGE = f"""CASE WHEN text IS NULL THEN {q(K.MSG_MISSING)}
  WHEN length(text) < 5 THEN {q(K.MSG_SHORT)} WHEN length(text) > 5000 THEN {q(K.MSG_LONG)}
  WHEN length({STRIPPED}) = 0 THEN {q(K.MSG_BLANK)} END"""

CHECKED = f"{SURVEY}, checked AS (SELECT *, {MESSAGE} AS msg FROM survey)"

VALID = f"""{CHECKED}, valid AS (
  SELECT pos, response_id, {STRIPPED} AS text, department, language, survey_theme
  FROM checked WHERE msg IS NULL)"""


LUHN = """(list_sum(list_transform(range(1, CAST(length(r) AS BIGINT) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(substr(r, length(r) - i + 1, 1) AS INT)
      WHEN CAST(substr(r, length(r) - i + 1, 1) AS INT) > 4
        THEN 2 * CAST(substr(r, length(r) - i + 1, 1) AS INT) - 9
      ELSE 2 * CAST(substr(r, length(r) - i + 1, 1) AS INT) END)) % 10 = 0)"""

MOD97 = """(list_reduce(list_concat([0], list_transform(
      string_split(substr(r, 5) || substr(r, 1, 4), ''),
      lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
    lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1)"""


def without_runs(text: str, pattern: str, check: str, mask: str) -> str:
    """``text`` with every checked run replaced where it is a word of its own."""
    good = f"list_filter(list_distinct(regexp_extract_all({text}, '{pattern}')), lambda r: {check})"
    return (
        f"list_reduce(list_concat([{text}], {good}), "
        f"lambda a, r: regexp_replace(a, '\\b' || r || '\\b', '{mask}', 'g'))"
    )


def masked(text: str) -> str:
    text = without_runs(text, r'\b[0-9]{13,19}\b', LUHN, '[CREDIT_CARD]')
    text = without_runs(text, r'\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b', MOD97, '[IBAN]')
    for pattern, mask in (
        (K.EMAIL_PATTERN, "[EMAIL]"), (K.PHONE_PATTERN, "[PHONE]"), (K.PERSON_PATTERN, "[PERSON]")
    ):
        text = f"regexp_replace({text}, {q(pattern)}, '{mask}', 'g')"
    return text


def action(sentiment: str, themes: str, leaving: str) -> str:
    return f"""CASE
      WHEN {sentiment} = 'very_negative' AND list_contains({themes}, 'wellbeing_safety')
        THEN 'urgent_action'
      WHEN {leaving} THEN 'urgent_action'
      WHEN {sentiment} IN ('negative', 'very_negative') THEN 'monitor'
      WHEN {sentiment} = 'very_positive' THEN 'positive_share' ELSE 'no_action' END"""


def labelled(source: str) -> str:
    """CTEs from ``source`` (with pos, language) to ``labelled``."""
    def d(k, p, m):
        return draw("pos", k, p, m)

    def theme(k, p):
        return f"{array(K.THEMES)}[{d(k, p, 10)} + 1]"

    emotions = ", ".join(
        f"{array(EMOTIONS)}[{d(k, p, len(EMOTIONS))} + 1]"
        for k, p in [(7, 19993), (8, 14057), (10, 31337)]
    )
    return f"""drawn AS (
  SELECT *, {weighted(K.SENTIMENT_PERCENT, d(1, 7919, 100))} AS sentiment,
    {d(9, 90007, 101)} / 100e0 AS sentiment_confidence, {theme(2, 62711)} AS primary_theme,
    [{theme(4, 45911)}, {theme(5, 35713)}][1:{d(3, 53813, 3)}] AS secondary_themes,
    [{emotions}][1:{d(6, 27413, 4)}] AS plain_emotions
  FROM {source}),
labelled AS (
  SELECT *, list_transform(plain_emotions, lambda e: CASE WHEN pos % 2 = 1
      THEN upper(e[1]) || substr(e, 2) ELSE e END) AS emotion_tags,
    {action('sentiment', 'list_concat([primary_theme], secondary_themes)', 'false')} AS action_signal
  FROM drawn)"""


def scored(source: str = "labelled") -> str:
    """CTEs from label columns to ``scored``."""
    sentiment = case({k: f"{v!r}e0" for k, v in K.SENTIMENT_SCORES.items()}, "sentiment", "0.35e0")
    themes = "list_concat([primary_theme], secondary_themes)"
    return f"""parts AS (
  SELECT *, {sentiment} AS sentiment_part,
    CASE WHEN list_has_any({themes}, {array(K.HIGH_RISK_THEMES)}) THEN 0.9e0
         WHEN list_has_any({themes}, {array(K.MEDIUM_RISK_THEMES)}) THEN 0.5e0
         ELSE 0.2e0 END AS theme_part,
    list_distinct(list_transform(emotion_tags, lambda e: lower(e))) AS emotions,
    CASE WHEN action_signal = 'urgent_action' THEN 0.9e0 ELSE 0e0 END AS action_part
  FROM {source}),
parts2 AS (
  SELECT *, greatest(0e0,
      least(1e0, 0.35e0 * len(list_filter(emotions, lambda e: e IN {in_list(K.BURNOUT_EMOTIONS)})))
    - least(0.2e0, 0.1e0 * len(list_filter(emotions, lambda e: e IN {in_list(K.PROTECTIVE_EMOTIONS)})))
    ) AS emotion_part,
    list_sort(list_filter(emotions, lambda e: e IN {in_list(K.PROTECTIVE_EMOTIONS)})) AS protective
  FROM parts),
scored0 AS (
  SELECT *, round(least(1e0, greatest(0e0, 0.4e0 * sentiment_part + 0.3e0 * theme_part
    + 0.2e0 * emotion_part + 0.1e0 * action_part)), 4) AS risk_score FROM parts2),
scored AS (
  SELECT *, CASE WHEN risk_score <= 0.3e0 THEN 'low' WHEN risk_score <= 0.55e0 THEN 'medium'
      WHEN risk_score <= 0.75e0 THEN 'high' ELSE 'critical' END AS risk_level,
    array_to_string(list_filter([
      CASE WHEN sentiment_part >= 0.65e0 THEN 'Negative sentiment: ' || sentiment END,
      CASE WHEN primary_theme IN {in_list(K.HIGH_RISK_THEMES)}
        THEN 'High-risk theme: ' || primary_theme END,
      CASE WHEN emotion_part >= 0.35e0 THEN 'Burnout-correlated emotions detected' END,
      CASE WHEN action_signal = 'urgent_action' THEN 'Urgent action signal' END
    ], lambda x: x IS NOT NULL), {SEP}) AS risk_factors,
    array_to_string(list_filter([
      CASE WHEN sentiment IN ('positive', 'very_positive') THEN 'Positive sentiment baseline' END,
      CASE WHEN len(protective) > 0
        THEN 'Protective emotions: ' || array_to_string(protective, ', ') END
    ], lambda x: x IS NOT NULL), {SEP}) AS protective_factors
  FROM scored0)"""


LABELLED = f"WITH {SURVEY}, {labelled('survey')}"
SCORED = f"{LABELLED}, {scored()}"
ANALYZED = f"WITH {VALID}, {labelled('valid')}, {scored()}"

# -- lexicon labels, from a relation with response_id and text ---------------------------


def lexical(source: str) -> str:
    """CTEs from ``source`` (response_id, text) to the label relations
    ``sent``, ``themes``, ``emo``, ``lang``, ``keys`` and ``lead``."""
    lex = p = PROSE
    weights = [(t, w, 0) for w, ts in p.positive.items() for t in sorted(set(ts))]
    weights += [(t, 0, w) for w, ts in p.negative.items() for t in sorted(set(ts))]
    themes = [
        (t, i, theme) for i, theme in enumerate(K.THEMES) for t in sorted(set(lex.themes[theme]))
    ]
    emotions = [(t, e) for e, ts in lex.emotions.items() for t in sorted(set(ts))]
    owners: dict[str, list[str]] = {}
    for lang, words in lex.function_words.items():
        for w in set(words):
            owners.setdefault(w, []).append(lang)
    unit = lcm(*[len(o) for o in owners.values()])
    langs = list(K.LANGUAGES)
    shares = [
        (w, langs.index(lang), unit // len(ls)) for w, ls in sorted(owners.items()) for lang in ls
    ]
    pos_han, neg_han = "|".join(lex.positive_han), "|".join(lex.negative_han)
    return f"""tok AS (
  SELECT response_id, text, {tokens('text')} AS ts FROM {source}),
word AS (SELECT response_id, unnest(ts) AS t FROM tok),
weight(t, p, n) AS ({values(weights)}),
hit AS (SELECT response_id, sum(p) AS p, sum(n) AS n FROM word JOIN weight USING (t) GROUP BY 1),
polar AS (
  SELECT response_id,
    CAST(coalesce(p, 0) + len(regexp_extract_all(text, '{pos_han}')) AS BIGINT) AS pos_weight,
    CAST(coalesce(n, 0) + len(regexp_extract_all(text, '{neg_han}')) AS BIGINT) AS neg_weight
  FROM tok LEFT JOIN hit USING (response_id)),
sent AS (
  SELECT *, CASE
      WHEN 5 * (pos_weight - neg_weight) >= 3 * (pos_weight + neg_weight)
        AND pos_weight - neg_weight >= 2 THEN 'very_positive'
      WHEN 5 * (pos_weight - neg_weight) >= pos_weight + neg_weight
        AND pos_weight > neg_weight THEN 'positive'
      WHEN 5 * (neg_weight - pos_weight) >= 3 * (pos_weight + neg_weight)
        AND neg_weight - pos_weight >= 2 THEN 'very_negative'
      WHEN 5 * (neg_weight - pos_weight) >= pos_weight + neg_weight
        AND neg_weight > pos_weight THEN 'negative'
      ELSE 'neutral' END AS sentiment,
    CASE WHEN pos_weight + neg_weight = 0 THEN 0.5e0 ELSE
      round(abs(pos_weight - neg_weight) / CAST(pos_weight + neg_weight AS DOUBLE), 4)
      END AS sentiment_confidence
  FROM polar),
theme_term(t, ord, theme) AS ({values(themes)}),
theme_hit AS (
  SELECT response_id, theme, row_number() OVER (
    PARTITION BY response_id ORDER BY count(*) DESC, ord) AS r
  FROM word JOIN theme_term USING (t) GROUP BY response_id, theme, ord),
themes AS (
  SELECT response_id,
    coalesce(max(CASE WHEN r = 1 THEN theme END), 'communication') AS primary_theme,
    coalesce(list(theme ORDER BY r) FILTER (r IN (2, 3)), []) AS secondary_themes
  FROM tok LEFT JOIN theme_hit USING (response_id) GROUP BY response_id),
emotion_term(t, emotion) AS ({values(emotions)}),
emo AS (
  SELECT response_id, coalesce(list(emotion ORDER BY r) FILTER (r <= 3), []) AS emotion_tags
  FROM tok LEFT JOIN (
    SELECT response_id, emotion,
      row_number() OVER (PARTITION BY response_id ORDER BY count(*) DESC, emotion) AS r
    FROM word JOIN emotion_term USING (t) GROUP BY response_id, emotion
  ) USING (response_id) GROUP BY response_id),
share(t, li, w) AS ({values(shares)}),
evidence AS (
  SELECT response_id, li, sum(w) AS s FROM word JOIN share USING (t) GROUP BY ALL
  UNION ALL
  SELECT response_id, {langs.index('zh')}, {unit} * len(regexp_extract_all(text, '\\p{{Han}}')) FROM tok
  UNION ALL
  SELECT response_id, {langs.index('hi')}, {unit} * len(regexp_extract_all(text, '\\p{{Devanagari}}'))
  FROM tok),
lang AS (
  SELECT response_id, CASE WHEN max(s) > 0
      THEN {array(langs)}[1 + arg_max(li, (s, -li))] ELSE 'unknown' END AS language_detected
  FROM (SELECT response_id, li, sum(s) AS s FROM evidence GROUP BY ALL) GROUP BY response_id),
content AS (
  SELECT response_id, t, count(*) AS tf FROM word
  WHERE t NOT IN {in_list(lex.stop_words)} AND length(t) >= 3 GROUP BY ALL),
key_rank AS (
  SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY tf DESC, t) AS r FROM content),
keys AS (
  SELECT response_id, coalesce(list(t ORDER BY r) FILTER (r <= 8), []) AS terms
  FROM tok LEFT JOIN key_rank USING (response_id) GROUP BY response_id),
sentence AS (
  SELECT response_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
    SELECT response_id, list_filter(
      list_transform(regexp_split_to_array(text, '[.!?。！？।\\n]+'), lambda s: trim(s)),
      lambda s: regexp_matches(s, '\\p{{L}}')) AS l FROM {source})),
sentence_score AS (
  SELECT response_id, s, i,
    pow(len(list_filter({tokens('s')}, lambda t: list_contains(terms, t))), 2)
      / CAST(len({tokens('s')}) AS DOUBLE) AS score
  FROM sentence JOIN keys USING (response_id)),
lead AS (
  SELECT response_id, coalesce(arg_max(s, (score, -i)), '') AS lead
  FROM tok LEFT JOIN sentence_score USING (response_id) GROUP BY response_id)"""


# RE2's \\b knows ASCII only: edges of a phrase are spelled out.
_EDGE = r"[^\p{L}\p{M}\p{N}_]"
LEAVING = "(?i)" + "|".join(
    f"(?:^|{_EDGE}){p[2:-2]}(?:$|{_EDGE})" if p.startswith(r"\b") else p for p in PROSE.leaving
)
LEXICAL = f"WITH {SURVEY}, {lexical('survey')}"

# -- statistics -----------------------------------------------------------------------

DIMS = {
    "sentiment": "sentiment", "theme": "primary_theme", "risk_level": "risk_level",
    "department": "department", "action": "action_signal",
}
FREQ = ANALYZED + ", freq AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dim, {c} AS value, count(*) AS n, min(pos) AS first_pos FROM scored"
    + (" WHERE coalesce(department, '') <> ''" if d == "department" else "") + " GROUP BY ALL"
    for d, c in DIMS.items()
) + ")"
TOTALS = """totals AS (
  SELECT count(*) AS total,
    CAST(round(CAST(sum(CAST(risk_score AS DECIMAL(9,4))) AS DECIMAL(38,8)) / count(*), 3) AS DOUBLE)
      AS avg_burnout_score,
    count(*) FILTER (action_signal = 'urgent_action') AS urgent_action_count,
    count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk_count,
    count(*) FILTER (sentiment IN ('negative', 'very_negative')) AS negative_count
  FROM scored)"""


def top(dim: str, n: int = 5) -> str:
    return f"""(SELECT value, n, first_pos,
      row_number() OVER (ORDER BY n DESC, first_pos) - 1 AS ord FROM freq
      WHERE dim = '{dim}' ORDER BY n DESC, first_pos LIMIT {n})"""


def pairs(relation: str) -> str:
    return f"(SELECT string_agg(value || '=' || n, '|' ORDER BY value) FROM {relation})"


def of(dim: str) -> str:
    return f"(SELECT * FROM freq WHERE dim = '{dim}')"


def display(theme: str) -> str:
    return case({k: q(v) for k, v in K.THEMES.items()}, theme, theme)


KB = f"kb(id, topic, text) AS ({values(K.KB_SEED)})"

# -- retrieval: lnc.ltc from corpus(id, text) and asked(query_id, query) ------------------


def text_topk(stop_words, k: int = 3) -> str:
    """CTEs from ``corpus`` and ``asked`` to ``results``."""
    keep = f"t NOT IN {in_list(stop_words)}" if stop_words else "true"
    return f"""qterm AS (
  SELECT query_id, t, count(*) AS tf FROM (SELECT query_id, unnest({tokens('query')}) AS t FROM asked)
  WHERE {keep} GROUP BY ALL),
dterm AS (
  SELECT id, t, 1 + ln(count(*)) AS w FROM (SELECT id, unnest({tokens('text')}) AS t FROM corpus)
  WHERE {keep} GROUP BY id, t),
dlen AS (SELECT id, sqrt(sum(w * w)) AS l FROM dterm GROUP BY id),
idf AS (SELECT t, ln((SELECT count(*) FROM corpus) / count(*)) AS idf FROM dterm GROUP BY t),
qw AS (SELECT query_id, t, (1 + ln(tf)) * idf AS w FROM qterm JOIN idf USING (t)),
qlen AS (SELECT query_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY query_id HAVING l > 0),
pair AS (
  SELECT query_id, id, round(sum(qw.w * dterm.w) / (any_value(qlen.l) * any_value(dlen.l)), 6) AS score
  FROM qw JOIN dterm USING (t) JOIN qlen USING (query_id) JOIN dlen USING (id)
  GROUP BY query_id, id),
results AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score
  FROM pair WHERE score > 0 QUALIFY rank <= {k})"""


REPORT_QUERIES = f"""{FREQ}, {TOTALS}, asked AS (
  SELECT CAST(ord AS INT) AS query_id, 'best practices for ' || {display('value')}
    || ' employee engagement' AS query FROM {top('theme', 3)}
  UNION ALL SELECT 3, {q(K.CRISIS_QUERY)} FROM totals WHERE avg_burnout_score > 0.55)"""

FINDINGS = f"""line(ord, finding) AS (
  SELECT 0, printf('%.1f%% of %d responses are negative', round(negative_count * 100e0 / total, 1), total)
  FROM totals UNION ALL
  SELECT 1, 'Most mentioned theme: ' || {display('value')} || ' (' || n || ' responses)'
  FROM {top('theme', 1)} UNION ALL
  SELECT 2, printf('%.1f%% show high or critical burnout risk', round(high_risk_count * 100e0 / total, 1))
  FROM totals UNION ALL
  SELECT 3, urgent_action_count || ' responses need urgent action' FROM totals UNION ALL
  SELECT 4, printf('Mean burnout score is %.3f (', avg_burnout_score) || CASE
    WHEN avg_burnout_score <= 0.3 THEN 'low' WHEN avg_burnout_score <= 0.55 THEN 'medium'
    WHEN avg_burnout_score <= 0.75 THEN 'high' ELSE 'critical' END || ')' FROM totals)"""

ACTIONS = f"""led AS (
  SELECT CAST(ord AS INT) AS ord, value AS theme, CASE
    WHEN value IN {in_list(K.HIGH_RISK_THEMES)} THEN 'high'
    WHEN value IN {in_list(K.MEDIUM_RISK_THEMES)} THEN 'medium' ELSE 'low' END AS priority
  FROM {top('theme')}),
act AS (
  SELECT ord, priority, theme, coalesce((SELECT arg_min(text, id) FROM kb WHERE topic = theme),
      'Review the responses on ' || {display('theme')}) AS action,
    CASE priority WHEN 'high' THEN 'Leadership' WHEN 'medium' THEN 'Management' ELSE 'HR' END AS owner
  FROM led)"""

CONTEXT = f"""corpus AS (SELECT id, text FROM kb), {text_topk(PROSE.stop_words)},
context AS (
  SELECT CAST(row_number() OVER (ORDER BY min((query_id, rank))) - 1 AS INT) AS ord, text
  FROM results JOIN kb USING (id) GROUP BY text ORDER BY ord LIMIT 3)"""


def json_map(dim: str) -> str:
    return f"""'{{' || (SELECT string_agg(to_json(value) || ':' || n, ',' ORDER BY value)
      FROM {of(dim)}) || '}}'"""


def json_list(item: str, relation: str) -> str:
    return f"'[' || (SELECT string_agg({item}, ',' ORDER BY ord) FROM {relation}) || ']'"


REPORT = f"""SELECT '{{"total_responses":' || total
  || ',"sentiment_distribution":' || {json_map('sentiment')}
  || ',"top_themes":' || {json_list('to_json(value)', top('theme'))}
  || ',"burnout_risk_summary":' || {json_map('risk_level')}
  || ',"executive_summary":' || to_json(
    printf('%d responses, mean burnout score %.3f, %d need urgent action. Leading theme: ',
      total, avg_burnout_score, urgent_action_count)
    || (SELECT {display('value')} FROM {top('theme', 1)}) || '.')
  || ',"key_findings":' || {json_list('to_json(finding)', 'line')}
  || ',"recommended_actions":' || {json_list(
    "'{\"priority\":' || to_json(priority) || ',\"theme\":' || to_json(theme) || ',\"action\":' "
    "|| to_json(action) || ',\"owner\":' || to_json(owner) || '}'", 'act')}
  || ',"rag_references":' || {json_list('to_json(text)', 'context')} || '}}' AS report
FROM totals WHERE total > 0"""

# -- topics -----------------------------------------------------------------------------


def topic_terms(docs: str, topic: str) -> str:
    """CTEs from ``docs`` (topic, text) to ``term_score``."""
    return f"""tw AS (
  SELECT {topic}, t, count(*) AS tf FROM (SELECT {topic}, unnest({tokens('text')}) AS t FROM {docs})
  WHERE length(t) >= 2 GROUP BY ALL),
per_topic AS (SELECT {topic}, sum(tf) AS w FROM tw GROUP BY ALL),
term_score AS (
  SELECT {topic}, t AS term, round(tf * ln(1 + (SELECT avg(w) FROM per_topic)
    / sum(tf) OVER (PARTITION BY t)), 6) AS score FROM tw),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {topic} ORDER BY score DESC, term) AS rank
  FROM term_score)"""


def folded(min_size: int) -> str:
    return f"""sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
kept AS (
  SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS topic_id
  FROM sizes WHERE n >= {min_size} QUALIFY topic_id < {K.N_TOPICS}),
folded AS (
  SELECT vec_id, embedding, label, coalesce(topic_id, -1) AS topic_id
  FROM embeddings LEFT JOIN kept USING (label))"""


CENTROIDS = f"""{folded(K.MIN_TOPIC_SIZE)},
dims AS (
  SELECT topic_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM folded WHERE topic_id <> -1),
centre AS (
  SELECT topic_id, list(m ORDER BY i) AS centroid
  FROM (SELECT topic_id, i, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY topic_id),
near AS (
  SELECT vec_id, f.topic_id AS own, c.topic_id,
    list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS cos
  FROM folded f, centre c)"""

def made_topics(fitted: str, asked: str) -> str:
    """Topics of the documents that are ``asked`` by the classes of those that are ``fitted``."""
    return f"""WITH docs AS (
  SELECT doc_id, text, {fitted} AS fitted,
    CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 10 < 3 THEN 1 WHEN doc_id % 10 < 6 THEN 2 ELSE 3 END AS cls
  FROM documents),
raw AS (
  SELECT doc_id, cls, fitted, list_transform(range(4), lambda i:
    CASE WHEN cls = i THEN 10e0 ELSE 0e0 END + ((doc_id * 7 + i * 3) % 11) / 10e0) AS v FROM docs),
unit AS (
  SELECT doc_id, cls, fitted, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM raw),
sizes AS (
  SELECT cls, row_number() OVER (ORDER BY count(*) DESC) - 1 AS topic_id FROM docs WHERE fitted
  GROUP BY cls HAVING count(*) >= {K.MIN_TOPIC_SIZE}),
centre AS (
  SELECT topic_id, list(m ORDER BY i) AS c FROM (
    SELECT topic_id, i, avg(x) AS m FROM (
      SELECT topic_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM unit JOIN sizes USING (cls) WHERE fitted)
    GROUP BY ALL) GROUP BY topic_id),
fitted_docs AS (
  SELECT coalesce(topic_id, -1) AS cls, text FROM docs LEFT JOIN sizes USING (cls) WHERE fitted),
{topic_terms('fitted_docs', 'cls')},
named AS (
  SELECT cls AS topic_id, string_agg(term, ' / ' ORDER BY rank) FILTER (rank <= 3) AS topic_label,
    string_agg(term, '|' ORDER BY rank) AS topic_keywords FROM ranked WHERE rank <= 5 GROUP BY cls),
near AS (
  SELECT doc_id, topic_id, list_cosine_similarity(v, c) AS cos FROM unit, centre WHERE {asked}),
share AS (SELECT doc_id, topic_id, cos, exp(cos) / sum(exp(cos)) OVER (PARTITION BY doc_id) AS p FROM near)
SELECT doc_id, CAST(topic_id AS INT) AS topic_id, topic_label, topic_keywords,
  round(least(1e0, p), 4) AS topic_confidence FROM share JOIN named USING (topic_id)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, topic_id) = 1"""


# -- synthetic ---------------------------------------------------------------------------


def bucket_keys(source: str, id_: str, vector: str, tables: int, bits: int) -> str:
    """(id, t, key) of vectors of 64 numbers: the sides of the planes as bits."""
    plane = (
        "list_transform(range(1, 65), lambda i: 1e0 - 2 * "
        "((i * (7919 * t + 104729 * j) + i * i * (31 * t + 17 * j + 5)) % 10007 % 2))"
    )
    return f"""SELECT {id_}, t, list_sum(list_transform(range(1, {bits + 1}), lambda j:
    CASE WHEN list_dot_product(CAST({vector} AS DOUBLE[]), {plane}) > 0 THEN 1 << (j - 1) ELSE 0 END)) AS key
  FROM {source}, range(1, {tables + 1}) x(t)"""


RUN_WORDS = f"""WITH run AS (
  SELECT t AS run, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS t FROM documents) GROUP BY t),
place AS (
  SELECT substr(run, i, k) AS gram, CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '' END AS before,
    substr(run, i + k, 1) AS after, n
  FROM (SELECT run, n, k, unnest(range(1, length(run) - k + 2)) AS i FROM run, range(1, 5) sizes(k))),
counts AS (SELECT gram, sum(n)::DOUBLE AS n FROM place GROUP BY gram),
free AS (
  SELECT gram FROM (SELECT gram, before, sum(n)::DOUBLE AS n FROM place GROUP BY ALL) GROUP BY gram
  HAVING round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) >= 0.6
  INTERSECT
  SELECT gram FROM (SELECT gram, after, sum(n)::DOUBLE AS n FROM place GROUP BY ALL) GROUP BY gram
  HAVING round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) >= 0.6),
parted AS (
  SELECT gram, n, substr(gram, 1, j) AS a, substr(gram, j + 1) AS b
  FROM (SELECT gram, n, unnest(range(1, length(gram))) AS j
        FROM counts JOIN free USING (gram) WHERE length(gram) > 1 AND n >= 3)),
kept AS (
  SELECT p.gram, any_value(p.n) AS n FROM parted p JOIN counts a ON a.gram = p.a JOIN counts b ON b.gram = p.b
  GROUP BY p.gram HAVING round(min(ln(p.n * (SELECT sum(n) FROM counts WHERE length(gram) = 1) / (a.n * b.n))), 6) >= 1.5
  UNION ALL SELECT gram, n FROM counts WHERE length(gram) = 1)
SELECT gram AS word, n::BIGINT AS n, round(ln(n / (SELECT sum(n) FROM kept)), 6) AS weight FROM kept"""

UPLOADED = f"""SELECT 'd' || doc_id AS response_id, CASE WHEN doc_id % 3 = 0
    THEN concat_ws(chr(10), text, 'second, "quoted" line', '') ELSE text END AS text,
  {array(K.DEPARTMENTS)}[doc_id % 11 + 1] AS department, lang AS language FROM documents"""

ASKED_VECTORS = """asked AS (
  SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"""


def nearest_of(pairs: str, k: int = 3) -> str:
    return f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank,
  id, score FROM (
    SELECT query_id, vec_id AS id,
      round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 4) AS score
    FROM {pairs}) QUALIFY rank <= {k}"""


def nested(table: dict, row: str, column: str) -> str:
    return "[" + ", ".join(array(table[lang]) for lang in K.LANGUAGES) + f"][{row} + 1][{column} + 1]"


def hashed(id_: str, node: str, m: int) -> str:
    return f"CAST(('0x' || substr(md5({id_} || '/{node}'), 1, 15))::BIGINT % {m} AS INT)"


def chosen(drawn: str, weights: list[int]) -> str:
    upto = [sum(weights[: i + 1]) for i in range(len(weights))]
    return f"CASE {' '.join(f'WHEN {drawn} < {u} THEN {i}' for i, u in enumerate(upto))} END"


def reason(nth: int) -> str:
    since = chosen(hashed("counter", f"reason{nth}.since", sum(synth.SINCE_WEIGHTS)), synth.SINCE_WEIGHTS)
    own = nested(synth.REASONS, "li", hashed("counter", f"reason{nth}", 8))
    who = nested(synth.WHO, "li", hashed("counter", f"reason{nth}.who", 4))
    filled = f"replace(replace({own}, '<since>', {nested(synth.SINCE, 'li', f'({since})')}), '<who>', {who})"
    many = chosen(hashed("counter", "answer", sum(synth.REASON_WEIGHTS)), synth.REASON_WEIGHTS)
    return f"CASE WHEN {many} >= {nth} THEN gap || {filled} ELSE '' END"


SYNTH = f"""WITH r AS (
  SELECT doc_id AS row, li, (doc_id // 5) * 6 + li AS g,
    li * (SELECT count(*) FROM documents) + doc_id AS counter
  FROM documents, range(6) x(li)),
s AS (
  SELECT *, {array(K.LANGUAGES)}[li + 1] AS language, {hashed('g', 'theme', 10)} AS theme_no,
    {weighted(K.SENTIMENT_PERCENT, hashed('g', 'sentiment', 100))} AS declared_sentiment,
    {array(K.DEPARTMENTS)}[{hashed('g', 'department', len(K.DEPARTMENTS))} + 1] AS department,
    {array(K.EXPERIENCE_LEVELS)}[{hashed('counter', 'experience', len(K.EXPERIENCE_LEVELS))} + 1] AS experience FROM r),
t AS (
  SELECT *, replace({nested(synth.OPENINGS, 'li', f"(list_position({array(K.SENTIMENTS)}, declared_sentiment) - 1)")},
    '%s', {nested(synth.SUBJECTS, 'li', 'theme_no')}) AS opening,
    {nested(synth.CLOSINGS, 'li', '(row % 5)')} AS closing, CASE WHEN language = 'zh' THEN '' ELSE ' ' END AS gap FROM s)
SELECT language || '_' || printf('%05d', counter) AS response_id,
  opening || {reason(1)} || {reason(2)} || gap || closing AS text,
  language, declared_sentiment, {array(K.THEMES)}[theme_no + 1] AS survey_theme, department, experience
FROM t"""

# -- checks on runs of digits ---------------------------------------------------------------

def runs(source: str, pattern: str, check: str, mask: str) -> str:
    """CTEs to ``out`` with the checked runs of each text and the text without them."""
    return f"""run AS (
  SELECT response_id, r, min(i) AS i FROM (
    SELECT response_id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (
      SELECT response_id, regexp_extract_all(text, '{pattern}') AS l FROM {source}))
  GROUP BY ALL),
good AS (SELECT response_id, list(r ORDER BY i) AS l FROM run WHERE {check} GROUP BY response_id),
out AS (
  SELECT s.*, coalesce(l, []) AS l, CASE WHEN l IS NULL THEN text ELSE
      regexp_replace(text, '\\b(' || array_to_string(l, '|') || ')\\b', '{mask}', 'g') END AS masked
  FROM {source} s LEFT JOIN good USING (response_id))"""


_DEFAULT_LABEL = ("neutral", 0.5, "communication", "", "", "", "", "no_action", "en")
_FALLBACK_LABEL = ("neutral", 0.0, "communication", "", "", "Analysis failed.", "", "no_action", "unknown")
_LABEL_COLUMNS = (
    "sentiment, sentiment_confidence, primary_theme, secondary_themes, key_phrases, summary_en, "
    "emotion_tags, action_signal, language_detected"
)
# What each of the thirteen answers of label_parse must come to.
_PARSED = [
    _DEFAULT_LABEL, _FALLBACK_LABEL, ("neutral", 0.7, *_DEFAULT_LABEL[2:]), _FALLBACK_LABEL,
    _FALLBACK_LABEL,
    ("neutral", 0.5, "communication", "", "a|b", "", "Stressed", "no_action", "en"),
    _FALLBACK_LABEL, _FALLBACK_LABEL,
    ("negative", 0.5, "communication", "", "", "S", "", "monitor", "de"),
    _FALLBACK_LABEL, _FALLBACK_LABEL, _FALLBACK_LABEL,
    ("neutral", 1.0, *_DEFAULT_LABEL[2:]),
]


def label_values(rows) -> str:
    return values([(i, *row) for i, row in enumerate(rows)])


def error_line(pos: str, shown: str, loc: str, msg: str) -> str:
    return f"'Record ' || {pos} || ' [' || {shown} || ']: (''' || {loc} || ''',) — ' || {msg}"


ERRORS = f"""WITH {CHECKED}
SELECT pos, CAST(0 AS INT) AS err_ord, {error_line('pos', 'response_id', "'text'", 'msg')} AS error
FROM checked WHERE msg IS NOT NULL"""

HISTOGRAM = """WITH bound(le, b) AS ({bounds})
SELECT event_type AS {label}, observations, total, le,
  count(*) FILTER (value <= b) AS bucket_count
FROM events JOIN (
  SELECT event_type, count(value) AS observations,
    CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) AS total FROM events GROUP BY event_type
) USING (event_type), bound GROUP BY ALL"""


def histogram(bounds, label: str) -> str:
    rows = [(str(b), f"{b}e0") for b in bounds] + [("+Inf", "'Infinity'::DOUBLE")]
    return HISTOGRAM.format(
        label=label, bounds="VALUES " + ", ".join(f"('{le}', {b})" for le, b in rows)
    )


RESULT = f"""response_id, scored.text AS anonymized_text, department, language_detected, sentiment,
  sentiment_confidence, primary_theme, array_to_string(secondary_themes, {SEP}) AS secondary_themes,
  array_to_string(terms[1:4], {SEP}) AS key_phrases, lead AS summary_en,
  array_to_string(emotion_tags, {SEP}) AS emotion_tags, action_signal, -1 AS topic_id,
  'N/A' AS topic_label, '' AS topic_keywords, risk_score AS burnout_risk_score,
  risk_level AS burnout_risk_level, risk_factors AS burnout_risk_factors"""


def joined_labels(source: str) -> str:
    """CTE ``joined``: ``source`` with its lexical labels."""
    return f"""joined AS (
  SELECT m.*, sentiment, sentiment_confidence, primary_theme, secondary_themes, emotion_tags,
    language_detected, terms, lead, {action(
        'sentiment', 'list_concat([primary_theme], secondary_themes)',
        f"regexp_matches(m.text, {q(LEAVING)})")} AS action_signal
  FROM {source} m JOIN sent USING (response_id) JOIN themes USING (response_id)
    JOIN emo USING (response_id) JOIN lang USING (response_id) JOIN keys USING (response_id)
    JOIN lead USING (response_id))"""


ORACLE = {
    "analyze": f"""{ANALYZED}
SELECT response_id, {masked('text')} AS anonymized_text, department, language AS language_detected,
  sentiment, sentiment_confidence, primary_theme,
  array_to_string(secondary_themes, {SEP}) AS secondary_themes, '' AS key_phrases, '' AS summary_en,
  array_to_string(emotion_tags, {SEP}) AS emotion_tags, action_signal, -1 AS topic_id,
  'N/A' AS topic_label, '' AS topic_keywords, risk_score AS burnout_risk_score,
  risk_level AS burnout_risk_level, risk_factors AS burnout_risk_factors
FROM scored""",
    "analyze_lexicon": f"""WITH {VALID},
masked AS (SELECT pos, response_id, department, {masked('text')} AS text FROM valid),
{lexical('masked')}, {joined_labels('masked')}, {scored('joined')}
SELECT {RESULT} FROM scored""",
    "analyze_repeated": f"""WITH survey AS (
  SELECT turn AS pos, 'c' || conv_id AS response_id, text, role AS department FROM conversations),
valid AS (SELECT *, {STRIPPED} AS stripped FROM survey
  WHERE length(text) BETWEEN 5 AND 5000 AND length({STRIPPED}) > 0),
masked AS (SELECT response_id, arg_max({masked('stripped')}, pos) AS text FROM valid GROUP BY 1),
{lexical('masked')}, {joined_labels('masked')}, {scored('joined')}
SELECT v.pos, v.department, {RESULT.replace(' department,', '')}
FROM scored JOIN valid v USING (response_id)""",
    "analyze_summary": f"""WITH {CHECKED}
SELECT count(*) FILTER (msg IS NULL AND pos % 7 <> 3) AS total_processed,
  count(msg) AS validation_errors FROM checked""",
    "src_rename": """SELECT CAST(doc_id AS VARCHAR) AS response_id, text,
  CAST(NULL AS VARCHAR) AS department, lang AS language, CAST(NULL AS VARCHAR) AS employee_id,
  CAST(NULL AS VARCHAR) AS survey_theme FROM documents""",
    "json_records": """SELECT event_id // 5 AS request_id,
  CAST(row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id) - 1 AS INT) AS pos,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "run_words": RUN_WORDS,
    "sentiment_model": f"""SELECT CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 3 AS INT) AS fold,
  count(*) AS rows, count(*) FILTER (lang = 'en') AS ones,
  true AS most_right, true AS sure FROM documents GROUP BY fold""",
    "embed_cache_reads": """SELECT d.doc_id, length(text)::DOUBLE AS length,
  CASE WHEN text IN (SELECT text FROM documents SEMI JOIN labels USING (doc_id)) THEN 1e0 ELSE 2e0 END AS run
FROM documents d""",
    "topic_sparse": """WITH p AS (
  SELECT doc_id AS id, doc_id % 7 AS topic, CASE WHEN doc_id % 97 = 0 THEN 4.5e0 + doc_id / 97e0 * 0.13e0 % 1.5e0
    ELSE doc_id % 7 * 0.6e0 + doc_id * 7919 % 10007 / 10007e0 * 0.05e0 END AS a FROM documents),
near AS (
  SELECT x.id, round(cos(x.a - y.a), 4) AS s FROM p x JOIN p y ON x.id <> y.id
  QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY s DESC, y.id) <= 5),
found AS (SELECT id, round(avg(s), 6) AS density FROM near GROUP BY id),
middle AS (SELECT round(quantile_cont(density, 0.5), 6) AS m FROM found),
spread AS (SELECT greatest(quantile_cont(round(abs(density - m), 6), 0.5), 0.001) AS s FROM found, middle)
SELECT id, CASE WHEN round(m - density, 6) > round(3 * s, 6) THEN -1 ELSE topic END::INT AS topic_id,
  round(density, 4) AS density FROM found JOIN p USING (id), middle, spread""",
    "csv_upload": UPLOADED,
    "json_upload": UPLOADED,
    "fill_ids": """SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 1 THEN 'd' || doc_id
  ELSE 'resp_' || printf('%05d', doc_id) || '_' || substr(sha256(text), 1, 6) END AS response_id
FROM documents""",
    "preview": """SELECT doc_id AS pos, 'd' || doc_id AS response_id, text, lang AS language
FROM documents ORDER BY doc_id LIMIT 10""",
    "kb_seeded": f"""WITH {KB}, filled AS (
  SELECT source AS topic, text FROM documents
  UNION ALL SELECT topic, text FROM kb WHERE NOT EXISTS (FROM documents)),
was_empty AS (
  SELECT source AS topic, text FROM documents WHERE lang = 'hi'
  UNION ALL SELECT topic, text FROM kb WHERE NOT EXISTS (FROM documents WHERE lang = 'hi'))
SELECT 'filled' AS kb, topic, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM filled GROUP BY ALL UNION ALL
SELECT 'was_empty', topic, count(*), CAST(sum(length(text)) AS BIGINT) FROM was_empty GROUP BY ALL""",
    # Labelled documents are there already, so each document is in the result once.
    "kb_append": """SELECT 'd' || doc_id AS id, coalesce(source, 'general') AS topic, text FROM documents
UNION ALL SELECT 'b' || item_id, 'general', text FROM benchmark""",
    "embed_cache_misses": """SELECT sha256(text) AS text_hash, CAST(any_value(length(text)) AS INT) AS n_chars
FROM documents WHERE text NOT IN (
  SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
GROUP BY sha256(text)""",
    "validate_rows": f"""WITH {CHECKED}
SELECT pos, response_id, CASE WHEN msg IS NULL THEN {STRIPPED} ELSE text END AS text,
  msg IS NULL AS is_valid, CASE WHEN msg IS NULL THEN 0 ELSE 1 END AS n_errors,
  coalesce(msg, '') AS errors FROM checked""",
    "validate_split": f"""WITH {CHECKED}
SELECT pos, response_id, CASE WHEN msg IS NULL THEN 'valid' ELSE 'invalid' END AS split,
  CASE WHEN msg IS NULL THEN {STRIPPED} ELSE text END AS text FROM checked""",
    "validate_errors": ERRORS,
    "validate_errors_top50": ERRORS + " ORDER BY pos LIMIT 50",
    "validate_summary": f"""WITH {CHECKED}
SELECT count(*) FILTER (msg IS NULL) AS valid_count, count(msg) AS invalid_count,
  coalesce(round(count(*) FILTER (msg IS NULL) / nullif(CAST(count(*) AS DOUBLE), 0), 4), 0e0)
    AS pass_rate FROM checked""",
    "validate_json": f"""WITH r AS (
  SELECT doc_id AS pos, doc_id % 8 AS kind, text, CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN length(text) < 5 THEN {q(K.MSG_SHORT)} WHEN length(text) > 5000 THEN {q(K.MSG_LONG)}
    END AS msg FROM documents),
e(pos, err_ord, shown, loc, msg) AS (
  SELECT pos, 0, '?', 'response_id', {q(K.MSG_MISSING)} FROM r WHERE kind = 0 UNION ALL
  SELECT pos, 1, '?', 'text', {q(K.MSG_MISSING)} FROM r WHERE kind = 0 UNION ALL
  SELECT pos, 0, id, 'response_id', {q(K.MSG_NOT_STRING)} FROM r WHERE kind = 1 UNION ALL
  SELECT pos, 1, id, 'text', {q(K.MSG_NOT_STRING)} FROM r WHERE kind = 1 UNION ALL
  SELECT pos, 0, id, 'text', msg FROM r WHERE kind IN (2, 3, 6, 7) AND msg IS NOT NULL UNION ALL
  SELECT pos, CASE WHEN msg IS NULL THEN 0 ELSE 1 END, id, 'department', {q(K.MSG_NOT_STRING)}
    FROM r WHERE kind = 2 UNION ALL
  SELECT pos, 0, id, 'text', {q(K.MSG_BLANK)} FROM r WHERE kind = 4 UNION ALL
  SELECT pos, 0, 'None', 'response_id', {q(K.MSG_NOT_STRING)} FROM r WHERE kind = 5 UNION ALL
  SELECT pos, 1, 'None', 'text', {q(K.MSG_SHORT)} FROM r WHERE kind = 5)
SELECT pos, CAST(err_ord AS INT) AS err_ord, {error_line('pos', 'shown', 'loc', 'msg')} AS error
FROM e""",
    "pii_mask": f"WITH {SURVEY} SELECT response_id, {masked('text')} AS anonymized_text FROM survey",
    "pii_blank": f"""WITH {SURVEY} SELECT response_id, CASE doc % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END
  AS anonymized_text, FALSE AS blank_detected FROM (SELECT *, pos AS doc FROM survey) WHERE pos % 3 < 2
UNION ALL SELECT response_id, {masked('text')}, {masked('text')} <> text FROM survey WHERE pos % 3 = 2""",
    "pii_links": "SELECT page_id, url AS masked_url FROM pages",
    "pii_types": f"""WITH {SURVEY}, {runs('survey', r'\b[0-9]{13,19}\b', LUHN, '[CREDIT_CARD]')},
steps AS (
  SELECT response_id, department, language, survey_theme, text AS t0, masked AS t1,
    regexp_replace(t1, {q(K.EMAIL_PATTERN)}, '[EMAIL]', 'g') AS t2,
    regexp_replace(t2, {q(K.PHONE_PATTERN)}, '[PHONE]', 'g') AS t3,
    regexp_replace(t3, {q(K.PERSON_PATTERN)}, '[PERSON]', 'g') AS t4 FROM out),
found AS (
  SELECT *, list_filter([CASE WHEN t1 <> t0 THEN 'CREDIT_CARD' END,
    CASE WHEN t2 <> t1 THEN 'EMAIL' END, CASE WHEN t3 <> t2 THEN 'PHONE' END,
    CASE WHEN t4 <> t3 THEN 'PERSON' END], lambda x: x IS NOT NULL) AS types FROM steps)
SELECT response_id, len(types) > 0 AS pii_detected, array_to_string(types, {SEP}) AS pii_types,
  array_to_string(list_transform(types, lambda x: '[' || x || ']'), {SEP}) AS placeholders,
  department, language, survey_theme FROM found""",
    "pii_cards": f"""WITH {SURVEY}, {runs('survey', r'\b[0-9]{13,19}\b', LUHN, '[CREDIT_CARD]')}
SELECT response_id, array_to_string(l, {SEP}) AS cards, masked FROM out""",
    "pii_iban": f"""WITH {SURVEY}, account AS (
  SELECT response_id, text || ' DE' || printf('%02d', pos % 97 + 2)
    || printf('%018d', (pos * 7919) % 1000003) AS text FROM survey),
{runs('account', r'\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b', MOD97, '[IBAN]')}
SELECT response_id, array_to_string(l, {SEP}) AS ibans, masked FROM out""",
    "label_chunks": """SELECT 'd' || doc_id AS response_id, doc_id // 10 AS chunk,
  doc_id % 10 AS id_in_chunk FROM documents""",
    "label_ledger": """SELECT doc_id // 10 AS chunk, count(*)::INT AS records,
  md5('[' || string_agg(printf('{"id": %d, "response_id": "d%d"}', doc_id % 10, doc_id), ', ' ORDER BY doc_id) || ']') AS answer
FROM documents GROUP BY doc_id // 10""",
    "label_hook": f"""SELECT 'd' || doc_id AS response_id,
  {array(K.SENTIMENTS)}[length(text) % 5 + 1] AS sentiment,
  (length(text) % 101) / 100e0 AS sentiment_confidence, 'communication' AS primary_theme,
  '' AS secondary_themes, 'd' || doc_id AS key_phrases, '' AS summary_en, '' AS emotion_tags,
  {array(K.ACTIONS)}[length(text) % 4 + 1] AS action_signal, 'en' AS language_detected
FROM documents""",
    "label_parse": f"""WITH p(kind, {_LABEL_COLUMNS}) AS ({label_values(_PARSED)})
SELECT 'd' || doc_id AS response_id, sentiment,
  CAST(sentiment_confidence AS DOUBLE) AS sentiment_confidence, primary_theme, secondary_themes,
  key_phrases, summary_en, emotion_tags, action_signal, language_detected
FROM documents JOIN p ON kind = doc_id % 13""",
    "label_chunk_fallback": """WITH c AS (
  SELECT *, bool_and(length(text) % 23 <> 0) OVER (PARTITION BY doc_id // 10) AS ok FROM documents)
SELECT 'd' || doc_id AS response_id, 'neutral' AS sentiment,
  CASE WHEN ok THEN 0.5e0 ELSE 0e0 END AS sentiment_confidence, 'communication' AS primary_theme,
  '' AS secondary_themes, '' AS key_phrases,
  CASE WHEN ok THEN lang ELSE 'Analysis failed.' END AS summary_en, '' AS emotion_tags,
  'no_action' AS action_signal, CASE WHEN ok THEN 'en' ELSE 'unknown' END AS language_detected
FROM c""",
    "label_align": """SELECT 'd' || doc_id AS response_id, 'answer ' || (doc_id % 10 + 1) AS summary_en
FROM documents WHERE doc_id % 10 < (doc_id // 10) % 13""",
    "sentiment_lexicon": f"""{LEXICAL}
SELECT response_id, pos_weight, neg_weight, sentiment, sentiment_confidence FROM sent""",
    "theme_tags": f"""{LEXICAL}
SELECT response_id, primary_theme, array_to_string(secondary_themes, {SEP}) AS secondary_themes
FROM themes""",
    "emotion_tags": f"""{LEXICAL}
SELECT response_id, array_to_string(emotion_tags, {SEP}) AS emotion_tags FROM emo""",
    "key_phrases": f"""WITH w AS (
  SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
  FROM (SELECT doc_id, {tokens('text')} AS ts FROM documents)),
c AS (SELECT * FROM w WHERE t NOT IN {in_list(PROSE.stop_words)} AND length(t) >= 4),
phrase AS (
  SELECT doc_id, t AS phrase FROM c
  UNION ALL SELECT a.doc_id, a.t || ' ' || b.t FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.i = a.i + 1),
tf AS (SELECT doc_id, phrase, count(*) AS tf FROM phrase GROUP BY ALL),
s AS (
  SELECT doc_id, phrase, round(tf * ln((SELECT count(*) FROM documents)
    / count(*) OVER (PARTITION BY phrase)), 6) AS score FROM tf)
SELECT doc_id, phrase,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INT) AS rank
FROM s QUALIFY rank <= 4""",
    "action_signal": f"""{LABELLED}
SELECT response_id, {action('sentiment', 'list_concat([primary_theme], secondary_themes)',
                            f"regexp_matches(text, {q(LEAVING)})")} AS action_signal FROM labelled""",
    "detect_language": f"""{LEXICAL}
SELECT response_id, language, language_detected FROM lang JOIN survey USING (response_id)""",
    "lead_sentence": f"""{LEXICAL}
SELECT response_id, array_to_string(terms, {SEP}) AS terms, lead
FROM keys JOIN lead USING (response_id)""",
    "burnout_score": f"{SCORED} SELECT response_id, risk_score, risk_level FROM scored",
    "burnout_emotion": f"""{SCORED}
SELECT response_id, round(emotion_part, 4) AS emotion_part, sentiment_part, theme_part, action_part
FROM scored""",
    "burnout_factors": f"{SCORED} SELECT response_id, risk_factors, protective_factors FROM scored",
    "merge_inner": f"""WITH {VALID}, {labelled('survey')}, {scored()}
SELECT v.response_id, v.pos, v.department, sentiment, risk_score
FROM valid v JOIN scored s USING (response_id) JOIN labels l ON l.doc_id = v.pos""",
    "merge_last_wins": """SELECT 'c' || conv_id AS response_id, turn AS pos, role AS department,
  last_value(role) OVER w AS label, last_value(text) OVER w AS text FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "merge_topics": f"""WITH {SURVEY}
SELECT pos, response_id, department, coalesce(label, -1) AS topic_id,
  coalesce('Topic ' || label, 'N/A') AS topic_label,
  coalesce(CAST(label AS VARCHAR), '') AS topic_keywords
FROM survey LEFT JOIN embeddings ON vec_id = pos""",
    "freq_tables": f"{FREQ} SELECT dim, value, n FROM freq",
    "cohort_stats": f"""{FREQ}, {TOTALS}
SELECT total, avg_burnout_score, urgent_action_count,
  (SELECT string_agg(value, '|' ORDER BY ord) FROM {top('theme')}) AS top_themes,
  {pairs(of('sentiment'))} AS sentiment_dist, {pairs(of('theme'))} AS theme_distribution,
  {pairs(of('risk_level'))} AS burnout_summary, {pairs(of('action'))} AS action_distribution,
  {pairs(top('department'))} AS department_distribution
FROM totals WHERE total > 0""",
    "cohort_empty": f"""{FREQ}, {TOTALS}
SELECT 'full' AS cohort, total, avg_burnout_score FROM totals WHERE total > 0""",
    "top_themes": f"{FREQ} SELECT value, n, first_pos FROM {top('theme')}",
    "top_departments": f"{FREQ} SELECT value, n, first_pos FROM {top('department')}",
    "kpi_tiles": f"""{ANALYZED}
SELECT count(*) AS total_analyzed,
  count(*) FILTER (action_signal = 'urgent_action') AS urgent_actions,
  count(*) FILTER (risk_level IN ('high', 'critical')) AS high_critical_burnout,
  CAST(round(CAST(sum(CAST(risk_score AS DECIMAL(9,4))) AS DECIMAL(38,8)) / count(*), 2) AS DOUBLE)
    AS avg_burnout_score FROM scored""",
    "value_counts": f"""{ANALYZED}
SELECT sentiment AS value, count(*) AS n FROM scored GROUP BY ALL
UNION ALL SELECT risk_level, count(*) FROM scored GROUP BY ALL""",
    "urgent_rows": f"""{ANALYZED}
SELECT response_id, {masked('text')} AS anonymized_text, sentiment,
  risk_score AS burnout_risk_score FROM scored WHERE action_signal = 'urgent_action'""",
    "business_counters": f"""{ANALYZED}
SELECT count(*) AS surveys_analyzed,
  count(*) FILTER (risk_level IN ('high', 'critical')) AS burnout_high_risk,
  count(*) FILTER (action_signal = 'urgent_action') AS urgent_actions,
  count(*) FILTER ({masked('text')} <> text) AS pii_detected,
  (SELECT count(*) FROM (SELECT max(pos) FROM scored HAVING count(*) > 0)) AS insights_generated FROM scored""",
    "stream_counters": f"""{ANALYZED}
SELECT 'surveys_analyzed' AS counter, '' AS labels, count(*) AS n FROM scored
UNION ALL SELECT 'burnout_high_risk', '', count(*) FILTER (risk_level IN ('high', 'critical')) FROM scored
UNION ALL SELECT 'urgent_actions', '', count(*) FILTER (action_signal = 'urgent_action') FROM scored
UNION ALL SELECT 'responses', sentiment || '/' || primary_theme, count(*) FROM scored GROUP BY ALL""",
    "labelled_counter": """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS status,
  count(*) AS n FROM events GROUP BY ALL""",
    "latency_histogram": histogram(K.REQUEST_BUCKETS, "event_type"),
    "model_latency_histogram": histogram(K.MODEL_CALL_BUCKETS, "operation"),
    "vectors_unit_norm": """SELECT vec_id,
  round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm_before,
  1e0 AS norm_after FROM embeddings""",
    "topic_outliers": f"WITH {folded(50)} SELECT vec_id, label, topic_id FROM folded",
    "topic_keywords": f"""WITH {topic_terms('documents', 'source')}
SELECT source, CAST(rank AS INT) AS rank, term, score FROM ranked WHERE rank <= 5""",
    "topic_keywords_rerank": f"""WITH joined AS (
  SELECT doc_id, text, embedding, label FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
kept AS (
  SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS topic_id
  FROM (SELECT label, count(*) AS n FROM joined WHERE label IS NOT NULL GROUP BY label) WHERE n >= {K.MIN_TOPIC_SIZE}
  QUALIFY topic_id < {K.N_TOPICS}),
docs AS (
  SELECT doc_id, text, embedding, coalesce(topic_id, -1) AS topic_id FROM joined LEFT JOIN kept USING (label)),
{topic_terms('docs', 'topic_id')},
candidate AS (SELECT topic_id, term FROM ranked WHERE rank <= 30),
comp AS (
  SELECT doc_id, topic_id, generate_subscripts(embedding, 1) AS i,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM docs),
used AS (
  SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM docs)
  WHERE term IN (SELECT term FROM candidate)),
tv AS (SELECT term, i, avg(x) AS x FROM used JOIN comp USING (doc_id) GROUP BY ALL),
cv AS (SELECT topic_id, i, avg(x) AS x FROM comp WHERE topic_id <> -1 GROUP BY ALL),
sim AS (
  SELECT topic_id, term,
    round(sum(tv.x * cv.x) / (sqrt(sum(tv.x * tv.x)) * sqrt(sum(cv.x * cv.x))), 4) AS similarity
  FROM candidate JOIN tv USING (term) JOIN cv USING (topic_id, i) GROUP BY ALL)
SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, term) AS INT)
  AS rank, term, similarity FROM sim QUALIFY rank <= 5""",
    "topic_fit": made_topics("true", "true"),
    "topic_reuse": made_topics("(doc_id // 10) % 2 = 0", "NOT fitted"),
    "topic_labels": f"""WITH {topic_terms('documents', 'source')}
SELECT source, string_agg(term, ' / ' ORDER BY rank) FILTER (rank <= 3) AS topic_label,
  string_agg(term, '|' ORDER BY rank) AS topic_keywords FROM ranked WHERE rank <= 5 GROUP BY source""",
    "topic_confidence": f"""WITH {CENTROIDS},
p AS (SELECT vec_id, exp(cos) / sum(exp(cos)) OVER (PARTITION BY vec_id) AS p, own, topic_id FROM near)
SELECT vec_id, topic_id, coalesce(c, 0e0) AS topic_confidence FROM folded LEFT JOIN (
  SELECT vec_id, round(least(1e0, p), 4) AS c FROM p WHERE own = topic_id) USING (vec_id)""",
    "topic_predict": f"""WITH {CENTROIDS}
SELECT vec_id, arg_max(topic_id, (cos, -topic_id)) AS topic_id FROM near GROUP BY vec_id""",
    "cosine_topk": f"""WITH {ASKED_VECTORS} {nearest_of('asked, embeddings')}""",
    "cosine_topk_lsh": f"""WITH {ASKED_VECTORS},
a AS ({bucket_keys('embeddings', 'vec_id', 'embedding', 24, 4)}),
b AS ({bucket_keys('asked', 'query_id', 'q', 24, 4)}),
pair AS (SELECT DISTINCT vec_id, query_id FROM a JOIN b USING (t, key))
{nearest_of('pair JOIN asked USING (query_id) JOIN embeddings USING (vec_id)')}""",
    "text_topk": f"""WITH corpus AS (SELECT doc_id AS id, text FROM documents),
asked AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 20 = 0),
{text_topk([])}
SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM results""",
    "report_queries": f"{REPORT_QUERIES} SELECT query_id, query FROM asked",
    "report_context": f"{REPORT_QUERIES}, {KB}, {CONTEXT} SELECT ord, text FROM context",
    "report_findings": f"""{FREQ}, {TOTALS}, {FINDINGS}
SELECT CAST(ord AS INT) AS ord, finding FROM line WHERE (SELECT total FROM totals) > 0""",
    "report_actions": f"""{FREQ}, {KB}, {ACTIONS}
SELECT ord, priority, theme, action, owner FROM act""",
    "report_json": f"{REPORT_QUERIES}, {KB}, {FINDINGS}, {ACTIONS}, {CONTEXT} {REPORT}",
    "synth_survey": SYNTH,
}
