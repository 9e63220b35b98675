"""The registered queries once more as DuckDB SQL, for checking results.

DuckDB's regular expressions have no look-around. Where a boundary matters the
text is cut into runs of word and non-word characters, or every non-word
character is fenced with ``\\x01`` so that a boundary becomes a character.
"""

from __future__ import annotations

from ..functions.fixed_values import STOP_WORDS, UNDETERMINED, TOO_BRIEF_MESSAGE
from .queries import HIGHLIGHT_QUERY, LARGE_FILE, WARNING_PAGES, WORD_PIECE

# The public English stop list of Spark ML's StopWordsRemover.
SPARK_ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't
hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's
why's would
""".split()

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
TEXT_RUNS = rf"'{WORD}+|[^\p{{L}}\p{{N}}_]+'"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOPS = _quoted(STOP_WORDS)
_ML_STOPS = _quoted(SPARK_ENGLISH_STOP_WORDS)


# --- fragments ---------------------------------------------------------------

def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean(x: str) -> str:
    c = f"coalesce({x}, '')"
    for a, b in (("“", '"'), ("”", '"'), ("’", "''"), ("‘", "''"), ("—", " - "), ("–", " - ")):
        c = f"replace({c}, '{a}', '{b}')"
    c = f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    c = rf"regexp_replace({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    c = rf"regexp_replace({c}, '[ \t]+', ' ', 'g')"
    c = rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(c)


def _pieces(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def paragraphs(c: str) -> str:
    return _pieces(rf"regexp_split_to_array({c}, '\n{SPACE}*\n+')")


def sentences(c: str) -> str:
    marked = rf"""regexp_replace({c}, '([.!?]){SPACE}+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g')"""
    return _pieces(f"string_split({marked}, chr(1))")


def _tokens(x: str, plain_run: str, token: str) -> str:
    """Words touching other letters are blanked as whole runs, then tokens are extracted."""
    blanked = (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), {TEXT_RUNS}), lambda r: "
        f"CASE WHEN regexp_matches(r, '{WORD}') AND NOT regexp_full_match(r, '{plain_run}') THEN ' ' ELSE r END), '')"
    )
    return f"regexp_extract_all({blanked}, '{token}')"


def words(x: str) -> str:
    return _tokens(x, "[a-z0-9]+", "[a-z0-9]+(?:[-''][a-z0-9]+)*")


def keyword_tokens(x: str) -> str:
    return _no_stops(_tokens(x, "[a-z]{3,}", "[a-z]{3,}(?:-[a-z]{3,})*"))


def search_tokens(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '{WORD}+')"
    return _no_stops(f"list_filter({runs}, lambda r: regexp_full_match(r, '[a-z0-9]{{2,}}'))")


def classifier_tokens(x: str) -> str:
    return _no_stops(f"regexp_extract_all(lower({x}), '{WORD}{{2,}}')", _ML_STOPS)


def _no_stops(tokens: str, stops: str = _STOPS) -> str:
    return f"list_filter({tokens}, lambda t: t NOT IN ({stops}))"


def grams(t: str) -> str:
    """Unigrams and bigrams of a token list held in column t."""
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def half_up(numerator: str, denominator: str, scale: int) -> str:
    return f"CASE WHEN {denominator} = 0 THEN 0.0::DOUBLE ELSE floor((2 * 10 ** {scale} * {numerator} + {denominator}) / (2 * {denominator})) / (10 ** {scale})::DOUBLE END"


def fenced(x: str) -> str:
    return rf"chr(1) || regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', chr(1) || '\1' || chr(1), 'g') || chr(1)"


def occurrences(text: str, phrase: str) -> str:
    f, p = fenced(text), fenced(phrase)
    return f"((length({f}) - length(replace({f}, {p}, ''))) // length({p}))"


def mark_pattern(tokens: str) -> str:
    inner = rf"regexp_replace(regexp_replace(t, '([^a-z0-9])', chr(1) || '\\\1' || chr(1), 'g'), 'x^', '')"
    return f"'(?i)' || chr(1) || '(' || array_to_string(list_transform({tokens}, lambda t: {inner}), '|') || ')' || chr(1)"


def highlighted(text: str, tokens: str) -> str:
    h = f"replace(regexp_replace({fenced(text)}, {mark_pattern(tokens)}, chr(2) || '\\1' || chr(3), 'g'), chr(1), '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        h = f"replace({h}, '{a}', '{b}')"
    h = f"""replace(replace({h}, chr(2), '<mark class="search-match">'), chr(3), '</mark>')"""
    return h


def matched(text: str, tokens: str) -> str:
    found = f"regexp_extract_all({fenced(text)}, {mark_pattern(tokens)}, 1)"
    return (
        f"coalesce(array_to_string(list_sort(list_distinct(list_transform({found}, lambda m: "
        f"lower(replace(m, chr(1), ''))))), '|'), '')"
    )


def highlight_tokens(q: str) -> str:
    w = words(q)
    kept = f"list_filter({_no_stops(w)}, lambda t: length(t) > 1)"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {w} END"


def exploded(source: str, pieces: str, name: str) -> str:
    return f"""
    WITH p AS (SELECT doc_id, {pieces} AS l FROM {source})
    SELECT doc_id, generate_subscripts(l, 1)::BIGINT AS position, unnest(l) AS {name} FROM p"""


# --- inputs ------------------------------------------------------------------

DOUBLED = "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"
_R, _N, _T = "chr(13)", "chr(10)", "chr(9)"
MESSY = f"""(SELECT doc_id, '  ' || replace(replace(text, {_N}, {_R}||{_N}||{_R}||{_N}||' '||{_R}||{_N}||{_R}), ', ',
    {_T} || '—' || chr(7) || ' “x”' || chr(133) || ' ‘y’ ') || '  ' || {_N} AS text FROM documents)"""
PAGES = "(SELECT conv_id AS doc_id, turn + 1 AS page_number, text FROM conversations)"
GUESSES = """(SELECT lang AS label, CASE WHEN contains(lower(text), ' the ') THEN 'en'
    WHEN contains(lower(text), ' und ') THEN 'de' WHEN contains(lower(text), ' le ') THEN 'fr' ELSE 'es' END AS prediction
    FROM documents)"""
FILES = r"""files AS (
    SELECT doc_id, source || '/' || doc_id ||
        CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.v2.TXT' WHEN 'de' THEN '.docx' ELSE '' END AS path,
        CASE WHEN source = 'src1' THEN regexp_replace(text, '[^\n]', ' ', 'g')
             WHEN source = 'src2' THEN regexp_replace(text, '[^\n]', chr(160), 'g')
             WHEN source = 'src3' THEN '' ELSE text END AS content
    FROM documents),
routed AS (
    SELECT *, string_split(path, '/')[-1] AS file_name,
        CASE WHEN contains(path, '.') THEN '.' || lower(string_split(path, '.')[-1]) ELSE '' END AS extension
    FROM files)"""
LABELLED = f"""(SELECT * FROM (SELECT doc_id, lang AS category, {strip('text')} AS text FROM documents) WHERE length(text) > 10)"""


def _keyword_rank(weights: str, top: int = 15) -> str:
    return f"""
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank,
        max(w) OVER (PARTITION BY doc_id) AS best, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm
    FROM {weights}),
keywords AS (
    SELECT r.doc_id, r.rank::BIGINT AS rank, r.term AS keyword, round(w / best, 4) AS score, round(w / norm, 4) AS tfidf_raw,
        greatest(1, {occurrences('lower(c)', 'r.term')})::BIGINT AS frequency,
        CASE WHEN contains(r.term, ' ') THEN 'bigram' ELSE 'unigram' END AS ngram_type
    FROM ranked r JOIN cleaned USING (doc_id) WHERE rank <= {top})"""


def _cleaned(source: str) -> str:
    return f"cleaned AS (SELECT doc_id, {clean('text')} AS c FROM {source})"


LONG_ENOUGH = rf"len(regexp_extract_all(c, '[^\s\x0b\x1c-\x1f\x85\p{{Z}}]+')) >= 3"


def _fallback_keywords(where: str) -> str:
    return f"""
fallback AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::BIGINT AS rank, term AS keyword,
        round(n / max(n) OVER (PARTITION BY doc_id), 4) AS score, round(n / max(n) OVER (PARTITION BY doc_id), 4) AS tfidf_raw,
        n::BIGINT AS frequency, 'unigram' AS ngram_type
    FROM (SELECT doc_id, term, count(*) AS n, min(pos) AS first
          FROM (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos
                FROM (SELECT doc_id, {_no_stops(words('c'))} AS l FROM cleaned WHERE {where}))
          WHERE length(term) > 3 GROUP BY ALL)
    QUALIFY rank <= 15)"""


def local_keywords(source: str) -> str:
    return f"""{_cleaned(source)},
parts AS (SELECT doc_id, c, {paragraphs('c')} AS p, {sentences('c')} AS s FROM cleaned WHERE {LONG_ENOUGH}),
scopes AS (SELECT doc_id, c, CASE WHEN len(p) >= 2 THEN p WHEN len(s) >= 2 THEN s ELSE [c, c] END AS rows FROM parts),
whole AS (SELECT doc_id, unnest({grams('t')}) AS term FROM (SELECT doc_id, {keyword_tokens('c')} AS t FROM scopes)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM whole GROUP BY ALL),
pieces AS (SELECT doc_id, unnest(rows) AS piece FROM scopes),
df AS (SELECT doc_id, term, count(*) AS df FROM
    (SELECT doc_id, unnest(list_distinct({grams('t')})) AS term FROM (SELECT doc_id, {keyword_tokens('piece')} AS t FROM pieces))
    GROUP BY ALL),
weights AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + len(rows)) / (1 + df)) + 1) AS w
    FROM tf JOIN df USING (doc_id, term) JOIN scopes USING (doc_id)),
{_keyword_rank('weights')},
{_fallback_keywords(f'{LONG_ENOUGH} AND doc_id NOT IN (SELECT doc_id FROM df)')},
local_keywords AS (SELECT * FROM keywords UNION ALL SELECT * FROM fallback)"""


def term_counts(source: str, name: str = "tf") -> str:
    return f"""{name} AS (SELECT doc_id, term, count(*) AS tf FROM
    (SELECT doc_id, unnest({grams('t')}) AS term FROM (SELECT doc_id, {keyword_tokens(clean('text'))} AS t FROM {source})) GROUP BY ALL)"""


def sections(source: str) -> str:
    return f"""
cut AS (SELECT doc_id, c, {paragraphs('c')} AS p FROM (SELECT doc_id, {clean('text')} AS c FROM {source})),
paras AS (SELECT doc_id, generate_subscripts(p, 1)::BIGINT AS section_id, unnest(p) AS text FROM cut),
kept AS (SELECT * FROM paras WHERE length(text) > 15),
sections AS (
    SELECT doc_id, section_id, 1::BIGINT AS page_number, text, len({words('text')})::BIGINT AS word_count
    FROM (SELECT * FROM kept UNION ALL
          SELECT doc_id, 1::BIGINT, c FROM cut WHERE c <> '' AND doc_id NOT IN (SELECT doc_id FROM kept)))"""


ASSEMBLED = f"""(SELECT doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_number) FILTER (t <> ''), '') AS text
    FROM (SELECT conv_id AS doc_id, turn + 1 AS page_number, {strip("replace(text, chr(10), chr(10) || chr(10))")} AS t FROM conversations) GROUP BY doc_id)"""
PAGED_SOURCE = "(SELECT conv_id AS doc_id, turn + 1 AS page_number, replace(text, chr(10), chr(10) || chr(10)) AS text FROM conversations)"


def sections_paged(source: str = PAGED_SOURCE) -> str:
    return f"""
page AS (SELECT doc_id, page_number, {strip('text')} AS t FROM {source}),
cut AS (SELECT doc_id, page_number, CASE WHEN len(p) > 0 THEN p ELSE [t] END AS p
        FROM (SELECT *, {paragraphs(clean('t'))} AS p FROM page)),
paras AS (SELECT doc_id, page_number, generate_subscripts(p, 1) AS pos, unnest(p) AS text FROM cut),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pos)::BIGINT AS section_id,
            page_number::BIGINT AS page_number, text FROM paras WHERE length(text) > 15),
joined AS (SELECT doc_id, {clean("string_agg(t, chr(10) || chr(10) ORDER BY page_number)")} AS text FROM page WHERE t <> '' GROUP BY doc_id),
sections AS (
    SELECT doc_id, section_id, page_number, text, len({words('text')})::BIGINT AS word_count
    FROM (SELECT * FROM kept UNION ALL
          SELECT doc_id, 1::BIGINT, 1::BIGINT, text FROM joined WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM kept)))"""


def postings(scope: str = "doc_id") -> str:
    """After ``sections``; scope is doc_id, or 0 for the whole table."""
    return f"""
counts AS (SELECT {scope} AS scope, doc_id, section_id, term, count(*) AS tf FROM
    (SELECT doc_id, section_id, unnest({grams('t')}) AS term FROM
        (SELECT doc_id, section_id, {search_tokens('text')} AS t FROM sections)) GROUP BY ALL),
sizes AS (SELECT {scope} AS scope, count(*) AS n FROM sections GROUP BY 1),
vocabulary AS (SELECT scope, term, any_value(df) AS df, any_value(ln((1 + n) / (1 + df)) + 1) AS idf FROM
    (SELECT scope, term, count(*) AS df FROM counts GROUP BY ALL) JOIN sizes USING (scope) GROUP BY ALL),
raw AS (SELECT c.*, df, idf, (1 + ln(tf)) * idf AS w FROM counts c JOIN vocabulary USING (scope, term)),
postings AS (SELECT * EXCLUDE w, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, section_id)) AS weight FROM raw)"""


TURNS = """queries AS (SELECT conv_id || '-' || turn AS query_id, conv_id AS doc_id, text AS query FROM conversations)"""
FIRST_LINES = "queries AS (SELECT doc_id AS query_id, doc_id, string_split(text, chr(10))[1] AS query FROM documents)"
PASSAGES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def vectors(targeted: bool) -> str:
    """After ``postings`` and ``queries``: normalised query weights per scope."""
    key = "query_id, doc_id AS target" if targeted else "query_id, NULL AS target"
    on = "v.term = q.term" + (" AND v.scope = q.target" if targeted else "")
    return f"""
asked AS (SELECT * FROM queries WHERE {strip('query')} <> ''),
query_counts AS (SELECT query_id, target, term, count(*) AS qf FROM
    (SELECT query_id, target, unnest({grams('t')}) AS term FROM
        (SELECT {key}, {search_tokens('query')} AS t FROM asked)) GROUP BY ALL),
query_raw AS (SELECT query_id, scope, v.term, (1 + ln(qf)) * idf AS w FROM vocabulary v JOIN query_counts q ON {on}),
vectors AS (SELECT query_id, scope, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, scope)) AS weight, sqrt(sum(w * w) OVER (PARTITION BY query_id, scope)) AS norm FROM query_raw)"""


def vector_hits(top_k: int, threshold: float) -> str:
    zero = threshold <= 0
    source = "near"
    fill = ""
    if zero:
        source = "filled"
        fill = """
filled AS (SELECT p.query_id, p.scope, s.doc_id, s.section_id, coalesce(m.dot, 0.0) AS dot, coalesce(m.score, 0.0) AS score
    FROM (SELECT DISTINCT query_id, scope FROM vectors) p JOIN sections s ON s.doc_id = p.scope
    LEFT JOIN near m ON m.query_id = p.query_id AND m.doc_id = s.doc_id AND m.section_id = s.section_id),"""
    return f"""
near AS (SELECT query_id, scope, doc_id, section_id, sum(p.weight * v.weight) AS score, sum(p.weight * v.weight * v.norm) AS dot
    FROM postings p JOIN vectors v USING (scope, term) GROUP BY ALL),{fill}
passing AS (SELECT *, max(score) OVER (PARTITION BY query_id, scope) AS best FROM {source}),
hits AS (SELECT query_id, doc_id, section_id, round(score, 4) AS score, round(score * 100, 1) AS score_percent,
        row_number() OVER (PARTITION BY query_id, scope ORDER BY round(dot, 9) DESC, doc_id, section_id)::BIGINT AS rank
    FROM passing WHERE CASE WHEN best >= {threshold} THEN score >= {threshold} ELSE score > 0.005 END
    QUALIFY rank <= {top_k})"""


def fallback_hits(targeted: bool, top_k: int, scope: str = "s.doc_id") -> str:
    """After ``vectors``: substring matches where a query has no vector in the scope."""
    tokens = f"list_filter({words('query')}, lambda t: length(t) > 1)"
    on = "ON s.doc_id = q.doc_id" if targeted else "ON true"
    return f"""
fallback_words AS (SELECT *, {tokens} AS ws FROM asked),
fallback_scores AS (SELECT query_id, {scope} AS scope, s.doc_id, section_id, len(ws) AS total,
        len(list_filter(ws, lambda w: contains(lower(s.text), w))) AS m
    FROM sections s JOIN fallback_words q {on}
    WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.query_id = q.query_id AND v.scope = {scope})),
fallback_hits AS (SELECT query_id, doc_id, section_id, {half_up('m', '(2 * total)', 4)} AS score,
        {half_up('50 * m', 'total', 1)} AS score_percent,
        row_number() OVER (PARTITION BY query_id, scope ORDER BY {half_up('m', '(2 * total)', 4)} DESC, doc_id, section_id)::BIGINT AS rank
    FROM fallback_scores WHERE m > 0 QUALIFY rank <= {top_k})"""


def _query_join(targeted: bool) -> str:
    return "(query_id, doc_id)" if targeted else "(query_id)"


def projected(hits: str, tokens: str, targeted: bool) -> str:
    return f"""SELECT query_id, doc_id, rank, section_id, page_number, score, score_percent,
    {highlighted('text', 'marks')} AS highlighted_text, text AS raw_text, {matched('text', 'marks')} AS matched_terms, word_count
FROM {hits} JOIN sections USING (doc_id, section_id) JOIN (SELECT *, {tokens} AS marks FROM queries) USING {_query_join(targeted)}"""


ALL_WORDS = f"list_filter({words('query')}, lambda t: length(t) > 1)"


def full_search(cut: str, asked: str, targeted: bool, top_k: int, threshold: float, scope: str = "doc_id") -> str:
    fallback_scope = "s.doc_id" if scope == "doc_id" else "0"
    return f"""WITH {cut}, {postings(scope)}, {asked}, {vectors(targeted)}, {vector_hits(top_k, threshold)},
{fallback_hits(targeted, top_k, fallback_scope)}
{projected('hits', highlight_tokens('query'), targeted)}
UNION ALL
{projected('fallback_hits', ALL_WORDS, targeted)}"""


SPLIT = f"""
rows AS (SELECT *, md5('42|' || doc_id) AS h FROM {LABELLED}),
sizes AS (SELECT category, count(*) AS n FROM rows GROUP BY 1),
totals AS (SELECT sum(n) AS n, ceil(round(sum(n) * 0.2, 6))::BIGINT AS tests FROM sizes),
quotas AS (SELECT category, tests * s.n // t.n AS base, tests * s.n % t.n AS rest, tests FROM sizes s, totals t),
final_quotas AS (SELECT category, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, category) <=
    tests - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM quotas),
split AS (SELECT doc_id, category, text, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY h, doc_id) <= quota
    THEN 'test' ELSE 'train' END AS split FROM rows JOIN final_quotas USING (category))"""
VOCABULARY = f"""
vocabulary AS (SELECT term, count(*)::BIGINT AS total, row_number() OVER (ORDER BY count(*) DESC, term)::BIGINT AS position FROM
    (SELECT unnest({grams('t')}) AS term FROM (SELECT {classifier_tokens('text')} AS t FROM split WHERE split = 'train'))
    GROUP BY term QUALIFY position <= 4000)"""

PER_CLASS = f"""
cells AS (SELECT label, prediction, count(*) AS n FROM {GUESSES} GROUP BY ALL),
names AS (SELECT label AS class FROM cells UNION SELECT prediction FROM cells),
sides AS (SELECT class, coalesce((SELECT sum(n) FROM cells WHERE label = class), 0) AS support,
    coalesce((SELECT sum(n) FROM cells WHERE prediction = class), 0) AS predicted,
    coalesce((SELECT sum(n) FROM cells WHERE label = class AND prediction = class), 0) AS hit FROM names),
per_class AS (SELECT class, coalesce(hit / nullif(predicted, 0), 0)::DOUBLE AS precision, coalesce(hit / nullif(support, 0), 0)::DOUBLE AS recall,
    coalesce(2 * hit / nullif(predicted + support, 0), 0)::DOUBLE AS f1, support::BIGINT AS support, hit FROM sides),
averages AS (SELECT (sum(hit) / sum(support))::DOUBLE AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
    sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted,
    sum(f1 * support) / sum(support) AS f1_weighted, sum(support)::BIGINT AS support FROM per_class)"""

LANGUAGES = ("de", "en", "es", "fr")
_EACH = range(len(LANGUAGES))
MODEL = f"""
labelled AS (SELECT doc_id, category, {classifier_tokens('text')} AS t FROM {LABELLED}),
label_terms AS (SELECT doc_id, category, term, count(*) AS tf FROM
    (SELECT doc_id, category, unnest({grams('t')}) AS term FROM labelled) GROUP BY ALL),
term_totals AS (SELECT term, sum(tf) AS total, count(*) AS df FROM label_terms GROUP BY term
    QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, term) <= 4000),
model AS (SELECT term, any_value(ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1) AS idf,
    {", ".join(f"round(8 * coalesce(sum(tf) FILTER (category = '{c}'), 0) / any_value(total), 4) AS c{i}" for i, c in enumerate(LANGUAGES))}
    FROM term_totals JOIN label_terms USING (term) GROUP BY term)"""
VECTORS = f"""
texts AS (SELECT doc_id, s, length(s) < 10 AS brief FROM (SELECT doc_id, {strip("coalesce(text, '')")} AS s FROM documents)),
doc_terms AS (SELECT doc_id, term, count(*) AS tf FROM
    (SELECT doc_id, unnest({grams('t')}) AS term FROM (SELECT doc_id, {classifier_tokens('s')} AS t FROM texts)) GROUP BY ALL),
doc_weights AS (SELECT d.*, (1 + ln(tf)) * idf AS w, {", ".join(f"c{i}" for i in _EACH)} FROM doc_terms d JOIN model USING (term))"""
PREDICTIONS = f"""{MODEL}, {VECTORS},
margins AS (SELECT doc_id, brief, {", ".join(f"coalesce(m{i}, 0.0) AS m{i}" for i in _EACH)} FROM texts LEFT JOIN
    (SELECT doc_id, {", ".join(f"sum(w * c{i}) / sqrt(sum(w * w)) AS m{i}" for i in _EACH)} FROM doc_weights GROUP BY doc_id) USING (doc_id)),
powers AS (SELECT doc_id, brief, list_transform([{", ".join(f"m{i}" for i in _EACH)}], lambda m: exp(m - greatest({", ".join(f"m{i}" for i in _EACH)}))) AS e FROM margins),
shares AS (SELECT doc_id, brief, list_transform(e, lambda x: x / list_sum(e)) AS p FROM powers),
predictions AS (SELECT doc_id, brief, p, CASE WHEN brief THEN '{UNDETERMINED}' ELSE ([{_quoted(LANGUAGES)}])[list_position(p, list_max(p))] END AS predicted_category,
    CASE WHEN brief THEN 0.0 ELSE round(list_max(p) * 100, 2) END AS confidence, CASE WHEN brief THEN 0.0 ELSE round(list_max(p), 6) END AS confidence_raw,
    CASE WHEN brief THEN '{TOO_BRIEF_MESSAGE}' ELSE 'Success' END AS message FROM shares)"""

STATISTICS = f"""
measured AS (SELECT doc_id, {words('c')} AS w, length(c) AS with_spaces,
    length(regexp_replace(c, '{SPACE}', '', 'g')) AS without, len({paragraphs('c')}) AS p, len({sentences('c')}) AS s FROM cleaned),
counted AS (SELECT *, len(w) AS wc, len(list_distinct(w)) AS uc FROM measured),
stats AS (SELECT doc_id, wc::BIGINT AS word_count, uc::BIGINT AS unique_word_count, with_spaces::BIGINT AS char_count_with_spaces,
    without::BIGINT AS char_count_no_spaces, p::BIGINT AS paragraph_count, s::BIGINT AS sentence_count, 1::BIGINT AS page_count,
    {half_up('100 * uc', 'wc', 2)} AS lexical_diversity_percent, {half_up('wc', '200', 1)} AS reading_time_minutes,
    {half_up('wc', 's', 1)} AS avg_words_per_sentence FROM counted)"""


def statements() -> dict[str, str]:
    corpus = f"""{_cleaned('documents')}, {term_counts('documents')},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
    corpus_weights = "(1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w"
    long_docs = f"(SELECT doc_id FROM cleaned WHERE {LONG_ENOUGH})"
    return {
        "ingest_route": f"""WITH {FILES} SELECT doc_id, path, file_name, extension,
            CASE WHEN extension = '.txt' THEN 'text' WHEN extension = '.pdf' THEN 'pdf' ELSE 'unsupported' END AS route FROM routed""",
        "decode_text": "SELECT doc_id, text FROM documents",
        "ingest_documents": f"""WITH {FILES} SELECT path AS doc_id, file_name, 'txt' AS file_type, content AS raw_text,
            1::BIGINT AS page_count, 'Plain Text' AS format FROM routed WHERE extension = '.txt' AND {strip('content')} <> ''""",
        "ingest_errors": f"""WITH {FILES} SELECT path,
            CASE WHEN extension NOT IN ('.txt', '.pdf') THEN 'UNSUPPORTED_FORMAT'
                 WHEN strlen(content) > {LARGE_FILE} THEN 'FILE_TOO_LARGE'
                 WHEN contains(content, chr(160)) THEN 'ONLY_WHITESPACE' ELSE 'EMPTY_FILE' END AS error_code,
            CASE WHEN extension NOT IN ('.txt', '.pdf') THEN 'Unsupported file format ''' || extension || ''': only .pdf and .txt are read.'
                 WHEN strlen(content) > {LARGE_FILE} THEN 'The file is too large to be read in one piece.'
                 WHEN contains(content, chr(160)) THEN 'The file contains only whitespace.'
                 ELSE 'The file is empty (0 bytes of text).' END AS message
            FROM routed WHERE extension NOT IN ('.txt', '.pdf') OR strlen(content) > {LARGE_FILE} OR {strip('content')} = ''""",
        "assemble_pages": f"""WITH p AS (SELECT *, {strip('text')} AS t FROM {PAGES}),
            d AS (SELECT doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_number) FILTER (t <> ''), '') AS raw_text,
                count(*) AS page_count, coalesce(sum(length(t)), 0)::BIGINT AS char_count FROM p GROUP BY doc_id)
            SELECT doc_id, raw_text, page_count, char_count, 'Untitled' AS title, coalesce(nullif(source, ''), 'Unknown') AS author
            FROM d LEFT JOIN documents USING (doc_id)""",
        "ingest_warnings": f"""WITH p AS (SELECT *, {strip('text')} AS t FROM {PAGES}),
            d AS (SELECT doc_id, count(*) AS n, coalesce(sum(length(t)), 0) AS chars FROM p GROUP BY doc_id)
            SELECT doc_id, n AS page_count, concat_ws('|',
                CASE WHEN n > {WARNING_PAGES} THEN 'Large document detected (' || n || ' pages): all pages are kept.' END,
                CASE WHEN chars < 30 THEN 'Very little or no selectable text found: probably a scan or vector graphics.' END) AS warnings FROM d""",
        "page_breakdown": f"""SELECT doc_id, page_number, {strip('text')} AS text, length({strip('text')}) AS char_count
            FROM {PAGES}""",
        "labelled_clean": f"SELECT * FROM {LABELLED}",
        "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM {MESSY}",
        "paragraphs": exploded(MESSY, paragraphs(clean("text")), "paragraph"),
        "sentences": exploded("documents", sentences(clean("text")), "sentence"),
        "tokenize_words": exploded("documents", words("text"), "token"),
        "preprocess_for_ml": f"""SELECT doc_id, array_to_string(list_filter({_no_stops(words('text'), _STOPS + ", 'report', 'ing'")},
            lambda t: length(t) > 2 AND NOT regexp_full_match(t, '[0-9]+')), ' ') AS text FROM documents""",
        "ngrams": exploded(f"(SELECT doc_id, {keyword_tokens('text')} AS t FROM documents)", grams("t"), "ngram"),
        "highlight": f"""WITH q AS (SELECT {highlight_tokens("'" + HIGHLIGHT_QUERY + "'")} AS marks)
            SELECT doc_id, {highlighted('text', 'marks')} AS highlighted_text, {matched('text', 'marks')} AS matched_terms FROM documents, q""",
        "document_statistics": f"WITH {_cleaned(DOUBLED)}, {STATISTICS} SELECT * FROM stats",
        "document_statistics_paged": f"""WITH {_cleaned(ASSEMBLED)}, {STATISTICS} SELECT stats.* REPLACE (p.n AS page_count) FROM stats
            JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) p USING (doc_id)""",
        "term_frequency": f"WITH {term_counts('documents')} SELECT * FROM tf",
        "inverse_document_frequency": f"""WITH {corpus} SELECT term, df,
            round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 4) AS idf FROM df""",
        "keyword_scope": f"""WITH {_cleaned(DOUBLED)}, parts AS (SELECT doc_id, len({paragraphs('c')}) AS p, len({sentences('c')}) AS s
                FROM cleaned WHERE {LONG_ENOUGH})
            SELECT doc_id, CASE WHEN p >= 2 THEN 'paragraph' WHEN s >= 2 THEN 'sentence' ELSE 'text' END AS scope,
                (CASE WHEN p >= 2 THEN p WHEN s >= 2 THEN s ELSE 2 END)::BIGINT AS n FROM parts""",
        "keywords_local": f"WITH {local_keywords(DOUBLED)} SELECT * FROM local_keywords",
        "keyword_table": f"""WITH {local_keywords('documents')}
            SELECT doc_id, rank, keyword, score, frequency, ngram_type FROM local_keywords WHERE rank <= 10""",
        "keywords_corpus": f"""WITH {corpus},
            weights AS (SELECT doc_id, term, {corpus_weights} FROM tf JOIN df USING (term) WHERE doc_id IN {long_docs}),
            {_keyword_rank('weights')} SELECT * FROM keywords""",
        "keywords_background": f"""WITH {_cleaned('(SELECT item_id AS doc_id, text FROM benchmark)')},
            {term_counts('documents', 'background')}, {term_counts('(SELECT item_id AS doc_id, text FROM benchmark)')},
            df AS (SELECT term, count(*) AS df FROM background GROUP BY term),
            weights AS (SELECT doc_id, term, {corpus_weights} FROM tf JOIN df USING (term) WHERE doc_id IN {long_docs}),
            {_keyword_rank('weights')} SELECT * FROM keywords""",
        "keywords_single_background": f"WITH {local_keywords(DOUBLED)} SELECT * FROM local_keywords",
        "keywords_fallback": f"WITH {_cleaned('documents')}, {_fallback_keywords(LONG_ENOUGH)} SELECT * FROM fallback",
        "sections": f"WITH {sections(DOUBLED)} SELECT * FROM sections",
        "sections_paged": f"WITH {sections_paged()} SELECT * FROM sections",
        "section_counts": f"WITH {sections_paged()} SELECT doc_id, count(*) AS section_count FROM sections GROUP BY doc_id",
        "section_tfidf": f"""WITH {sections(DOUBLED)}, {postings()}
            SELECT doc_id, section_id, term, tf, df, round(weight, 4) AS weight FROM postings""",
        "query_vector": f"""WITH {sections_paged()}, {postings()}, {TURNS}, {vectors(True)}
            SELECT query_id, scope AS doc_id, term, round(weight, 4) AS weight FROM vectors""",
        "search_topk": full_search(sections_paged(), TURNS, True, 5, 0.05),
        "search_zero_threshold": full_search(sections_paged(), TURNS, True, 10, 0),
        "search_every_document": f"""WITH {sections(DOUBLED)}, {postings()}, {FIRST_LINES}, {vectors(True)}, {vector_hits(1, 0.05)}
            {projected('hits', highlight_tokens('query'), True)}""",
        "search_fallback": f"""WITH {sections_paged()}, {postings()}, {TURNS.replace("conv_id AS doc_id", "conv_id + 1 AS doc_id")}, {vectors(True)}, {fallback_hits(True, 1)}
            {projected('fallback_hits', ALL_WORDS, True)}""",
        "search_blank_queries": full_search(sections_paged(), TURNS.replace("text AS query", "CASE WHEN conv_id % 3 = 0 THEN ' ' WHEN conv_id % 3 = 1 THEN text END AS query"), True, 5, 0.05),
        "search_fallback_corpus": f"""WITH {sections(DOUBLED)}, {postings('0')},
            {PASSAGES.replace("text AS query", f"array_to_string(regexp_extract_all(text, '{WORD_PIECE}', 1), ' ') AS query")}, {vectors(False)}, {fallback_hits(False, 5, '0')}
            {projected('fallback_hits', ALL_WORDS, False)}""",
        "training_optimality": f"""WITH {SPLIT}, {VOCABULARY}
            SELECT DISTINCT category AS class, (SELECT count(*) FROM vocabulary) AS n_terms, true AS gradient_ok FROM split""",
        "labelled_csv": f"SELECT category, text FROM {LABELLED}",
        "search_corpus": full_search(sections(DOUBLED), PASSAGES, False, 5, 0.05, "0"),
        "predict_gate": f"""SELECT doc_id, CASE WHEN length({strip('text')}) < 10 THEN '{UNDETERMINED}' ELSE 'Classified' END AS outcome,
            CASE WHEN length({strip('text')}) < 10 THEN '{TOO_BRIEF_MESSAGE}' ELSE 'Success' END AS message FROM documents""",
        "stratified_split": f"WITH {SPLIT} SELECT doc_id, category, split FROM split",
        "vocabulary_topk": f"WITH {SPLIT}, {VOCABULARY} SELECT * FROM vocabulary",
        "training_summary": f"""WITH {SPLIT}, {VOCABULARY} SELECT count(DISTINCT category) AS class_count,
            count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'test') AS test_samples,
            count(*) AS total_samples, (SELECT count(*) FROM vocabulary) AS vocabulary_size FROM split""",
        "confusion_matrix": f"""SELECT 'True: ' || label AS true_class, {", ".join(
            f'''count(*) FILTER (prediction = '{c}') AS "Pred: {c}"''' for c in ("de", "en", "es", "fr"))} FROM {GUESSES} GROUP BY label""",
        "classification_metrics": f"""WITH {PER_CLASS} SELECT {", ".join(f"round({m}, 4) AS {m}" for m in (
            "accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"))} FROM averages""",
        "classification_report": f"""WITH {PER_CLASS} SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall,
                round(f1, 4) AS f1, support FROM per_class
            UNION ALL SELECT 'accuracy', round(accuracy, 4), round(accuracy, 4), round(accuracy, 4), support FROM averages
            UNION ALL SELECT 'macro avg', round(precision_macro, 4), round(recall_macro, 4), round(f1_macro, 4), support FROM averages
            UNION ALL SELECT 'weighted avg', round(precision_weighted, 4), round(recall_weighted, 4), round(f1_weighted, 4), support FROM averages""",
        "document_report": f"""WITH {local_keywords(DOUBLED)}, {STATISTICS}, {sections(DOUBLED).replace("cut AS", "cut2 AS").replace("FROM cut", "FROM cut2")}
            SELECT stats.*, coalesce(k.keywords, '') AS keywords, coalesce(n.section_count, 0) AS section_count FROM stats
            LEFT JOIN (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS keywords FROM local_keywords GROUP BY doc_id) k USING (doc_id)
            LEFT JOIN (SELECT doc_id, count(*) AS section_count FROM sections GROUP BY doc_id) n USING (doc_id)""",
        "model_roundtrip": f"""WITH {MODEL} SELECT term, round(idf, 6) AS idf, {", ".join(f"c{i} AS coefficient_{c}" for i, c in enumerate(LANGUAGES))} FROM model""",
        "classifier_vectors": f"""WITH {MODEL}, {VECTORS}
            SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 4) AS weight FROM doc_weights""",
        "predict": f"WITH {PREDICTIONS} SELECT doc_id, predicted_category, confidence, confidence_raw, message FROM predictions",
        "predict_hard": f"WITH {PREDICTIONS} SELECT doc_id, predicted_category, CASE WHEN brief THEN 0.0 ELSE 100.0 END::DOUBLE AS confidence FROM predictions",
        "probability_table": f"""WITH {PREDICTIONS}, listed AS (SELECT doc_id, brief, unnest(p) AS x, unnest([{_quoted(LANGUAGES)}]) AS category FROM predictions),
            percent AS (SELECT doc_id, category, CASE WHEN brief THEN 0.0 ELSE round(x * 100, 2) END AS probability FROM listed)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, category)::BIGINT AS rank, category, probability FROM percent""",
        "document_report_with_topic": f"""WITH {local_keywords(DOUBLED)}, {STATISTICS}, {sections(DOUBLED).replace("cut AS", "cut2 AS").replace("FROM cut", "FROM cut2")},
            {PREDICTIONS.replace("AS s FROM documents)", f"AS s FROM {DOUBLED})")}
            SELECT stats.*, coalesce(k.keywords, '') AS keywords, coalesce(n.section_count, 0) AS section_count, predicted_category, confidence, message FROM stats
            LEFT JOIN (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS keywords FROM local_keywords GROUP BY doc_id) k USING (doc_id)
            LEFT JOIN (SELECT doc_id, count(*) AS section_count FROM sections GROUP BY doc_id) n USING (doc_id)
            LEFT JOIN predictions USING (doc_id)""",
        "document_report_paged": f"""WITH {local_keywords(ASSEMBLED)}, {STATISTICS}, {sections_paged().replace("cut AS", "cut2 AS").replace("FROM cut)", "FROM cut2)")}
            SELECT stats.* REPLACE (p.n AS page_count), coalesce(k.keywords, '') AS keywords, coalesce(n.section_count, 0) AS section_count FROM stats
            JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) p USING (doc_id)
            LEFT JOIN (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS keywords FROM local_keywords GROUP BY doc_id) k USING (doc_id)
            LEFT JOIN (SELECT doc_id, count(*) AS section_count FROM sections GROUP BY doc_id) n USING (doc_id)""",
        "blank_documents": f"""WITH {FILES} SELECT doc_id, 'BLANK_TEXT' AS error_code, 'No text could be extracted.' AS message FROM routed WHERE {strip('content')} = ''""",
        "ingest_plain": f"""SELECT source || '/' || doc_id || '.txt' AS doc_id, 1::BIGINT AS page_number, text FROM documents WHERE {strip('text')} <> ''""",
    }
