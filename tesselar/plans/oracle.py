"""Blocks of DuckDB SQL that the oracles of the catalogue are made of. Each is a chain of common table expressions."""

from __future__ import annotations

from tesselar.functions import stem as S
from tesselar.functions import text as T

TOKEN = T.TOKEN
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"


def tokens(text: str) -> str:
    """A list of the tokens of a text."""
    joined = "list_concat([t], list_filter(string_split_regex(t, '[._-]'), lambda p: length(p) > 1))"
    return f"flatten(list_transform(regexp_extract_all(lower(strip_accents({text})), '{TOKEN}'), lambda t: CASE WHEN regexp_matches(t, '[._-]') THEN {joined} ELSE [t] END))"


def content(text: str) -> str:
    return f"list_filter({tokens(text)}, lambda w: length(w) > 2 AND w NOT IN {STOP})"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def prose(s: str) -> str:
    marks = " AND ".join(f"NOT contains({s}, '{m}')" for m in T.CODE_MARKS)
    words = f"string_split({squeezed(s)}, ' ')"
    return (
        f"(length({s}) > 0 AND {marks} AND len(regexp_extract_all({s}, '[\\p{{L}}\\s]')) >= 0.86 * length({s}) "
        f"AND len(list_filter({words}, lambda w: regexp_full_match(w, '\\p{{L}}+'))) >= 0.7 * len({words}))"
    )


def cleaned(s: str) -> str:
    return squeezed(f"regexp_replace(regexp_replace({squeezed(s)}, '^[-*>#| ]+', ''), '`|\\*|\\[\\[|\\]\\]', '', 'g')")


def sentences(text: str, min_words: int) -> str:
    """A list of the sentences of a text; the look-around of the Spark side is two replacements by a sentinel."""
    marked = f"regexp_replace(regexp_replace({text}, '\\n{{2,}}', chr(1), 'g'), '([.!?])\\s+([A-Z(\\[`])', '\\1' || chr(1) || '\\2', 'g')"
    # A second pass for ends that touch, as in "A. B. C".
    marked = f"regexp_replace({marked}, '([.!?])\\s+([A-Z(\\[`])', '\\1' || chr(1) || '\\2', 'g')"
    cut = f"list_transform(string_split({marked}, chr(1)), lambda s: {squeezed('s')})"
    return f"list_filter({cut}, lambda s: length(s) > 0 AND len(string_split(s, ' ')) >= {min_words})"


def doc_tokens(source: str = "documents", text: str = "text", name: str = "tok_d") -> str:
    return f"{name} AS (SELECT doc_id, {tokens(f"coalesce({text}, '')")} AS toks FROM {source})"


def query_tokens(source: str = "benchmark", qid: str = "item_id", name: str = "tok_q") -> str:
    return f"{name} AS (SELECT {qid} AS qid, {tokens("coalesce(text, '')")} AS toks FROM {source})"


POSTINGS = """
pos AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok_d) GROUP BY ALL),
dl AS (SELECT doc_id, len(toks) AS dl FROM tok_d),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
df AS (SELECT term, count(*) AS df FROM pos GROUP BY term)"""


def bm25(k1: str = "1.5", b: str = "0.75", extra: str = "", grid: str = "") -> str:
    """bm: (qid, doc_id, score) of all documents with a term of the query, after tok_d, tok_q and POSTINGS."""
    keys = "qid, doc_id" + (f", {extra}" if extra else "")
    w = f"ln(1 + (n - df + 0.5) / (0.5 + df)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / a))"
    return f"""
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(toks) AS term FROM tok_q)),
parts AS (SELECT {keys}, term, {w} AS contrib FROM qt JOIN pos USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st{grid}),
bm AS (SELECT {keys}, sum(contrib) AS score FROM parts GROUP BY ALL)"""


def top(source: str, k: int, name: str, by: str = "qid") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k})"


LEXICAL = f"{doc_tokens()}, {query_tokens()}, {POSTINGS}, {bm25()}"
#: Cosines of the queries' vectors with all vectors: a query's vector is that of its number.
SEMANTIC = """
sem AS (SELECT b.item_id AS qid, d.vec_id AS doc_id, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])
  / (greatest(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 1e-9) * greatest(sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])), 1e-9)) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings d)"""
POOL = f"""
{LEXICAL}, {SEMANTIC}, {top("bm", 60, "bm_top")}, {top("sem", 60, "sem_top")},
pool AS (SELECT qid, doc_id FROM bm_top UNION SELECT qid, doc_id FROM sem_top),
full_pool AS (SELECT p.qid, p.doc_id, coalesce(b.score, 0) AS l, coalesce(s.score, 0) AS s FROM pool p LEFT JOIN bm b USING (qid, doc_id) LEFT JOIN sem s ON s.qid = p.qid AND s.doc_id = p.doc_id)"""
MINMAX = """
normed AS (SELECT qid, doc_id, CASE WHEN max(l) OVER w - min(l) OVER w < 1e-9 THEN 0 ELSE (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) END AS nl,
  CASE WHEN max(s) OVER w - min(s) OVER w < 1e-9 THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS ns FROM full_pool WINDOW w AS (PARTITION BY qid))"""
ZSCORE = """
normed AS (SELECT qid, doc_id, CASE WHEN stddev_pop(l) OVER w < 1e-9 THEN 0 ELSE (l - avg(l) OVER w) / stddev_pop(l) OVER w END AS nl,
  CASE WHEN stddev_pop(s) OVER w < 1e-9 THEN 0 ELSE (s - avg(s) OVER w) / stddev_pop(s) OVER w END AS ns FROM full_pool WINDOW w AS (PARTITION BY qid))"""
#: A document is relevant to a passage that it contains.
QRELS = "qrels AS (SELECT b.item_id AS qid, d.doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RUN = f"{LEXICAL}, {top('bm', 100, 'run')}"


def metrics(run: str = "run", ks: str = "(1), (3), (5), (10), (100)") -> str:
    """per: every metric by judged query and cut-off, from qrels and a run (qid, doc_id, score)."""
    return f"""
ks AS (SELECT * FROM (VALUES {ks}) AS t(k)),
placed AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id::VARCHAR DESC) AS r FROM {run}),
tot AS (SELECT qid, sum((rel > 0)::INT) AS nrel FROM qrels GROUP BY qid),
ideal AS (SELECT qid, k, sum(greatest(rel, 0) / log2(r + 1)) AS idcg FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS r FROM qrels), ks WHERE r <= k GROUP BY ALL),
hit AS (SELECT p.qid, r, rel, sum((rel > 0)::INT) OVER (PARTITION BY p.qid ORDER BY r) AS nth FROM placed p JOIN qrels USING (qid, doc_id)),
got AS (SELECT qid, k, sum(greatest(rel, 0) / log2(r + 1)) AS dcg, sum((rel > 0)::INT) AS hits, sum(CASE WHEN rel > 0 THEN nth / r ELSE 0 END) AS ps, min(CASE WHEN rel > 0 THEN r END) AS first FROM hit, ks WHERE r <= k GROUP BY ALL),
per AS (SELECT t.qid, ks.k, coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0) AS ndcg, coalesce(CASE WHEN nrel > 0 THEN hits / nrel END, 0) AS recall, coalesce(hits / ks.k, 0) AS precision,
  coalesce(CASE WHEN nrel > 0 THEN ps / nrel END, 0) AS map, coalesce(1 / first, 0) AS mrr
  FROM tot t CROSS JOIN ks LEFT JOIN ideal i ON i.qid = t.qid AND i.k = ks.k LEFT JOIN got g ON g.qid = t.qid AND g.k = ks.k)"""


def pairs(k: int) -> str:
    """pairs: passages and their k best documents, with the words of both; after it the features of re-ranking, by pair."""
    return f"""
{LEXICAL}, {top("bm", k, "best")},
pairs AS (SELECT h.qid, h.doc_id, h.rank, {content("b.text")} AS words, {tokens("d.text")} AS toks, {tokens("coalesce(d.source, '')")} AS title
  FROM best h JOIN benchmark b ON b.item_id = h.qid JOIN documents d ON d.doc_id = h.doc_id),
f_words AS (SELECT qid, doc_id, toks, unnest(words) AS term FROM pairs),
f_known AS (SELECT qid, doc_id, list_contains(toks, term) AS has, coalesce(ln(1 + (n - df + 0.5) / (0.5 + df)), 3.0) AS idf FROM f_words LEFT JOIN df USING (term), st),
f_cov AS (SELECT qid, doc_id, sum(CASE WHEN has THEN idf ELSE 0 END) / sum(idf) AS coverage FROM f_known GROUP BY ALL),
f_grams AS (SELECT qid, doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS a,
  list_distinct(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS b FROM pairs),
f_want AS (SELECT qid, doc_id, unnest(list_distinct(words)) AS term FROM pairs),
f_at AS (SELECT t.* FROM (SELECT qid, doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS p FROM pairs) t JOIN f_want USING (qid, doc_id, term)),
f_last AS (SELECT a.qid, a.doc_id, a.p, max(CASE WHEN a.term = w.term THEN a.p END) OVER (PARTITION BY a.qid, a.doc_id, w.term ORDER BY a.p) AS last FROM f_at a JOIN f_want w ON w.qid = a.qid AND w.doc_id = a.doc_id),
f_end AS (SELECT qid, doc_id, p, count(last) AS have, min(last) AS begins FROM f_last GROUP BY ALL),
f_win AS (SELECT p.qid, p.doc_id, any_value(len(list_distinct(words))) AS n, min(CASE WHEN have = len(list_distinct(words)) THEN p - begins + 1 END) AS best, max(have) AS seen, count(*) AS places
  FROM pairs p JOIN f_end e ON e.qid = p.qid AND e.doc_id = p.doc_id GROUP BY p.qid, p.doc_id),
features AS (SELECT p.qid, p.doc_id, p.rank, coalesce(coverage, 0) AS coverage, len(list_intersect(a, b)) / greatest(len(a), 1) AS phrase,
  CASE WHEN n IS NULL OR n < 2 OR places < 2 THEN 0 WHEN best IS NULL THEN 0.35::DOUBLE * seen / n ELSE least(1.0::DOUBLE, n / best) END AS proximity,
  len(list_filter(words, lambda w: list_contains(title, w))) / greatest(len(words), 1) AS title
  FROM pairs p LEFT JOIN f_cov c ON c.qid = p.qid AND c.doc_id = p.doc_id LEFT JOIN f_win w ON w.qid = p.qid AND w.doc_id = p.doc_id JOIN f_grams g ON g.qid = p.qid AND g.doc_id = p.doc_id)"""


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: What comes up to the end of the first run of vowels; a y that begins a word is a consonant.
_HEAD = f"(?:{_C}{_V}|[aeiou]+)"
_CONSONANT = "(?:[^aeiouy]|(?:^|[aeiou])y)"


def _measured(stem: str, least: int) -> str:
    """Whether a stem has `least` runs of vowels with consonants after them, by the shapes of letters."""
    return f"regexp_matches({stem}, '^{_HEAD}{_C}" + f"{_V}{_C}" * (least - 1) + "')"


def _without(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _first(rules: list[str], ok) -> str:
    """The word with the first of the suffixes (suffix, replacement) that it ends in replaced, if its stem is ok."""
    cases = "".join(f" WHEN ends_with(w, '{a}') THEN CASE WHEN {ok(_without(len(a)), a)} THEN {_without(len(a))} || '{b}' ELSE w END" for a, b in rules)
    return f"CASE{cases} ELSE w END"


def stems(source: str, name: str = "stems") -> str:
    """name: (term, stem) of the distinct terms of a relation, by Porter's algorithm as regular expressions."""
    vowel = lambda x: f"regexp_matches({x}, '[aeiou]|[^aeiou]y')"
    # A short stem anywhere: its last three letters are consonant, vowel, consonant, the last not w, x or y.
    ends_short = lambda x: f"regexp_matches({x}, '{_CONSONANT}[aeiouy][^aeiouwxy]$')"
    one = lambda x: f"regexp_matches({x}, '^{_HEAD}{_C}(?:{_V})?$')"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_without(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_without(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measured(_without(3), 1)} THEN {_without(1)} ELSE w END "
        f"WHEN ends_with(w, 'ed') THEN CASE WHEN {vowel(_without(2))} THEN {_without(2)} || chr(1) ELSE w END WHEN ends_with(w, 'ing') THEN CASE WHEN {vowel(_without(3))} THEN {_without(3)} || chr(1) ELSE w END ELSE w END",
        # chr(1) marks a word that lost its ending: some get an e, double consonants lose one.
        f"CASE WHEN NOT ends_with(w, chr(1)) THEN w WHEN regexp_matches({_without(1)}, '(at|bl|iz)$') THEN {_without(1)} || 'e' "
        f"WHEN length(w) > 2 AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND regexp_matches({_without(1)}, '{_CONSONANT}$') AND NOT regexp_matches({_without(1)}, '[lsz]$') THEN {_without(2)} "
        f"WHEN length(w) > 2 AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND regexp_matches({_without(1)}, '{_CONSONANT}$') THEN {_without(1)} "
        f"WHEN {one(_without(1))} AND {ends_short(_without(1))} THEN {_without(1)} || 'e' ELSE {_without(1)} END",
        f"CASE WHEN ends_with(w, 'y') AND {vowel(_without(1))} THEN {_without(1)} || 'i' ELSE w END",
        _first(S._STEP2, lambda x, _: _measured(x, 1)),
        _first(S._STEP3, lambda x, _: _measured(x, 1)),
        _first([(x, "") for x in S._STEP4], lambda x, a: _measured(x, 2) + (f" AND regexp_matches({x}, '[st]$')" if a == "ion" else "")),
        f"CASE WHEN ends_with(w, 'e') AND ({_measured(_without(1), 2)} OR ({_measured(_without(1), 1)} AND NOT {ends_short(_without(1))})) THEN {_without(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measured('w', 2)} THEN {_without(1)} ELSE w END",
    ]
    out = [f"{name}_0 AS (SELECT DISTINCT term, term AS w FROM {source})"]
    for i, step in enumerate(steps):
        out.append(f"{name}_{i + 1} AS (SELECT term, CASE WHEN length(term) < 3 THEN w ELSE {step} END AS w FROM {name}_{i})")
    return ",\n".join([*out, f"{name} AS (SELECT term, w AS stem FROM {name}_{len(steps)})"])


def chunks(max_tokens: int, overlap: int, min_tokens: int) -> str:
    """chunks: the windows of conversations whose users' turns are sections; paragraphs are packed by a recursive relation."""
    return f"""
c_turns AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '# user' || chr(10) || chr(10) || text ELSE text END AS part, role, text,
  sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS sec FROM conversations),
c_lines AS (SELECT *, coalesce(sum(length(part) - length(replace(part, chr(10), '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS line FROM c_turns),
c_bodies AS (SELECT conv_id, sec, min(line) AS line, bool_or(role = 'user') AS headed, trim(string_agg(text, chr(10) || chr(10) ORDER BY turn), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM c_lines GROUP BY ALL),
c_secs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sec) - 1 AS section FROM c_bodies WHERE body <> ''),
c_paras AS (SELECT conv_id, section, line, headed, list_filter(string_split_regex(body, '\\n\\s*\\n'), lambda p: regexp_matches(p, '\\S')) AS ps FROM c_secs),
c_sized AS (SELECT *, list_transform(ps, lambda p: len({tokens("p")})) AS ns FROM c_paras),
c_pack AS (
  WITH RECURSIVE pack AS (
    SELECT conv_id, section, line, headed, ps, ns, 1::BIGINT AS i, 1::BIGINT AS lo, 0::BIGINT AS size, NULL::BIGINT AS a, NULL::BIGINT AS b FROM c_sized
    UNION ALL
    SELECT conv_id, section, line, headed, ps, ns, i + 1, CASE WHEN shut THEN keep ELSE lo END, CASE WHEN i > len(ns) THEN 0 WHEN shut THEN coalesce(list_sum(ns[keep:i - 1]), 0) + ns[i] ELSE size + ns[i] END,
      CASE WHEN shut THEN lo END, CASE WHEN shut THEN i - 1 END
    FROM (SELECT *, (i > lo AND (i > len(ns) OR size + ns[i] > {max_tokens})) AS shut, list_min(list_filter(range(lo, i + 1), lambda j: j >= i OR coalesce(list_sum(ns[j:i - 1]), 0) <= {overlap})) AS keep FROM pack WHERE i <= len(ns) + 1)
  )
  SELECT *, row_number() OVER (PARTITION BY conv_id, section ORDER BY a, b) - 1 AS win, array_to_string(ps[a:b], chr(10) || chr(10)) AS text FROM pack WHERE a IS NOT NULL),
c_kept AS (SELECT conv_id::VARCHAR AS doc_id, section, win, line, text, headed, len({tokens("text")}) AS n FROM c_pack),
chunks AS (SELECT doc_id, 'conversations' AS project, 'conversation ' || doc_id || CASE WHEN headed THEN ' > user' ELSE '' END AS title, section::INT AS section, win::INT AS "window", line::INT AS start_line, n::INT AS n_tokens, text,
  row_number() OVER (ORDER BY doc_id, section, win) - 1 AS id FROM c_kept WHERE n >= {min_tokens})"""


ICT = f"""
sen AS (SELECT doc_id, unnest({sentences("text", 10)}) AS sentence, generate_subscripts({sentences("text", 10)}, 1) AS p FROM documents),
ok AS (SELECT doc_id, p, sentence FROM sen WHERE {prose("sentence")} AND len({content("sentence")}) >= 5),
chosen AS (SELECT doc_id, arg_min(sentence, p) AS sentence FROM ok GROUP BY doc_id),
q0 AS (SELECT doc_id, sentence, {cleaned("sentence")} AS text FROM chosen),
ict AS (SELECT * FROM q0 WHERE len(string_split(text, ' ')) >= 3 ORDER BY md5('0:' || doc_id::VARCHAR), doc_id LIMIT 200),
masked AS (SELECT d.doc_id, {squeezed(f"CASE WHEN i.sentence IS NULL THEN {squeezed('d.text')} ELSE replace({squeezed('d.text')}, i.sentence, ' ') END")} AS text FROM documents d LEFT JOIN ict i USING (doc_id))"""
ICT_RUN = f"{ICT}, {doc_tokens('masked')}, {query_tokens('ict', 'doc_id')}, {POSTINGS}, {bm25()}, {top('bm', 50, 'run')}"

#: Sentences chosen by place, as queries of the hard kind (a draw of content words) and of the keyword kind (the most informative ones).
ICT_HARD = f"""
{ICT},
h_words AS (SELECT doc_id, sentence, {content("sentence")} AS ws FROM chosen),
h_drawn AS (SELECT doc_id, sentence, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i, greatest(3, round(len(ws) * (1 - 0.45::DOUBLE))) AS keep FROM h_words),
h_placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || i || ':' || sentence), w) AS r FROM h_drawn),
hard0 AS (SELECT doc_id, any_value(sentence) AS sentence, string_agg(w, ' ' ORDER BY r) AS text FROM h_placed WHERE r <= keep GROUP BY doc_id),
hard AS (SELECT * FROM hard0 WHERE len(string_split(text, ' ')) >= 3 ORDER BY md5('0:' || doc_id::VARCHAR), doc_id LIMIT 200)"""
ICT_KEYWORD = f"""
{ICT},
k_words AS (SELECT DISTINCT doc_id, unnest({content("chr(10) || text")}) AS term FROM documents),
k_idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) AS idf FROM k_words GROUP BY term),
k_mine AS (SELECT DISTINCT doc_id, sentence, unnest({content("sentence")}) AS term FROM chosen),
k_best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(idf, 8.0), 9) DESC, term) AS r FROM k_mine LEFT JOIN k_idf USING (term)),
key0 AS (SELECT doc_id, any_value(sentence) AS sentence, string_agg(term, ' ' ORDER BY r) AS text FROM k_best WHERE r <= 3 GROUP BY doc_id),
keyword AS (SELECT * FROM key0 WHERE len(string_split(text, ' ')) >= 3 ORDER BY md5('0:' || doc_id::VARCHAR), doc_id LIMIT 200)"""
