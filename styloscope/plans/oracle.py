"""DuckDB oracle SQL for the registered queries, written independently of the Spark plans.

The oracle uses window functions, ``unnest`` and lists where the Spark side uses composite-key
grouping and in-row arrays, so an agreement checks the semantics rather than one translation.
Floating outputs are rounded to 6 decimals as floor(x * 1e6 + 0.5) / 1e6, like the Spark side.
"""

from __future__ import annotations

from styloscope.functions import lexicons as lx

WS = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^ \t\n\x0B\f\r\x1C-\x1F\x85\p{Z}\p{L}\p{M}\p{N}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def R(expr: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) >= 1e12 THEN {x} ELSE floor({x} * 1000000.0 + 0.5) / 1000000.0 END)"


def div(num: str, den: str, default: str = "0.0") -> str:
    return f"(CASE WHEN coalesce({den}, 0) = 0 THEN {default} ELSE CAST({num} AS DOUBLE) / ({den}) END)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PROBLEMS = f"""problems AS (
  SELECT doc_id AS problem_id, ['easy', 'medium', 'hard'][CAST(doc_id % 3 AS INTEGER) + 1] AS difficulty,
         regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text
  FROM documents)"""

SENTENCES = """sentences AS (
  SELECT problem_id, difficulty, CAST(unnest(range(len(parts))) AS INTEGER) AS sent_idx,
         unnest(parts) AS sentence, CAST(len(parts) AS INTEGER) AS n_sentences
  FROM (SELECT problem_id, difficulty, string_split(text, chr(10)) AS parts FROM problems))"""

BASE = [PROBLEMS, SENTENCES]

RHYTHM = """marks AS (
  SELECT problem_id, sent_idx, length(sentence) AS len,
         len(regexp_extract_all(sentence, '!')) AS c0, len(regexp_extract_all(sentence, '\\?')) AS c1,
         len(regexp_extract_all(sentence, '\\.')) AS c2
  FROM sentences),
win AS (
  SELECT problem_id, sent_idx, sum(c0) OVER w AS s0, sum(c1) OVER w AS s1, sum(c2) OVER w AS s2,
         var_pop(len) OVER w AS v, count(*) OVER w AS m
  FROM marks WINDOW w AS (PARTITION BY problem_id ORDER BY sent_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
rhythm AS (
  SELECT problem_id, sent_idx,
         CASE WHEN s0 + s1 + s2 > 1 THEN CAST((s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT AS DOUBLE) / (s0 + s1 + s2)
              ELSE 0.0 END AS punctuation_burstiness,
         CASE WHEN m > 1 THEN v ELSE 0.0 END AS length_variance
  FROM win)"""


def _pattern_type_sql(col: str) -> str:
    s = f"lower(regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g'))"
    r1 = " OR ".join([f"starts_with({s}, {q(p)})" for p in lx.PATTERN1_PREFIXES] +
                     [f"contains({s}, {q(p)})" for p in lx.PATTERN1_PHRASES])
    r2 = " OR ".join(f"regexp_matches({s}, {q(p)})" for p in lx.PATTERN2_REGEXES)
    r3 = " OR ".join([f"contains({s}, {q(p)})" for p in lx.PATTERN3_PHRASES] +
                     [f"starts_with({s}, {q(p)})" for p in lx.PATTERN3_PREFIXES])
    r4 = " OR ".join(f"starts_with({s}, {q(p)})" for p in lx.PATTERN4_PREFIXES)
    return f"(CASE WHEN {r1} THEN 1 WHEN {r2} THEN 2 WHEN {r3} THEN 3 WHEN {r4} THEN 4 ELSE 0 END)"


SQL: dict[str, str] = {}

SQL["sentence_split"] = with_(*BASE) + "SELECT problem_id, sent_idx, sentence, n_sentences FROM sentences"

SQL["min_length_filter"] = with_(PROBLEMS) + """SELECT problem_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_sentences
FROM problems WHERE len(string_split(text, chr(10))) >= 2"""

SQL["position_ratio"] = with_(*BASE) + f"""SELECT problem_id, sent_idx AS pair_idx,
  {R(div('sent_idx', 'greatest(1, n_sentences - 1)'))} AS position_ratio
FROM sentences WHERE n_sentences >= 2 AND sent_idx < n_sentences - 1"""

SQL["punct_burstiness"] = with_(*BASE, RHYTHM) + f"""SELECT problem_id, sent_idx,
  {R('punctuation_burstiness')} AS punctuation_burstiness FROM rhythm"""

SQL["length_variance"] = with_(*BASE, RHYTHM) + f"""SELECT problem_id, sent_idx,
  {R('length_variance')} AS length_variance FROM rhythm"""

SQL["rhythm_pairs"] = with_(*BASE, RHYTHM) + f"""SELECT a.problem_id, a.sent_idx AS pair_idx,
  {R('b.punctuation_burstiness - a.punctuation_burstiness')} AS delta_punctuation_burstiness,
  {R('b.length_variance - a.length_variance')} AS delta_length_variance
FROM rhythm a JOIN rhythm b ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1"""

PATTERN = f"""pt AS (SELECT problem_id, sent_idx, {_pattern_type_sql('sentence')} AS pattern_type FROM sentences)"""

SQL["pattern_type"] = with_(*BASE, PATTERN) + """SELECT problem_id, sent_idx, pattern_type,
  CAST(pattern_type = 1 AS INTEGER) AS flag_pattern_1, CAST(pattern_type = 2 AS INTEGER) AS flag_pattern_2,
  CAST(pattern_type = 3 AS INTEGER) AS flag_pattern_3, CAST(pattern_type = 4 AS INTEGER) AS flag_pattern_4,
  CAST(pattern_type > 0 AS INTEGER) AS flag_special_meta FROM pt"""

SQL["pattern_blocks"] = with_(*BASE, PATTERN) + """, nb AS (
  SELECT problem_id, sent_idx, pattern_type,
         coalesce(lag(pattern_type) OVER w, 0) AS prev_t, coalesce(lead(pattern_type) OVER w, 0) AS next_t
  FROM pt WINDOW w AS (PARTITION BY problem_id ORDER BY sent_idx))
SELECT problem_id, sent_idx, pattern_type,
  CAST(pattern_type <> 0 AND pattern_type = next_t AS INTEGER) AS pattern_same_block,
  CAST(pattern_type <> next_t AS INTEGER) AS pattern_boundary_cross,
  CAST(pattern_type <> 0 AND pattern_type <> prev_t AS INTEGER) AS pattern_block_start,
  CAST(pattern_type <> 0 AND pattern_type <> next_t AS INTEGER) AS pattern_block_end
FROM nb"""


# ---------------------------------------------------------------------------------------------
# Tokens and the lexical family
# ---------------------------------------------------------------------------------------------

def _values(rows, cols) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else repr(float(v)) if isinstance(v, float) else str(v)
    body = ",\n    ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS v({', '.join(cols)})"


STOP_LIST = lst(lx.stopwords())

CLOSED = f"""closed_class AS (SELECT * FROM {_values(lx.closed_class_rows(), ['word', 'upos'])})"""
SENTI = f"""senti AS (SELECT * FROM {_values(lx.SENTIMENT_LEXICON, ['word', 'pol', 'subj'])})"""

TOKENS = f"""tok0 AS (
  SELECT problem_id, sent_idx, CAST(unnest(range(len(toks))) AS INTEGER) AS tok_idx, unnest(toks) AS text
  FROM (SELECT problem_id, sent_idx, regexp_extract_all(sentence, '{TOKEN}') AS toks FROM sentences)),
tok1 AS (
  SELECT *, lower(text) AS lower, regexp_matches(text, '^\\p{{L}}+$') AS is_alpha,
         regexp_matches(text, '^\\p{{P}}+$') AS is_punct, regexp_matches(text, '^[\\p{{L}}\\p{{M}}\\p{{N}}]') AS is_word,
         (text = upper(text) AND text <> lower(text)) AS is_upper
  FROM tok0),
ann AS (
  SELECT t.*, list_contains({STOP_LIST}, t.lower) AS is_stop,
    coalesce(c.upos, CASE
      WHEN NOT t.is_word THEN (CASE WHEN t.is_punct THEN 'PUNCT' ELSE 'SYM' END)
      {' '.join(f"WHEN regexp_matches(t.lower, {q(p)}) THEN {q(tag)}" for tag, p in lx.OPEN_CLASS_RULES)}
      ELSE 'NOUN' END) AS upos,
    CASE WHEN list_contains({STOP_LIST}, t.lower) OR NOT t.is_alpha OR length(t.lower) <= 4 THEN t.lower
      {' '.join(f"WHEN regexp_matches(t.lower, {q(p)}) THEN regexp_replace(t.lower, {q(p)}, {q(r.replace('$1', chr(92) + '1'))})" for p, r in lx.LEMMA_RULES)}
      ELSE t.lower END AS lemma
  FROM tok1 t LEFT JOIN closed_class c ON c.word = t.lower)"""

TOK_BASE = [PROBLEMS, SENTENCES, CLOSED, TOKENS]

_VOWELS = f"[{lx.SYLLABLE_VOWELS}]+"
_SYL = (f"(CASE WHEN regexp_matches(lower, '\\p{{L}}') THEN greatest(1, len(regexp_extract_all(lower, {q(_VOWELS)})) - "
        f"CASE WHEN regexp_matches(lower, '[^l]e$') AND len(regexp_extract_all(lower, {q(_VOWELS)})) > 1 THEN 1 ELSE 0 END)"
        f" ELSE 0 END)")

LEX = f"""syl AS (SELECT *, {_SYL} AS syl FROM ann),
tagg AS (
  SELECT problem_id, sent_idx, count(*) AS ntok, sum(length(text)) AS sum_len,
    count(*) FILTER (WHERE is_upper AND length(text) > 1) AS all_caps_words,
    count(*) FILTER (WHERE list_contains({lst(lx.FUNCTION_POS_TAGS)}, upos)) AS fw,
    count(*) FILTER (WHERE upos = 'PRON') AS pron, count(*) FILTER (WHERE upos = 'CCONJ') AS cconj,
    count(*) FILTER (WHERE upos = 'ADP') AS adp,
    count(*) FILTER (WHERE is_alpha AND list_contains({lst(lx.FIRST_PERSON)}, lower)) AS p1,
    count(*) FILTER (WHERE is_alpha AND list_contains({lst(lx.SECOND_PERSON)}, lower)) AS p2,
    count(*) FILTER (WHERE is_alpha AND list_contains({lst(lx.THIRD_PERSON)}, lower)) AS p3,
    count(*) FILTER (WHERE is_alpha AND list_contains({lst(lx.WH_WORDS)}, lower)) AS wh,
    count(*) FILTER (WHERE is_stop) AS stop,
    count(*) FILTER (WHERE list_contains({lst(lx.FORMALITY_PLUS)}, upos))
      - count(*) FILTER (WHERE list_contains({lst(lx.FORMALITY_MINUS)}, upos)) AS formal,
    count(*) FILTER (WHERE list_contains({lst(lx.MODAL_WORDS)}, lower(lemma))) AS modal,
    count(*) FILTER (WHERE is_word) AS words,
    CAST(coalesce(sum(syl) FILTER (WHERE is_word), 0) AS BIGINT) AS syllables,
    count(*) FILTER (WHERE is_word AND syl >= 3) AS complex,
    count(*) FILTER (WHERE is_word AND syl >= 3 AND NOT is_stop) AS difficult,
    coalesce(sum(length(text)) FILTER (WHERE is_word), 0) AS word_chars,
    count(DISTINCT lower) FILTER (WHERE is_alpha) AS types
  FROM syl GROUP BY problem_id, sent_idx),
freq AS (
  SELECT problem_id, sent_idx, sum(c * c) AS m1, sum(c) AS n_alpha
  FROM (SELECT problem_id, sent_idx, lower, count(*) AS c FROM ann WHERE is_alpha GROUP BY ALL) GROUP BY ALL),
senti_agg AS (
  SELECT a.problem_id, a.sent_idx, avg(s.pol) AS pol, avg(s.subj) AS subj
  FROM ann a JOIN senti s ON s.word = a.lower GROUP BY ALL),
ents AS (
  SELECT problem_id, sent_idx, count(DISTINCT grp) AS n_ent FROM (
    SELECT problem_id, sent_idx, tok_idx - row_number() OVER (PARTITION BY problem_id, sent_idx ORDER BY tok_idx) AS grp
    FROM ann WHERE tok_idx > 0 AND is_alpha AND regexp_matches(text, '^\\p{{Lu}}')) GROUP BY ALL),
sstr AS (
  SELECT problem_id, sent_idx, s, lower(s) AS ls,
    list_filter(string_split_regex(s, '{WS}+'), lambda w: length(w) > 0) AS words_ws,
    list_filter(string_split_regex(lower(s), '{WS}+'), lambda w: length(w) > 0) AS lwords_ws,
    regexp_extract_all(s, '{TOKEN}') AS toks
  FROM (SELECT problem_id, sent_idx, regexp_replace(sentence, '^{WS}+|{WS}+$', '', 'g') AS s FROM sentences)),
lexical AS (
  SELECT x.problem_id, x.sent_idx,
    {div('coalesce(t.types, 0)', 'coalesce(t.ntok, 0)')} AS ttr,
    CASE WHEN coalesce(f.n_alpha, 0) > 0 THEN 1e4 * (f.m1 - f.n_alpha) / (CAST(f.n_alpha AS DOUBLE) ^ 2) ELSE 0.0 END AS yules_k,
    {div('coalesce(t.sum_len, 0)', 'coalesce(t.ntok, 0)')} AS avg_word_len,
    length(x.s) AS sentence_char_len,
    CAST(coalesce(t.ntok, 0) AS BIGINT) AS sentence_token_len,
    {div("len(regexp_extract_all(x.s, '\\p{L}'))", 'length(x.s)')} AS char_alpha_ratio,
    {div('length(x.s)', 'coalesce(t.ntok, 0)')} AS char_per_token,
    {div("len(regexp_extract_all(x.s, '\\p{Lu}'))", 'length(x.s)')} AS char_upper_ratio,
    {div("len(regexp_extract_all(x.s, '\\p{Nd}'))", 'length(x.s)')} AS char_digit_ratio,
    CAST(regexp_matches(x.s, {q(lx.REPEATED_PUNCT_REGEX)}) AS INTEGER) AS repeated_punct,
    CAST(contains(x.s, '*') OR contains(x.s, '_') AS INTEGER) AS markdown_emphasis,
    CAST(coalesce(t.all_caps_words, 0) AS BIGINT) AS all_caps_words,
    {div('coalesce(t.fw, 0)', 'coalesce(t.ntok, 0)')} AS function_word_ratio,
    {div('coalesce(t.pron, 0)', 'coalesce(t.ntok, 0)')} AS pronoun_ratio,
    {div('coalesce(t.cconj, 0)', 'coalesce(t.ntok, 0)')} AS conjunction_ratio,
    {div('coalesce(t.adp, 0)', 'coalesce(t.ntok, 0)')} AS preposition_ratio,
    {div('coalesce(t.p1, 0)', 'coalesce(t.ntok, 0)')} AS first_person_ratio,
    {div('coalesce(t.wh, 0)', 'coalesce(t.ntok, 0)')} AS wh_word_ratio,
    {div('coalesce(t.p2, 0)', 'coalesce(t.ntok, 0)')} AS second_person_ratio,
    {div('coalesce(t.p3, 0)', 'coalesce(t.ntok, 0)')} AS third_person_ratio,
    {div('coalesce(t.stop, 0)', 'coalesce(t.ntok, 0)')} AS stopword_ratio,
    coalesce(t.words, 0) AS words, greatest(1, len(regexp_extract_all(x.s, '[.!?]+'))) AS rd_sents,
    coalesce(t.syllables, 0) AS syllable_count, coalesce(t.complex, 0) AS complex,
    coalesce(t.difficult, 0) AS difficult, coalesce(t.word_chars, 0) AS word_chars,
    CASE WHEN coalesce(t.ntok, 0) > 0 THEN 50.0 + 0.5 * t.formal / t.ntok ELSE 50.0 END AS formality_score,
    {div('coalesce(e.n_ent, 0)', 'coalesce(t.ntok, 0)')} AS ner_density,
    {div('coalesce(t.modal, 0)', 'coalesce(t.ntok, 0)')} AS modal_word_ratio,
    {div(' + '.join(f'CAST(contains(x.ls, {q(m)}) AS INTEGER)' for m in lx.DISCOURSE_MARKERS), 'coalesce(t.ntok, 0)')} AS discourse_marker_ratio,
    CAST(regexp_matches(x.s, {q(lx.EMOJI_CLASS)}) AS INTEGER) AS has_emoji,
    CAST(regexp_matches(x.s, '[^\\x00-\\x7F]') AS INTEGER) AS has_non_ascii,
    CAST(regexp_matches(x.s, {q('[' + lx.QUOTE_CHARS + '].+[' + lx.QUOTE_CHARS + ']')}) AS INTEGER) AS has_quoted_text,
    coalesce(sa.pol, 0.0) AS sentiment_polarity, coalesce(sa.subj, 0.0) AS subjectivity_score,
    CAST(ends_with(x.s, '?') AND coalesce(list_contains({lst(lx.RHETORICAL_FIRST_WORDS)}, lower(x.words_ws[1])), false) AS INTEGER) AS rhetorical_question,
    CAST(len(list_filter(x.words_ws, lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 2)) > 0 AS INTEGER) AS has_all_caps,
    CAST({' OR '.join(f'contains(x.ls, {q(m)})' for m in lx.SARCASM_MARKERS)} AS INTEGER) AS sarcasm_marker,
    {', '.join(f"CAST(len(list_filter(x.lwords_ws, lambda w: list_contains({lst(v)}, w))) AS INTEGER) AS {k}" for k, v in lx.LIWC_CATEGORIES.items())},
    CAST(coalesce(list_contains({lst(lx.DISCOURSE_MARKERS)}, lower(x.toks[1])), false) AS INTEGER) AS starts_with_discourse
  FROM sstr x LEFT JOIN tagg t USING (problem_id, sent_idx) LEFT JOIN freq f USING (problem_id, sent_idx)
  LEFT JOIN senti_agg sa USING (problem_id, sent_idx) LEFT JOIN ents e USING (problem_id, sent_idx)),
lexical2 AS (
  SELECT *,
    CASE WHEN words > 0 THEN 206.835 - 1.015 * (words / rd_sents) - 84.6 * (syllable_count / words) ELSE 0.0 END AS flesch_reading_ease,
    CASE WHEN words > 0 THEN 0.4 * ((words / rd_sents) + 100.0 * (complex / words)) ELSE 0.0 END AS gunning_fog,
    CASE WHEN words > 0 THEN 4.71 * (word_chars / words) + 0.5 * (words / rd_sents) - 21.43 ELSE 0.0 END AS automated_readability_index,
    CASE WHEN words > 0 THEN 0.1579 * (100.0 * (difficult / words)) + 0.0496 * (words / rd_sents)
      + CASE WHEN 100.0 * (difficult / words) > 5 THEN 3.6365 ELSE 0.0 END ELSE 0.0 END AS dale_chall_score
  FROM lexical)"""

LEX_BASE = TOK_BASE + [SENTI, LEX]

_INT_COLS = {"sentence_char_len", "sentence_token_len", "all_caps_words", "syllable_count", "repeated_punct",
             "markdown_emphasis", "sarcasm_marker", "has_emoji", "has_non_ascii", "has_quoted_text",
             "starts_with_discourse", "rhetorical_question", "has_all_caps", *lx.LIWC_CATEGORIES.keys()}


def _lex_sql(cols) -> str:
    sel = ", ".join(c if c in _INT_COLS else f"{R(c)} AS {c}" for c in cols)
    return with_(*LEX_BASE) + f"SELECT problem_id, sent_idx, {sel} FROM lexical2"


def register_lexical(queries: dict[str, list[str]]):
    for name, cols in queries.items():
        SQL[name] = _lex_sql(cols)


# ---------------------------------------------------------------------------------------------
# POS n-grams, entropy, TF-IDF, overlaps
# ---------------------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT problem_id, sent_idx AS pair_idx FROM sentences
  WHERE n_sentences >= 2 AND sent_idx < n_sentences - 1)"""

NGRAM_WIN = """grams AS (
  SELECT problem_id, sent_idx, tok_idx, upos,
         lead(upos, 1) OVER w AS u1, lead(upos, 2) OVER w AS u2
  FROM ann WINDOW w AS (PARTITION BY problem_id, sent_idx ORDER BY tok_idx))"""

SQL["pos_ngrams"] = with_(*TOK_BASE, NGRAM_WIN) + """SELECT problem_id, sent_idx, kind, ngram, count(*) AS cnt FROM (
  SELECT problem_id, sent_idx, 'bigram' AS kind, upos || '_' || u1 AS ngram FROM grams WHERE u1 IS NOT NULL
  UNION ALL
  SELECT problem_id, sent_idx, 'skipgram' AS kind, upos || '_' || u2 AS ngram FROM grams WHERE u2 IS NOT NULL)
GROUP BY ALL"""

ENTROPY = """ent_counts AS (
  SELECT problem_id, sent_idx, g, count(*) AS c FROM (
    SELECT problem_id, sent_idx, upos || ' ' || u1 AS g FROM grams WHERE u1 IS NOT NULL
    UNION ALL SELECT problem_id, sent_idx, upos || ' ' || u1 || ' ' || u2 FROM grams WHERE u2 IS NOT NULL)
  GROUP BY ALL),
ent_tot AS (SELECT problem_id, sent_idx, sum(c) AS n FROM ent_counts GROUP BY ALL),
entropy AS (
  SELECT s.problem_id, s.sent_idx,
         coalesce((SELECT -sum((c / t.n) * ln(c / t.n)) FROM ent_counts e, ent_tot t
                   WHERE e.problem_id = s.problem_id AND e.sent_idx = s.sent_idx
                     AND t.problem_id = s.problem_id AND t.sent_idx = s.sent_idx), 0.0) AS pos_entropy
  FROM sentences s)"""

SQL["pos_entropy"] = with_(*TOK_BASE, NGRAM_WIN, ENTROPY) + f"""SELECT problem_id, sent_idx,
  {R('pos_entropy')} AS pos_entropy FROM entropy"""

SQL["pos_entropy_pairs"] = with_(*TOK_BASE, NGRAM_WIN, ENTROPY) + f"""SELECT a.problem_id, a.sent_idx AS pair_idx,
  {R('b.pos_entropy - a.pos_entropy')} AS pos_entropy_diff, {R('abs(b.pos_entropy - a.pos_entropy)')} AS pos_entropy_abs_diff
FROM entropy a JOIN entropy b ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1"""


def _ngram_sim_sql(kind: str, n: int, skip: int) -> str:
    last = "u2" if (n == 3 or skip == 1) else "u1"
    expr = {("bigram"): "upos || '_' || u1", "skipgram": "upos || '_' || u2",
            "trigram": "upos || '_' || u1 || '_' || u2"}[kind]
    return f"""c_{kind} AS (
  SELECT problem_id, sent_idx, {expr} AS term, count(*) AS c FROM grams WHERE {last} IS NOT NULL GROUP BY ALL),
n_{kind} AS (SELECT problem_id, sent_idx, sqrt(sum(c * c)) AS nrm, count(*) AS k FROM c_{kind} GROUP BY ALL),
d_{kind} AS (
  SELECT a.problem_id, a.sent_idx AS pair_idx, sum(a.c * b.c) AS dot, count(*) AS inter
  FROM c_{kind} a JOIN c_{kind} b ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1 AND a.term = b.term
  GROUP BY ALL),
s_{kind} AS (
  SELECT p.problem_id, p.pair_idx,
    CASE WHEN na.k > 0 AND nb.k > 0 THEN coalesce(d.dot, 0) / (na.nrm * nb.nrm) ELSE 0.0 END AS pos_{kind}_cosine,
    CASE WHEN na.k > 0 AND nb.k > 0 THEN CAST(coalesce(d.inter, 0) AS DOUBLE) / (na.k + nb.k - coalesce(d.inter, 0)) ELSE 0.0 END
      AS pos_{kind}_jaccard
  FROM pairs p LEFT JOIN n_{kind} na ON na.problem_id = p.problem_id AND na.sent_idx = p.pair_idx
  LEFT JOIN n_{kind} nb ON nb.problem_id = p.problem_id AND nb.sent_idx = p.pair_idx + 1
  LEFT JOIN d_{kind} d ON d.problem_id = p.problem_id AND d.pair_idx = p.pair_idx)"""


SQL["pos_ngram_similarity"] = with_(*TOK_BASE, PAIRS, NGRAM_WIN, _ngram_sim_sql("bigram", 2, 0),
                                    _ngram_sim_sql("trigram", 3, 0)) + f"""SELECT problem_id, pair_idx,
  {R('b.pos_bigram_cosine')} AS pos_bigram_cosine, {R('b.pos_bigram_jaccard')} AS pos_bigram_jaccard,
  {R('t.pos_trigram_cosine')} AS pos_trigram_cosine, {R('t.pos_trigram_jaccard')} AS pos_trigram_jaccard
FROM s_bigram b JOIN s_trigram t USING (problem_id, pair_idx)"""

SQL["pos_tfidf_cosine"] = with_(*TOK_BASE, PAIRS) + f""", lt AS (
  SELECT problem_id, sent_idx, lower(upos) AS t,
         row_number() OVER (PARTITION BY problem_id, sent_idx ORDER BY tok_idx) AS pos
  FROM ann WHERE length(upos) >= 2),
lg AS (SELECT problem_id, sent_idx, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2
  FROM lt WINDOW w AS (PARTITION BY problem_id, sent_idx ORDER BY pos)),
terms AS (
  SELECT problem_id, sent_idx, t || ' ' || t1 AS term FROM lg WHERE t1 IS NOT NULL
  UNION ALL SELECT problem_id, sent_idx, t || ' ' || t1 || ' ' || t2 FROM lg WHERE t2 IS NOT NULL),
tf AS (SELECT problem_id, sent_idx, term, count(*) AS tf FROM terms GROUP BY ALL),
dfreq AS (SELECT problem_id, term, count(*) AS df FROM tf GROUP BY ALL),
nsent AS (SELECT DISTINCT problem_id, n_sentences FROM sentences),
w AS (
  SELECT tf.problem_id, tf.sent_idx, tf.term, tf.tf * (ln((1.0 + n.n_sentences) / (1.0 + d.df)) + 1.0) AS w
  FROM tf JOIN dfreq d USING (problem_id, term) JOIN nsent n USING (problem_id)),
nw AS (SELECT problem_id, sent_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY problem_id, sent_idx)) AS v FROM w),
dots AS (
  SELECT a.problem_id, a.sent_idx AS pair_idx, sum(a.v * b.v) AS dot
  FROM nw a JOIN nw b ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1 AND a.term = b.term
  GROUP BY ALL)
SELECT p.problem_id, p.pair_idx, {R('coalesce(d.dot, 0.0)')} AS pos_tfidf_cosine
FROM pairs p LEFT JOIN dots d USING (problem_id, pair_idx)"""

ENTS = """ent_runs AS (
  SELECT problem_id, sent_idx, lower(string_agg(text, ' ' ORDER BY tok_idx)) AS ent FROM (
    SELECT problem_id, sent_idx, tok_idx, text,
           tok_idx - row_number() OVER (PARTITION BY problem_id, sent_idx ORDER BY tok_idx) AS grp
    FROM ann WHERE tok_idx > 0 AND is_alpha AND regexp_matches(text, '^\\p{Lu}'))
  GROUP BY problem_id, sent_idx, grp),
ent_sets AS (SELECT DISTINCT problem_id, sent_idx, ent AS item FROM ent_runs)"""

LEMMAS = """lem_sets AS (SELECT DISTINCT problem_id, sent_idx, lemma AS item FROM ann WHERE is_alpha)"""


def _overlap_sql(sets: str, out: str) -> str:
    return f"""{out}_k AS (SELECT problem_id, sent_idx, count(*) AS k FROM {sets} GROUP BY ALL),
{out}_i AS (
  SELECT a.problem_id, a.sent_idx, count(*) AS inter FROM {sets} a JOIN {sets} b
    ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1 AND a.item = b.item GROUP BY ALL),
{out} AS (
  SELECT s.problem_id, s.sent_idx,
    CASE WHEN s.sent_idx = s.n_sentences - 1 THEN 0.0
         WHEN coalesce(ka.k, 0) + coalesce(kb.k, 0) - coalesce(i.inter, 0) = 0 THEN 0.0
         ELSE CAST(coalesce(i.inter, 0) AS DOUBLE) / (coalesce(ka.k, 0) + coalesce(kb.k, 0) - coalesce(i.inter, 0)) END AS {out}
  FROM sentences s LEFT JOIN {out}_k ka ON ka.problem_id = s.problem_id AND ka.sent_idx = s.sent_idx
  LEFT JOIN {out}_k kb ON kb.problem_id = s.problem_id AND kb.sent_idx = s.sent_idx + 1
  LEFT JOIN {out}_i i ON i.problem_id = s.problem_id AND i.sent_idx = s.sent_idx)"""


SQL["entity_density_overlap"] = with_(*LEX_BASE, ENTS, _overlap_sql("ent_sets", "ner_overlap_next")) + f"""SELECT
  l.problem_id, l.sent_idx, {R('l.ner_density')} AS ner_density, {R('o.ner_overlap_next')} AS ner_overlap_next
FROM lexical2 l JOIN ner_overlap_next o USING (problem_id, sent_idx)"""

SQL["lemma_overlap"] = with_(*TOK_BASE, LEMMAS, _overlap_sql("lem_sets", "lemma_overlap_next")) + f"""SELECT
  problem_id, sent_idx, {R('lemma_overlap_next')} AS lemma_overlap_next FROM lemma_overlap_next"""


# ---------------------------------------------------------------------------------------------
# Word adjacency networks
# ---------------------------------------------------------------------------------------------

PRESETS = f"""presets AS (SELECT * FROM {_values([(k, *map(str, v)) for k, v in lx.PRESETS.items()],
                                               ['preset', 'rp', 'rs', 'lm', 'ip'])}),
dpreset AS (SELECT * FROM {_values(list(lx.DIFFICULTY_PRESET.items()), ['difficulty', 'preset'])}),
pflags AS (SELECT difficulty, rp = 'True' AS remove_punct, rs = 'True' AS remove_stopwords, lm = 'True' AS lemmatize,
                  ip = 'True' AS include_pos FROM dpreset JOIN presets USING (preset))"""


def _lemma_sql(w: str) -> str:
    rules = ' '.join(f"WHEN regexp_matches({w}, {q(p)}) THEN regexp_replace({w}, {q(p)}, {q(r.replace('$1', chr(92) + '1'))})"
                     for p, r in lx.LEMMA_RULES)
    return (f"(CASE WHEN list_contains({STOP_LIST}, {w}) OR NOT regexp_matches({w}, '^\\p{{L}}+$') OR length({w}) <= 4 "
            f"THEN {w} {rules} ELSE {w} END)")


def _upos_rules_sql(w: str) -> str:
    rules = ' '.join(f"WHEN regexp_matches({w}, {q(p)}) THEN {q(tag)}" for tag, p in lx.OPEN_CLASS_RULES)
    return (f"(CASE WHEN NOT regexp_matches({w}, '^[\\p{{L}}\\p{{M}}\\p{{N}}]') THEN "
            f"(CASE WHEN regexp_matches({w}, '^\\p{{P}}+$') THEN 'PUNCT' ELSE 'SYM' END) {rules} ELSE 'NOUN' END)")


def wan_sql(graph_src: str = "sentences", gkey: str = "sent_idx", text_col: str = "sentence",
            flags: str = "pflags", flag_join: str = "USING (difficulty)") -> str:
    """CTEs wan_words, wan_edges, wan_nodes, wan_deg for graphs keyed (problem_id, gkey)."""
    return f"""nt0 AS (
  SELECT problem_id, {gkey}, difficulty, CAST(unnest(range(len(toks))) AS INTEGER) AS k, unnest(toks) AS tok
  FROM (SELECT problem_id, {gkey}, difficulty,
               regexp_extract_all(replace(lower({text_col}), 'ß', 'ss'), '{TOKEN}') AS toks FROM {graph_src})),
nt1 AS (
  SELECT t.problem_id, t.{gkey}, f.include_pos, t.k,
         CASE WHEN f.lemmatize THEN {_lemma_sql('lower(t.tok)')} ELSE t.tok END AS w
  FROM nt0 t JOIN {flags} f {flag_join}
  WHERE NOT ((f.remove_stopwords AND list_contains({STOP_LIST}, lower(t.tok)))
             OR (f.remove_punct AND regexp_matches(t.tok, '^\\p{{P}}+$')))),
wan_words AS (
  SELECT n.problem_id, n.{gkey}, n.include_pos, n.w,
         'POS_' || coalesce(c.upos, {_upos_rules_sql('lower(n.w)')}) AS tag,
         row_number() OVER (PARTITION BY n.problem_id, n.{gkey} ORDER BY n.k) AS pos,
         count(*) OVER (PARTITION BY n.problem_id, n.{gkey}) AS nw
  FROM nt1 n LEFT JOIN closed_class c ON c.word = lower(n.w)),
wan_seq AS (
  SELECT *, lead(w) OVER x AS w1, lead(tag) OVER x AS t1 FROM wan_words
  WINDOW x AS (PARTITION BY problem_id, {gkey} ORDER BY pos)),
wan_edges AS (
  SELECT problem_id, {gkey}, src, dst, edge_type, count(*) AS weight FROM (
    SELECT problem_id, {gkey}, w AS src, w1 AS dst, 'word' AS edge_type FROM wan_seq WHERE w1 IS NOT NULL
    UNION ALL
    SELECT problem_id, {gkey}, tag, t1, 'pos_pos' FROM wan_seq WHERE t1 IS NOT NULL AND include_pos)
  WHERE src <> dst GROUP BY ALL),
wan_nodes AS (
  SELECT DISTINCT problem_id, {gkey}, w AS node, 'word' AS node_type FROM wan_words WHERE nw >= 2
  UNION SELECT DISTINCT problem_id, {gkey}, tag, 'POS' FROM wan_words WHERE nw >= 2 AND include_pos),
wan_deg AS (
  SELECT n.problem_id, n.{gkey}, n.node, n.node_type,
         coalesce(i.c, 0) AS in_deg, coalesce(o.c, 0) AS out_deg, coalesce(i.c, 0) + coalesce(o.c, 0) AS deg
  FROM wan_nodes n
  LEFT JOIN (SELECT problem_id, {gkey}, dst AS node, count(*) AS c FROM wan_edges GROUP BY ALL) i USING (problem_id, {gkey}, node)
  LEFT JOIN (SELECT problem_id, {gkey}, src AS node, count(*) AS c FROM wan_edges GROUP BY ALL) o USING (problem_id, {gkey}, node)),
wan_und AS (SELECT DISTINCT problem_id, {gkey}, least(src, dst) AS a, greatest(src, dst) AS b FROM wan_edges),
wan_tri AS (
  SELECT e1.problem_id, e1.{gkey}, e1.a AS x, e1.b AS y, e2.b AS z
  FROM wan_und e1 JOIN wan_und e2 ON e1.problem_id = e2.problem_id AND e1.{gkey} = e2.{gkey} AND e1.a = e2.a AND e1.b < e2.b
  JOIN wan_und e3 ON e3.problem_id = e1.problem_id AND e3.{gkey} = e1.{gkey} AND e3.a = e1.b AND e3.b = e2.b),
wan_k AS (
  SELECT problem_id, {gkey}, node, count(*) AS k FROM (
    SELECT problem_id, {gkey}, a AS node FROM wan_und UNION ALL SELECT problem_id, {gkey}, b FROM wan_und) GROUP BY ALL),
wan_t AS (
  SELECT problem_id, {gkey}, node, count(*) AS t FROM (
    SELECT problem_id, {gkey}, x AS node FROM wan_tri UNION ALL SELECT problem_id, {gkey}, y FROM wan_tri
    UNION ALL SELECT problem_id, {gkey}, z FROM wan_tri) GROUP BY ALL),
wan_m AS (
  SELECT d.problem_id, d.{gkey}, count(*) AS V, CAST(sum(d.out_deg) AS BIGINT) AS E,
    avg(d.deg) AS deg_mean, stddev_pop(d.deg) AS deg_std, max(d.deg) AS deg_max, min(d.deg) AS deg_min,
    avg(d.in_deg) AS in_degree_mean, stddev_pop(d.in_deg) AS in_degree_std,
    avg(d.out_deg) AS out_degree_mean, stddev_pop(d.out_deg) AS out_degree_std,
    count(*) FILTER (WHERE d.deg >= 3) AS star, count(*) FILTER (WHERE d.node_type = 'POS') AS vp,
    coalesce(sum(d.out_deg) FILTER (WHERE d.node_type = 'POS'), 0) AS ep,
    avg(d.deg) FILTER (WHERE d.node_type = 'POS') AS pdeg_mean, stddev_pop(d.deg) FILTER (WHERE d.node_type = 'POS') AS pdeg_std,
    sum(CASE WHEN coalesce(k.k, 0) >= 2 THEN 2.0 * coalesce(t.t, 0) / (k.k * (k.k - 1)) ELSE 0.0 END) AS csum
  FROM wan_deg d LEFT JOIN wan_k k USING (problem_id, {gkey}, node) LEFT JOIN wan_t t USING (problem_id, {gkey}, node)
  GROUP BY ALL),
wan_hist AS (SELECT problem_id, {gkey}, deg, count(*) AS c FROM wan_deg GROUP BY ALL),
wan_dent AS (
  SELECT h.problem_id, h.{gkey}, -sum((h.c / m.V) * ln(h.c / m.V)) AS degree_entropy
  FROM wan_hist h JOIN wan_m m USING (problem_id, {gkey}) GROUP BY ALL),
wan_pte AS (
  SELECT problem_id, {gkey}, ln(count(*)) AS pte,
         -sum((weight / tot) * ln(weight / tot)) AS ptew
  FROM (SELECT *, sum(weight) OVER (PARTITION BY problem_id, {gkey}) AS tot FROM wan_edges
        WHERE contains(src, 'POS_') AND contains(dst, 'POS_')) GROUP BY ALL),
wan_assort AS (
  SELECT e.problem_id, e.{gkey},
         CAST(count(*) * sum(s.out_deg * d.in_deg) - sum(s.out_deg) * sum(d.in_deg) AS DOUBLE) AS cov,
         sqrt(CAST(count(*) * sum(s.out_deg * s.out_deg) - sum(s.out_deg) * sum(s.out_deg) AS DOUBLE)
              * CAST(count(*) * sum(d.in_deg * d.in_deg) - sum(d.in_deg) * sum(d.in_deg) AS DOUBLE)) AS den
  FROM wan_edges e JOIN wan_deg s ON s.problem_id = e.problem_id AND s.{gkey} = e.{gkey} AND s.node = e.src
  JOIN wan_deg d ON d.problem_id = e.problem_id AND d.{gkey} = e.{gkey} AND d.node = e.dst GROUP BY ALL),
wan_ntri AS (SELECT problem_id, {gkey}, count(*) AS tc FROM wan_tri GROUP BY ALL),
wan_metrics AS (
  SELECT m.problem_id, m.{gkey}, m.V, m.E,
    CAST(2 * m.E AS DOUBLE) / m.V AS average_degree,
    CASE WHEN m.V > 1 THEN CAST(m.E AS DOUBLE) / (m.V * (m.V - 1)) ELSE 0.0 END AS density,
    CASE WHEN m.V = 1 THEN 1.0 ELSE m.deg_mean / (m.V - 1) END AS degree_centrality_mean,
    CASE WHEN m.V <= 1 THEN 0.0 ELSE m.deg_std / (m.V - 1) END AS degree_centrality_std,
    CASE WHEN m.V = 1 THEN 1.0 ELSE m.deg_max / (m.V - 1) END AS degree_centrality_max,
    CASE WHEN m.V = 1 THEN 1.0 ELSE m.deg_min / (m.V - 1) END AS degree_centrality_min,
    m.in_degree_mean, m.in_degree_std, m.out_degree_mean, m.out_degree_std,
    CAST(m.star AS DOUBLE) / m.V AS star_ratio, CAST(m.vp AS BIGINT) AS pos_node_count,
    CASE WHEN m.vp > 0 THEN 2.0 * m.ep / m.vp ELSE 0.0 END AS pos_avg_degree,
    CASE WHEN m.vp > 1 THEN CAST(m.ep AS DOUBLE) / (m.vp * (m.vp - 1)) ELSE 0.0 END AS pos_density,
    CASE WHEN m.vp = 0 THEN 0.0 WHEN m.vp = 1 THEN 1.0 ELSE m.pdeg_mean / (m.vp - 1) END AS pos_centrality_mean,
    CASE WHEN m.vp <= 1 THEN 0.0 ELSE m.pdeg_std / (m.vp - 1) END AS pos_centrality_std,
    CASE WHEN m.V > 1 THEN floor((m.csum / m.V) * 1e12 + 0.5) / 1e12 ELSE 0.0 END AS average_clustering,
    CAST(coalesce(nt.tc, 0) AS BIGINT) AS triangle_count,
    CASE WHEN m.V <= 1 THEN 0.0 WHEN coalesce(a.den, 0) = 0 THEN NULL ELSE a.cov / a.den END AS assortativity,
    de.degree_entropy, coalesce(p.pte, 0.0) AS pos_transition_entropy, coalesce(p.ptew, 0.0) AS pos_transition_entropy_weighted
  FROM wan_m m LEFT JOIN wan_dent de USING (problem_id, {gkey}) LEFT JOIN wan_pte p USING (problem_id, {gkey})
  LEFT JOIN wan_assort a USING (problem_id, {gkey}) LEFT JOIN wan_ntri nt USING (problem_id, {gkey}))"""


WAN_BASE = TOK_BASE + [PRESETS, wan_sql()]
_WAN_INT = {"V", "E", "pos_node_count", "triangle_count"}


def register_wan(queries: dict[str, list[str]]):
    for name, cols in queries.items():
        sel = ", ".join(c if c in _WAN_INT else f"{R(c)} AS {c}" for c in cols)
        SQL[name] = with_(*WAN_BASE) + f"SELECT problem_id, sent_idx, {sel} FROM wan_metrics"


SQL["wan_edges"] = with_(*WAN_BASE) + "SELECT problem_id, sent_idx, src, dst, weight, edge_type FROM wan_edges"

SQL["wan_nodes"] = with_(*WAN_BASE) + """SELECT problem_id, sent_idx, w AS node, 'word' AS node_type,
  max_by(CASE WHEN include_pos THEN substr(tag, 5) END, pos) AS pos
FROM wan_words WHERE nw >= 2 GROUP BY problem_id, sent_idx, w
UNION ALL SELECT problem_id, sent_idx, node, node_type, NULL FROM wan_nodes WHERE node_type = 'POS'"""

SQL["wan_pairwise"] = with_(*WAN_BASE) + f""", dc AS (
  SELECT d.problem_id, d.sent_idx, d.node, CASE WHEN m.V = 1 THEN 1.0 ELSE CAST(d.deg AS DOUBLE) / (m.V - 1) END AS dc
  FROM wan_deg d JOIN wan_m m USING (problem_id, sent_idx)),
gn AS (SELECT problem_id, sent_idx, count(*) AS nv, sqrt(sum(dc * dc)) AS nrm FROM dc GROUP BY ALL),
ge AS (SELECT problem_id, sent_idx, count(*) AS ne FROM wan_edges GROUP BY ALL),
ni AS (SELECT a.problem_id, a.sent_idx, count(*) AS i, sum(a.dc * b.dc) AS dot FROM dc a JOIN dc b
  ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1 AND a.node = b.node GROUP BY ALL),
ei AS (SELECT a.problem_id, a.sent_idx, count(*) AS i FROM wan_edges a JOIN wan_edges b
  ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1 AND a.src = b.src AND a.dst = b.dst GROUP BY ALL)
SELECT a.problem_id, a.sent_idx AS pair_idx,
  {R("CASE WHEN coalesce(ea.ne, 0) + coalesce(eb.ne, 0) - coalesce(ei.i, 0) = 0 THEN 0.0 ELSE CAST(coalesce(ei.i, 0) AS DOUBLE) / (coalesce(ea.ne, 0) + coalesce(eb.ne, 0) - coalesce(ei.i, 0)) END")} AS edge_jaccard,
  {R("CAST(coalesce(ni.i, 0) AS DOUBLE) / (a.nv + b.nv - coalesce(ni.i, 0))")} AS node_jaccard,
  {R("CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0 ELSE coalesce(ni.dot, 0.0) / (a.nrm * b.nrm) END")} AS centrality_cosine
FROM gn a JOIN gn b ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1
LEFT JOIN ge ea ON ea.problem_id = a.problem_id AND ea.sent_idx = a.sent_idx
LEFT JOIN ge eb ON eb.problem_id = b.problem_id AND eb.sent_idx = b.sent_idx
LEFT JOIN ni ON ni.problem_id = a.problem_id AND ni.sent_idx = a.sent_idx
LEFT JOIN ei ON ei.problem_id = a.problem_id AND ei.sent_idx = a.sent_idx"""


# ---------------------------------------------------------------------------------------------
# Embeddings
# ---------------------------------------------------------------------------------------------

EMB = """emb AS (
  SELECT CAST(label AS BIGINT) AS problem_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS sent_idx,
         CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
embn AS (
  SELECT problem_id, sent_idx, e, lag(e) OVER w AS ep, lead(e, 1) OVER w AS e1, lead(e, 2) OVER w AS e2,
         lead(e, 3) OVER w AS e3
  FROM emb WINDOW w AS (PARTITION BY problem_id ORDER BY sent_idx))"""


def _dot(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def _nrm(a):
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def _cos(a, b):
    return f"(CASE WHEN {_nrm(a)} * {_nrm(b)} = 0 THEN 0.0 ELSE {_dot(a, b)} / ({_nrm(a)} * {_nrm(b)}) END)"


def _euc(a, b):
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[2] - p[1]) ^ 2)))"


def _sub(a, b):
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"


SQL["embedding_pairs"] = with_(EMB) + f"""SELECT problem_id, sent_idx AS pair_idx,
  {R(_cos('e', 'e1'))} AS sbert_cosine_similarity, {R('1.0 - ' + _cos('e', 'e1'))} AS sbert_cosine_distance,
  {R(_euc('e', 'e1'))} AS sbert_euclidean,
  {R("list_sum(list_transform(list_zip(e, e1), lambda p: abs(p[2] - p[1])))")} AS sbert_manhattan,
  {R(f"CASE WHEN {_nrm('e')} = 0 THEN 0.0 ELSE {_nrm('e1')} / {_nrm('e')} END")} AS sbert_norm_ratio
FROM embn WHERE e1 IS NOT NULL"""

_FINITE = "CASE WHEN {0} IS NULL OR NOT isfinite({0}) THEN 0.0 ELSE {0} END"

SQL["embedding_vectors"] = with_(EMB) + f"""SELECT problem_id, pair_idx, CAST(k - 1 AS INTEGER) AS dim,
  {R(_FINITE.format("e[k]"))} AS f1_sbert, {R(_FINITE.format("e1[k]"))} AS f2_sbert,
  {R(_FINITE.format("(e1[k] - e[k])"))} AS delta_sbert
FROM (SELECT problem_id, sent_idx AS pair_idx, e, e1, unnest(range(1, greatest(len(e), len(e1)) + 1)) AS k
      FROM embn WHERE e1 IS NOT NULL)"""

SQL["multi_skip_drift"] = with_(EMB) + "SELECT problem_id, sent_idx AS pair_idx, " + ", ".join(
    f"{R(f'CASE WHEN e{k} IS NULL THEN NULL ELSE {_euc(chr(101), f"e{k}")} END')} AS semantic_drift_distance_skip{k}, "
    f"{R(f'CASE WHEN e{k} IS NULL THEN NULL ELSE {_cos(chr(101), f"e{k}")} END')} AS semantic_drift_cosine_skip{k}"
    for k in lx.DRIFT_SKIPS) + " FROM embn WHERE e1 IS NOT NULL"

SQL["directional_cosine"] = with_(EMB) + f"""SELECT problem_id, sent_idx AS pair_idx,
  {R(f"CASE WHEN e2 IS NULL THEN 0.0 ELSE {_cos(_sub('e1', 'e'), _sub('e2', 'e1'))} END")} AS sbert_directional_cosine
FROM embn WHERE e1 IS NOT NULL"""

SQL["neighbor_cosine"] = with_(EMB) + f"""SELECT problem_id, sent_idx,
  {R(f"CASE WHEN ep IS NULL OR e1 IS NULL THEN 0.0 ELSE ({_cos('e', 'ep')} + {_cos('e', 'e1')}) / 2.0 END")} AS avg_sbert_cosine_neighbors
FROM embn"""


# ---------------------------------------------------------------------------------------------
# Dependency operators over the rule parse
# ---------------------------------------------------------------------------------------------

PARSE = """pz AS (
  SELECT a.*, coalesce(min(tok_idx) FILTER (WHERE upos IN ('VERB', 'AUX')) OVER (PARTITION BY problem_id, sent_idx), 0) AS root,
         count(*) OVER (PARTITION BY problem_id, sent_idx) AS n,
         lag(lower) OVER w AS prev_low, lag(upos) OVER w AS prev_tag
  FROM ann a WINDOW w AS (PARTITION BY problem_id, sent_idx ORDER BY tok_idx)),
rootinfo AS (
  SELECT r.problem_id, r.sent_idx,
         (r.upos = 'VERB' AND ends_with(r.lower, 'ed') AND r.tok_idx > 0
          AND coalesce(list_contains(['is', 'are', 'was', 'were', 'be', 'been', 'being'], r.prev_low), false)) AS passive
  FROM pz r WHERE r.tok_idx = r.root),
parse AS (
  SELECT pz.problem_id, pz.sent_idx, pz.tok_idx, pz.text, pz.upos,
    CASE WHEN tok_idx = root THEN tok_idx WHEN upos IN ('DET', 'ADJ') AND tok_idx + 1 < n THEN tok_idx + 1 ELSE root END AS head_idx,
    CASE WHEN tok_idx = root THEN 'ROOT' WHEN upos = 'DET' THEN 'det' WHEN upos = 'ADJ' THEN 'amod'
         WHEN upos IN ('PRON', 'NOUN') AND tok_idx < root THEN (CASE WHEN ri.passive THEN 'nsubjpass' ELSE 'nsubj' END)
         WHEN upos = 'VERB' AND prev_low = 'to' THEN 'xcomp'
         WHEN upos = 'VERB' AND prev_tag = 'SCONJ' THEN 'advcl'
         WHEN upos = 'VERB' AND list_contains(['who', 'which', 'that'], prev_low) THEN 'relcl'
         WHEN upos = 'VERB' THEN 'ccomp' ELSE 'dep' END AS dep
  FROM pz LEFT JOIN rootinfo ri USING (problem_id, sent_idx))"""

SQL["clause_ratio"] = with_(*TOK_BASE, PARSE) + f"""SELECT s.problem_id, s.sent_idx,
  {R("coalesce(c.r, 0.0)")} AS clause_complexity
FROM sentences s LEFT JOIN (SELECT problem_id, sent_idx,
  CAST(count(*) FILTER (WHERE list_contains({lst(lx.CLAUSE_DEPS)}, dep)) AS DOUBLE) / count(*) AS r FROM parse GROUP BY ALL) c
USING (problem_id, sent_idx)"""

SQL["passive_ratio"] = with_(*TOK_BASE, PARSE) + f"""SELECT s.problem_id, s.sent_idx, {R("coalesce(c.r, 0.0)")} AS passive_ratio
FROM sentences s LEFT JOIN (
  SELECT v.problem_id, v.sent_idx,
         CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM parse c WHERE c.problem_id = v.problem_id
             AND c.sent_idx = v.sent_idx AND c.head_idx = v.tok_idx AND c.dep = 'nsubjpass')) AS DOUBLE) / count(*) AS r
  FROM parse v WHERE v.upos = 'VERB' GROUP BY ALL) c USING (problem_id, sent_idx)"""

SQL["dep_depth"] = "WITH RECURSIVE " + ",\n".join([*TOK_BASE, PARSE]) + f""",
walk(problem_id, sent_idx, tok_idx, cur, d) AS (
  SELECT problem_id, sent_idx, tok_idx, tok_idx, 0 FROM parse
  UNION ALL
  SELECT w.problem_id, w.sent_idx, w.tok_idx, p.head_idx, w.d + 1 FROM walk w JOIN parse p
    ON p.problem_id = w.problem_id AND p.sent_idx = w.sent_idx AND p.tok_idx = w.cur WHERE p.head_idx <> p.tok_idx),
depth AS (SELECT problem_id, sent_idx, tok_idx, max(d) AS d FROM walk GROUP BY ALL)
SELECT s.problem_id, s.sent_idx, {R("coalesce(x.a, 0.0)")} AS dependency_avg_depth
FROM sentences s LEFT JOIN (SELECT problem_id, sent_idx, avg(d) AS a FROM depth GROUP BY ALL) x USING (problem_id, sent_idx)"""

SQL["subject_overlap"] = with_(*TOK_BASE, PARSE) + """, subj AS (SELECT DISTINCT problem_id, sent_idx, lower(text) AS w FROM parse WHERE dep = 'nsubj')
SELECT s.problem_id, s.sent_idx,
  CASE WHEN s.sent_idx = 0 THEN 0 ELSE CAST(EXISTS (SELECT 1 FROM subj a JOIN subj b ON a.w = b.w
    WHERE a.problem_id = s.problem_id AND a.sent_idx = s.sent_idx AND b.problem_id = s.problem_id
      AND b.sent_idx = s.sent_idx - 1) AS INTEGER) END AS subject_overlap_prev
FROM sentences s"""


# ---------------------------------------------------------------------------------------------
# Pair assembly over the core families
# ---------------------------------------------------------------------------------------------

def _core_lists():
    from styloscope.operators import pairs as pr
    return pr


PB = """pb AS (
  SELECT problem_id, sent_idx, pattern_type,
    CAST(pattern_type = 1 AS INTEGER) AS flag_pattern_1, CAST(pattern_type = 2 AS INTEGER) AS flag_pattern_2,
    CAST(pattern_type = 3 AS INTEGER) AS flag_pattern_3, CAST(pattern_type = 4 AS INTEGER) AS flag_pattern_4,
    CAST(pattern_type > 0 AS INTEGER) AS flag_special_meta,
    CAST(pattern_type <> 0 AND pattern_type = coalesce(lead(pattern_type) OVER w, 0) AS INTEGER) AS pattern_same_block,
    CAST(pattern_type <> coalesce(lead(pattern_type) OVER w, 0) AS INTEGER) AS pattern_boundary_cross,
    CAST(pattern_type <> 0 AND pattern_type <> coalesce(lag(pattern_type) OVER w, 0) AS INTEGER) AS pattern_block_start,
    CAST(pattern_type <> 0 AND pattern_type <> coalesce(lead(pattern_type) OVER w, 0) AS INTEGER) AS pattern_block_end
  FROM pt WINDOW w AS (PARTITION BY problem_id ORDER BY sent_idx))"""


def _sent_core(extra: list[str]) -> str:
    pr = _core_lists()
    g = ", ".join(
        f"CASE WHEN g.problem_id IS NULL THEN 0.0 ELSE {'g.' + c if c == 'assortativity' else f'coalesce(g.{c}, 0.0)'} END AS {c}"
        for c in pr.GRAPH_COUNT_FEATURES)
    lex = ", ".join(f"l.{c}" for c in pr.LEXICAL_FEATURES + pr.DEEP_FEATURES)
    pat = ", ".join(f"p.{c}" for c in pr.PATTERN_FEATURES)
    ex = "".join(f", coalesce(x.{c}, 0.0) AS {c}" for c in extra)
    xj = """ LEFT JOIN (SELECT problem_id, sent_idx,
  CAST(count(*) FILTER (WHERE list_contains(['relcl', 'advcl', 'ccomp', 'xcomp'], dep)) AS DOUBLE) / count(*) AS clause_complexity
  FROM parse GROUP BY ALL) x USING (problem_id, sent_idx)""" if extra else ""
    return f"""sent_core AS (
  SELECT s.problem_id, s.sent_idx, s.n_sentences, {g}, {lex}, {pat}{ex}
  FROM sentences s LEFT JOIN lexical2 l USING (problem_id, sent_idx) LEFT JOIN pb p USING (problem_id, sent_idx)
  LEFT JOIN wan_metrics g USING (problem_id, sent_idx){xj})"""


def pair_parts(extra: list[str]):
    """(ctes, expressions, integer columns) of the pair assembly over the core families."""
    from styloscope.functions import lexicons as lx2
    pr = _core_lists()
    cols = list(pr.CORE_FEATURES) + list(extra)
    a = [f"CAST(a.{c} AS DOUBLE)" for c in cols]
    b = [f"CAST(b.{c} AS DOUBLE)" for c in cols]
    za = [f"coalesce({x}, 0.0)" for x in a]
    zb = [f"coalesce({y}, 0.0)" for y in b]
    dot = " + ".join(f"{x} * {y}" for x, y in zip(za, zb))
    na = "sqrt(" + " + ".join(f"{x} * {x}" for x in za) + ")"
    nb = "sqrt(" + " + ".join(f"{y} * {y}" for y in zb) + ")"
    euc = "sqrt(" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(za, zb)) + ")"
    exprs = {
        "position_ratio": "CAST(a.sent_idx AS DOUBLE) / greatest(1, a.n_sentences - 1)",
        "cosine_similarity": f"CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE ({dot}) / ({na} * {nb}) END",
        "euclidean_distance": euc,
    }
    for c, x, y in zip(cols, a, b):
        exprs[f"f1_{c}"] = f"coalesce({x}, 0.0)"
        exprs[f"f2_{c}"] = f"coalesce({y}, 0.0)"
        exprs[f"delta_{c}"] = f"coalesce({y} - {x}, 0.0)"
        exprs[f"diff_{c}"] = f"coalesce(abs({x} - {y}), 0.0)"
    ints = set()
    for k in lx2.INCREASED_KEYS:
        if k in cols:
            exprs[f"{k}_increased"] = f"coalesce(CAST(b.{k} > a.{k} AS INTEGER), 0)"
            ints.add(f"{k}_increased")
    if all(k in cols for k in lx2.DEEP_STYLE_KEYS):
        x = [f"coalesce(CAST(a.{k} AS DOUBLE), 0.0)" for k in lx2.DEEP_STYLE_KEYS]
        y = [f"coalesce(CAST(b.{k} AS DOUBLE), 0.0)" for k in lx2.DEEP_STYLE_KEYS]
        d = " + ".join(f"{p} * {q}" for p, q in zip(x, y))
        den = "sqrt(" + " + ".join(f"{p} * {p}" for p in x) + ") * sqrt(" + " + ".join(f"{q} * {q}" for q in y) + ")"
        exprs["deep_style_cosine"] = f"CASE WHEN {den} = 0 THEN 0.0 ELSE ({d}) / ({den}) END"
    ctes = [*TOK_BASE, SENTI, LEX, PRESETS, wan_sql(), PATTERN, PB] + ([PARSE] if extra else []) + [_sent_core(extra)]
    return ctes, exprs, ints


PAIR_FROM = """FROM sent_core a JOIN sent_core b ON a.problem_id = b.problem_id AND b.sent_idx = a.sent_idx + 1
WHERE a.n_sentences >= 2"""


def pair_sql(extra: list[str], select_cols: list[str] | None = None) -> str:
    ctes, exprs, ints = pair_parts(extra)
    names = select_cols or list(exprs)
    sel = ",\n  ".join(f"{exprs[n]} AS {n}" if n in ints else f"{R(exprs[n])} AS {n}" for n in names)
    return with_(*ctes) + f"SELECT a.problem_id, a.sent_idx AS pair_idx,\n  {sel}\n{PAIR_FROM}"


def smooth_sql() -> str:
    ctes, exprs, _ = pair_parts(["clause_complexity"])
    p0 = f"""p0 AS (SELECT a.problem_id, a.sent_idx AS pair_idx, {exprs['cosine_similarity']} AS cosine_similarity,
  {exprs['deep_style_cosine']} AS deep_style_cosine {PAIR_FROM})"""
    p1 = """p1 AS (SELECT p0.*, coalesce(t.pos_trigram_cosine, 0.0) AS pos_trigram_cosine
  FROM p0 LEFT JOIN s_trigram t USING (problem_id, pair_idx))"""
    keys = ["cosine_similarity", "deep_style_cosine", "pos_trigram_cosine"]
    sel = ", ".join(f"{R(f'avg({k}) OVER w')} AS {k}_smooth" for k in keys)
    return with_(*ctes, PAIRS, NGRAM_WIN, _ngram_sim_sql("trigram", 3, 0), p0, p1) + f"""SELECT problem_id, pair_idx, {sel}
FROM p1 WINDOW w AS (PARTITION BY problem_id ORDER BY pair_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""


SQL["pair_features"] = pair_sql([])
SQL["pair_row_similarity"] = pair_sql(["clause_complexity"], ["cosine_similarity", "euclidean_distance",
                                                              "deep_style_cosine"])
SQL["smooth_features"] = smooth_sql()


# ---------------------------------------------------------------------------------------------
# Presets, normaliser, labels, evaluation, scaling, window graphs
# ---------------------------------------------------------------------------------------------

SQL["preset_lookup"] = with_(PROBLEMS, PRESETS) + """SELECT p.problem_id, p.difficulty, d.preset, f.remove_punct,
  f.remove_stopwords, f.lemmatize, f.include_pos
FROM problems p JOIN dpreset d USING (difficulty) JOIN pflags f USING (difficulty)"""

SQL["normalize_sentence"] = with_(*TOK_BASE, PRESETS, wan_sql()) + """SELECT s.problem_id, s.sent_idx, d.preset,
  coalesce((SELECT string_agg(w, ' ' ORDER BY k) FROM nt1 WHERE nt1.problem_id = s.problem_id AND nt1.sent_idx = s.sent_idx), '')
    AS normalized
FROM sentences s JOIN dpreset d USING (difficulty)"""

STITCH = f"""st0 AS (
  SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line_idx, unnest(parts) AS sentence
  FROM (SELECT doc_id, string_split(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), chr(10)) AS parts FROM documents)),
st AS (
  SELECT CAST(doc_id // 4 AS BIGINT) AS problem_id, ['easy', 'medium', 'hard'][CAST((doc_id // 4) % 3 AS INTEGER) + 1] AS difficulty,
         doc_id AS author, sentence,
         CAST(row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id, line_idx) - 1 AS INTEGER) AS sent_idx
  FROM st0),
stl AS (
  SELECT problem_id, difficulty, sent_idx AS pair_idx, CAST(author <> lead(author) OVER w AS INTEGER) AS label,
         length(sentence) AS len, lead(length(sentence)) OVER w AS len1
  FROM st WINDOW w AS (PARTITION BY problem_id ORDER BY sent_idx))"""

SQL["change_labels"] = with_(STITCH) + "SELECT problem_id, pair_idx, label FROM stl WHERE len1 IS NOT NULL"

SQL["macro_f1"] = with_(STITCH) + """, z AS (
  SELECT difficulty, label AS y,
         CAST(CAST(abs(len1 - len) AS DOUBLE) / greatest(len, len1, 1) > 0.5 AS INTEGER) AS p
  FROM stl WHERE len1 IS NOT NULL),
c AS (
  SELECT difficulty, count(*) AS n_pairs,
    count(*) FILTER (WHERE y = 0 AND p = 0) AS tp0, count(*) FILTER (WHERE y <> 0 AND p = 0) AS fp0,
    count(*) FILTER (WHERE y = 0 AND p <> 0) AS fn0,
    count(*) FILTER (WHERE y = 1 AND p = 1) AS tp1, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp1,
    count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn1
  FROM z GROUP BY difficulty)
SELECT difficulty,
  (floor(((CASE WHEN 2 * tp0 + fp0 + fn0 = 0 THEN 0.0 ELSE 2.0 * tp0 / (2 * tp0 + fp0 + fn0) END)
   + (CASE WHEN 2 * tp1 + fp1 + fn1 = 0 THEN 0.0 ELSE 2.0 * tp1 / (2 * tp1 + fp1 + fn1) END)) / 2.0 * 1000000.0 + 0.5)
   / 1000000.0) AS macro_f1,
  CAST(n_pairs AS BIGINT) AS n_pairs
FROM c"""


def _minmax_sql() -> str:
    ctes, exprs, _ = pair_parts(["clause_complexity"])
    cols = ["position_ratio", "cosine_similarity", "euclidean_distance", "deep_style_cosine"]
    p0 = "p0 AS (SELECT a.problem_id, a.sent_idx AS pair_idx, " + ", ".join(
        f"{exprs[c]} AS {c}" for c in cols) + f" {PAIR_FROM})"
    sel = ", ".join(f"{R(f'CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END')} AS {c}"
                    for c in cols)
    return with_(*ctes, p0) + f"SELECT problem_id, pair_idx, {sel} FROM p0"


SQL["minmax_scale"] = _minmax_sql()

WINDOWS = f"""wsrc AS (
  SELECT problem_id, sent_idx AS window_start, 'x' AS difficulty,
         sentence || ' ' || lead(sentence, 1) OVER w || ' ' || lead(sentence, 2) OVER w AS wtext, n_sentences
  FROM sentences WINDOW w AS (PARTITION BY problem_id ORDER BY sent_idx)),
windows AS (SELECT * FROM wsrc WHERE n_sentences >= 4 AND window_start <= n_sentences - 3),
wflags AS (SELECT false AS remove_punct, false AS remove_stopwords, false AS lemmatize, true AS include_pos)"""


def _window_graph_sql() -> str:
    from styloscope.operators.pairs import GRAPH_COUNT_FEATURES
    w = wan_sql("windows", "window_start", "wtext", "wflags", "ON true")
    sel = ", ".join(
        f"{R(f'CASE WHEN m.problem_id IS NULL THEN 0.0 ELSE ' + ('m.' + c if c == 'assortativity' else f'coalesce(m.{c}, 0.0)') + ' END')} AS {c}"
        for c in GRAPH_COUNT_FEATURES)
    return with_(*TOK_BASE, WINDOWS, w) + f"""SELECT x.problem_id, x.window_start, {sel}
FROM windows x LEFT JOIN wan_metrics m USING (problem_id, window_start)"""


SQL["wan_window_graphs"] = _window_graph_sql()

SQL["roundtrip_problem_files"] = with_(PROBLEMS) + """SELECT CAST(problem_id AS VARCHAR) AS problem_id, difficulty,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_sentences FROM problems"""

SQL["graph_sink"] = with_(*WAN_BASE) + """SELECT p.difficulty, e.edge_type, count(*) AS n_edges,
  CAST(sum(e.weight) AS BIGINT) AS total_weight
FROM wan_edges e JOIN problems p USING (problem_id) GROUP BY ALL"""

SQL["metric_sink"] = "WITH f1 AS (" + SQL["macro_f1"] + """)
SELECT CASE difficulty WHEN 'easy' THEN 'task1_f1_score' WHEN 'medium' THEN 'task2_f1_score'
            ELSE 'task3_f1_score' END AS key, macro_f1 AS value FROM f1"""

SQL["stream_rhythm_pairs"] = SQL["rhythm_pairs"]


def _window_drift_sql() -> str:
    """Cosine and euclidean between the unrounded feature rows of consecutive windows."""
    from styloscope.operators.pairs import GRAPH_COUNT_FEATURES
    w = wan_sql("windows", "window_start", "wtext", "wflags", "ON true")
    feats = ", ".join(
        f"CASE WHEN m.problem_id IS NULL THEN 0.0 ELSE {'m.' + c if c == 'assortativity' else f'coalesce(m.{c}, 0.0)'} END AS {c}"
        for c in GRAPH_COUNT_FEATURES)
    rows = f"""wfeat AS (SELECT x.problem_id, x.window_start, {feats}
  FROM windows x LEFT JOIN wan_metrics m USING (problem_id, window_start))"""
    total = lambda f: " + ".join(f(c) for c in GRAPH_COUNT_FEATURES)
    dot = total(lambda c: f"CAST(a.{c} AS DOUBLE) * b.{c}")
    norms = "sqrt(" + total(lambda c: f"CAST(a.{c} AS DOUBLE) * a.{c}") + ") * sqrt(" + total(
        lambda c: f"CAST(b.{c} AS DOUBLE) * b.{c}") + ")"
    apart = "sqrt(" + total(lambda c: f"(CAST(a.{c} AS DOUBLE) - b.{c}) * (a.{c} - b.{c})") + ")"
    return with_(*TOK_BASE, WINDOWS, w, rows) + f"""SELECT a.problem_id, a.window_start AS wan_window_index,
  {lx.WINDOW_SIZE} AS wan_window_size,
  {R(f"CASE WHEN coalesce({norms}, 0) > 0 THEN ({dot}) / ({norms}) ELSE 0.0 END")} AS wan_window_cosine_sim,
  {R(apart)} AS wan_window_euclidean
FROM wfeat a JOIN wfeat b ON a.problem_id = b.problem_id AND b.window_start = a.window_start + 1"""


SQL["wan_window_drift"] = _window_drift_sql()

SQL["scoring_split"] = with_(STITCH) + """SELECT problem_id, difficulty, CAST(count(*) - 1 AS INTEGER) AS n_pairs,
  substr(md5(CAST(problem_id AS VARCHAR)), 1, 1) >= '4' AS in_training
FROM st GROUP BY problem_id, difficulty HAVING count(*) >= 2"""

SQL["truth_scan"] = with_(STITCH) + """SELECT problem_id, difficulty, CAST(count(*) AS INTEGER) AS n_pairs,
  CAST(sum(label) AS INTEGER) AS n_changes
FROM stl WHERE len1 IS NOT NULL GROUP BY problem_id, difficulty"""
