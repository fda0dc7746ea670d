"""DuckDB SQL for the registered queries.

Written on flat token rows with windows and joins, not on the arrays the Spark
side uses; only fixed values (word tables, patterns, weights) are shared.
"""

from __future__ import annotations

import re

from plainread.functions import rules
from plainread.functions import wordlists as W
from plainread.operators.surface import multi_word, phrase_pattern


def quoted(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


LISTED = ", ".join(
    f"('{form}', '{tag}', '{base}', {flag}, {str(form in W.IRREGULAR_PAST).lower()})"
    for form, (tag, base, flag) in rules.listed_words().items())
SUFFIXES = ", ".join(f"('{s}', {n}, '{tag}', {drop}, '{add}')"
                     for s, (n, tag, drop, add) in W.SUFFIX_RULES.items())
NOMINAL = quoted(rules.NOMINAL_POS)

# text_rows(doc_id, text) is the input; key columns are named by {key}
BASE = r"""
sent AS (
  SELECT {key}, unnest(range(len(ss))) AS sent_id, unnest(ss) AS text FROM (
    SELECT {key}, list_transform(list_filter(regexp_extract_all(text, '{sentence}'),
      lambda s: regexp_matches(s, '{visible}')), lambda s: trim(s)) AS ss FROM text_rows)),
tok AS (
  SELECT {key}, sent_id, unnest(range(len(ts))) AS tok_idx, unnest(ts) AS text FROM (
    SELECT {key}, sent_id, regexp_extract_all(text, '{token}') AS ts FROM sent)),
listed(form, ltag, llemma, lflag, is_past) AS (VALUES {listed}),
sufs(suf, shortest, stag, sdrop, sadd) AS (VALUES {suffixes}),
tok1 AS (
  SELECT t.*, lower(text) AS lower, regexp_extract(lower(text), '({alternatives})$', 1) AS suffix
  FROM tok t),
tok2 AS (
  SELECT t.*, l.llemma, coalesce(l.lflag, 0) AS lflag, coalesce(l.is_past, false) AS is_past,
    s.sdrop, s.sadd,
    CASE WHEN l.ltag IS NOT NULL THEN l.ltag
      WHEN regexp_matches(t.text, '^\p{{N}}') THEN 'NUM'
      WHEN NOT regexp_matches(t.text, '^\p{{L}}') THEN 'PUNCT'
      WHEN coalesce(s.stag, 'NOUN') = 'NOUN' AND t.tok_idx > 0 AND t.text <> t.lower THEN 'PROPN'
      ELSE coalesce(s.stag, 'NOUN') END AS pos
  FROM tok1 t LEFT JOIN listed l ON t.lower = l.form
  LEFT JOIN sufs s ON t.suffix = s.suf AND length(t.lower) >= s.shortest),
word AS (
  SELECT {key}, sent_id, tok_idx, text, lower, pos, lflag,
    CASE WHEN llemma IS NOT NULL THEN llemma
      WHEN pos IN ('VERB', 'NOUN') AND sdrop IS NOT NULL
        THEN left(lower, length(lower) - sdrop) || sadd
      ELSE lower END AS base,
    regexp_matches(text, '^\p{{L}}') AS is_alpha,
    CASE WHEN regexp_matches(text, '^\p{{L}}')
      THEN greatest(len(regexp_extract_all(lower, '{vowels}')), 1) ELSE 0 END::INTEGER AS syllables,
    pos = 'VERB' AND suffix IN ('ed', 'ied') AS is_ed,
    pos = 'VERB' AND suffix = 'ing' AS is_ing,
    pos = 'VERB' AND (suffix IN ('ed', 'ied') OR lower LIKE '%en') AS is_part,
    pos = 'VERB' AND is_past AS is_irregular
  FROM tok2),
near AS (
  SELECT *, CASE WHEN pos = 'PROPN' THEN text ELSE base END AS lemma,
    coalesce(min(CASE WHEN pos = 'VERB' THEN tok_idx END) OVER s, 0) AS root,
    coalesce(lead(is_part) OVER o, false) AS next_part,
    coalesce(lag(lflag) OVER o, 0) AS prev_flag,
    min(CASE WHEN pos IN {nominal} THEN tok_idx END) OVER
      (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_nominal
  FROM word WINDOW s AS (PARTITION BY {key}, sent_id),
    o AS (PARTITION BY {key}, sent_id ORDER BY tok_idx)),
role AS (
  SELECT *, max(CASE WHEN pos IN {nominal} AND tok_idx < root THEN tok_idx END) OVER s AS subj,
    min(CASE WHEN pos IN {nominal} AND tok_idx > root THEN tok_idx END) OVER s AS obj,
    bool_or(tok_idx = root AND is_part AND prev_flag & 1 <> 0) OVER s AS passive
  FROM near WINDOW s AS (PARTITION BY {key}, sent_id)),
ann AS (
  SELECT {key}, sent_id, tok_idx, text, lower, base, lemma, pos, is_alpha, syllables,
    CASE WHEN tok_idx = root THEN 'ROOT' WHEN lflag & 4 <> 0 THEN 'neg'
      WHEN lflag & 1 <> 0 AND next_part THEN 'auxpass'
      WHEN tok_idx = subj THEN CASE WHEN passive THEN 'nsubjpass' ELSE 'nsubj' END
      WHEN tok_idx = obj THEN 'dobj'
      ELSE CASE pos WHEN 'DET' THEN 'det' WHEN 'ADP' THEN 'prep' WHEN 'ADJ' THEN 'amod'
        WHEN 'NUM' THEN 'nummod' WHEN 'CCONJ' THEN 'cc' WHEN 'SCONJ' THEN 'mark'
        WHEN 'AUX' THEN 'aux' WHEN 'ADV' THEN 'advmod' WHEN 'PART' THEN 'aux'
        WHEN 'PUNCT' THEN 'punct' WHEN 'VERB' THEN 'advcl' ELSE 'dep' END END AS dep,
    CASE WHEN tok_idx = root THEN NULL WHEN lflag & 4 <> 0 THEN root
      WHEN lflag & 1 <> 0 AND next_part THEN tok_idx + 1
      WHEN pos IN ('DET', 'ADP', 'ADJ', 'NUM') THEN coalesce(next_nominal, root)
      ELSE root END::INTEGER AS head_idx,
    CASE WHEN is_ed OR is_irregular THEN 'Past' WHEN is_ing THEN 'Pres' END AS tense,
    CASE WHEN is_ing THEN 'Prog' WHEN is_ed AND prev_flag & 2 <> 0 THEN 'Perf' END AS aspect
  FROM role)"""

# depth by walking down from the root, one level a step
DEPTH = """
walk AS (
  SELECT {key}, sent_id, tok_idx, 0 AS depth FROM ann WHERE head_idx IS NULL
  UNION ALL
  SELECT {a_key}, a.sent_id, a.tok_idx, w.depth + 1 FROM ann a JOIN walk w
    ON {a_w} AND a.sent_id = w.sent_id AND a.head_idx = w.tok_idx),
depths AS (SELECT {key}, sent_id, max(depth) AS dependency_depth FROM walk GROUP BY ALL)"""

# similarities of sentences: sparse cells, joined with earlier sentences of the document
SIMILAR = r"""
cell AS (
  SELECT {key}, sent_id, ('0x' || left(md5(w), 8))::BIGINT % {width} AS bucket, count(*) AS tf
  FROM (SELECT {key}, sent_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM sent)
  GROUP BY ALL),
size AS (SELECT {key}, sent_id, sqrt(sum(tf * tf)) AS norm FROM cell GROUP BY ALL),
dots AS (
  SELECT {a_key}, a.sent_id, b.sent_id AS other, sum(a.tf * b.tf) AS dot
  FROM cell a JOIN cell b ON {a_b} AND a.bucket = b.bucket AND b.sent_id < a.sent_id GROUP BY ALL),
cosines AS (
  SELECT {d_key}, d.sent_id, d.other, d.dot / (x.norm * y.norm) AS cos FROM dots d
  JOIN size x ON {d_x} AND d.sent_id = x.sent_id JOIN size y ON {d_y} AND d.other = y.sent_id),
semantic AS (
  SELECT {key}, sent_id, sum(cos) / sent_id AS mean_previous, max(cos) AS max_previous,
    coalesce(max(CASE WHEN other = sent_id - 1 THEN cos END), 0) AS adjacent
  FROM cosines GROUP BY {key}, sent_id)"""

NORMS = """
vocab AS (
  SELECT lower(text) AS word, count(*) AS n FROM corpus_tok GROUP BY ALL),
zipf AS (SELECT word, n, round(log10(n * 1e9 / (SELECT sum(n) FROM vocab)), 2) AS zipf FROM vocab),
norms AS (
  SELECT word, s * 10.0 AS aoa, s * 3 + 200.0 AS concreteness,
    CASE WHEN s % 3 = 0 THEN 0 ELSE s + 300.0 END AS familiarity, s * s * 1.0 AS imagery
  FROM (SELECT word, CASE WHEN length(word) % 2 = 0 AND (length(word) + 100) % 7 <> 0
          THEN length(word) + 100 ELSE length(word) END AS s
        FROM vocab WHERE regexp_matches(word, '^\\p{L}+$'))
  WHERE s % 7 <> 0)"""

FEATURE_ROWS = r"""
agg AS (
  SELECT {key}, sent_id, {counts} FROM ann a
  LEFT JOIN zipf z ON a.lower = z.word LEFT JOIN norms m ON a.base = m.word
  GROUP BY {key}, sent_id),
docs_agg AS (
  SELECT {key}, count(DISTINCT base) AS n_words, count(DISTINCT base) FILTER (pos IN {content})
    AS n_content, count(DISTINCT base) FILTER (pos = 'VERB') AS n_verbs, count(*) AS all_words,
    count(*) FILTER (pos = 'VERB') AS all_verbs
  FROM ann WHERE is_alpha GROUP BY {key}),
lagged AS (
  SELECT g.*, lag(l_content) OVER o AS p_content, lag(l_nouns) OVER o AS p_nouns,
    lag(l_args) OVER o AS p_args, lag(l_words) OVER o AS p_words, lag(l_pos) OVER o AS p_pos,
    lag(l_verbs) OVER o AS p_verbs, lag(l_tense) OVER o AS p_tense, lag(l_aspect) OVER o AS p_aspect,
    coalesce(sum(word_count) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM agg g WINDOW o AS (PARTITION BY {key} ORDER BY sent_id)),
mods AS (
  SELECT {a_key}, a.sent_id, count(*) AS mods FROM ann a JOIN ann w ON {a_w} AND a.sent_id = w.sent_id
    AND a.head_idx = w.tok_idx AND a.dep IN {modifiers} AND w.pos IN ('NOUN', 'PROPN')
  GROUP BY {a_key}, a.sent_id),
feat AS (
  SELECT {l_key}, l.sent_id, {features}
  FROM lagged l JOIN sent s ON {l_s} AND l.sent_id = s.sent_id
  LEFT JOIN docs_agg d ON {l_d}
  LEFT JOIN depths h ON {l_h} AND l.sent_id = h.sent_id
  LEFT JOIN mods q ON {l_q} AND l.sent_id = q.sent_id
  LEFT JOIN semantic c ON {l_c} AND l.sent_id = c.sent_id)"""


def fill(template: str, keys: list[str], **more: str) -> str:
    def both(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)

    def of(a: str) -> str:
        return ", ".join(f"{a}.{k}" for k in keys)

    return template.format(
        key=", ".join(keys), a_key=of("a"), d_key=of("d"), l_key=of("l"), a_w=both("a", "w"),
        a_b=both("a", "b"), d_x=both("d", "x"), d_y=both("d", "y"), l_s=both("l", "s"),
        l_d=both("l", "d"), l_h=both("l", "h"), l_c=both("l", "c"), l_q=both("l", "q"), **more)


def base(keys: list[str]) -> str:
    return fill(BASE, keys, sentence=W.SENTENCE_PATTERN.replace("\\n", "\n"),
                visible=W.VISIBLE_PATTERN, token=W.TOKEN_PATTERN, listed=LISTED, suffixes=SUFFIXES,
                alternatives="|".join(W.SUFFIX_RULES), vowels=W.VOWEL_RUN, nominal=NOMINAL)


DOCS = "text_rows AS (SELECT doc_id, text FROM documents)"


def annotated(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join([DOCS, base(['doc_id']), *ctes])} {body}"


def share(n: str, d: str) -> str:
    return f"CASE WHEN coalesce({d}, 0) = 0 THEN 0.0 ELSE coalesce(({n}) * 1.0 / ({d}), 0) END"


def connective_count(name: str) -> str:
    return (f"count(*) FILTER (pos IN {quoted(W.CONJUNCTION_POS)} "
            f"AND lower IN {quoted(W.CONNECTIVES[name])})")


def rate(words: list[str]) -> str:
    return share(f"count(*) FILTER (lower IN {quoted(words)})", "count(*)")


SPOKEN = "count(*) FILTER (pos <> 'PUNCT')"


def aggregates(compat: bool) -> dict[str, str]:
    freq = quoted(W.FREQUENCY_POS)
    first = "false" if compat else f"lower IN {quoted(W.FIRST_PERSON)}"
    out = {
        "nouns": "count(*) FILTER (pos IN ('NOUN', 'PROPN'))",
        "verbs": "count(*) FILTER (pos = 'VERB')",
        "adjectives": "count(*) FILTER (pos = 'ADJ')",
        "adverbs": "count(*) FILTER (pos = 'ADV')",
        "pronouns": "count(*) FILTER (pos = 'PRON')",
        "first_person_pronouns": f"count(*) FILTER (pos = 'PRON' AND {first})",
        "third_person_pronouns": f"count(*) FILTER (pos = 'PRON' AND NOT {first})",
        "avg_syllables_per_word": share("sum(syllables) FILTER (pos <> 'PUNCT')", SPOKEN),
        "avg_word_frequency_log": share("round(sum(zipf) FILTER (pos <> 'PUNCT'), 2)", SPOKEN),
        "avg_content_word_frequency_log": share(f"round(sum(zipf) FILTER (pos IN {freq}), 2)", SPOKEN),
        "word_count": "count(*)",
        "connectives_total": "0" if compat else " + ".join(map(connective_count, W.CONNECTIVES)),
        "function_to_content_ratio": "0.0" if compat else share(
            f"count(*) FILTER (pos NOT IN {freq} AND pos NOT IN ('PUNCT', 'NUM'))",
            f"count(*) FILTER (pos IN {freq})"),
        "passive_constructions": "0" if compat else
            f"count(*) FILTER (dep IN {quoted(W.PASSIVE_DEP)})",
        "root_at": "min(tok_idx) FILTER (dep = 'ROOT')",
        "negations": "count(*) FILTER (dep = 'neg')",
        "causal_rate": rate(W.CAUSAL_COHESION), "temporal_rate": rate(W.TEMPORAL_COHESION),
        "intentional_rate": rate(W.INTENTIONAL_COHESION),
        "n_alpha": "count(*) FILTER (is_alpha)",
    }
    for feature, column in (("avg_age_of_acquisition", "aoa"), ("avg_concreteness", "concreteness"),
                            ("avg_imagery", "imagery"), ("avg_familiarity", "familiarity")):
        out[feature] = (f"coalesce(avg({column}) FILTER (pos <> 'PUNCT' AND {column} <> 0), 0)")
    for name in W.CONNECTIVES:
        out[f"{name}_connectives"] = connective_count(name)
    lists = {
        "l_words": "list(DISTINCT base) FILTER (is_alpha)",
        "l_content": f"list(DISTINCT base) FILTER (pos IN {quoted(W.CONTENT_POS)})",
        "l_nouns": "list(DISTINCT base) FILTER (pos = 'NOUN')",
        "l_args": f"list(DISTINCT base) FILTER (dep IN {quoted(W.ARGUMENT_DEP)})",
        "l_pos": "list(pos ORDER BY tok_idx)",
        "l_verbs": "list(lemma ORDER BY tok_idx) FILTER (pos = 'VERB')",
        "l_tense": "list(coalesce(tense, '-') ORDER BY tok_idx) FILTER (pos = 'VERB')",
        "l_aspect": "list(coalesce(aspect, '-') ORDER BY tok_idx) FILTER (pos = 'VERB')",
    }
    out.update({n: f"coalesce({x}, [])" for n, x in lists.items()})
    return out


def shared(name: str) -> str:
    return share(f"len(list_intersect(l.p_{name}, l.l_{name}))", f"len(l.p_{name})")


def equal_pairs(name: str) -> str:
    return (f"len(list_filter(range(1, least(len(l.l_{name}), len(l.p_{name})) + 1), "
            f"lambda i: l.l_{name}[i] = l.p_{name}[i]))")


def later(value: str) -> str:
    return f"CASE WHEN l.sent_id > 0 THEN {value} ELSE 0 END"


def feature_columns(compat: bool) -> dict[str, str]:
    out = {f: f"l.{f}" for f in aggregates(compat) if f in W.FEATURES or f == "negations"}
    out.update({
        "sentence_length": "length(s.text)",
        "dependency_depth": "h.dependency_depth",
        "words_before_main_verb": "l.root_at + l.off" if compat else "l.root_at",
        "avg_polysemy": "0.0", "modifiers_per_np": "0.0" if compat else share("coalesce(q.mods, 0)", "l.nouns"),
        "content_overlap_adjacent": shared("content"), "noun_overlap_adjacent": shared("nouns"),
        "argument_overlap_adjacent": shared("args"),
        "stem_overlap_all": later(share("len(l.l_words)", "d.n_words")),
        "content_overlap_all": "0.0" if compat else later(share(
            "len(list_intersect(l.l_content, l.l_words))", "d.n_content")),
        "lsa_overlap_adjacent": later("coalesce(c.adjacent, 0)"),
        "lsa_overlap_all": later("coalesce(c.mean_previous, 0)"),
        "lsa_given_new": later("1 - coalesce(c.max_previous, 0)"),
        "lsa_verb_overlap_adjacent": "CASE WHEN len(l.l_verbs) > 0 AND len(l.p_verbs) > 0 "
                                     "THEN coalesce(c.adjacent, 0) ELSE 0 END",
        "pos_dissimilarity_prev": later(
            f"1 - {equal_pairs('pos')} * 1.0 / greatest(len(l.l_pos), len(l.p_pos))"),
        "word_dissimilarity_prev": share(
            "len(list_filter(l.l_words, lambda w: NOT list_contains(l.p_words, w)))",
            "len(l.p_words)"),
        "causal_cohesion": later("l.causal_rate"), "temporal_cohesion": later("l.temporal_rate"),
        "intentional_cohesion": later("l.intentional_rate"),
        "verb_overlap_adjacent": share(
            "len(list_distinct(list_intersect(l.p_verbs, l.l_verbs)))", "len(l.p_verbs)"),
        "verb_tense_repetition": share(equal_pairs("tense"), "len(l.p_verbs)"),
        "verb_aspect_repetition": share(equal_pairs("aspect"), "len(l.p_verbs)"),
        "type_token_ratio": later(share("len(l.l_words)", "l.n_alpha")),
        "lexical_diversity_all": later(share("d.n_words", "d.all_words")),
        "lexical_diversity_verbs": later(share("d.n_verbs", "d.all_verbs")),
    })
    return out


def feature_ctes(keys: list[str], compat: bool, corpus: str) -> list[str]:
    """Everything from text_rows to feat(keys, sent_id, features)."""
    counts = ", ".join(f"{x} AS {n}" for n, x in aggregates(compat).items())
    columns = ", ".join(f"{x} AS {n}" for n, x in feature_columns(compat).items())
    return [base(keys), corpus, fill(DEPTH, keys), fill(SIMILAR, keys, width=str(W.EMBEDDING_WIDTH)), NORMS,
            fill(FEATURE_ROWS, keys, counts=counts, features=columns, content=quoted(W.CONTENT_POS),
                 modifiers=quoted(W.MODIFIER_DEP))]


CORPUS_TOK = "corpus_tok AS (SELECT text FROM tok)"


def with_features(body: str, compat: bool = False, *more: str) -> str:
    ctes = [DOCS, *feature_ctes(["doc_id"], compat, CORPUS_TOK), *more]
    return f"WITH RECURSIVE {', '.join(ctes)} {body}"


def nudged(value: str) -> str:
    """As on the Spark side: the engines round halves of inexact decimals differently."""
    return f"round({value} + 1e-9, 6)"


def stat(feature: str, kind: str) -> str:
    made = {"avg": "avg", "sd": "stddev_pop", "min": "min", "max": "max"}[kind]
    return nudged(f"coalesce({made}(f.{feature}::DOUBLE), 0)")


def sentence_query(*names: str, integers: bool = False) -> str:
    chosen = ", ".join(f"{n}::BIGINT AS {n}" if integers else f"round({n}, 6) AS {n}" for n in names)
    return with_features(f"SELECT doc_id, sent_id, {chosen} FROM feat")


def means_cte(keys: list[str]) -> str:
    cols = ", ".join(f"coalesce(avg(f.{x}::DOUBLE), 0) AS {x}" for x in W.FEATURES)
    of = ", ".join(f"t.{k}" for k in keys)
    on = " AND ".join(f"t.{k} = f.{k}" for k in keys)
    return f"means AS (SELECT {of}, {cols} FROM text_rows t LEFT JOIN feat f ON {on} GROUP BY {of})"


MEANS = means_cte(["doc_id"])
SCORE = f"{W.SAVED_INTERCEPT!r} + " + " + ".join(
    f"({c!r}) * {f}" for f, c in zip(W.FEATURES, W.SAVED_COEFFICIENTS))


def unpivot(source: str, value: str, expr: str = "{f}") -> str:
    """(doc_id?, idx, feature, value) by one UNION branch per feature."""
    return " UNION ALL ".join(
        f"SELECT *, {i} AS idx, '{f}' AS feature, {expr.format(f=f, i=i)} AS {value} FROM {source}"
        for i, f in enumerate(W.FEATURES))


def profile_sql() -> str:
    cols = ", ".join(f"{stat(f, k)} AS {f}_{k}" for f in W.FEATURES for k in ("avg", "sd", "min", "max"))
    return with_features(
        f"SELECT t.doc_id, {cols} FROM text_rows t LEFT JOIN feat f ON t.doc_id = f.doc_id "
        "GROUP BY t.doc_id")


def stats_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT t.doc_id, '{f}' AS feature, " + ", ".join(
            f"{stat(f, k)} AS {k}" for k in ("avg", "sd", "min", "max"))
        + " FROM text_rows t LEFT JOIN kept f ON t.doc_id = f.doc_id GROUP BY t.doc_id"
        for f in W.FEATURES)
    return with_features(parts, False, "kept AS MATERIALIZED (SELECT * FROM feat)")


def sentence_scores_sql() -> str:
    keys = ["doc_id", "seg_id"]
    segments = ("segs AS (SELECT doc_id, unnest(range(len(p)))::INTEGER AS seg_id, unnest(p) AS text "
                "FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)), "
                f"text_rows AS (SELECT * FROM segs WHERE regexp_matches(text, '{W.VISIBLE_PATTERN}'))")
    corpus = (f"corpus_tok AS (SELECT unnest(regexp_extract_all(s, '{W.TOKEN_PATTERN}')) AS text FROM "
              f"(SELECT unnest(regexp_extract_all(text, '{SENTENCE}')) AS s FROM documents))")
    ctes = [segments, *feature_ctes(keys, True, corpus), means_cte(keys)]
    return (f"WITH RECURSIVE {', '.join(ctes)} SELECT m.doc_id, m.seg_id, t.text AS sentence, "
            f"round({SCORE}, 6) AS score FROM means m JOIN text_rows t USING (doc_id, seg_id)")


SENTENCE = W.SENTENCE_PATTERN.replace("\\n", "\n")

COUNTS = (f"counted AS (SELECT doc_id, (SELECT count(*) FROM sent s WHERE s.doc_id = t.doc_id) AS s, "
          "count(syllables) FILTER (is_alpha) AS w, "
          "sum(syllables) FILTER (is_alpha) AS y, count(*) FILTER (is_alpha AND syllables >= 3) AS c "
          "FROM text_rows t LEFT JOIN word USING (doc_id) GROUP BY doc_id)")
FORMULAS = {
    "flesch_ease": "206.835 - 1.015 * (w / nullif(s, 0)) - 84.6 * (y / nullif(w, 0))",
    "fk_grade": "0.39 * (w / nullif(s, 0)) + 11.8 * (y / nullif(w, 0)) - 15.59",
    "smog": "1.043 * sqrt(30.0 * (c / nullif(s, 0))) + 3.1291",
    "gunning_fog": "0.4 * ((w / nullif(s, 0)) + 100.0 * (c / nullif(w, 0)))",
}


def formula(name: str) -> str:
    return re.sub(r"\b([wsyc])\b", r"\1::DOUBLE", FORMULAS[name])


FIT = ("SELECT '{0}' AS model, count(*) AS n, round(avg({2}), 6) AS mean_prediction, "
       "round(avg({2}), 6) AS mean_label, true AS no_worse_than_mean FROM {1}")


def rotated() -> dict[str, list[str]]:
    """Each category with the words of the next."""
    names = list(W.CONNECTIVES)
    return {name: W.CONNECTIVES[other] for name, other in zip(names, [*names[1:], names[0]])}


def training_columns() -> str:
    return ("SELECT d.doc_id AS id, d.text AS excerpt, CASE WHEN l.toxic = 1 THEN 'n/a' ELSE "
            "l.quality::VARCHAR END AS label, CASE WHEN l.quality = 1 THEN d.n_chars::DOUBLE END AS score, "
            "CASE WHEN l.toxic = 0 THEN d.n_chars / 4.0 END AS rival, d.lang AS split "
            "FROM documents d LEFT JOIN labels l USING (doc_id)")


VALID = "try_cast(label AS DOUBLE) IS NOT NULL AND excerpt <> ''"

LINKS = ("links AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS entity, url AS link, "
         "page_id AS rank FROM pages), "
         "best AS (SELECT entity, arg_min(link, rank) FILTER (link LIKE '%/') AS link "
         "FROM links GROUP BY entity)")


#: The phrases of a category that no built-in list has.
OWN_PHRASES = ["of the", "in ... and", "a lot", "e.g. this"]


def phrase_columns(lists: dict[str, list[str]]) -> str:
    counts = []
    for name, phrases in lists.items():
        each = [f"len(regexp_extract_all(lower(text), '{phrase_pattern(p)}'))"
                for p in multi_word(phrases)]
        counts.append(f"({' + '.join(each) or '0'})::BIGINT AS {name}_phrases")
    return ", ".join(counts)


def phrase_sql() -> str:
    return annotated(f"SELECT doc_id, sent_id, {phrase_columns(W.CONNECTIVES)} FROM sent")


def ruleset_sql() -> str:
    rows = [("first_person", p) for p in W.FIRST_PERSON] + [
        (name, p) for name, words in W.CONNECTIVES.items() for p in words]
    values = ", ".join(f"('{c}', '{p}')" for c, p in rows)
    return annotated("SELECT category, phrase, count(t.text) AS n FROM ruleset LEFT JOIN tok t "
                     "ON lower(t.text) = phrase GROUP BY category, phrase",
                     f"ruleset(category, phrase) AS (VALUES {values})")


def aggregate_query(*names: str, ints: bool = True, joins: str = "", ctes: tuple[str, ...] = ()) -> str:
    made = aggregates(False)
    cols = ", ".join(f"({made[n]})::BIGINT AS {n}" if ints else f"{nudged(made[n])} AS {n}"
                     for n in names)
    return annotated(f"SELECT doc_id, sent_id, {cols} FROM ann a {joins} GROUP BY doc_id, sent_id", *ctes)


EMBEDDED = ("pairs AS (SELECT a.label, a.vec_id, b.vec_id AS other, "
            "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos "
            "FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id)")


PAGE_TEXT = (r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(html, "
             r"'(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), "
             r"'[ \t\n\f\r]+', ' ', 'g')), '')")


def entity_sql() -> str:
    """Pages as documents, joined with the chosen links; word frequencies are those of the documents."""
    keys = ["doc_id"]
    pages = f"text_rows AS (SELECT page_id AS doc_id, {PAGE_TEXT} AS text FROM pages)"
    corpus = (f"corpus_tok AS (SELECT unnest(regexp_extract_all(s, '{W.TOKEN_PATTERN}')) AS text FROM "
              f"(SELECT unnest(regexp_extract_all(text, '{SENTENCE}')) AS s FROM documents))")
    chosen = ", ".join(f"round({formula(n)}, 6) AS {n}" for n in FORMULAS)
    ctes = [pages, *feature_ctes(keys, True, corpus), means_cte(keys), COUNTS, LINKS,
            f"scored AS (SELECT doc_id, {chosen} FROM counted)",
            f"modelled AS (SELECT doc_id, round({SCORE}, 6) AS custom FROM means)"]
    return (f"WITH RECURSIVE {', '.join(ctes)} "
            "SELECT entity, link, t.text, CASE WHEN t.text IS NOT NULL THEN custom END AS custom, "
            + ", ".join(FORMULAS) + " FROM best b "
            "LEFT JOIN pages p ON b.link = p.url LEFT JOIN text_rows t ON t.doc_id = p.page_id "
            "LEFT JOIN scored s ON s.doc_id = p.page_id LEFT JOIN modelled m ON m.doc_id = p.page_id")


ABBREVIATIONS = r"""
dotted AS (
  SELECT rtrim(w, '.') AS word, count(*) AS n, count(*) FILTER (w LIKE '%.') AS n_dotted
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+(?:[.]\p{L}+)*[.]?')) AS w FROM documents) GROUP BY ALL),
rated AS (
  SELECT word, n, n_dotted, n - n_dotted AS rest, length(replace(word, '.', '')) AS letters,
    sum(n_dotted) OVER () * 1.0 / sum(n) OVER () AS share FROM dotted),
known AS (
  SELECT word, n, n_dotted, -2.0 * (n_dotted * ln(share / 0.99) + rest * ln((1.0 - share) / 0.01)) * exp(-letters)
    * (length(word) - letters + 1) * pow(letters::DOUBLE, -rest) AS score FROM rated WHERE n_dotted > 0)"""
KNOWN_SENTENCES = r"""
piece AS (
  SELECT doc_id, unnest(range(len(ps))) AS spot, unnest(ps) AS piece FROM (SELECT doc_id, regexp_extract_all(text,
    '(?:[^.!?\n]+|[.][^ \t\n\f\r\x0B.!?])[^.!?\n]*(?:[.][^ \t\n\f\r\x0B.!?][^.!?\n]*)*[.!?]*\n?') AS ps FROM documents)),
marked AS (
  SELECT *, CASE WHEN lower(regexp_extract(piece, '(\p{L}+(?:[.]\p{L}+)*)[.] *$', 1)) IN
    (SELECT word FROM known WHERE score >= 0.3) THEN 1 ELSE 0 END AS open FROM piece),
grouped AS (
  SELECT *, sum(1 - before) OVER (PARTITION BY doc_id ORDER BY spot) AS no FROM (
    SELECT *, coalesce(lag(open) OVER (PARTITION BY doc_id ORDER BY spot), 0) AS before FROM marked)),
whole AS (
  SELECT doc_id, no, trim(replace(string_agg(piece, '' ORDER BY spot), chr(10), '')) AS text FROM grouped GROUP BY ALL)"""


def all_sql() -> dict[str, str]:
    lex = (CORPUS_TOK, NORMS)
    sets = {"content_lemmas": f"pos IN {quoted(W.CONTENT_POS)}", "noun_lemmas": "pos = 'NOUN'",
            "verb_lemmas": "pos = 'VERB'", "all_stems": "true",
            "argument_lemmas": f"dep IN {quoted(W.ARGUMENT_DEP)}"}
    set_columns = ", ".join(
        f"count(DISTINCT base) FILTER ({w}) AS n_{n}, coalesce(array_to_string(list_sort("
        f"list(DISTINCT base) FILTER ({w})), ' '), '') AS {n}" for n, w in sets.items())
    out = {
        "train_read": f"SELECT id, excerpt, label, split FROM ({training_columns()})",
        "train_valid_rows": "SELECT id, excerpt, round(label::DOUBLE, 6) AS bt_easiness "
                            f"FROM ({training_columns()}) WHERE {VALID}",
        "train_optional_numeric":
            "SELECT id, round(score, 6) AS flesch_reading_ease, round(rival, 6) AS smog, "
            "NULL::DOUBLE AS ari, round(score, 6) AS first, round(rival, 6) AS sixth "
            f"FROM ({training_columns()}) WHERE {VALID}",
        "train_first_n": f"SELECT id, round(label::DOUBLE, 6) AS bt_easiness FROM ({training_columns()}) "
                         f"WHERE {VALID} ORDER BY id LIMIT 100",
        "lexicon_norms": annotated(
            "SELECT word, round(aoa, 6) AS aoa, round(concreteness, 6) AS concreteness, "
            "round(familiarity, 6) AS familiarity, round(imagery, 6) AS imagery FROM norms", *lex),
        "ruleset_phrases": ruleset_sql(),
        "entities_read": "SELECT s_name AS name, n_name AS state, r_name AS type, s_suppkey AS rank "
                         "FROM supplier JOIN nation ON s_nationkey = n_nationkey "
                         "JOIN region ON n_regionkey = r_regionkey",
        "page_text": r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(html, "
                     r"'(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), "
                     r"'[ \t\n\f\r]+', ' ', 'g')), '') AS text FROM pages",
        "first_matching_link": f"WITH {LINKS} SELECT entity, link FROM best",
        "failed_extractions": f"WITH {LINKS} SELECT entity FROM best WHERE link IS NULL",
        "entity_results": entity_sql(),
        "concat_pages": r"SELECT conv_id, regexp_replace(string_agg(text, chr(10) ORDER BY turn), "
                        r"'^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') AS text FROM conversations "
                        "WHERE text <> '' GROUP BY conv_id",
        "sentences": annotated("SELECT doc_id, sent_id, text FROM sent"),
        "abbreviations": f"WITH {ABBREVIATIONS} SELECT word, n, n_dotted, round(score, 6) AS score FROM known "
                         "WHERE score >= 0.3",
        "known_sentences": f"WITH {ABBREVIATIONS}, {KNOWN_SENTENCES} SELECT doc_id, "
                           "(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INTEGER AS sent_id, text "
                           f"FROM whole WHERE regexp_matches(text, '{W.VISIBLE_PATTERN}')",
        "dot_segments": "SELECT doc_id, unnest(range(len(p)))::INTEGER AS seg_id, unnest(p) AS sentence "
                        "FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)",
        "tokens": annotated(r"SELECT doc_id, sent_id, tok_idx, text, regexp_matches(text, '^\p{L}+$') "
                            "AS is_alpha FROM tok"),
        "token_pos": annotated("SELECT doc_id, sent_id, tok_idx, text, pos, tense, aspect FROM ann"),
        "token_lemma": annotated("SELECT doc_id, sent_id, tok_idx, lemma FROM ann"),
        "token_dep": annotated("SELECT doc_id, sent_id, tok_idx, dep, head_idx FROM ann"),
        "token_syllables": annotated("SELECT doc_id, sent_id, tok_idx, syllables FROM word"),
        "word_zipf": annotated("SELECT word, n, zipf FROM zipf", *lex),
        "hashed_embedding": annotated(
            "SELECT doc_id, sent_id, bucket AS cell, round(tf * ln(((SELECT count(*) FROM sent) + 1) / "
            "(df + 1)), 6) AS value FROM cell JOIN (SELECT bucket, count(*)::DOUBLE AS df FROM cell "
            "GROUP BY bucket) USING (bucket) WHERE ln(((SELECT count(*) FROM sent) + 1) / (df + 1)) <> 0",
            fill(SIMILAR, ["doc_id"], width=str(W.EMBEDDING_WIDTH))),
        "surface_lengths": annotated(
            "SELECT a.doc_id, a.sent_id, any_value(length(s.text))::BIGINT AS sentence_length, "
            "count(*) AS word_count FROM ann a JOIN sent s ON a.doc_id = s.doc_id AND "
            "a.sent_id = s.sent_id GROUP BY a.doc_id, a.sent_id"),
        "surface_connectives": aggregate_query(
            *[f"{n}_connectives" for n in W.CONNECTIVES], "connectives_total"),
        "surface_phrases": phrase_sql(),
        "function_content_ratio": aggregate_query("function_to_content_ratio", ints=False),
        "lexical_pos_counts": aggregate_query("nouns", "verbs", "adjectives", "adverbs", "pronouns"),
        "lexical_person": aggregate_query("first_person_pronouns", "third_person_pronouns"),
        "lexical_syllables": aggregate_query("avg_syllables_per_word", ints=False),
        "lexical_frequency": aggregate_query(
            "avg_word_frequency_log", "avg_content_word_frequency_log", ints=False,
            joins="LEFT JOIN zipf z ON a.lower = z.word", ctes=lex),
        "lexical_norms": aggregate_query(
            "avg_age_of_acquisition", "avg_concreteness", "avg_imagery", "avg_familiarity",
            ints=False, joins="LEFT JOIN norms m ON a.base = m.word", ctes=lex),
        "lexical_negations": aggregate_query("negations"),
        "passive_count": aggregate_query("passive_constructions"),
        "doc_lemma_sets": annotated(f"SELECT doc_id, {set_columns} FROM text_rows t LEFT JOIN (SELECT * "
                                    "FROM ann WHERE is_alpha) USING (doc_id) WHERE doc_id IN "
                                    "(SELECT doc_id FROM ann) GROUP BY doc_id"),
        "doc_lexical_diversity": annotated(
            f"SELECT doc_id, round({share('count(DISTINCT base)', 'count(*)')}, 6) AS "
            "lexical_diversity_all, round("
            + share("count(DISTINCT base) FILTER (pos = 'VERB')", "count(*) FILTER (pos = 'VERB')")
            + ", 6) AS lexical_diversity_verbs FROM word WHERE is_alpha GROUP BY doc_id"),
        "dependency_depth": annotated("SELECT doc_id, sent_id, dependency_depth::BIGINT AS "
                                      "dependency_depth FROM depths", fill(DEPTH, ["doc_id"])),
        "words_before_root": annotated("SELECT doc_id, sent_id, min(tok_idx) AS words_before_main_verb "
                                       "FROM ann WHERE dep = 'ROOT' GROUP BY doc_id, sent_id"),
        "cosine_adjacent":
            "SELECT label, vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], "
            "lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)), 0), 6) AS adjacent "
            "FROM embeddings",
        "cosine_all_previous":
            f"WITH {EMBEDDED} SELECT label, vec_id, round(coalesce(avg(cos), 0), 6) AS mean_previous, "
            "round(coalesce(1 - max(cos), 0), 6) AS given_new FROM pairs GROUP BY label, vec_id",
        "profile_wide": profile_sql(),
        "profile_struct": annotated(
            "SELECT doc_id, " + ", ".join(f"round(coalesce({a}({b}), 0) + 1e-9, 6) AS {c}" for a, b, c in (
                ("avg", "nouns", "nouns_avg"), ("stddev_pop", "nouns", "nouns_sd"),
                ("min", "words", "word_count_min"), ("max", "words", "word_count_max")))
            + " FROM text_rows LEFT JOIN (SELECT doc_id, sent_id, count(*) FILTER (pos IN ('NOUN', 'PROPN')) AS "
            "nouns, count(*) AS words FROM ann GROUP BY doc_id, sent_id) USING (doc_id) GROUP BY doc_id"),
        "nested_record": annotated(
            "SELECT doc_id, sent_id, count(*) AS word_count, count(*) FILTER (pos = 'VERB') AS verbs, "
            f"count(*) FILTER (dep IN {quoted(W.PASSIVE_DEP)}) AS passive_constructions, "
            "round(CASE WHEN sent_id > 0 THEN coalesce(count(DISTINCT base) FILTER (is_alpha) / "
            "nullif(count(*) FILTER (is_alpha), 0), 0) ELSE 0 END + 1e-9, 6) AS type_token_ratio "
            "FROM ann GROUP BY doc_id, sent_id"),
        "profile_stats": stats_sql(),
        "feature_vector": with_features(
            f"SELECT doc_id, idx, {nudged('value')} AS value FROM ({unpivot('kept', 'value')})", True,
            MEANS, "kept AS MATERIALIZED (SELECT * FROM means)"),
        "training_pairs": with_features(
            "SELECT m.doc_id, round(l.quality::DOUBLE, 6) AS label, "
            + ", ".join(f"{nudged(f'm.{f}')} AS {f}" for f in W.FEATURES)
            + " FROM means m JOIN labels l USING (doc_id)", False, MEANS),
        "train_gbt": FIT.format("gbt", "documents JOIN labels USING (doc_id)", "quality::DOUBLE"),
        "train_linear": FIT.format("linear", "documents JOIN labels USING (doc_id)", "quality::DOUBLE"),
        "train_from_file": FIT.format("file", f"({training_columns()}) WHERE {VALID}", "label::DOUBLE"),
        "tree_importances": "SELECT unnest(" + str(list(W.FEATURES)) + ") AS feature, true AS not_negative, "
                            "1.0::DOUBLE AS total",
        "ruleset_features": annotated(
            "SELECT doc_id, sent_id, " + ", ".join(
                f"count(*) FILTER (pos IN {quoted(W.CONJUNCTION_POS)} AND lower IN {quoted(words)}) "
                f"AS {name}_connectives" for name, words in rotated().items())
            + ", count(*) FILTER (pos = 'PRON' AND lower IN ('you', 'it', 'they')) AS first_person_pronouns, "
            + ", ".join(f"any_value({name}_phrases) AS {name}_phrases" for name in [*rotated(), "own"])
            + " FROM ann JOIN held USING (doc_id, sent_id) GROUP BY doc_id, sent_id",
            f"held AS (SELECT doc_id, sent_id, {phrase_columns({**rotated(), 'own': OWN_PHRASES})} FROM sent)"),
        "modifiers_per_np": sentence_query("modifiers_per_np"),
        "syntactic_similarity": annotated(
            "SELECT doc_id, sent_id, round(CASE WHEN before > 0 THEN common * 2.0 / (now + before) ELSE 0 END, 6) "
            "AS syntactic_similarity_prev FROM (SELECT doc_id, sent_id, sum(now) AS now, sum(before) AS before, "
            "sum(least(now, before)) AS common FROM (SELECT doc_id, sent_id, tree, sum(now) AS now, sum(before) AS before "
            "FROM (SELECT doc_id, sent_id, tree, 1 AS now, 0 AS before FROM trees "
            "UNION ALL SELECT doc_id, sent_id + 1, tree, 0, 1 FROM trees) GROUP BY ALL) GROUP BY ALL) WHERE now > 0",
            "trees AS (SELECT a.doc_id, a.sent_id, a.tok_idx, any_value(a.pos) || coalesce(' ' || "
            "string_agg(b.pos, ' ' ORDER BY b.tok_idx), '') AS tree FROM ann a LEFT JOIN ann b ON a.doc_id = b.doc_id "
            "AND a.sent_id = b.sent_id AND b.head_idx = a.tok_idx GROUP BY a.doc_id, a.sent_id, a.tok_idx)"),
        "tree_attributions": "SELECT doc_id, true AS adds_up, true AS idle_are_zero "
                             "FROM documents JOIN labels USING (doc_id)",
        "score_linear": with_features(f"SELECT doc_id, round({SCORE}, 6) AS score FROM means", True, MEANS),
        "sentence_scores": sentence_scores_sql(),
        "weights_load": with_features(
            "SELECT idx, feature, round(coefficient, 6) + 0 AS coefficient, "
            f"round({W.SAVED_INTERCEPT!r}::DOUBLE, 6) AS intercept, round(corpus_mean, 6) AS corpus_mean, "
            "round(coefficient * corpus_mean, 6) + 0 AS contribution FROM (SELECT idx, feature, "
            f"list_extract({[*W.SAVED_COEFFICIENTS]}::DOUBLE[], idx + 1) AS coefficient, value AS corpus_mean "
            f"FROM ({unpivot('kept', 'value')}))", True, MEANS,
            "kept AS MATERIALIZED (SELECT "
            + ", ".join(f"avg({f}) AS {f}" for f in W.FEATURES) + " FROM means)"),
        "attributions": with_features(
            f"SELECT feature, round(avg(abs(value)), 6) AS importance FROM ("
            + unpivot("kept", "value", "({f} - (SELECT avg({f}) FROM kept)) * "
                      f"list_extract({[*W.SAVED_COEFFICIENTS]}::DOUBLE[], {{i}} + 1)")
            + ") GROUP BY feature", True, MEANS, "kept AS MATERIALIZED (SELECT * FROM means)"),
        "score_card": with_features(
            f"SELECT doc_id, round({SCORE}, 6) AS custom, round({formula('flesch_ease')}, 6) AS "
            f"flesch_kincaid_ease, round({formula('fk_grade')}, 6) AS flesch_kincaid_level, "
            f"round({formula('smog')}, 6) AS smog_analysis, round({formula('gunning_fog')}, 6) AS "
            "gunning_fog FROM means JOIN counted USING (doc_id)", True, MEANS, COUNTS),
    }
    for name in FORMULAS:
        out[name] = annotated(f"SELECT doc_id, round({formula(name)}, 6) AS {name} FROM counted", COUNTS)
    for name, columns in {
            "cohesion_overlaps": ["content_overlap_adjacent", "noun_overlap_adjacent",
                                  "argument_overlap_adjacent"],
            "cohesion_stem_all": ["stem_overlap_all", "content_overlap_all"],
            "cosine_verb_gated": ["lsa_overlap_adjacent", "lsa_overlap_all", "lsa_given_new",
                                  "lsa_verb_overlap_adjacent"],
            "pos_dissimilarity": ["pos_dissimilarity_prev"],
            "word_dissimilarity": ["word_dissimilarity_prev"],
            "verb_repetition": ["verb_overlap_adjacent", "verb_tense_repetition",
                                "verb_aspect_repetition"],
            "cohesion_word_rates": ["causal_cohesion", "temporal_cohesion", "intentional_cohesion"],
            "type_token_ratio": ["type_token_ratio"]}.items():
        out[name] = sentence_query(*columns)
    return out
