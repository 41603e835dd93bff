"""SQL for the grammar queries in another engine: the context by joins instead of arrays."""

from __future__ import annotations

from ..operators.rules import DEGREE_SQL, FAMILIES, GERUND_CASE_SQL, GERUNDIVE_SQL, LOOKUPS, LOOKUPS2, SPECIAL, render
from ..operators.token_context import CLIMB
from ..sources.surrogate import annotation_sql

KEY = "doc_id, sent_id"

# The kinds of the constructions that have kinds, told from the tokens anew and not from the rules.
LABELS = """CASE key
  WHEN 'ablative_absolute' THEN CASE WHEN vf IS DISTINCT FROM 'Part' THEN 'predicate' WHEN voice = 'Pass' THEN 'completed action' WHEN tense = 'Pres' THEN 'ongoing action' ELSE 'predicate' END
  WHEN 'indirect_statement' THEN coalesce(map {'Pres': 'at the same time', 'Past': 'before', 'Fut': 'after'}[tense], 'relative')
  WHEN 'purpose_clause' THEN CASE WHEN l = 'ut' OR l = 'quo' THEN 'positive' ELSE 'negative' END
  WHEN 'cum_clause' THEN CASE WHEN coalesce(hd_mood, '') <> 'Sub' THEN 'temporal' WHEN coalesce(hd_tense, '') IN ('Pqp', 'Past') THEN 'circumstantial or causal' ELSE 'causal or concessive' END
  WHEN 'supine' THEN CASE WHEN form LIKE '%um' THEN 'accusative, purpose' ELSE 'ablative, respect' END
  WHEN 'gerund' THEN CASE WHEN coalesce(prep_l, '') = 'ad' THEN 'purpose' ELSE coalesce(map {'Gen': 'genitive', 'Abl': 'means'}[cas], '') END
  WHEN 'subjunctive_independent' THEN CASE coalesce(person, '') WHEN '3' THEN 'jussive' WHEN '1' THEN CASE WHEN num IS NOT DISTINCT FROM 'Plur' THEN 'hortatory' ELSE 'deliberative' END ELSE 'optative or potential' END
    || CASE WHEN EXISTS (SELECT 1 FROM tok k WHERE k.doc_id = f.doc_id AND k.sent_id = f.sent_id AND k.head = f.ti AND k.i <> f.ti AND k.l IN ('non', 'ne')) THEN ', negated' ELSE '' END
  WHEN 'conditional_clause' THEN CASE WHEN own_mood <> 'Sub' THEN 'indicative'
    WHEN own_tense IN ('Imp', 'Pqp') AND coalesce(gh_mood, gk_cop_mood, '') = 'Sub' AND (CASE WHEN gh_mood IS NULL THEN gk_cop_tense ELSE gh_tense END) IN ('Imp', 'Pqp') THEN 'contrary to fact' ELSE 'subjunctive' END
  WHEN 'genitive_with_adjective' THEN CASE WHEN cas IS NOT DISTINCT FROM 'Gen' THEN '' ELSE 'against the parser' END
  ELSE '' END"""
_LABEL_COLUMNS = "i AS ti, vf, voice, tense, l, hd_mood, hd_tense, form, prep_l, cas, person, num, gh_mood, gh_tense, gk_cop_mood, gk_cop_tense, CASE WHEN hd_mood IN ('Ind', 'Sub', 'Imp') THEN hd_mood ELSE hk_fin_mood END AS own_mood, CASE WHEN hd_mood IN ('Ind', 'Sub', 'Imp') THEN hd_tense ELSE hk_fin_tense END AS own_tense"


def context_sql() -> str:
    """CTEs up to ``ctx``, one row per token with the columns the rules name."""
    duck = lambda s: render(s, "duckdb")
    ups = "\n".join(
        f"LEFT JOIN tok u{k} ON u{k}.doc_id = {p}.doc_id AND u{k}.sent_id = {p}.sent_id AND u{k}.i = {p}.head AND {p}.head <> {p}.i" for k, p in ((k, f"u{k - 1}" if k > 1 else "t") for k in range(1, CLIMB + 1))
    )
    gov = lambda c: "CASE " + " ".join(f"WHEN u{k}.pos IN ('VERB', 'AUX') THEN u{k}.{c}" for k in range(1, CLIMB + 1)) + " END"
    heads = ", ".join(f"u1.{c} AS hd_{c}" for c in ("i", "l", "pos", "dep", "cas", "mood", "tense", "voice", "vf", "deg"))
    # arg_min passes over nulls, so a feature that may be missing in the first token is listed
    one = lambda n, c, f: f"(list(x.{f} ORDER BY x.i) FILTER (WHERE {c}))[1] AS {n}" if f == "tense" or n == "gk_cop_mood" else f"arg_min(x.{f}, x.i) FILTER (WHERE {c}) AS {n}"
    look = lambda table: ", ".join(one(n, c, f) for n, (c, f) in table.items())
    return f"""WITH {annotation_sql()},
flat AS (SELECT *, (coalesce(cas, '') = 'Gen' OR cand_gen) AS may_gen, {GERUNDIVE_SQL} AS gdv, {duck(DEGREE_SQL)} AS deg FROM flat0),
flat1 AS (SELECT *, {duck(GERUND_CASE_SQL)} AS gcas FROM flat),
tok AS MATERIALIZED (SELECT t.*, NOT EXISTS (SELECT 1 FROM flat x WHERE x.sent_id = t.sent_id AND x.doc_id = t.doc_id AND x.head = t.i AND x.i <> t.i AND x.dep = 'case' AND x.pos IN ('ADP', 'SCONJ')) AS bare, p.l AS hl
  FROM flat1 t LEFT JOIN flat p ON p.doc_id = t.doc_id AND p.sent_id = t.sent_id AND p.i = t.head AND t.head <> t.i),
up AS (SELECT t.*, {heads}, u2.i AS gh_i, u2.l AS gh_l, u2.mood AS gh_mood, u2.tense AS gh_tense, {gov("i")} AS gov_i, {gov("l")} AS gov_l, {gov("pos")} AS gov_pos FROM tok t {ups}),
l1 AS (SELECT t.doc_id, t.sent_id, t.i AS ti, {look(LOOKUPS)} FROM up t JOIN tok x USING (doc_id, sent_id) GROUP BY t.doc_id, t.sent_id, t.i),
c1 AS (SELECT up.*, l1.* EXCLUDE (doc_id, sent_id, ti) FROM up JOIN l1 ON l1.doc_id = up.doc_id AND l1.sent_id = up.sent_id AND l1.ti = up.i),
l2 AS (SELECT t.doc_id, t.sent_id, t.i AS ti, {look(LOOKUPS2)} FROM c1 t JOIN tok x USING (doc_id, sent_id) GROUP BY t.doc_id, t.sent_id, t.i),
ctx AS MATERIALIZED (SELECT c1.*, l2.* EXCLUDE (doc_id, sent_id, ti) FROM c1 JOIN l2 ON l2.doc_id = c1.doc_id AND l2.sent_id = c1.sent_id AND l2.ti = c1.i)"""


def _role_words() -> str:
    from ..functions import lexicon as L

    return _in("l", [*L.ABL_ABS_ROLE_NOUNS, *L.ABL_ABS_ROLE_ADJS])


# The role words of a sentence in order; each takes the first mate that is left, and both are used.
NOMINAL = """ro AS (SELECT doc_id, sent_id, i, num, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS k FROM tok WHERE cas = 'Abl' AND bare AND {role}),
us AS (SELECT doc_id, sent_id, list(j) AS used FROM (SELECT doc_id, sent_id, unnest([i, k_subj_abl]) AS j FROM ctx WHERE dep = 'advcl:abs' AND cas = 'Abl') GROUP BY ALL),
ma AS (SELECT ro.doc_id, ro.sent_id, ro.k, ro.i AS t, x.i AS x FROM ro JOIN tok x ON x.doc_id = ro.doc_id AND x.sent_id = ro.sent_id AND x.i <> ro.i AND abs(x.i - ro.i) <= 2
  WHERE x.cas = 'Abl' AND x.bare AND x.pos IN ('NOUN', 'PROPN', 'PRON') AND (x.num IS NULL OR ro.num IS NULL OR x.num = ro.num)),
ml AS (SELECT ro.doc_id, ro.sent_id, ro.k, ro.i AS t, coalesce((SELECT list(x ORDER BY x) FROM ma WHERE ma.doc_id = ro.doc_id AND ma.sent_id = ro.sent_id AND ma.k = ro.k), []) AS xs FROM ro),
na AS (SELECT DISTINCT ro.doc_id, ro.sent_id, 0::BIGINT AS k, NULL::INT AS t, NULL::INT AS x, coalesce(us.used, []) AS used FROM ro LEFT JOIN us USING (doc_id, sent_id)
  UNION ALL SELECT doc_id, sent_id, k, t, x, CASE WHEN x IS NULL THEN used ELSE list_concat(used, [t, x]) END FROM (
    SELECT na.doc_id, na.sent_id, ml.k, ml.t, na.used, CASE WHEN NOT list_contains(na.used, ml.t) THEN list_filter(ml.xs, lambda y: NOT list_contains(na.used, least(y, ml.t)))[1] END AS x
    FROM na JOIN ml ON ml.doc_id = na.doc_id AND ml.sent_id = na.sent_id AND ml.k = na.k + 1))"""


def _row(rule, number: int | None = None) -> str:
    duck = lambda s: render(s, "duckdb")
    tokens = ", ".join(f"({duck(x)})" for x in rule.tokens)
    return f"{KEY}, '{rule.key}' AS key, CAST({rule.anchor} AS INT) AS anchor, concat_ws(',', {tokens}) AS tokens, CAST({duck(rule.conf)} AS DOUBLE) AS confidence, {_LABEL_COLUMNS}"


def family_sql(families: list[str]) -> str:
    """Findings of some families, without suppression: a cascade numbers its branches first."""
    extra, parts = [], []
    for f in families:
        if f == "nominal":  # settled word by word, by a recursive query of its own
            extra.append(NOMINAL.format(role=_role_words()))
            nothing = ", ".join(f"NULL::VARCHAR AS {c}" for c in "vf voice tense l hd_mood hd_tense form prep_l cas person num gh_mood gh_tense gk_cop_mood gk_cop_tense own_mood own_tense".split())
            parts.append(f"SELECT {KEY}, 'ablative_absolute_nominal' AS key, t AS anchor, least(t, x) || ',' || greatest(t, x) AS tokens, 0.7::DOUBLE AS confidence, t AS ti, {nothing} FROM na WHERE x IS NOT NULL")
            continue
        alone, cascade = FAMILIES[f]
        parts += [f"SELECT {_row(r)} FROM ctx WHERE {render(r.when, 'duckdb')}" for r in alone]
        if cascade:
            branch = "CASE " + " ".join(f"WHEN {render(r.when, 'duckdb')} THEN {n}" for n, r in enumerate(cascade)) + " END"
            extra.append(f"b_{f} AS (SELECT *, {branch} AS branch FROM ctx)")
            parts += [f"SELECT {_row(r)} FROM b_{f} WHERE branch = {n}" for n, r in enumerate(cascade) if r.key]
            if f == "genitive":
                parts += [f"SELECT {_row(r)} FROM b_{f} WHERE branch = {n}".replace("genitive_subjective", "genitive_objective").replace(f"CAST({render(r.conf, 'duckdb')} AS DOUBLE)", "0.5::DOUBLE") for n, r in enumerate(cascade) if r.key == "genitive_subjective"]
    head = context_sql() if "nominal" not in families else context_sql().replace("WITH", "WITH RECURSIVE", 1)
    return head + "".join(f",\n{x}" for x in extra) + ",\nfound AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")\n"


def findings_sql(families: list[str]) -> str:
    return family_sql(families) + f"SELECT {KEY}, key, anchor, tokens, confidence, {LABELS} AS label FROM found f"


#: The findings that stay after suppression, as a subquery.
KEPT = f"""(SELECT * FROM found f WHERE NOT (key IN ('purpose_clause', 'result_clause') AND EXISTS (SELECT 1 FROM found s WHERE s.key IN ({', '.join(map(repr, SPECIAL))}) AND s.doc_id = f.doc_id AND s.sent_id = f.sent_id AND s.anchor = f.anchor))) kept"""


def all_sql() -> str:
    """CTEs up to ``found`` of all families."""
    return family_sql(list(FAMILIES))


def suppressed_sql() -> str:
    """Number of findings of each key after suppression."""
    return family_sql(list(FAMILIES)) + f"SELECT key, count(*)::BIGINT AS n FROM {KEPT} GROUP BY key"


def tags_sql() -> str:
    return (
        family_sql(list(FAMILIES))
        + f"""SELECT {KEY}, i::INT AS i, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT {KEY}, key, unnest(string_split(tokens, ',')) AS i FROM {KEPT}) GROUP BY {KEY}, i"""
    )


def tokens_sql() -> str:
    """CTE ``tok`` of stand-in tokens without the rule columns."""
    # k counts the words of a sentence, leaving signs out
    return f"""WITH {annotation_sql()},
tok AS MATERIALIZED (SELECT *, CASE WHEN pos NOT IN ('PUNCT', 'X') AND text <> '' THEN row_number() OVER (PARTITION BY doc_id, sent_id, (pos NOT IN ('PUNCT', 'X') AND text <> '') ORDER BY i) - 1 END AS k FROM flat0)"""


def _in(column: str, lemmas: list[str]) -> str:
    from ..operators.rules import within

    return within(column, lemmas)


def figures_sql(group: str) -> str:
    """The figures of a group by joins and windows over the token rows."""
    from ..functions import lexicon as L

    pair = "a.pos IN ('ADJ', 'DET', 'NUM') AND a.dep IN ('amod', 'det', 'nummod')"
    coord = "(dep = 'cc' OR l IN ('et', 'que', 'atque', 'ac'))"
    out = "SELECT doc_id, sent_id, {k} AS key, {t} AS tokens, {c}::DOUBLE AS confidence FROM {f}"
    parts: list[str] = []
    extra = ""
    if group == "order":
        extra = f""",
p AS (SELECT a.doc_id, a.sent_id, a.i AS a, n.i AS n FROM tok a JOIN tok n ON n.doc_id = a.doc_id AND n.sent_id = a.sent_id AND n.i = a.head WHERE {pair}),
q AS (SELECT p.doc_id, p.sent_id, p.a AS a1, p.n AS n1, r.a AS a2, r.n AS n2,
  list_sort([{{'i': p.a, 'c': 'A'}}, {{'i': p.n, 'c': 'a'}}, {{'i': r.a, 'c': 'B'}}, {{'i': r.n, 'c': 'b'}}]) AS x
  FROM p JOIN p r ON r.doc_id = p.doc_id AND r.sent_id = p.sent_id AND r.a > p.a WHERE abs(p.a - p.n) > 1 AND abs(r.a - r.n) > 1),
z AS (SELECT *, array_to_string(list_transform(x, lambda y: y.c), '') AS shape, array_to_string(list_transform(x, lambda y: y.i), ',') AS tokens FROM q
  WHERE x[4].i - x[1].i <= 8 AND len(list_distinct(list_transform(x, lambda y: y.i))) = 4),
zz AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY a1, a2) AS k FROM z WHERE shape IN ('ABba', 'BAab', 'ABab', 'BAba')),
g AS (SELECT doc_id, sent_id, list(pos ORDER BY i) AS ps, list(coalesce(cas, '') ORDER BY i) AS cs, string_agg(i, ',' ORDER BY i) AS tokens FROM tok WHERE k IS NOT NULL GROUP BY ALL HAVING count(*) = 5)"""
        parts = [
            out.format(k="'hyperbaton'", t="a || ',' || n", c="0.7", f="p WHERE abs(a - n) - 1 >= 3"),
            out.format(k="CASE WHEN shape IN ('ABba', 'BAab') THEN 'chiasmus' ELSE 'synchysis' END", t="tokens", c="0.65", f="zz WHERE k <= 3"),
            out.format(k="'golden_line'", t="tokens", c="CASE WHEN cs[1] = cs[5] AND cs[2] = cs[4] THEN 0.8 ELSE 0.5 END", f="g WHERE ps[1] = 'ADJ' AND ps[2] = 'ADJ' AND ps[3] IN ('VERB', 'AUX') AND ps[4] IN ('NOUN', 'PROPN') AND ps[5] IN ('NOUN', 'PROPN')"),
            out.format(k="'anastrophe'", t="head || ',' || i", c="0.75", f="tok WHERE dep = 'case' AND pos = 'ADP' AND i = head + 1"),
        ]
    if group == "words":
        extra = f""",
pl AS (SELECT doc_id, sent_id, l, min(i) AS first, max(i) AS last, count(*) AS n, count(DISTINCT form) AS forms, string_agg(i, ',' ORDER BY i) AS tokens FROM tok
  WHERE pos IN ('NOUN', 'PROPN', 'ADJ', 'PRON', 'VERB') AND length(l) > 2 GROUP BY doc_id, sent_id, l HAVING n >= 2 AND forms >= 2 AND last - first <= 10),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY first) AS k FROM pl),
li AS (SELECT t.doc_id, t.sent_id, t.i, min(u.i) AS u FROM tok t JOIN tok u ON u.doc_id = t.doc_id AND u.sent_id = t.sent_id AND u.i BETWEEN t.i + 1 AND t.i + 2 WHERE {_in("t.l", L.NEGATORS)} AND {_in("u.l", L.NEGATIVE_SENSE)} GROUP BY ALL),
ap AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS nth FROM tok WHERE cas = 'Voc' AND dep NOT IN ('nsubj', 'nsubj:pass') AND pos IN ('NOUN', 'PROPN', 'PRON', 'ADJ')),
el AS (SELECT doc_id, sent_id, string_agg(i, ',' ORDER BY i) FILTER (WHERE k < 6) AS tokens FROM tok GROUP BY doc_id, sent_id HAVING count(k) >= 3 AND count(*) FILTER (WHERE vf = 'Fin') = 0)"""
        parts = [
            out.format(k="'polyptoton'", t="tokens", c="0.7", f="pk WHERE k <= 3"),
            out.format(k="'litotes'", t="i || ',' || u", c="0.7", f="li"),
            out.format(k="'simile'", t="i::VARCHAR", c="0.7", f=f"tok WHERE {_in('l', L.SIMILE_MARKERS)}"),
            out.format(k="'apostrophe'", t="i::VARCHAR", c="0.7", f="ap WHERE nth <= 3"),
            out.format(k="'ellipsis'", t="tokens", c="0.6", f="el"),
        ]
    if group == "coordination":
        extra = f""",
co AS (SELECT doc_id, sent_id, count(*) FILTER (WHERE {coord}) AS nc, string_agg(i, ',' ORDER BY i) FILTER (WHERE {coord}) AS cs, count(*) FILTER (WHERE dep = 'conj') AS nj,
  string_agg(i, ',' ORDER BY i) FILTER (WHERE dep = 'conj') AS js, arg_min(head, i) FILTER (WHERE dep = 'conj') AS h FROM tok GROUP BY doc_id, sent_id),
cm AS (SELECT t.doc_id, t.sent_id, t.i, (SELECT count(*) FROM tok c WHERE c.doc_id = t.doc_id AND c.sent_id = t.sent_id AND c.text = ',' AND c.i < t.i) AS commas FROM tok t
  WHERE t.pos IN ('VERB', 'NOUN', 'ADJ', 'PROPN', 'ADV', 'NUM') AND t.text <> ',' AND EXISTS (SELECT 1 FROM tok c WHERE c.doc_id = t.doc_id AND c.sent_id = t.sent_id AND c.text = ',')),
sa AS (SELECT doc_id, sent_id, string_agg(i, ',' ORDER BY i) AS tokens FROM cm JOIN co USING (doc_id, sent_id) WHERE nc = 0 AND nj < 2 GROUP BY doc_id, sent_id HAVING count(*) >= 3 AND count(DISTINCT commas) = count(*)),
tr AS (SELECT doc_id, sent_id, head, string_agg(i, ',' ORDER BY i) AS ms FROM tok WHERE dep = 'conj' GROUP BY ALL HAVING count(*) = 2)"""
        parts = [
            out.format(k="'asyndeton'", t="h || ',' || js", c="0.65", f="co WHERE nc = 0 AND nj >= 2"),
            out.format(k="'asyndeton'", t="tokens", c="0.65", f="sa"),
            out.format(k="'polysyndeton'", t="cs", c="0.6", f="co WHERE nc >= 3"),
            out.format(k="'tricolon'", t="head || ',' || ms", c="0.6", f="tr"),
        ]
    if group == "sound":
        extra = """,
ho AS (SELECT a.doc_id, a.sent_id, a.i, min(b.i) AS b FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.sent_id = a.sent_id AND b.k BETWEEN a.k + 1 AND a.k + 3
  WHERE length(a.form) >= 3 AND length(b.form) >= 3 AND right(a.form, 3) = right(b.form, 3) AND a.l <> b.l GROUP BY ALL),
hk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS k FROM ho),
wn AS (SELECT a.doc_id, a.sent_id, a.i, count(*) AS n, string_agg(b.form, '' ORDER BY b.i) AS t, string_agg(b.i, ',' ORDER BY b.i) AS tokens,
  min(instr(b.form, 'a') > 0)::INT AS va, min(instr(b.form, 'e') > 0)::INT AS ve, min(instr(b.form, 'i') > 0)::INT AS vi, min(instr(b.form, 'o') > 0)::INT AS vo, min(instr(b.form, 'u') > 0)::INT AS vu
  FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.sent_id = a.sent_id AND b.k BETWEEN a.k AND a.k + 3 GROUP BY ALL HAVING count(*) >= 3),
vw AS (SELECT doc_id, sent_id, i, tokens, t, v, length(t) - length(replace(t, v, '')) AS total, row_number() OVER (PARTITION BY doc_id, sent_id, i ORDER BY instr(t, v)) AS k
  FROM (SELECT *, unnest(list_filter([CASE WHEN va = 1 THEN 'a' END, CASE WHEN ve = 1 THEN 'e' END, CASE WHEN vi = 1 THEN 'i' END, CASE WHEN vo = 1 THEN 'o' END, CASE WHEN vu = 1 THEN 'u' END], lambda y: y IS NOT NULL)) AS v FROM wn)),
vk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS kk FROM vw WHERE k = 1 AND total >= 6)"""
        parts = [out.format(k="'homoeoteleuton'", t="i || ',' || b", c="0.45", f="hk WHERE k <= 3"), out.format(k="'assonance'", t="tokens", c="0.5", f="vk WHERE kk <= 2")]
    return tokens_sql() + extra + "\n" + "\nUNION ALL ".join(parts)


def anaphora_sql() -> str:
    return (
        tokens_sql()
        + """,
o AS (SELECT doc_id, sent_id, i, form, lag(form) OVER (PARTITION BY doc_id ORDER BY sent_id) AS before FROM tok WHERE k = 0),
r AS (SELECT *, sum(CASE WHEN form = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_id) AS run FROM o)
SELECT doc_id, min(sent_id) AS sent_id, 'anaphora' AS key, string_agg(sent_id || ':' || i, ',' ORDER BY sent_id) AS tokens, 0.75::DOUBLE AS confidence FROM r GROUP BY doc_id, run HAVING count(*) >= 2"""
    )
