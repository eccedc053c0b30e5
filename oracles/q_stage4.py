"""Oracles for causeway.plans.q_stage4."""

from __future__ import annotations

from causeway.functions.wording import MODEL_TERMS
from oracles.base import CTE, build
from oracles.q_mart import nums

ORACLES: dict[str, str] = {}


def add(name: str, final: str) -> None:
    ORACLES[name] = build(final)


K = "kpi, region, window_start"


def same(a: str, b: str) -> str:
    return f"{a}.kpi = {b}.kpi AND {a}.region = {b}.region AND {a}.window_start = {b}.window_start"


CTE["anchor_word"] = """
  SELECT r_name AS region, word FROM (SELECT rk, word, ROW_NUMBER() OVER (PARTITION BY rk ORDER BY COUNT(*) DESC, word) AS rn FROM (
      SELECT page_id % 5 AS rk, regexp_extract(lower(html), '<title>[^a-z]*([a-z]+)', 1) AS word FROM pages) WHERE word <> '' GROUP BY 1, 2)
  JOIN region ON r_regionkey = rk WHERE rn = 1"""

CTE["pool0"] = f"""
  SELECT e.*, a.primary_component, w.word AS anchor,
         bool_or(COALESCE(e.component = a.primary_component, FALSE)) OVER (PARTITION BY e.kpi, e.region, e.window_start) AS own,
         e.evidence_mode <> 'insufficient_evidence' AND NOT starts_with(e.model_status, 'insufficient')
           AND e.evidence_score > 1e-12 AND e.direction_consistency <> 'contradictory' AS has_evidence
  FROM evidence e JOIN action a ON {same('e', 'a')} LEFT JOIN anchor_word w ON w.region = e.region"""

CTE["pool1"] = """
  SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi, region, window_start ORDER BY round(softmax_probability, 9) DESC, ordinal) AS pos,
         CASE driver WHEN 'weather_index' THEN 'external' WHEN 'competitor_price_index' THEN 'conditional_external' ELSE 'internal' END AS scope
  FROM pool0 WHERE COALESCE(component = primary_component, FALSE) OR NOT own"""

CTE["pool"] = f"""
  SELECT p.*, (scope = 'external' OR (scope = 'conditional_external' AND anchor IS NOT NULL)) AND has_evidence
         AND softmax_probability >= 0.15 AND evidence_score >= 0.05 AND EXISTS (
           SELECT 1 FROM pool1 o WHERE {same('o', 'p')} AND o.driver <> p.driver AND o.has_evidence AND o.softmax_probability >= 0.15) AS eligible
  FROM pool1 p"""

CTE["gates0"] = f"""
  SELECT a.*, v.needs_verification, a.confidence_level = 'Low' AS low, a.top_probability_gap < 0.10 AS close_gap,
         NOT a.any_driver_significant AS unproven
  FROM action a JOIN (SELECT {K}, bool_or(eligible AND driver = 'weather_index' AND (abs(driver_zscore) >= 3.0 OR abs(structural_break_score) >= 0.15))
         AS needs_verification FROM pool GROUP BY ALL) v USING ({K})"""

CTE["gates"] = f"""
  SELECT {K}, needs_verification, decision_type = 'investigate' AND action_level NOT IN ('monitor', 'data_quality_first') AND healthy
           AND (needs_verification OR is_ambiguous OR low OR close_gap OR unproven) AS clarification_needed,
         CASE WHEN needs_verification THEN 'a strong outside driver has to be checked against public text'
              WHEN low OR close_gap OR unproven THEN concat_ws('; ', CASE WHEN low THEN 'confidence is low' END,
                CASE WHEN close_gap THEN printf('the two leading drivers are only %.3f apart', top_probability_gap) END,
                CASE WHEN unproven THEN 'no driver has a valid relationship' END)
              ELSE 'the computed evidence leaves the cause open' END AS reason,
         CASE WHEN needs_verification THEN 'a stored outside driver has to be checked against public text'
              WHEN is_ambiguous THEN 'the stored evidence leaves the cause open' WHEN low THEN 'confidence is low'
              WHEN close_gap THEN 'the leading drivers are too close' WHEN unproven THEN 'no stored driver has a valid relationship'
              ELSE 'the stored evidence needs a second look' END AS refresh_reason FROM gates0"""

CTE["uniq"] = f"""
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY pos) AS upos FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, driver ORDER BY pos) AS dup FROM pool) WHERE dup = 1"""

CTE["slots"] = f"""
  SELECT u.*, ROW_NUMBER() OVER (PARTITION BY u.kpi, u.region, u.window_start
    ORDER BY CASE WHEN upos = 1 THEN 0 WHEN upos = reserved THEN 1 ELSE 2 END, upos) - 1 AS slot
  FROM uniq u JOIN (SELECT {K}, CASE WHEN NOT bool_or(upos = 1 AND eligible) THEN MIN(CASE WHEN upos > 1 AND eligible THEN upos END) END AS reserved
                    FROM uniq GROUP BY ALL) r ON {same('u', 'r')}"""

CTE["cands"] = "SELECT *, CASE WHEN eligible THEN scope ELSE 'internal' END AS open_scope FROM slots WHERE slot < 2"

CTE["plan0"] = f"""
  SELECT {K}, MAX(CASE WHEN slot = 0 THEN driver END) AS first, MAX(CASE WHEN slot = 1 THEN driver END) AS second, MAX(anchor) AS anchor,
         arg_min(driver, slot) FILTER (open_scope <> 'internal') AS ext, bool_or(open_scope = 'external') AS weather_open
  FROM cands GROUP BY ALL"""

CTE["plan_all"] = f"""
  SELECT *, ext IS NOT NULL AS can_search,
         CASE ext WHEN 'weather_index' THEN region || ' ' || window_start || ' weather rainfall rain storm cyclone flood flooding disruption'
                  WHEN 'competitor_price_index' THEN anchor || ' ' || region || ' ' || window_start || ' competitor price pricing discount promotion launch repricing' END AS policy_query,
         CASE WHEN ext IS NOT NULL THEN CASE WHEN second IS NOT NULL THEN
             'Which public records from around that time tell ' || first || ' and ' || second || ' apart in ' || region || '?'
             ELSE 'Which public records from around that time show whether there was ' || CASE ext WHEN 'weather_index' THEN 'weather disruption' ELSE 'competitor action' END
               || ' in ' || region || '?' END END AS web_question,
         CASE WHEN second IS NOT NULL THEN 'Which record outside this model tells ' || first || ' and ' || second || ' apart for those days?'
              ELSE 'Which record outside this model shows whether ' || first || ' was at work on those days?' END AS own_question
  FROM plan0"""

CTE["plan"] = f"""
  SELECT p.kpi, p.region, p.window_start, COALESCE(web_question, own_question) AS clarification_question, policy_query AS retrieval_query,
         CASE WHEN can_search THEN 'web' ELSE 'none' END AS retrieval_target,
         CASE WHEN can_search THEN 'policy_fallback' ELSE 'safe_fallback' END AS planner_status
  FROM plan_all p JOIN gates g ON {same('p', 'g')} WHERE g.clarification_needed"""

TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(replace({t}, '_', ' ')), '[a-z0-9]+'), lambda x: length(x) >= 3))"
_TERMS = "[" + ", ".join(f"'{t}'" for t in MODEL_TERMS) + "]"
CTE["words_of"] = f"""
  SELECT {K}, COALESCE(string_agg(driver || ' ' || component || ' ' || CASE WHEN eligible THEN CASE driver WHEN 'weather_index' THEN 'weather_disruption'
             WHEN 'competitor_price_index' THEN 'competitor_action' ELSE '' END ELSE '' END, ' '), '') AS names,
         COALESCE(string_agg(CASE WHEN open_scope = 'internal' THEN '' WHEN driver = 'weather_index' THEN
             'weather rainfall rain storm cyclone flood flooding disruption weather_index weather_disruption'
           ELSE 'competitor price pricing discount promotion launch repricing competitor_price_index competitor_action' END, ' '), '') AS allowed
  FROM cands GROUP BY ALL"""
CTE["proposal"] = f"""
  SELECT p.*, names, allowed, p.kpi || ' ' || p.region || ' ' || p.window_start || ' ' || names || ' ' || COALESCE(anchor, '') AS known,
         CASE kind WHEN 0 THEN 'What changed? And why?' WHEN 1 THEN 'Did the coefficient move?' WHEN 6 THEN 'What ' || repeat('really ', 80) || 'happened?'
           ELSE 'What happened in ' || p.region || '?' END AS q,
         CASE kind WHEN 2 THEN 'storm rainfall ' || p.region || ' ' || p.window_start WHEN 3 THEN 'storm ' || p.region || ' 2031' WHEN 4 THEN 'unrelated words only'
           WHEN 9 THEN 'was there a storm in ' || p.region || '?' WHEN 10 THEN repeat('storm ', 26) || p.region WHEN 11 THEN 'storm p-value ' || p.region
           WHEN 12 THEN 'storm ' || p.kpi WHEN 13 THEN 'storm ' || p.region WHEN 14 THEN 'competitor price ' || p.region || ' ' || p.window_start END AS s,
         CASE WHEN kind IN (5, 13) THEN 'internal' WHEN kind = 7 THEN 'mail' ELSE 'web' END AS target
  FROM (SELECT *, (window_start - DATE '1995-01-01') % 15 AS kind FROM plan_all) p JOIN words_of w ON {same('p', 'w')}"""


def has(text: str, words: str) -> str:
    return f"len(list_filter({words}, lambda t: contains(lower({text}), t))) > 0"


def problem(q: str, s: str, target: str) -> str:
    """The fourteen rules of a plan, in their order, over a proposal's texts."""
    mine, known = TOKENS.format(t=s), TOKENS.format(t="known")
    years, dates = "regexp_extract_all({t}, '\\b(?:19|20)\\d{{2}}\\b')", "regexp_extract_all({t}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b')"
    web = f"{target} = 'web'"
    inside = lambda f: f"list_has_all({f.format(t='known')}, {f.format(t=s)})"
    return f"""CASE WHEN trim(COALESCE({q}, '')) = '' OR length({q}) - length(replace({q}, '?', '')) <> 1 THEN 'clarification question must contain exactly one question'
      WHEN length(trim({q})) > 420 THEN 'clarification question is too long'
      WHEN {has(q, _TERMS)} THEN 'clarification question references model-internal statistics'
      WHEN {target} NOT IN ('web', 'internal', 'none') THEN 'invalid retrieval target'
      WHEN {web} AND {s} IS NULL THEN 'web retrieval requires a query'
      WHEN {web} AND contains({s}, '?') THEN 'web query must be search-oriented rather than a question'
      WHEN {web} AND (length({s}) > 180 OR len(string_split_regex({s}, '\\s+')) > 24) THEN 'web query is too long'
      WHEN {web} AND {has(s, _TERMS)} THEN 'web query references model-internal statistics'
      WHEN {web} AND NOT (len(list_intersect({mine}, {known})) > 0 AND {inside(dates)} AND {inside(years)}) THEN 'web query is not grounded in supplied context'
      WHEN {web} AND NOT (list_has_all({mine}, {TOKENS.format(t='region')}) OR (anchor IS NOT NULL AND len({TOKENS.format(t='anchor')}) > 0
        AND list_has_all({mine}, {TOKENS.format(t='anchor')}))) THEN 'web query does not contain a supplied external anchor'
      WHEN {web} AND NOT can_search THEN 'candidate hypotheses are not externally verifiable'
      WHEN {web} AND len(list_intersect({mine}, {TOKENS.format(t='allowed')})) = 0 THEN 'web query does not match an externally searchable hypothesis'
      WHEN {target} <> 'web' AND {s} IS NOT NULL THEN 'non-web retrieval target must use a null query' END"""


add("clarification_gate", "SELECT * FROM gates")
add("web_eligibility", f"SELECT {K}, component, driver, scope, has_evidence, eligible FROM pool")
add("retrieval_candidates", f"SELECT {K}, slot, driver FROM cands")
add("retrieval_context", f"""SELECT c.kpi, c.region, c.window_start,
  CASE WHEN COALESCE(a.percent_change, a.total_change) IS NULL OR abs(COALESCE(a.percent_change, a.total_change)) < 1e-12 THEN 'flat_or_unknown'
       WHEN COALESCE(a.percent_change, a.total_change) > 0 THEN 'up' ELSE 'down' END AS direction, lower(a.confidence_level) AS confidence,
  a.decision_type, c.driver AS name, c.open_scope AS retrieval_scope,
  CASE WHEN c.eligible THEN CASE c.driver WHEN 'weather_index' THEN 'weather_disruption' WHEN 'competitor_price_index' THEN 'competitor_action' END END AS external_hypothesis
  FROM cands c JOIN action a ON {same('c', 'a')}""")
add("retrieval_plan", "SELECT * FROM plan")
add("plan_validation", f"SELECT {K}, COALESCE({problem('q', 's', 'target')}, 'valid') AS verdict FROM proposal")
add("plan_normalisation", f"""
  SELECT {K}, CASE WHEN bad IS NULL THEN q ELSE COALESCE(web_question, own_question) END AS clarification_question,
         CASE WHEN bad IS NULL THEN p_query ELSE policy_query END AS retrieval_query,
         CASE WHEN bad IS NULL THEN p_target WHEN can_search THEN 'web' ELSE 'none' END AS retrieval_target,
         CASE WHEN bad IS NULL THEN 'generated' WHEN can_search THEN 'policy_fallback' ELSE 'safe_fallback' END AS planner_status,
         CASE WHEN bad IS NOT NULL THEN 'planner output rejected: ' || bad WHEN up THEN 'sent to public search, as the policy asks for this driver'
              WHEN target = 'web' AND p_target = 'internal' THEN 'kept internal: no candidate can be checked against public text' END AS planner_reason
  FROM (SELECT *, {problem('q', 'p_query', 'p_target')} AS bad FROM (
    SELECT *, CASE WHEN up THEN policy_query WHEN p_target = 'web' THEN s END AS p_query FROM (
      SELECT *, CASE WHEN target = 'web' AND NOT can_search THEN 'internal' WHEN up THEN 'web' ELSE target END AS p_target FROM (
        SELECT *, target IN ('internal', 'none') AND can_search AS up FROM proposal))))""")

add("query_words", f"""SELECT doc_id, CAST(len({TOKENS.format(t='text')}) AS BIGINT) AS n_words,
  COALESCE(array_to_string(list_sort({TOKENS.format(t='text')}), ' '), '') AS words,
  COALESCE(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b'))), ' '), '') AS years,
  COALESCE(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'))), ' '), '') AS dates FROM documents""")
CTE["canonical"] = """
  SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN
      lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')) ||
      CASE WHEN rtrim(regexp_extract(u, '^[^:]+://[^/?#]+([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(u, '^[^:]+://[^/?#]+([^?#]*)', 1), '/') END
      || CASE WHEN length(regexp_extract(u, '^[^?#]*([?][^#]*)', 1)) > 1 THEN regexp_extract(u, '^[^?#]*([?][^#]*)', 1) ELSE '' END
    ELSE NULLIF(u, '') END AS canonical_url FROM (SELECT page_id, trim(url) AS u FROM pages)"""
add("url_canonical", "SELECT page_id, canonical_url FROM canonical")


def _plain(x: str) -> str:
    x = f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
    return f"trim(regexp_replace({x}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


_BODY = "html"
for _tag in ("script", "style", "nav", "footer", "header", "noscript", "svg"):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_BODY = _plain(f"regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[!/?a-zA-Z][^>]*>', ' ', 'g')")
CTE["page_plain"] = f"""SELECT page_id AS doc_id, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_BODY} AS body FROM pages"""
add("page_text", "SELECT *, CASE WHEN body = '' THEN 'empty_page' ELSE 'fetched' END AS fetch_status FROM page_plain")
add("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")

CTE["doc_words"] = f"SELECT doc_id, {TOKENS.format(t='''(split_part(text, chr(10), 1) || ' ' || text)''')} AS has, split_part(text, chr(10), 1) AS title FROM documents"
CTE["bench_query"] = f"""
  SELECT text AS query, w AS terms, list_sort(list_filter(w, lambda x: length(x) >= 6))[1] AS anchor
  FROM (SELECT DISTINCT text, {TOKENS.format(t='text')} AS w FROM benchmark)"""
add("corpus_search", """
  SELECT md5(query) AS search_key, ROW_NUMBER() OVER (PARTITION BY query ORDER BY raw_rank) AS search_rank, doc_id FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY query, CASE WHEN tk = '' THEN CAST(doc_id AS VARCHAR) ELSE tk END ORDER BY raw_rank) AS dup FROM (
      SELECT query, doc_id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS tk,
             ROW_NUMBER() OVER (PARTITION BY query ORDER BY len(list_intersect(terms, has)) DESC, doc_id) AS raw_rank
      FROM bench_query JOIN doc_words ON CASE WHEN anchor IS NULL THEN len(list_intersect(terms, has)) > 0 ELSE list_contains(has, anchor) END)) WHERE dup = 1
  QUALIFY search_rank <= 5""")

CTE["place_words"] = f"""
  SELECT p.doc_id, c.canonical_url AS source_url, p.title, {TOKENS.format(t='''(p.title || ' ' || p.body || ' ' || r_name || ' ' || ['storm', 'rainfall', 'price', 'notice'][p.doc_id % 4 + 1])''')} AS has
  FROM page_plain p JOIN canonical c ON c.page_id = p.doc_id JOIN region ON r_regionkey = p.doc_id % 5"""
CTE["web_search"] = f"""
  SELECT kpi, region, window_start, retrieval_query, {TOKENS.format(t='retrieval_query')} AS terms, {TOKENS.format(t='region')} AS anchor_words
  FROM plan WHERE retrieval_target = 'web'"""
CTE["raw_hits"] = f"""
  SELECT * FROM (SELECT s.kpi, s.region, s.window_start, s.retrieval_query, d.doc_id, d.source_url, d.title,
      trim(regexp_replace(lower(d.title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS tk,
      ROW_NUMBER() OVER (PARTITION BY s.kpi, s.region, s.window_start ORDER BY len(list_intersect(s.terms, d.has)) DESC, d.doc_id) AS raw_rank
    FROM web_search s JOIN place_words d ON list_has_all(d.has, s.anchor_words))"""
CTE["walk"] = f"""
  SELECT {K}, CAST(0 AS BIGINT) AS step_no, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS titles, CAST([] AS BIGINT[]) AS docs FROM web_search
  UNION ALL
  SELECT w.kpi, w.region, w.window_start, h.raw_rank,
         CASE WHEN list_contains(urls, source_url) OR (tk <> '' AND list_contains(titles, tk)) THEN urls ELSE list_append(urls, source_url) END,
         CASE WHEN list_contains(urls, source_url) OR (tk <> '' AND list_contains(titles, tk)) THEN titles ELSE list_append(titles, tk) END,
         CASE WHEN list_contains(urls, source_url) OR (tk <> '' AND list_contains(titles, tk)) THEN docs ELSE list_append(docs, doc_id) END
  FROM walk w JOIN raw_hits h ON h.kpi = w.kpi AND h.region = w.region AND h.window_start = w.window_start AND h.raw_rank = w.step_no + 1"""
CTE["sources"] = f"""
  SELECT h.*, list_position(docs, h.doc_id) AS source_index FROM raw_hits h
  JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY step_no DESC) AS rn FROM walk) w ON {same('w', 'h')} AND w.rn = 1
  WHERE list_contains(docs[1:5], h.doc_id)"""
add("retrieved_sources", f"SELECT {K}, source_index, doc_id, source_url FROM sources")

CTE["hypo"] = f"SELECT c.kpi, c.region, c.window_start, c.driver AS hypothesis, c.component FROM cands c JOIN web_search w ON {same('c', 'w')}"
CTE["assess"] = f"""
  SELECT s.kpi, s.region, s.window_start, s.source_index, h.hypothesis, h.component,
         CASE WHEN (s.doc_id + length(h.hypothesis)) % 5 <> 0 THEN LEAST(1.0, GREATEST(-0.5, ((s.doc_id * 7 + length(h.hypothesis) + 1) % 40) / 20.0 - 0.75)) ELSE 0.0 END AS support,
         CASE WHEN (s.doc_id + length(h.hypothesis)) % 5 <> 0 THEN LEAST(1.0, ((s.doc_id + length(h.hypothesis) + 1) % 13) / 10.0) ELSE 0.0 END AS confidence,
         CASE WHEN (s.doc_id + length(h.hypothesis)) % 5 <> 0 THEN 'word overlap' ELSE 'assessment missing from model output' END AS reason
  FROM sources s JOIN hypo h ON {same('s', 'h')}"""
CTE["backing"] = f"""
  SELECT *, LEAST(1.0, GREATEST(-0.5, mean)) AS weighted_support, trust AS retrieval_confidence, LEAST(1.0, GREATEST(-0.5, mean * trust)) AS effective_support
  FROM (SELECT {K}, hypothesis, component, COUNT(*) AS n_sources_scored,
          CASE WHEN SUM(confidence) > 1e-12 THEN SUM(support * confidence) / SUM(confidence) ELSE 0.0 END AS mean,
          LEAST(1.0, SUM(confidence) / GREATEST(1, LEAST(2, COUNT(*)))) AS trust FROM assess GROUP BY ALL)"""
CTE["fused"] = f"""
  SELECT *, CASE WHEN hit AND SUM(CASE WHEN hit THEN softmax_probability ELSE 0.0 END) OVER w > 0 AND SUM(CASE WHEN hit THEN raw ELSE 0.0 END) OVER w > 0
      THEN raw * SUM(CASE WHEN hit THEN softmax_probability ELSE 0.0 END) OVER w / SUM(CASE WHEN hit THEN raw ELSE 0.0 END) OVER w
      ELSE softmax_probability END AS fused_probability
  FROM (SELECT e.*, COALESCE(b.effective_support, 0.0) AS retrieval_support, abs(COALESCE(b.effective_support, 0.0)) > 1e-12 AS hit,
          e.softmax_probability * (1 + 0.25 * COALESCE(b.effective_support, 0.0)) AS raw
        FROM evidence e LEFT JOIN backing b ON {same('e', 'b')} AND b.component = e.component AND b.hypothesis = e.driver)
  WINDOW w AS (PARTITION BY {K})"""
add("assessment_cleanup", f"SELECT {K}, source_index, hypothesis, reason, {nums('support confidence')} FROM assess")
add("support_aggregate", f"SELECT {K}, hypothesis, n_sources_scored, {nums('weighted_support retrieval_confidence effective_support')} FROM backing")
add("single_hypothesis_support", f"SELECT {K}, {nums('support confidence')} FROM (SELECT *, effective_support AS support, retrieval_confidence AS confidence FROM backing WHERE hypothesis = 'competitor_price_index')")
add("fusion_reweight", f"SELECT {K}, component, driver, {nums('softmax_probability:5 fused_probability:5 retrieval_support')} FROM fused")
add("fusion_updates", f"""SELECT {K}, component, driver, retrieval_query, {nums('probability_before:5 retrieval_support probability_after:5')}
  FROM (SELECT f.*, f.softmax_probability AS probability_before, f.fused_probability AS probability_after, w.retrieval_query
        FROM fused f JOIN web_search w ON {same('f', 'w')})""")
add("driver_probabilities", f"SELECT {K}, driver, {nums('probability', 5)} FROM (SELECT {K}, driver, MAX(softmax_probability) AS probability FROM evidence GROUP BY ALL)")
add("stage4_status", f"""
  SELECT g.kpi, g.region, g.window_start, g.clarification_needed, CASE WHEN NOT g.clarification_needed THEN 'deterministic_only'
    WHEN p.retrieval_target = 'internal' THEN 'clarification_internal' WHEN p.retrieval_target <> 'web' THEN 'clarification_abstained'
    WHEN COALESCE(b.effect, 0) > 1e-12 THEN 'retrieval_fused' ELSE 'retrieval_no_effective_support' END AS status
  FROM gates g LEFT JOIN plan p ON {same('p', 'g')}
  LEFT JOIN (SELECT {K}, MAX(abs(effective_support)) AS effect FROM backing GROUP BY ALL) b ON {same('b', 'g')}""")
