"""Checking SQL (DuckDB) for the registered queries, written independently of the Spark code."""

from __future__ import annotations

# What the texts are searched for, written out here so that a slip in the code shows.
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"(\+\d{1,3}[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
SKILL_KEYWORDS = (
    "python", "java", "javascript", "typescript", "c++", "c#", "sql",
    "react", "angular", "vue", "node.js", "django", "flask", "fastapi",
    "aws", "azure", "gcp", "docker", "kubernetes", "terraform",
    "machine learning", "deep learning", "data science", "ai",
    "project management", "agile", "scrum", "communication",
    "leadership", "teamwork", "problem solving",
    "excel", "tableau", "power bi", "git", "ci/cd",
)

ORACLES: dict[str, str] = {}

EMAIL = f"nullif(regexp_extract(text, '{EMAIL_PATTERN}'), '')"
PHONE = (
    f"regexp_replace(list_filter(regexp_extract_all(text, '{PHONE_PATTERN}'), "
    r"lambda r: length(regexp_replace(r, '\D', '', 'g')) >= 10)[1], '^\s+|\s+$', '', 'g')"
)
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
HALF_UP = "floor(({0}) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE)"
CENTS_MEAN = (
    "CAST(sum(CAST(floor({0} * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE)"
    " / nullif(count({0}), 0) / CAST(100 AS DOUBLE)"
)
DIGITS10 = (
    r"nullif(CASE WHEN length(regexp_replace({0}, '\D', '', 'g')) >= 10"
    r" THEN right(regexp_replace({0}, '\D', '', 'g'), 10) ELSE regexp_replace({0}, '\D', '', 'g') END, '')"
)

_VIEWS = {
    "candidates": f"""
      SELECT b.id, concat(split_part(b.flat, ' ', 1), ' ', split_part(b.flat, ' ', 2)) AS name,
             {EMAIL} AS email, {PHONE} AS phone, CASE WHEN b.id % 29 = 0 THEN '' ELSE b.text END AS text_content,
             concat('doc_', CAST(b.id AS VARCHAR), '.pdf') AS source_file,
             CASE b.id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'upload' ELSE 'manual' END AS source_type,
             CASE WHEN b.id % 58 = 0 THEN '' ELSE concat_ws(',', CASE WHEN b.flat LIKE '% the %' THEN 'The' END, CASE WHEN b.flat LIKE '% of %' THEN 'of' END,
                       CASE WHEN b.flat LIKE '% la %' THEN 'LA' END, CASE WHEN b.flat LIKE '% und %' THEN 'und' END) END AS skills,
             CASE WHEN b.n_chars % 37 <> 0 THEN CAST(b.n_chars % 16 AS INT) END AS experience_years,
             b.first_id <> b.id AS is_duplicate,
             CASE WHEN b.first_id <> b.id THEN b.first_id END AS duplicate_of,
             CASE WHEN b.first_id <> b.id THEN CAST(1 AS DOUBLE) END AS duplicate_confidence,
             e.ts AS created_at, v.embedding AS profile_embedding
      FROM (SELECT doc_id AS id, replace(text, chr(10), ' ') AS flat, text, n_chars,
                   min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) b
      LEFT JOIN events e ON e.event_id = b.id * 5
      LEFT JOIN embeddings v ON v.vec_id = b.id""",
    "jds": """
      SELECT b.item_id AS id, concat('Role ', CAST(b.item_id AS VARCHAR)) AS title,
             CASE WHEN b.item_id % 13 = 12 THEN '' ELSE b.text END AS description,
             concat('dept_', CAST(b.item_id % 5 AS VARCHAR)) AS department,
             CASE b.item_id % 3 WHEN 0 THEN 'the, of' WHEN 1 THEN 'La, und, of' ELSE 'The, go' END AS required_skills,
             CAST(b.item_id % 8 AS INT) AS required_experience_min,
             CASE WHEN b.item_id % 4 = 0 THEN NULL ELSE CAST(b.item_id % 8 + 5 AS INT) END AS required_experience_max,
             CASE b.item_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'closed' ELSE 'on_hold' END AS status,
             CASE b.item_id % 3
               WHEN 0 THEN '{"semantic_weight": 0.7, "skill_weight": 0.3, "experience_weight": 0.0, "min_score_threshold": 10}'
               WHEN 1 THEN '{"semantic_weight": 0.4, "skill_weight": 0.4, "experience_weight": 0.2, "min_score_threshold": 10, "longlist_percentage": 0.29}'
               ELSE '{}' END AS matching_config,
             v.embedding AS jd_embedding
      FROM benchmark b LEFT JOIN embeddings v ON v.vec_id = b.item_id""",
    "vocabulary": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{k.title()}')" for k in SKILL_KEYWORDS) + ") AS t(term, shown)",
    "listed": r"""
      SELECT id, s.item AS skill FROM jds, LATERAL (SELECT regexp_replace(unnest(string_split(replace(required_skills, chr(10), ','), ',')),
             '^\s+|\s+$', '', 'g') AS item) s WHERE s.item <> ''""",
    "wanted": """
      SELECT id, list_sort(list(DISTINCT skill)) AS wanted FROM (
        SELECT id, skill FROM listed
        UNION ALL SELECT j.id, v.shown FROM jds j JOIN vocabulary v ON contains(lower(j.description), v.term)) GROUP BY id""",
    "cfg": """
      SELECT id, coalesce(CAST(json_extract(matching_config, '$.semantic_weight') AS DOUBLE), CAST(0.7 AS DOUBLE)) AS semantic_weight,
             coalesce(CAST(json_extract(matching_config, '$.skill_weight') AS DOUBLE), CAST(0.3 AS DOUBLE)) AS skill_weight,
             coalesce(CAST(json_extract(matching_config, '$.experience_weight') AS DOUBLE), CAST(0 AS DOUBLE)) AS experience_weight,
             coalesce(CAST(json_extract(matching_config, '$.min_score_threshold') AS DOUBLE), CAST(50 AS DOUBLE)) AS min_score_threshold,
             coalesce(CAST(json_extract(matching_config, '$.longlist_percentage') AS DOUBLE), CAST(0.5 AS DOUBLE)) AS longlist_percentage,
             coalesce(CAST(json_extract(matching_config, '$.shortlist_percentage') AS DOUBLE), CAST(0.2 AS DOUBLE)) AS shortlist_percentage
      FROM jds""",
    "people": r"""
      SELECT id, experience_years, text_content <> '' AS has_text, concat(text_content, skills) <> '' AS has_profile, CAST(profile_embedding AS DOUBLE[]) AS v,
             list_sort(list_distinct(list_filter(list_transform(string_split(replace(skills, chr(10), ','), ','),
               lambda s: lower(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> ''))) AS offered
      FROM candidates WHERE NOT is_duplicate""",
    "pairs": """
      SELECT *, CASE WHEN has_text AND described THEN raw_score ELSE CAST(0 AS DOUBLE) END AS semantic_score FROM (
      SELECT c.has_text, c.has_profile, j.description <> '' AS described, j.id AS job_description_id, c.id AS candidate_id, c.offered, c.experience_years AS years,
             w.wanted, list_distinct(list_transform(w.wanted, lambda s: lower(s))) AS keys,
             j.required_experience_min AS lo, j.required_experience_max AS hi, g.* EXCLUDE (id),
             floor(coalesce(CASE WHEN isfinite(list_cosine_similarity(c.v, CAST(j.jd_embedding AS DOUBLE[])))
               THEN list_cosine_similarity(c.v, CAST(j.jd_embedding AS DOUBLE[])) END, 0)
               * CAST(100000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS raw_score
      FROM people c CROSS JOIN jds j LEFT JOIN wanted w ON w.id = j.id JOIN cfg g ON g.id = j.id)""",
    "scores": f"""
      SELECT *, {HALF_UP.format('''CASE WHEN semantic_weight + skill_weight + experience_weight = 0 THEN CAST(0 AS DOUBLE) ELSE
               (semantic_score * semantic_weight + skill_match_score * skill_weight + experience_score * experience_weight)
               / (semantic_weight + skill_weight + experience_weight) END''')} AS final_score
      FROM (SELECT *, CASE WHEN len(keys) = 0 THEN CAST(0 AS DOUBLE)
                 ELSE CAST(len(list_intersect(keys, offered)) AS DOUBLE) / CAST(len(keys) AS DOUBLE) * CAST(100 AS DOUBLE) END AS skill_match_score,
               CAST(CASE WHEN lo IS NULL THEN 0 WHEN years < lo THEN greatest(0, 100 - (lo - years) * 20)
                 WHEN hi <> 0 AND years > hi THEN greatest(0, 100 - (years - hi) * 5) ELSE 100 END AS DOUBLE) AS experience_score,
               CASE WHEN lo IS NULL THEN 0 WHEN years < lo THEN lo - years WHEN hi <> 0 AND years > hi THEN years - hi ELSE 0 END AS experience_gap,
               nullif(array_to_string(list_filter(wanted, lambda s: list_contains(offered, lower(s))), ', '), '') AS matched_skills,
               nullif(array_to_string(list_filter(wanted, lambda s: NOT list_contains(offered, lower(s))), ', '), '') AS missing_skills
            FROM pairs)""",
    "ranked": """
      SELECT *, row_number() OVER (PARTITION BY job_description_id ORDER BY final_score DESC, candidate_id) AS rank_position,
             count(*) OVER (PARTITION BY job_description_id) AS n FROM scores
      WHERE NOT (years IS NULL AND lo IS NOT NULL)""",
    "results": """
      SELECT r.job_description_id, r.candidate_id, r.rank_position, r.final_score, r.semantic_score, r.skill_match_score,
             r.experience_score, r.experience_gap, r.matched_skills, r.missing_skills,
             r.rank_position <= CAST(trunc(r.n * r.longlist_percentage) AS BIGINT) AND r.final_score >= r.min_score_threshold AS in_longlist,
             r.rank_position <= CAST(trunc(r.n * r.shortlist_percentage) AS BIGINT) AND r.final_score >= r.min_score_threshold AS in_shortlist,
             CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 AND r.candidate_id % 10 = 0 THEN 'hired'
                  WHEN l.quality = 1 THEN 'reviewed' ELSE 'pending' END AS status,
             TIMESTAMP '2024-01-01 12:00:00' + INTERVAL 1 DAY * (r.job_description_id % 28) AS screened_at
      FROM ranked r LEFT JOIN labels l ON l.doc_id = r.candidate_id""",
    "history": f"""
      SELECT job_description_id, (SELECT count(*) FROM people)::INT AS total_candidates,
             count_if(in_longlist)::INT AS longlist_count, count_if(in_shortlist)::INT AS shortlist_count,
             {HALF_UP.format(CENTS_MEAN.format('final_score'))} AS avg_score, max(final_score) AS max_score, min(final_score) AS min_score,
             max(screened_at) AS executed_at
      FROM results GROUP BY job_description_id""",
    "eligible": """
      SELECT s.job_description_id, s.candidate_id, s.raw_score AS score, c.created_at, s.lo, s.years,
             list_sort(list_distinct((SELECT list(lower(skill)) FROM listed x WHERE x.id = s.job_description_id))) AS asked, s.offered
      FROM pairs s JOIN candidates c ON c.id = s.candidate_id
      WHERE s.raw_score >= 10 AND s.has_profile AND s.described AND (coalesce(s.lo, 0) <= 0 OR s.years >= s.lo)
        AND s.candidate_id NOT IN (SELECT candidate_id FROM results WHERE status = 'rejected')""",
    "placed": """
      SELECT *, row_number() OVER (PARTITION BY job_description_id ORDER BY score DESC, created_at DESC NULLS LAST, candidate_id) AS rank_position
      FROM eligible""",
    "recs": "SELECT * FROM placed WHERE rank_position <= 10",
}

REASON = """concat_ws('; ',
  CASE WHEN coalesce({lo}, 0) <> 0 AND {years} >= {lo} THEN concat('Has ', {years}, ' years of experience (required: ', {lo}, '+)')
       WHEN coalesce({lo}, 0) <> 0 THEN concat('Experience gap of ', {lo} - {years}, ' years') END,
  CASE WHEN len(list_intersect({asked}, {offered})) > 0 THEN concat('Matching skills: ',
       array_to_string(list_sort(list_intersect({asked}, {offered}))[1:3], ', ')) END,
  CASE WHEN {score} >= 80 THEN 'Excellent semantic profile match' WHEN {score} >= 60 THEN 'Good profile alignment'
       ELSE 'Partial profile match' END)"""

_NEEDS = {
    "candidates": [], "jds": [], "vocabulary": [], "listed": ["jds"], "wanted": ["listed", "vocabulary"], "cfg": ["jds"],
    "people": ["candidates"], "pairs": ["people", "wanted", "cfg"], "scores": ["pairs"], "ranked": ["scores"],
    "results": ["ranked"], "history": ["results"], "eligible": ["results", "listed"], "placed": ["eligible"], "recs": ["placed"],
}


def with_views(names: str, body: str) -> str:
    """``body`` behind the named views and whatever they build on."""
    chosen: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS[name]:
            need(other)
        if name not in chosen:
            chosen.append(name)

    for name in names.split():
        need(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({_VIEWS[n]})" for n in chosen) + "\n" + body


def oracle(name: str, views: str, body: str) -> None:
    ORACLES[name] = with_views(views, body) if views else body


oracle("screen_all_scores", "results", "SELECT * EXCLUDE (status, screened_at) FROM results")
oracle("screen_shortlist", "results", """
  SELECT r.job_description_id, r.candidate_id, r.rank_position, c.name, c.email, c.experience_years, r.final_score,
         r.semantic_score, r.skill_match_score, r.matched_skills, r.missing_skills
  FROM results r JOIN candidates c ON c.id = r.candidate_id WHERE r.in_shortlist""")
oracle("screen_longlist", "results", """
  SELECT r.job_description_id, r.candidate_id, r.rank_position, c.name, c.email, c.experience_years, r.final_score,
         r.matched_skills, r.missing_skills, r.status
  FROM results r JOIN candidates c ON c.id = r.candidate_id WHERE r.in_longlist""")
oracle("screen_run_history", "history", "SELECT * FROM history")
oracle("results_by_status", "results", """
  SELECT job_description_id, status, count(*) AS rows, max(final_score) AS best FROM results GROUP BY ALL""")
oracle("score_histogram", "results", """
  SELECT job_description_id, bin, count(*) AS candidates, CAST(bin AS DOUBLE) * 5 AS bin_start FROM (
    SELECT job_description_id, CAST(least(19, greatest(0, floor(final_score / CAST(5 AS DOUBLE)))) AS INT) AS bin FROM results)
  GROUP BY job_description_id, bin""")
oracle("jd_skills", "wanted", """
  SELECT id AS job_description_id, array_to_string(wanted, '|') AS skills,
         CAST(len(list_distinct(list_transform(wanted, lambda s: lower(s)))) AS INT) AS n_skills FROM wanted""")
oracle("config_weights", "cfg", "SELECT * FROM cfg")
oracle("skill_match", "results",
       "SELECT job_description_id, candidate_id, skill_match_score, matched_skills, missing_skills FROM results")
oracle("experience_score", "results", """
  SELECT job_description_id, experience_gap, experience_score, count(*) AS candidates FROM results GROUP BY ALL""")
oracle("semantic_scores", "pairs", "SELECT job_description_id, candidate_id, raw_score AS semantic_score FROM pairs")
_REC = REASON.format(lo="lo", years="years", asked="asked", offered="offered", score="score")
oracle("recommend_topn", "recs", f"""
  SELECT job_description_id, candidate_id, CAST(rank_position AS INT) AS rank_position, score AS recommendation_score,
         {_REC} AS match_reasoning FROM recs""")
oracle("recommendation_list", "recs", f"""
  SELECT r.job_description_id, r.candidate_id, {HALF_UP.format('r.score')} AS score, c.name, c.email, c.experience_years, c.skills
  FROM recs r JOIN candidates c ON c.id = r.candidate_id""")
oracle("recommend_new_only", "recs", f"""
  SELECT job_description_id, candidate_id, {HALF_UP.format('score')} AS score FROM placed
  WHERE rank_position <= 20 AND (job_description_id, candidate_id) NOT IN (SELECT job_description_id, candidate_id FROM recs)""")
oracle("match_reasoning", "pairs", f"""
  SELECT job_description_id, candidate_id, {REASON.format(lo='lo', years='years', asked='asked', offered='offered', score='semantic_score')} AS match_reasoning
  FROM pairs JOIN (SELECT id, list_sort(list(DISTINCT lower(skill))) AS asked FROM listed GROUP BY id) a ON a.id = job_description_id
  WHERE NOT (years IS NULL AND lo IS NOT NULL)""")

_OURS = "FROM candidates WHERE NOT is_duplicate"
oracle("candidates_total", "candidates jds", f"""
  SELECT count(*) AS total_candidates, (SELECT count_if(status = 'active')::BIGINT FROM jds) AS active_jobs {_OURS}""")
oracle("candidates_last_n_days", "candidates", f"SELECT count(*) AS candidates {_OURS} AND created_at >= {AS_OF} - INTERVAL 14 DAY")
oracle("candidates_by_source", "candidates", f"SELECT source_type, count(*) AS candidates {_OURS} GROUP BY source_type")
oracle("duplicate_rate", "candidates", """
  SELECT coalesce(CAST(count_if(is_duplicate) AS DOUBLE) / nullif(count(*), 0) * CAST(100 AS DOUBLE), 0) AS duplicate_rate FROM candidates""")
_MEAN = HALF_UP.format(CENTS_MEAN.format("final_score"))
oracle("screening_stats", "history", f"""
  SELECT (SELECT count(*) FROM history) AS screening_runs, count(DISTINCT candidate_id) AS candidates_screened,
         coalesce({_MEAN}, 0) AS avg_score, count_if(in_shortlist)::BIGINT AS shortlisted FROM results""")
_STAGES = """count(DISTINCT candidate_id) AS screened, count_if(in_longlist)::BIGINT AS longlisted,
         count_if(in_shortlist)::BIGINT AS shortlisted, count_if(status IN ('reviewed', 'rejected', 'hired'))::BIGINT AS reviewed,
         count_if(status = 'hired')::BIGINT AS hired"""
oracle("funnel_overall", "results", f"SELECT (SELECT count(*) {_OURS}) AS total_cvs, {_STAGES} FROM results")
oracle("funnel_by_jd", "results", f"""
  SELECT job_description_id, (SELECT count(*) {_OURS}) AS total_cvs, {_STAGES} FROM results GROUP BY job_description_id""")
oracle("jd_summary", "results", f"""
  SELECT j.title AS job_title, j.id AS job_id, count(r.candidate_id) AS total_screened,
         count(CASE WHEN r.in_shortlist THEN 1 END) AS shortlisted, count(CASE WHEN r.in_longlist THEN 1 END) AS longlisted,
         {CENTS_MEAN.format('r.final_score')} AS avg_score, max(r.screened_at) AS last_screened
  FROM jds j LEFT JOIN results r ON r.job_description_id = j.id WHERE j.status = 'active' GROUP BY j.id, j.title""")
oracle("runs_with_titles", "history", """
  SELECT h.job_description_id, j.title, j.department, h.shortlist_count, h.executed_at
  FROM history h JOIN jds j ON j.id = h.job_description_id""")
oracle("daily_candidates", "candidates", f"""
  SELECT CAST(created_at AS DATE) AS day, count(*) AS candidates {_OURS} AND created_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""")
oracle("daily_screenings", "history", f"""
  SELECT CAST(executed_at AS DATE) AS day, count(*) AS screenings, {CENTS_MEAN.format('avg_score')} AS avg_score
  FROM history WHERE executed_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""")
oracle("recent_activity", "history", f"""
  SELECT * FROM (
    (SELECT 'candidate_added' AS activity_type, name AS title, created_at AS happened_at, source_type AS details, id AS ref
     {_OURS} ORDER BY created_at DESC NULLS LAST, id LIMIT 10)
    UNION ALL
    (SELECT 'screening_completed', j.title, h.executed_at, concat(h.shortlist_count, ' shortlisted'), h.job_description_id
     FROM history h JOIN jds j ON j.id = h.job_description_id ORDER BY h.executed_at DESC, h.job_description_id LIMIT 10))
  ORDER BY happened_at DESC, activity_type, ref LIMIT 10""")
_RATE = "coalesce(CAST(count_if(is_duplicate) AS DOUBLE) / nullif(count(*), 0) * CAST(100 AS DOUBLE), 0)"
_KPI = f"""
  SELECT p.*, s.*, (SELECT count(*) FROM history) AS screening_runs FROM (
    SELECT count_if(NOT is_duplicate)::BIGINT AS total_candidates,
           count_if(NOT is_duplicate AND created_at >= {AS_OF} - INTERVAL 30 DAY)::BIGINT AS candidates_this_month,
           count_if(NOT is_duplicate AND created_at >= {AS_OF} - INTERVAL 7 DAY)::BIGINT AS candidates_this_week,
           {HALF_UP.format(_RATE)} AS duplicate_rate FROM candidates) p,
   (SELECT {_STAGES}, coalesce({_MEAN}, 0) AS avg_score FROM results) s"""
oracle("kpi_row", "history", _KPI)
oracle("kpi_from_rollups", "history", _KPI)
oracle("trends_from_rollups", "history", f"""
  SELECT * FROM (
    SELECT CAST(created_at AS DATE) AS day, count(*) AS candidates {_OURS} AND created_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1)
  FULL JOIN (
    SELECT CAST(executed_at AS DATE) AS day, count(*) AS screenings, {CENTS_MEAN.format('avg_score')} AS avg_score
    FROM history WHERE executed_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1) USING (day)""")
oracle("exported_summary", "history", f"""
  SELECT total_candidates AS "Total Candidates", candidates_this_month AS "Candidates This Month", duplicate_rate AS "Duplicate Rate",
         screened AS "Screened Candidates", shortlisted AS "Shortlisted", avg_score AS "Average Score" FROM ({_KPI})""")
oracle("metric_log", "history", f"""
  SELECT metric_name, 'dashboard' AS metric_category, metric_value, metric_data, {AS_OF} AS calculated_at FROM (
    SELECT concat('{{"screened":', screened, ',"hired":', hired, '}}') AS metric_data,
           unnest([total_candidates::DOUBLE, candidates_this_month::DOUBLE, candidates_this_week::DOUBLE, duplicate_rate,
                   longlisted::DOUBLE, shortlisted::DOUBLE, reviewed::DOUBLE, avg_score, screening_runs::DOUBLE]) AS metric_value,
           unnest(['total_candidates', 'candidates_this_month', 'candidates_this_week', 'duplicate_rate', 'longlisted',
                   'shortlisted', 'reviewed', 'avg_score', 'screening_runs']) AS metric_name
    FROM ({_KPI}))""")
oracle("candidate_search", "candidates", """
  SELECT id, name, email, source_type, is_duplicate, experience_years, created_at FROM candidates
  WHERE name ILIKE '%an%' AND source_type = 'email' ORDER BY created_at DESC NULLS LAST, id LIMIT 100""")
oracle("search_summary", "candidates", """
  SELECT count(*) AS found, CAST(sum(coalesce(experience_years, 0)) AS DOUBLE) / count(*) AS avg_experience,
         count_if(email <> '')::BIGINT AS with_email, count_if(is_duplicate)::BIGINT AS duplicates
  FROM candidates WHERE name ILIKE '%e%'""")
oracle("jd_search", "jds", """
  SELECT id, title, department, status, required_skills FROM jds WHERE title ILIKE '%ROLE 1%' AND status = 'active'""")
oracle("active_candidates", "candidates", f"""
  SELECT id, name, email, phone, skills, experience_years, source_type, created_at {_OURS}""")
oracle("duplicate_report", "candidates", """
  SELECT a.id AS duplicate_id, a.name AS duplicate_name, a.email AS duplicate_email, b.id AS original_id, b.name AS original_name,
         b.email AS original_email, a.duplicate_confidence, a.created_at AS duplicate_created_at
  FROM candidates a JOIN candidates b ON a.duplicate_of = b.id WHERE a.is_duplicate""")
oracle("mail_log_summary", "", """
  SELECT count(*) AS emails_checked, sum(n)::BIGINT AS resumes_found, sum(a)::BIGINT AS resumes_saved,
         count_if(conv_id % 11 = 0)::BIGINT AS failed
  FROM (SELECT conv_id, count(*) AS n, count_if(role = 'assistant') AS a FROM conversations GROUP BY conv_id)""")

oracle("extract_email", "", f"SELECT doc_id, {EMAIL} AS email FROM documents")
oracle("extract_phone", "", f"SELECT doc_id, {PHONE} AS phone FROM documents")
oracle("extract_experience", "", r"""
  SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(lower(concat(text, ' ', doc_id % 30, '+ Years, 3 years')),
         '(\d+)\+?\s*years?', 1), lambda n: TRY_CAST(n AS INT))), 0) AS experience_years FROM documents""")
oracle("keyword_skills", "vocabulary", """
  SELECT doc_id, coalesce(string_agg(shown, '|' ORDER BY shown), '') AS skills, CAST(count(shown) AS INT) AS n_skills
  FROM documents LEFT JOIN vocabulary ON contains(lower(text), term) GROUP BY doc_id""")
oracle("keyword_skills_whole_words", "vocabulary", r"""
  SELECT doc_id, coalesce(string_agg(shown, '|' ORDER BY shown), '') AS skills
  FROM documents LEFT JOIN vocabulary
    ON regexp_matches(lower(text), concat('(^|[^a-z0-9])', regexp_escape(term), '($|[^a-z0-9])')) GROUP BY doc_id""")
oracle("normalize_phone", "candidates", f"""
  SELECT id, phone, {DIGITS10.format('phone')} AS phone_key FROM candidates WHERE phone IS NOT NULL""")
oracle("stored_file_names", "candidates", r"""
  SELECT id, concat(regexp_replace(regexp_replace(concat(name, ' cv!'), '[^\p{L}\p{N} _-]', '', 'g'), '^\s+|\s+$', '', 'g'),
         '_20240131_000000_', substr(md5(CAST(id AS VARCHAR)), 1, 8), '.pdf') AS file_name, concat('Doc ', id) AS fallback_name FROM candidates""")

oracle("upsert_overlay", "recs", f"""
  SELECT job_description_id * 1000 + rank_position AS id, job_description_id, candidate_id, score >= 30 AS was_contacted,
         CASE WHEN score >= 30 THEN {AS_OF} END AS contacted_at FROM recs""")
oracle("delete_cascade", "results", """
  SELECT job_description_id, count(*) AS rows, max(final_score) AS best FROM results
  WHERE job_description_id NOT IN (SELECT id FROM jds WHERE status = 'closed') GROUP BY job_description_id""")
oracle("unique_violations", "candidates", """
  SELECT name, count(*) AS rows FROM candidates WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1""")
oracle("fk_violations", "results", """
  SELECT 'result' AS row, candidate_id, count(*) AS rows FROM results
  WHERE candidate_id NOT IN (SELECT id FROM candidates WHERE source_type <> 'manual') GROUP BY candidate_id
  UNION ALL SELECT 'copy', id, 1 FROM candidates WHERE source_type <> 'manual'
    AND duplicate_of NOT IN (SELECT id FROM candidates WHERE source_type <> 'manual')""")
oracle("table_scan", "candidates", """
  SELECT id, experience_years, source_type FROM candidates WHERE experience_years >= 10 AND NOT is_duplicate""")
oracle("row_by_id", "candidates", "SELECT id, name, source_file FROM candidates WHERE id = 7")
oracle("bound_sql", "candidates", """
  SELECT source_type, count(*) AS rows, max(id) AS last FROM candidates WHERE experience_years >= 5 GROUP BY source_type""")
oracle("appended_rows", "candidates", "SELECT id, name, email, experience_years, CAST(NULL AS VARCHAR) AS summary FROM candidates")
oracle("replaced_results", "results", """
  SELECT job_description_id, count(*) AS rows, max(final_score) AS best FROM results r
  WHERE job_description_id % 2 = 1 OR in_shortlist
    OR NOT EXISTS (SELECT 1 FROM results x WHERE x.job_description_id = r.job_description_id AND x.in_shortlist) GROUP BY 1""")
oracle("cleared_table", "recs", "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM recs")
oracle("exported_csv", "results", """
  SELECT CAST(r.job_description_id AS VARCHAR) AS job_description_id, CAST(r.candidate_id AS VARCHAR) AS candidate_id, c.name,
         CAST(r.final_score AS VARCHAR) AS final_score, r.matched_skills
  FROM results r JOIN candidates c ON c.id = r.candidate_id WHERE r.in_longlist""")
oracle("screen_errors", "people jds", """
  SELECT j.id AS job_description_id, c.id AS candidate_id, 'experience is unknown' AS error_message
  FROM people c CROSS JOIN jds j WHERE c.experience_years IS NULL AND j.required_experience_min IS NOT NULL""")
oracle("screen_batches", "history jds", """
  SELECT h.job_description_id, substr(sha256(concat(h.job_description_id, '|', strftime(h.executed_at, '%Y-%m-%d %H:%M:%S'))), 1, 8) AS batch_id,
         j.matching_config AS config_snapshot FROM history h JOIN jds j ON j.id = h.job_description_id""")
oracle("screening_candidates", "candidates", """
  SELECT id, name, skills, experience_years, length(text_content) AS n_chars FROM candidates WHERE NOT is_duplicate""")
oracle("recommendation_runs", "recs", """
  SELECT j.id AS job_description_id, CASE WHEN j.description <> '' THEN p.n ELSE 0 END AS evaluated, coalesce(k.n, 0) AS kept,
         CASE WHEN j.description = '' THEN 'vacancy has no description' WHEN p.n = 0 THEN 'no candidates to evaluate'
              WHEN k.n IS NULL THEN 'no candidate reaches the minimum' END AS reason
  FROM jds j LEFT JOIN (SELECT job_description_id, count(*) AS n FROM recs GROUP BY 1) k ON k.job_description_id = j.id
  CROSS JOIN (SELECT count(*) AS n FROM people WHERE has_profile
              AND id NOT IN (SELECT candidate_id FROM results WHERE status = 'rejected')) p""")
oracle("tfidf_scores", "candidates jds", r"""
  , words AS (
    SELECT 'p' AS side, id, unnest(regexp_split_to_array(lower(text_content), '[^\p{L}\p{N}]+')) AS word FROM candidates WHERE NOT is_duplicate
    UNION ALL SELECT 'j', id, unnest(regexp_split_to_array(lower(description), '[^\p{L}\p{N}]+')) FROM jds),
  tf AS (SELECT side, id, word, count(*) AS tf FROM words WHERE word <> '' GROUP BY ALL),
  idf AS (SELECT word, count(*) AS df FROM tf WHERE side = 'p' GROUP BY word),
  w AS (SELECT side, id, tf.word, tf * ln(CAST((SELECT count(*) FROM candidates WHERE NOT is_duplicate) + 1 AS DOUBLE) / (coalesce(df, 0) + 1)) AS w
        FROM tf LEFT JOIN idf USING (word)),
  norm AS (SELECT side, id, sqrt(sum(w * w)) AS n FROM w GROUP BY ALL)
  SELECT b.id AS job_description_id, a.id AS candidate_id,
         floor(sum(a.w * b.w) / (any_value(x.n) * any_value(y.n)) * CAST(100000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS semantic_score
  FROM w a JOIN w b ON a.word = b.word AND a.side = 'p' AND b.side = 'j' JOIN norm x ON x.side = 'p' AND x.id = a.id
  JOIN norm y ON y.side = 'j' AND y.id = b.id WHERE a.w <> 0 AND b.w <> 0 GROUP BY b.id, a.id""")
oracle("encoded_scores", "candidates jds", r"""
  , texts AS (
    SELECT 'p' AS side, id, text_content AS t FROM candidates WHERE NOT is_duplicate UNION ALL SELECT 'j', id, description FROM jds),
  words AS (SELECT side, id, unnest(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+')) AS word FROM texts),
  tf AS (SELECT side, id, CAST('0x' || substr(md5(word), 1, 4) AS BIGINT) AS bucket, count(*) AS tf FROM words WHERE word <> '' GROUP BY ALL),
  seen AS (SELECT bucket, count(*) AS df FROM tf WHERE side = 'p' GROUP BY bucket),
  w AS (
    SELECT side, id, bucket, tf * CAST(floor(ln(CAST((SELECT count(*) FROM texts WHERE side = 'p') + 1 AS DOUBLE) / (coalesce(df, 0) + 1))
           * CAST(1000 AS DOUBLE)) AS BIGINT) AS w FROM tf LEFT JOIN seen USING (bucket)),
  mixed AS (
    SELECT side, id, w, (bucket * factor + shift) % 2147483647 AS h
    FROM w CROSS JOIN (VALUES (48271, 11), (69621, 1013), (16807, 104729), (39373, 15485863)) p(factor, shift)),
  v AS (SELECT side, id, h % 64 AS place, CAST(sum(w * (1 - 2 * (h // 64 % 2))) AS DOUBLE) AS v FROM mixed GROUP BY ALL),
  u AS (SELECT side, id, place, CAST(CAST(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY side, id)), 0) AS FLOAT) AS DOUBLE) AS u FROM v),
  norm AS (SELECT side, id, sqrt(sum(u * u)) AS n FROM u GROUP BY ALL),
  dots AS (SELECT a.id AS c, b.id AS j, sum(a.u * b.u) AS dot FROM u a JOIN u b ON a.place = b.place AND a.side = 'p' AND b.side = 'j' GROUP BY ALL)
  SELECT b.id AS job_description_id, a.id AS candidate_id,
         floor(coalesce(dot / (x.n * y.n), 0) * CAST(100000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS semantic_score
  FROM texts a JOIN texts b ON a.side = 'p' AND b.side = 'j' LEFT JOIN dots ON dots.c = a.id AND dots.j = b.id
  LEFT JOIN norm x ON x.side = 'p' AND x.id = a.id LEFT JOIN norm y ON y.side = 'j' AND y.id = b.id""")
oracle("vacancies_from_forms", "", f"""
  SELECT concat('Role ', CAST(item_id AS VARCHAR)) AS title, CAST(item_id % 8 AS INT) AS required_experience_min,
         CASE WHEN item_id % 3 * 4 > 0 THEN CAST(item_id % 3 * 4 AS INT) END AS required_experience_max,
         CAST(0.5 AS DOUBLE) AS semantic_weight, CAST(0.25 AS DOUBLE) AS shortlist_percentage, {AS_OF} AS created_at
  FROM benchmark WHERE item_id % 7 <> 0 AND text <> ''""")


# Linkage: every pair of names is compared here, by definition, without any blocking

_PERSON = f"""concat(split_part(replace(text, chr(10), ' '), ' ', 1), ' ',
         split_part(replace(text, chr(10), ' '), ' ', 2)) AS name, {EMAIL} AS email, {PHONE} AS phone"""
_VIEWS["arrivals"] = f"""
  SELECT conv_id * 1000 + turn AS id, {_PERSON} FROM conversations
  UNION ALL SELECT * FROM (SELECT doc_id + 1000000000 AS id, {_PERSON} FROM documents) WHERE email IS NOT NULL OR phone IS NOT NULL"""
_NEEDS["arrivals"] = []


def _keys_of(source: str) -> str:
    return rf"""
      SELECT id, name, email, nullif(regexp_replace(lower(email), '^\s+|\s+$', '', 'g'), '') AS email_key,
             {DIGITS10.format('phone')} AS phone_key,
             list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '),
               lambda w: w <> ''))) AS words FROM {source}"""


def _name_scores(left: str, right: str) -> str:
    """(aw, bw, score) of all pairs of distinct names at or over 85."""
    mask = ("coalesce(CAST(list_sum(list_transform(range(length(x)), lambda i: CASE WHEN substr(x, i + 1, 1) = ch "
            "THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT), 0)")
    every = "((CAST(1 AS HUGEINT) << CAST(length(x) AS INT)) - 1)"
    lcs = (f"(length(x) - bit_count(list_reduce([{every}] || list_transform(string_split(y, ''), lambda ch: {mask}), "
           f"lambda s, m: ((s + (s & m)) | (s - (s & m))) & {every}) & {every}))")
    contained = "CAST(200 AS DOUBLE) * length(c) / (length(c) + lead + length({0}))"
    return f"""
      SELECT aw, bw, CAST(round_even(score, 0) AS INT) AS score FROM (
        SELECT aw, bw, CASE WHEN c <> '' AND (x = '' OR y = '') THEN CAST(100 AS DOUBLE) ELSE greatest(
            CASE WHEN levenshtein(x, y) <= 0.156 * total THEN CAST(200 AS DOUBLE) * (lead + {lcs}) / total ELSE 0 END,
            CASE WHEN c <> '' THEN {contained.format('x')} ELSE 0 END, CASE WHEN c <> '' THEN {contained.format('y')} ELSE 0 END) END AS score
        FROM (SELECT *, CASE WHEN c <> '' THEN length(c) + 1 ELSE 0 END AS lead,
                     2 * CASE WHEN c <> '' THEN length(c) + 1 ELSE 0 END + length(x) + length(y) AS total
              FROM (SELECT a.words AS aw, b.words AS bw,
                           array_to_string(list_filter(a.words, lambda w: list_contains(b.words, w)), ' ') AS c,
                           array_to_string(list_filter(a.words, lambda w: NOT list_contains(b.words, w)), ' ') AS x,
                           array_to_string(list_filter(b.words, lambda w: NOT list_contains(a.words, w)), ' ') AS y
                    FROM (SELECT DISTINCT words FROM {left} WHERE len(words) > 0) a,
                         (SELECT DISTINCT words FROM {right} WHERE len(words) > 0) b))) WHERE round_even(score, 0) >= 85"""


_VIEWS["stored_keys"] = _keys_of("candidates WHERE NOT is_duplicate")
_NEEDS["stored_keys"] = ["candidates"]
_VIEWS["batch_keys"] = _keys_of("arrivals")
_NEEDS["batch_keys"] = ["arrivals"]
_VIEWS["all_keys"] = _keys_of("candidates")
_NEEDS["all_keys"] = ["candidates"]
_VIEWS["name_scores"] = _name_scores("batch_keys", "stored_keys")
_NEEDS["name_scores"] = ["batch_keys", "stored_keys"]
_VIEWS["name_hits"] = """
  SELECT id, original, score FROM (
    SELECT k.id, s.id AS original, n.score, row_number() OVER (PARTITION BY k.id ORDER BY n.score DESC, s.id) AS place
    FROM batch_keys k JOIN name_scores n ON n.aw = k.words JOIN stored_keys s ON s.words = n.bw) WHERE place = 1"""
_NEEDS["name_hits"] = ["name_scores"]

for _kind in ("email", "phone"):
    oracle(f"{_kind}_matches", "batch_keys stored_keys", f"""
      SELECT a.id, min(s.id) AS original FROM batch_keys a JOIN stored_keys s ON s.{_kind}_key = a.{_kind}_key GROUP BY a.id""")
oracle("name_matches", "name_hits", "SELECT * FROM name_hits")
oracle("duplicate_decisions", "name_hits", """
  SELECT b.id, coalesce(e.original, p.original, n.original) IS NOT NULL AS is_duplicate,
         coalesce(e.original, p.original, n.original) AS duplicate_of,
         CASE WHEN e.original IS NOT NULL THEN CAST(1 AS DOUBLE) WHEN p.original IS NOT NULL THEN CAST(0.95 AS DOUBLE)
              ELSE n.score / CAST(100 AS DOUBLE) END AS duplicate_confidence,
         CASE WHEN e.original IS NOT NULL THEN concat('Exact Email Match (', s.email, ')')
              WHEN p.original IS NOT NULL THEN concat('Phone Match (', s.name, ')')
              WHEN n.original IS NOT NULL THEN concat('Name Similarity ', n.score, '% (', s.name, ')') ELSE 'Unique' END AS reason
  FROM batch_keys b
  LEFT JOIN (SELECT x.id, min(y.id) AS original FROM batch_keys x JOIN stored_keys y USING (email_key) GROUP BY x.id) e ON e.id = b.id
  LEFT JOIN (SELECT x.id, min(y.id) AS original FROM batch_keys x JOIN stored_keys y USING (phone_key) GROUP BY x.id) p ON p.id = b.id
  LEFT JOIN name_hits n ON n.id = b.id
  LEFT JOIN stored_keys s ON s.id = coalesce(e.original, p.original, n.original)""")

# Arrivals one by one: each is a duplicate when an earlier canonical row matches it


def _arrivals_in_order(name: str, view: str, first: str) -> str:
    """Walk over ``view`` in id order; ``first`` gives the ids that are canonical from the start."""
    _VIEWS[f"{name}_scores"] = _name_scores(view, view)
    _NEEDS[f"{name}_scores"] = [view]
    return with_views(f"{name}_scores", "").rstrip() + f""",
  edges AS MATERIALIZED (
    SELECT a.id, b.id AS earlier, 1 AS rank, 100 AS score FROM {view} a JOIN {view} b ON a.email_key = b.email_key AND b.id < a.id
    UNION ALL SELECT a.id, b.id, 2, 100 FROM {view} a JOIN {view} b ON a.phone_key = b.phone_key AND b.id < a.id
    UNION ALL SELECT a.id, b.id, 3, n.score FROM {view} a JOIN {name}_scores n ON n.aw = a.words
              JOIN {view} b ON b.words = n.bw AND b.id < a.id),
  fixed AS MATERIALIZED ({first}),
  in_order AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY k.id) AS rn, k.id, coalesce(e.near, []) AS near
    FROM {view} k LEFT JOIN (SELECT id, list(DISTINCT earlier) AS near FROM edges GROUP BY id) e ON e.id = k.id
    WHERE k.id NOT IN (SELECT id FROM fixed)),
  walk(rn, kept) AS (
    SELECT CAST(0 AS BIGINT), coalesce((SELECT list(id) FROM fixed), CAST([] AS BIGINT[]))
    UNION ALL
    SELECT o.rn, CASE WHEN list_has_any(o.near, w.kept) THEN w.kept ELSE list_append(w.kept, o.id) END
    FROM walk w JOIN in_order o ON o.rn = w.rn + 1),
  kept AS (SELECT unnest(kept) AS id FROM walk WHERE rn = (SELECT max(rn) FROM walk)),
  best AS (
    SELECT id, earlier, rank, score FROM (
      SELECT e.*, row_number() OVER (PARTITION BY e.id ORDER BY rank, score DESC, earlier) AS place
      FROM edges e WHERE e.earlier IN (SELECT id FROM kept) AND e.id NOT IN (SELECT id FROM kept)) WHERE place = 1)
  SELECT k.id, b.id IS NOT NULL AS is_duplicate, b.earlier AS duplicate_of,
         CASE b.rank WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(0.95 AS DOUBLE) WHEN 3 THEN b.score / CAST(100 AS DOUBLE) END AS duplicate_confidence,
         CASE b.rank WHEN 1 THEN concat('Exact Email Match (', s.email, ')') WHEN 2 THEN concat('Phone Match (', s.name, ')')
              WHEN 3 THEN concat('Name Similarity ', b.score, '% (', s.name, ')') ELSE 'Unique' END AS reason
  FROM {view} k LEFT JOIN best b ON b.id = k.id LEFT JOIN {view} s ON s.id = b.earlier WHERE k.id NOT IN (SELECT id FROM fixed)"""


ORACLES["canonical_set"] = _arrivals_in_order("self", "all_keys", "SELECT id FROM all_keys WHERE false")
_VIEWS["joined_keys"] = """
  SELECT * FROM stored_keys UNION ALL
  SELECT * REPLACE (id + (SELECT max(doc_id) FROM documents) + 1 AS id) FROM batch_keys"""
_NEEDS["joined_keys"] = ["stored_keys", "batch_keys"]
ORACLES["ingest_decisions"] = _arrivals_in_order("ingest", "joined_keys", "SELECT id FROM stored_keys")
_VIEWS["streamed"] = f"""
  SELECT doc_id AS id, concat(regexp_extract(text, '[A-Za-z]+'), ' ', doc_id % 97) AS name, {EMAIL} AS email, {PHONE} AS phone
  FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''"""
_NEEDS["streamed"] = []
_VIEWS["streamed_keys"] = _keys_of("streamed")
_NEEDS["streamed_keys"] = ["streamed"]
ORACLES["stream_ingest"] = (
    "SELECT d.id, d.is_duplicate, d.duplicate_of, d.duplicate_confidence FROM ("
    + _arrivals_in_order("streamed", "streamed_keys", "SELECT id FROM streamed_keys WHERE false") + ") d")

ORACLES["stream_ingest_batches"] = ORACLES["stream_ingest"]

_VIEWS["parsed"] = f"""
  SELECT conv_id * 1000 + turn + 1000000000 AS id, concat('Cv ', conv_id) AS name, {EMAIL} AS email, {PHONE} AS phone
  FROM conversations WHERE turn % 5 <> 4 AND regexp_matches(text, '\\S')"""
_NEEDS["parsed"] = []
_VIEWS["parsed_keys"] = _keys_of("parsed")
_NEEDS["parsed_keys"] = ["parsed"]
_VIEWS["stored_and_parsed"] = "SELECT * FROM stored_keys UNION ALL SELECT * FROM parsed_keys"
_NEEDS["stored_and_parsed"] = ["stored_keys", "parsed_keys"]
ORACLES["ingest_report"] = (
    "SELECT count(*) AS success, (SELECT count(*) FROM conversations) - count(*) AS failed, "
    "CAST(count_if(d.is_duplicate) AS BIGINT) AS duplicates FROM ("
    + _arrivals_in_order("parsed", "stored_and_parsed", "SELECT id FROM stored_keys") + ") d")
oracle("marked_duplicates", "candidates all_keys", f"""
  SELECT c.id, c.is_duplicate OR h.original IS NOT NULL AS is_duplicate, coalesce(h.original, c.duplicate_of) AS duplicate_of,
         CASE WHEN h.original IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE c.duplicate_confidence END AS duplicate_confidence,
         CASE WHEN h.original IS NOT NULL THEN {AS_OF} END AS updated_at
  FROM candidates c LEFT JOIN (SELECT a.id, min(b.id) AS original FROM all_keys a JOIN all_keys b USING (email_key)
                               GROUP BY a.id HAVING min(b.id) < a.id) h ON h.id = c.id""")

# Files, mails, replies, streams

oracle("parsed_candidates", "", rf"""
  SELECT concat('jane_van_doe_', doc_id, '.docx') AS source_file, concat('Jane Van Doe ', doc_id) AS name, {EMAIL} AS email,
         {PHONE} AS phone, coalesce(list_max(list_transform(regexp_extract_all(lower(text), '(\d+)\+?\s*years?', 1),
         lambda n: TRY_CAST(n AS INT))), 0) AS experience_years
  FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""")
oracle("reply_repair", "", r"""
  SELECT conv_id, turn, nullif(regexp_replace(concat(split_part(t, ' ', 1), ' ', split_part(t, ' ', 2)), '^\s+|\s+$', '', 'g'), '') AS name,
         CAST(NULL AS VARCHAR) AS email, concat('turn: ', turn, chr(10), 'role: ', role) AS experience,
         concat('one', chr(10), 'two', chr(10), role) AS skills, CASE WHEN conv_id <> 0 THEN CAST(conv_id AS VARCHAR) END AS projects,
         CAST(NULL AS VARCHAR) AS summary
  FROM (SELECT *, replace(text, chr(10), ' ') AS t FROM conversations)""")
oracle("stream_daily_counts", "", """
  SELECT CAST(ts AS DATE) AS day, count(*) AS rows,
         CAST(sum(CAST(floor(value * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS hundredths
  FROM events GROUP BY 1""")
oracle("stream_closed_days", "", """
  WITH marks AS (SELECT max(ts) FILTER (event_id % 10 <> 0) - INTERVAL 2 DAY AS first_mark, max(ts) - INTERVAL 2 DAY AS last_mark FROM events),
  e AS (
    SELECT CAST(ts AS DATE) AS day, CAST(floor(value * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS h,
           event_id % 10 = 0 AND CAST(ts AS DATE) + INTERVAL 1 DAY <= first_mark AS late
    FROM events, marks WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= last_mark)
  SELECT day, count_if(NOT late)::BIGINT AS rows, CAST(sum(h) FILTER (NOT late) AS BIGINT) AS hundredths,
         count_if(late)::BIGINT AS late_rows, CAST(coalesce(sum(h) FILTER (late), 0) AS BIGINT) AS late_hundredths
  FROM e GROUP BY day HAVING NOT bool_and(late)""")
