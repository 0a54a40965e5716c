"""Explicit schemas of the stored tables (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
        "bool": T.BooleanType(), "ts": T.TimestampNTZType(), "date": T.DateType(), "binary": T.BinaryType(),
        "vector": T.ArrayType(T.FloatType()),
    }
    out = T.StructType()
    for line in spec.strip().splitlines():
        kind, names = line.split(":")
        for name in names.split():
            out.add(name, kinds[kind.strip()], True)
    return out


CANDIDATES = _fields("""
    long: id
    string: name email phone summary education experience skills projects certifications others source_file
    binary: resume_file
    string: text_content
    vector: profile_embedding
    bool: is_duplicate
    long: duplicate_of
    double: duplicate_confidence
    int: experience_years
    string: source_type
    ts: created_at updated_at
""")

JOB_DESCRIPTIONS = _fields("""
    long: id
    string: title description department location required_skills
    int: required_experience_min required_experience_max
    string: required_certifications matching_config
    vector: jd_embedding
    string: status
    ts: created_at updated_at
    string: created_by
""")

SCREENING_RESULTS = _fields("""
    long: id job_description_id candidate_id
    double: final_score semantic_score skill_match_score experience_score
    string: matched_skills missing_skills
    int: experience_gap
    bool: in_longlist in_shortlist
    long: rank_position
    string: status reviewer_notes
    ts: screened_at reviewed_at
    string: reviewed_by
""")

SCREENING_HISTORY = _fields("""
    long: id job_description_id
    string: batch_id
    int: total_candidates longlist_count shortlist_count
    double: avg_score max_score min_score processing_time_seconds
    string: config_snapshot
    ts: executed_at
    string: executed_by
""")

VACANCY_RECOMMENDATIONS = _fields("""
    long: id job_description_id candidate_id
    double: recommendation_score
    string: match_reasoning
    bool: was_contacted
    string: candidate_response
    ts: recommended_at contacted_at
""")

EMAIL_LOGS = _fields("""
    long: id
    string: email_id subject sender
    ts: received_at
    bool: has_attachment
    int: attachments_count resumes_extracted
    string: processing_status error_message
    ts: fetched_at processed_at
""")

ANALYTICS_METRICS = _fields("""
    long: id
    string: metric_name metric_category
    double: metric_value
    int: metric_count
    string: metric_data
    date: period_start period_end
    ts: calculated_at
""")

SYSTEM_CONFIG = _fields("""
    long: id
    string: config_key config_value description
    ts: updated_at
""")

TABLES = {
    "candidates": CANDIDATES,
    "job_descriptions": JOB_DESCRIPTIONS,
    "screening_results": SCREENING_RESULTS,
    "screening_history": SCREENING_HISTORY,
    "vacancy_recommendations": VACANCY_RECOMMENDATIONS,
    "email_logs": EMAIL_LOGS,
    "analytics_metrics": ANALYTICS_METRICS,
    "system_config": SYSTEM_CONFIG,
}

# Matching settings of one vacancy; every weight and cut-off is a double.
MATCHING_CONFIG = _fields("""
    double: semantic_weight skill_weight experience_weight min_score_threshold
    double: longlist_percentage shortlist_percentage
""")
