"""The registered queries as DuckDB SQL over the provided tables."""

from __future__ import annotations

from callsift.operators.scoring import ALL_MET, INSTRUCTION, NOTE
from callsift.sources.sample import CRITERIA, ISSUES, RESOLUTIONS
from checks.inputs import sample_keywords

SPACE = r"\s\p{Z}\x1c-\x1f\x{85}"
WORD = r"\p{L}\p{N}_"
RUN = "TIMESTAMP '2026-01-01 00:00:00'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(of: str, options: dict) -> str:
    branches = " ".join(
        f"WHEN {key if isinstance(key, int) else text(key)} THEN "
        f"{value if isinstance(value, (int, float)) else text(value)}"
        for key, value in options.items()
    )
    return f"CASE {of} {branches} END"


def criterion(position: int, of: str) -> str:
    return case(of, {row[0]: row[position] for row in CRITERIA})


def units(of: str) -> str:
    """Exact sum in millionths."""
    return f"SUM(CAST(ROUND({of} * 1000000) AS BIGINT))"


def rounded(numerator: str, denominator: str, digits: int) -> str:
    """numerator / denominator of whole numbers, half up; null over zero."""
    ten = 10 ** digits
    bottom = f"NULLIF({denominator}, 0)"
    return f"CAST((2 * ({numerator}) * {ten} + {bottom}) // (2 * {bottom}) AS DOUBLE) / {ten}"


def average(of: str, digits: int, divide_by: int = 1) -> str:
    return rounded(units(of), f"COUNT({of}) * {1000000 * divide_by}", digits)


def percent(part: str, whole: str) -> str:
    return rounded(f"100 * ({part})", whole, 1)


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def count_if(condition: str) -> str:
    return big(f"SUM(CASE WHEN {condition} THEN 1 ELSE 0 END)")


def words(of: str) -> str:
    return big(f"len(regexp_extract_all(COALESCE({of}, ''), '[^{SPACE}]+'))")


def tokens(of: str) -> str:
    return f"regexp_extract_all(lower(COALESCE({of}, '')), '[{WORD}]+')"


def python_round(of: str, digits: int) -> str:
    """Rounded by the exact binary value, ties to even; see the Spark function of this name."""
    scale = f"1e{digits}"
    upper = f"({of} * 134217729e0 - ({of} * 134217729e0 - {of}))"
    lost = f"(({upper} * {scale} - {of} * {scale}) + ({of} - {upper}) * {scale})"
    floor = f"CAST(floor({of} * {scale}) AS BIGINT)"
    side = f"(({of} * {scale} - {floor} - 0.5e0) + {lost})"
    return (
        f"(({floor} + CASE WHEN {side} > 0 OR ({side} = 0 AND {floor} % 2 = 1) THEN 1 ELSE 0 END)"
        f" / {scale})"
    )


CENTS = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"
OUTCOME = case("o_orderstatus", RESOLUTIONS)
ISSUE = case("o_orderpriority", ISSUES)

VIEWS = {
    "calls": """
        SELECT o_orderkey AS contact_id, o_custkey AS agent_id,
          CASE WHEN o_orderkey % 11 <> 0 THEN 'Campaign ' || (o_custkey % 7) END AS campaign_name,
          'Skill ' || (o_orderkey % 3) AS skill_name, 'Team ' || (o_custkey % 5) AS team_name,
          'Agent' AS first_name, CAST(o_custkey AS VARCHAR) AS last_name,
          '+1' || o_custkey AS from_addr, '+2' || o_orderkey AS to_addr,
          o_orderdate AS contact_start, o_totalprice AS total_duration_sec,
          CAST(o_orderkey * 13 % 2400 AS DOUBLE) AS agent_seconds,
          CAST(o_orderkey * 17 % 120 AS DOUBLE) AS in_queue_seconds,
          CAST(o_orderkey * 37 % 3000 AS DOUBLE) AS hold_seconds,
          CAST(o_orderkey * 7 % 60 AS DOUBLE) AS acw_seconds,
          CAST(o_orderkey % 4 AS INT) AS hold_count, o_orderkey % 29 = 0 AS is_abandoned,
          o_orderkey % 5 = 0 AS is_outbound,
          CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS service_level_flag,
          'EndContact' AS state, 'Call' AS media_type_name, o_orderkey % 10 = 9 AS is_simulated,
          o_orderdate AS created_at
        FROM orders""",
    "call_summary": f"""
        SELECT o_orderkey AS contact_id, {ISSUE} AS issue_category,
          'About ' || o_orderpriority AS issue_description,
          CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'Abandoned'
            ELSE {OUTCOME} END AS resolution,
          CASE o_orderkey % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Neutral' ELSE 'Negative' END
            AS sentiment_agent,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Positive'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'Neutral' ELSE 'Negative' END
            AS sentiment_customer,
          CAST({CENTS} % 10001 AS DOUBLE) / 100 AS overall_score,
          'Moment ' || o_orderkey AS key_moments, CAST(NULL AS VARCHAR) AS ai_recommendation,
          o_orderdate AS created_at,
          CASE WHEN o_orderkey % 6 = 0 THEN 'Billing' ELSE {ISSUE} END AS pred_issue_category,
          CASE WHEN o_orderkey % 7 = 0 THEN 'Resolved' ELSE {OUTCOME} END AS pred_resolution
        FROM orders""",
    "quality_scores": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS score_id,
          l_orderkey AS contact_id, l_suppkey AS agent_id,
          {criterion(1, 'l_linenumber')} AS section_name,
          {criterion(2, 'l_linenumber')} AS criteria_name,
          CASE WHEN l_quantity <> 1 AND l_returnflag <> 'R'
            THEN {criterion(5, 'l_linenumber')} / 10000e0 ELSE 0e0 END AS score,
          CASE WHEN l_quantity <> 1 THEN l_returnflag <> 'R' END AS passed,
          'flag ' || l_returnflag AS reasoning, 'auditor' AS scored_by, l_shipdate AS evaluated_at
        FROM lineitem""",
    "rubric": f"""
        SELECT 'R' || l_linenumber AS framework_id,
          CASE WHEN l_linenumber <> 7 THEN {criterion(1, 'l_linenumber')} END AS section_name,
          {criterion(2, 'l_linenumber')} AS criteria_name,
          {criterion(3, 'l_linenumber')} / 10000e0 AS section_weight,
          {criterion(4, 'l_linenumber')} / 10000e0 AS criteria_weight,
          {criterion(5, 'l_linenumber')} / 10000e0 AS effective_weight,
          l_linenumber <> 6 AS enabled, 'check ' || l_linenumber AS what_to_check,
          'always' AS when_to_check, 'good ' || l_linenumber AS good_example,
          'bad ' || l_linenumber AS bad_example, 'binary' AS scoring_method,
          MAX(l_shipdate) AS updated_at
        FROM lineitem GROUP BY l_linenumber""",
    "rules": """
        SELECT 'P' || p_partkey AS framework_id,
          CASE WHEN p_type <> 'PROMO' THEN p_type END AS section_name,
          p_brand || ' ' || p_name AS criteria_name, p_size / 50e0 AS section_weight,
          CAST(CAST(ROUND(p_retailprice * 100) AS BIGINT) % 100 AS DOUBLE) / 100 AS criteria_weight,
          CAST(CAST(ROUND(p_retailprice * 100) AS BIGINT) % 20000 AS DOUBLE) / 10000
            AS effective_weight,
          p_size > 5 AS enabled, 'check ' || p_name AS what_to_check, 'always' AS when_to_check,
          'good' AS good_example, 'bad' AS bad_example, 'binary' AS scoring_method,
          TIMESTAMP '2024-01-01' AS updated_at
        FROM part""",
    "transcripts": f"""
        SELECT 'T' || doc_id AS transcript_id, doc_id AS contact_id, agent_text, customer_text,
          agent_text || ' ' || customer_text AS full_text, aw AS agent_word_count,
          cw AS customer_word_count, {python_round('share', 3)} AS talk_ratio
        FROM (SELECT *, CAST(aw AS DOUBLE) / NULLIF(aw + cw, 0) AS share
          FROM (SELECT *, {words('agent_text')} AS aw, {words('customer_text')} AS cw
          FROM (SELECT doc_id,
            NULLIF(array_to_string(list_filter(lines, lambda x, i: i % 2 = 0), ' '), '') AS agent_text,
            NULLIF(array_to_string(list_filter(lines, lambda x, i: i % 2 = 1), ' '), '')
              AS customer_text
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))))""",
}
SQL: dict[str, str] = {}


def add(name: str, body: str, *views: str, **extra: str) -> None:
    """Register a statement behind the views it uses and further named parts."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views]
    parts += [f"{k} AS ({v})" for k, v in extra.items()]
    SQL[name] = (f"WITH {', '.join(parts)} " if parts else "") + body


JOINED = "calls c JOIN call_summary s ON c.contact_id = s.contact_id"
FAILED = "NOT COALESCE(passed, FALSE)"
ROLLUP = f"""SELECT agent_id, team_name, skill_name, COUNT(DISTINCT c.contact_id) AS total_calls,
    {average('overall_score', 1)} AS avg_score,
    {count_if("resolution = 'Resolved'")} AS resolved,
    {count_if("resolution = 'Escalated'")} AS escalated,
    {count_if("resolution = 'Unresolved'")} AS unresolved,
    {average('total_duration_sec', 1, 60)} AS avg_dur_min,
    {average('hold_seconds', 0)} AS avg_hold_sec,
    {count_if("service_level_flag = '1'")} AS sla_met,
    {percent(count_if("sentiment_customer = 'Positive'"), 'COUNT(*)')} AS csat_pct,
    MAX(overall_score) AS best_score, MIN(overall_score) AS worst_score
  FROM {JOINED} GROUP BY agent_id, team_name, skill_name"""
PASS_RATES = f"""SELECT criteria_name, section_name,
    {percent(count_if('passed'), 'COUNT(*)')} AS pass_rate, {count_if('passed')} AS passed_count,
    COUNT(*) AS total
  FROM quality_scores GROUP BY criteria_name, section_name"""
DAILY = f"""SELECT CAST(contact_start AS DATE) AS day, COUNT(*) AS calls,
    COUNT(overall_score) AS scored, {units('overall_score')} AS score_sum
  FROM {JOINED} GROUP BY 1"""
SUMMARY_COLUMNS = (
    "s.overall_score, s.resolution, s.sentiment_agent, s.sentiment_customer, s.issue_category, "
    "s.ai_recommendation, s.pred_issue_category, s.pred_resolution, s.key_moments"
)

# Scans and sinks.

DETAILS = f"""SELECT o_orderkey AS contact_id, o_custkey AS agent_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'Campaign ' || (o_orderkey % 7) ELSE 'Unknown' END
      AS campaign_name,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority ELSE 'Unknown' END AS skill_name,
    'Unknown' AS team_name, 'Ann' AS first_name, '' AS last_name,
    CAST(o_custkey AS VARCHAR) AS from_addr, '' AS to_addr,
    CASE WHEN o_orderpriority = '5-LOW' THEN {RUN} ELSE o_orderdate END AS contact_start,
    o_totalprice AS total_duration_sec, 0e0 AS agent_seconds, 0e0 AS in_queue_seconds,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey * 37 % 3000 AS DOUBLE) ELSE 0e0 END
      AS hold_seconds,
    0e0 AS acw_seconds, CAST(o_orderkey % 4 AS INT) AS hold_count,
    o_orderkey % 29 = 0 AS is_abandoned, FALSE AS is_outbound,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS service_level_flag,
    'Unknown' AS state, 'Call' AS media_type_name, FALSE AS is_simulated, {RUN} AS created_at
  FROM orders WHERE o_orderkey <> 0 AND o_orderkey % 97 <> 0 AND o_orderkey % 178 <> 0"""
add("scan_call_details", DETAILS)
add("scan_call_detail_errors", """SELECT CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey <> 0
      THEN CAST(o_orderkey AS VARCHAR) END AS contact_id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'no JSON' WHEN o_orderkey = 0 THEN 'no contact id'
      ELSE 'holdSeconds is no number' END AS reason
    FROM orders WHERE o_orderkey = 0 OR o_orderkey % 97 = 0 OR o_orderkey % 178 = 0""")
add("scan_transcript_errors", """SELECT CAST(NULL AS VARCHAR) AS contact_id,
    substring('{"' || contact_id || '":{"' || CASE WHEN agent_text IS NOT NULL THEN 'agent'
      WHEN customer_text IS NOT NULL THEN 'customer' ELSE '' END || '_conversation":"', 1, 20) AS content,
    'no map of calls' AS reason FROM transcripts WHERE contact_id % 41 = 0""", "transcripts")
add("stream_calls_ingest", DETAILS)
add("scan_transcripts", """SELECT contact_id, agent_text, customer_text FROM transcripts
    WHERE contact_id % 41 <> 0""", "transcripts")
add("scan_rubric_config", """SELECT COALESCE(section_name, 'General') AS section_name, criteria_name,
    section_weight, criteria_weight, effective_weight, enabled, what_to_check, when_to_check,
    good_example, bad_example, criteria_name AS check_keywords, scoring_method FROM rubric""", "rubric")
add("scan_table", "SELECT * FROM orders")

STORED = """SELECT doc_id AS contact_id, CAST(length(lang) AS BIGINT) AS agent_id,
    CAST(n_chars AS DOUBLE) AS seconds, TIMESTAMP '2024-01-01' AS moment FROM documents"""
BATCH = """SELECT l_orderkey AS contact_id, l_suppkey AS agent_id, l_extendedprice AS seconds,
    l_shipdate AS moment FROM lineitem"""


def one_per_key(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in ("moment", "agent_id", "seconds"))
    return f"""SELECT contact_id, agent_id, seconds, moment FROM batch
        QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY {order}) = 1"""


add("sink_insert_ignore", """SELECT * FROM stored UNION ALL
    SELECT * FROM first WHERE contact_id NOT IN (SELECT contact_id FROM stored)""",
    stored=STORED, batch=BATCH, first=one_per_key("ASC"))
add("sink_upsert", """SELECT * FROM last UNION ALL
    SELECT * FROM stored WHERE contact_id NOT IN (SELECT contact_id FROM batch)""",
    stored=STORED, batch=BATCH, last=one_per_key("DESC"))


SQL["sink_upsert_stored"] = SQL["sink_upsert"]
add("sink_overwrite", f"""SELECT contact_id, substring(full_text, 1, 800) || {text(NOTE)} AS summary,
    '[]' AS strengths, 'fallback' AS model_name, CAST(2 AS INT) AS version FROM transcripts
    WHERE full_text IS NOT NULL""", "transcripts")
add("sink_csv_export", """SELECT contact_id || ',' || agent_word_count || ','
    || COALESCE(CAST(talk_ratio AS VARCHAR), '') AS line FROM transcripts""", "transcripts")
add("scan_csv", """SELECT contact_id, full_text, talk_ratio, agent_word_count
    FROM transcripts""", "transcripts")


def latest(field: str) -> str:
    return f"""SELECT framework_id, seq, {field} AS v FROM changes WHERE {field} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY framework_id ORDER BY seq DESC, {field} DESC) = 1"""


def merged(field: str, part: str, blank: str) -> str:
    return f"""CASE WHEN b.op = 'insert'
        THEN COALESCE(CASE WHEN {part}.seq >= b.seq THEN {part}.v END, {blank})
        ELSE COALESCE({part}.v, r.{field}) END AS {field}"""


add("rubric_changes", f"""
    SELECT k.framework_id,
      CASE WHEN b.op = 'insert' THEN NULL ELSE r.section_name END AS section_name,
      {merged('effective_weight', 'w', '0e0')}, {merged('enabled', 'e', 'FALSE')},
      {merged('what_to_check', 'c', "''")}, COALESCE(t.v, r.updated_at) AS updated_at
    FROM (SELECT framework_id FROM rules UNION SELECT framework_id FROM changes) k
    LEFT JOIN rules r USING (framework_id) LEFT JOIN base b USING (framework_id)
    LEFT JOIN w USING (framework_id) LEFT JOIN e USING (framework_id)
    LEFT JOIN c USING (framework_id) LEFT JOIN t USING (framework_id)
    WHERE COALESCE(b.op, '') <> 'delete' AND (b.op = 'insert' OR r.framework_id IS NOT NULL)""",
    "rules",
    changes="""SELECT CASE WHEN l_quantity = 50 THEN 'N' ELSE 'P' END || l_partkey AS framework_id,
        l_orderkey * 10 + l_linenumber AS seq,
        CASE l_quantity WHEN 50 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'update' END AS op,
        l_shipdate AS changed_at,
        CASE WHEN l_discount > 0.05e0 THEN l_discount END AS effective_weight,
        CASE WHEN l_tax > 0.04e0 THEN l_linestatus = 'O' END AS enabled,
        CASE WHEN l_returnflag = 'A' THEN 'look at ' || l_linenumber END AS what_to_check
        FROM lineitem""",
    base="""SELECT framework_id, seq, op FROM changes WHERE op <> 'update'
        QUALIFY row_number() OVER (PARTITION BY framework_id ORDER BY seq DESC, op DESC) = 1""",
    w=latest("effective_weight"), e=latest("enabled"), c=latest("what_to_check"),
    t=latest("changed_at"))

# Projections and filters.

add("normalize_text", f"""SELECT doc_id,
    regexp_replace(lower(text), '[^{WORD}{SPACE}]', '', 'g') AS normalized FROM documents""")
add("transcript_features", """SELECT contact_id, agent_word_count, customer_word_count, talk_ratio,
    COALESCE(agent_text, '') || ' ' || COALESCE(customer_text, '') AS full_text
    FROM transcripts""", "transcripts")
add("format_dialogue", """SELECT contact_id, 'AGENT: ' || COALESCE(agent_text, '') || chr(10)
    || chr(10) || 'CUSTOMER: ' || COALESCE(customer_text, '') AS formatted_text
    FROM transcripts""", "transcripts")
add("truncate_text", "SELECT doc_id, " + ", ".join(
    f"substring(text, 1, {n}) AS first_{n}" for n in (4000, 3000, 1000, 800)) + " FROM documents")
add("filter_enabled_rules", "SELECT * FROM rules WHERE enabled", "rules")
add("weight_percent", f"""SELECT *, CASE WHEN COALESCE(effective_weight, 0) <= 1
    THEN {python_round('(COALESCE(effective_weight, 0e0) * 100)', 2)}
    ELSE {python_round('effective_weight', 2)} END AS weight_pct FROM rules""", "rules")
add("filter_not_abandoned", """SELECT contact_id, resolution FROM call_summary
    WHERE resolution IS DISTINCT FROM 'Abandoned'""", "call_summary")
add("filter_has_text", """SELECT contact_id, full_text FROM transcripts
    WHERE full_text IS NOT NULL""", "transcripts")
add("call_detail_lookup", """SELECT c.contact_id, c.agent_id, c.team_name, c.contact_start,
    c.total_duration_sec, q.criteria_name, q.passed, ROUND(q.score * 100, 0) AS score_pct,
    q.reasoning FROM calls c LEFT JOIN quality_scores q ON c.contact_id = q.contact_id""",
    "calls", "quality_scores")
SENTIMENT = "CAST(CASE {} WHEN 'Positive' THEN 2 WHEN 'Negative' THEN 0 ELSE 1 END AS INT)"
ISSUE_NO = """CAST(CASE issue_category WHEN 'Account Access' THEN 1 WHEN 'Billing' THEN 2
    WHEN 'Software Request' THEN 3 ELSE 0 END AS INT)"""
SLA = "CAST(CASE WHEN service_level_flag = '1' THEN 1 ELSE 0 END AS INT)"
add("encode_sentiment", f"""SELECT contact_id,
    {SENTIMENT.format('sentiment_agent')} AS sentiment_agent_num,
    {SENTIMENT.format('sentiment_customer')} AS sentiment_customer_num
    FROM call_summary""", "call_summary")
add("encode_issue", f"SELECT contact_id, {ISSUE_NO} AS issue_num FROM call_summary", "call_summary")
add("encode_sla", f"SELECT contact_id, {SLA} AS sla_met FROM calls", "calls")
add("critical_risk_flag", f"""SELECT q.score_id, q.contact_id, q.criteria_name, r.effective_weight,
    CASE WHEN r.effective_weight > 0.1e0 THEN 'CRITICAL BUSINESS RISK' END AS risk
    FROM quality_scores q JOIN rubric r USING (criteria_name) WHERE {FAILED}""",
    "quality_scores", "rubric")
TRAINING = """SELECT t.contact_id, t.agent_text, t.customer_text, t.agent_word_count,
    t.customer_word_count, t.talk_ratio, c.campaign_name, c.total_duration_sec, c.agent_seconds,
    c.in_queue_seconds, c.hold_seconds, c.hold_count, c.acw_seconds, c.is_abandoned, c.is_outbound,
    c.service_level_flag, c.is_simulated, s.overall_score, s.sentiment_agent, s.sentiment_customer,
    s.issue_category, s.resolution
  FROM transcripts t JOIN calls c ON t.contact_id = c.contact_id
  JOIN call_summary s ON t.contact_id = s.contact_id"""
THREE = ("transcripts", "calls", "call_summary")
add("default_fill", """SELECT contact_id, COALESCE(agent_text, '') AS agent_text,
    COALESCE(campaign_name, 'Unknown') AS campaign_name, total_duration_sec, agent_word_count,
    customer_word_count, COALESCE(talk_ratio, 0e0) AS talk_ratio,
    COALESCE(overall_score, 0e0) AS overall_score, hold_count, hold_seconds, in_queue_seconds
    FROM training""", *THREE, training=TRAINING)

# Joins.

add("join_calls_summary", f"SELECT c.*, {SUMMARY_COLUMNS} FROM {JOINED}", "calls", "call_summary")
add("join_training_set", TRAINING, *THREE)
add("join_scores_calls", """SELECT q.*, c.agent_id AS ag_id, c.team_name FROM quality_scores q
    JOIN calls c ON q.contact_id = c.contact_id""", "quality_scores", "calls")
add("join_agent_names", """SELECT q.score_id, q.contact_id, q.criteria_name, q.score,
    c.first_name || ' ' || c.last_name AS agent_name FROM quality_scores q
    JOIN calls c ON q.contact_id = c.contact_id""", "quality_scores", "calls")
add("unsummarized_calls", """SELECT t.contact_id, t.agent_text, t.customer_text FROM transcripts t
    LEFT JOIN call_summary s ON t.contact_id = s.contact_id
    WHERE s.contact_id IS NULL OR s.issue_category IS NULL""", "transcripts", "call_summary")
add("unscored_calls", """SELECT t.contact_id, c.agent_id, t.full_text FROM transcripts t
    JOIN calls c ON t.contact_id = c.contact_id
    WHERE t.contact_id NOT IN (SELECT DISTINCT contact_id FROM quality_scores)""",
    "transcripts", "calls", "quality_scores")
add("rubric_weight_lookup", """SELECT q.score_id, q.criteria_name, q.passed,
    COALESCE((SELECT r.effective_weight FROM rubric r WHERE r.criteria_name = q.criteria_name), 0e0)
      AS effective_weight FROM quality_scores q""", "quality_scores", "rubric")
add("agent_id_lookup", """SELECT t.contact_id, t.full_text, c.agent_id FROM transcripts t
    LEFT JOIN calls c ON t.contact_id = c.contact_id""", "transcripts", "calls")
add("missing_transcripts", """SELECT contact_id, agent_id, contact_start FROM calls
    WHERE contact_id NOT IN (SELECT contact_id FROM transcripts)""", "calls", "transcripts")

# Aggregations.

add("agent_rollup", f"SELECT * EXCLUDE (best_score, worst_score) FROM ({ROLLUP})", "calls", "call_summary")
add("agent_rollup_minmax", ROLLUP, "calls", "call_summary")
add("criteria_pass_rate", f"SELECT * EXCLUDE (passed_count) FROM ({PASS_RATES})", "quality_scores")
add("criteria_passed_count", PASS_RATES, "quality_scores")
HEAT = f"""SELECT agent_id, criteria_name, section_name,
    {percent(count_if('passed'), 'COUNT(*)')} AS pass_rate
    FROM quality_scores GROUP BY agent_id, criteria_name, section_name"""
add("agent_criteria_heatmap", HEAT, "quality_scores")
add("agent_criteria_heatmap_wide", "SELECT agent_id, " + ", ".join(
    f"MAX(CASE WHEN criteria_name = {text(row[2])} THEN pass_rate END) AS c{i}"
    for i, row in enumerate(CRITERIA, 1)) + f" FROM ({HEAT}) GROUP BY agent_id", "quality_scores")
add("agents_dimension", f"""SELECT agent_id,
    arg_max(team_name, place) AS team_name, arg_max(skill_name, place) AS skill_name,
    COUNT(*) AS total_calls, {average('overall_score', 1)} AS avg_quality_score,
    {average('total_duration_sec', 1)} AS avg_handle_time, MAX(contact_start) AS last_call_date
    FROM (SELECT c.*, s.overall_score,
        row_number() OVER (PARTITION BY agent_id ORDER BY contact_start, c.contact_id) AS place
        FROM calls c LEFT JOIN call_summary s ON c.contact_id = s.contact_id)
    GROUP BY agent_id""", "calls", "call_summary")
add("overview_kpis", f"""SELECT COUNT(*) AS total_calls, {average('overall_score', 1)} AS avg_score,
    COUNT(DISTINCT agent_id) AS agents FROM {JOINED}""", "calls", "call_summary")
add("resolution_breakdown", f"""SELECT resolution, calls,
    {percent('calls', 'total')} AS share_pct
    FROM (SELECT resolution, COUNT(*) AS calls, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total
        FROM call_summary GROUP BY resolution)""", "call_summary")
add("total_calls_distinct", "SELECT COUNT(DISTINCT contact_id) AS total_calls FROM quality_scores",
    "quality_scores")
add("agent_avg_quality", f"""SELECT agent_id, total_calls,
    {rounded('s', 'total_calls * 1000000', 4)} AS avg_quality,
    {rounded('s * 100', 'total_calls * 1000000', 1)} AS avg_quality_pct
    FROM (SELECT agent_id, COUNT(DISTINCT contact_id) AS total_calls, {units('score')} AS s
        FROM quality_scores GROUP BY agent_id)""", "quality_scores")
add("most_failed_criteria", f"""SELECT criteria_name, {count_if(FAILED)} AS failed
    FROM quality_scores GROUP BY criteria_name ORDER BY failed DESC, criteria_name LIMIT 5""",
    "quality_scores")
add("overall_call_score", f"""SELECT contact_id, CAST({units('score')} AS DOUBLE) / 10000
    AS overall_score FROM quality_scores GROUP BY contact_id""", "quality_scores")
FAILED_LISTS = f"""SELECT contact_id, list(criteria_name ORDER BY place) FILTER (failed) AS failed
    FROM (SELECT DISTINCT q.contact_id, q.criteria_name, r.framework_id AS place, {FAILED} AS failed
        FROM quality_scores q LEFT JOIN rubric r USING (criteria_name)) GROUP BY contact_id"""
add("failed_criteria_list", """SELECT contact_id,
    CAST(to_json(COALESCE(failed, [])) AS VARCHAR) AS failed_criteria,
    CAST(len(COALESCE(failed, [])) AS BIGINT) AS n_failed FROM lists""",
    "quality_scores", "rubric", lists=FAILED_LISTS)
add("recommendation_text", f"""SELECT contact_id, CASE WHEN failed IS NULL THEN {text(ALL_MET)}
    ELSE 'Improve: ' || array_to_string(failed[1:3], ', ') END AS ai_recommendation FROM lists""",
    "quality_scores", "rubric", lists=FAILED_LISTS)
RUBRIC_TEXT = """SELECT string_agg('- ' || section || ':' || chr(10) || lines, chr(10)
      ORDER BY place) AS rubric_text
    FROM (SELECT section, MIN(place) AS place, string_agg(line, chr(10) ORDER BY place) AS lines
      FROM (SELECT COALESCE(section_name, 'General') AS section,
          row_number() OVER (ORDER BY section_name NULLS LAST, effective_weight DESC,
            criteria_name) AS place,
          '  • ' || criteria_name || ' (' || ROUND(effective_weight * 100, 2) || '%): '
            || what_to_check AS line
        FROM rubric WHERE enabled) GROUP BY section)"""
add("rubric_text", RUBRIC_TEXT, "rubric")
add("rubric_prompt_text", """SELECT string_agg('In section ' || COALESCE(section_name, '') || chr(10)
    || 'Rule ' || criteria_name || chr(10) || 'Asks: ' || what_to_check || chr(10)
    || 'Met, e.g.: ' || good_example || chr(10) || 'Not met, e.g.: ' || bad_example || chr(10)
    || chr(10), '' ORDER BY section_name NULLS LAST, effective_weight DESC, criteria_name)
    AS rubric_prompt FROM rubric WHERE enabled""", "rubric")
add("rubric_counts", f"""SELECT section_name, COUNT(*) AS rules, {count_if('enabled')} AS enabled_rules,
    CAST({units('criteria_weight')} AS DOUBLE) / 1000000 AS weight_sum,
    {units('criteria_weight')} = 1000000 AS sums_to_one FROM rules GROUP BY section_name""", "rules")

CALL_ISSUES = """
    SELECT contact_id, 'dispositionNotes' AS field_name, 'missing' AS issue_type,
      'No disposition notes' AS issue_description, 'low' AS severity
    FROM noted WHERE disposition_notes IS NULL
    UNION ALL SELECT contact_id, 'holdSeconds', 'outlier',
      'Long hold: ' || hold_seconds || 's', 'high' FROM noted WHERE hold_seconds > 1000"""
TALK_ISSUES = """SELECT contact_id, 'talk_ratio', 'outlier', 'Agent only '
      || CAST(round_even(talk_ratio * 100, 0) AS INT) || '%', 'medium'
    FROM transcripts WHERE talk_ratio < 0.25e0"""
NOTED = """SELECT o_orderkey AS contact_id,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS disposition_notes,
    CAST(o_orderkey * 37 % 3000 AS DOUBLE) AS hold_seconds FROM orders"""
LOG_ID = "sha256(concat_ws('|', contact_id, field_name, issue_type)) AS log_id"
LOG = dict(noted=NOTED, log=f"{CALL_ISSUES} UNION ALL {TALK_ISSUES}")
add("quality_log", f"SELECT {LOG_ID}, * FROM log", "transcripts", **LOG)
add("stream_quality_log", f"SELECT {LOG_ID}, * FROM log", noted=NOTED, log=CALL_ISSUES)
add("quality_log_summary", """SELECT severity, COUNT(*) AS issues FROM log GROUP BY severity
    UNION ALL SELECT 'total', COUNT(*) FROM log""", "transcripts", **LOG)
add("severity_sort", """SELECT CAST(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END
    AS INT) AS severity_rank, severity, contact_id, field_name FROM log
    ORDER BY severity_rank, contact_id, field_name""", "transcripts", **LOG)
add("load_audit", " UNION ALL ".join(
    f"SELECT '{v}' AS item, COUNT(*) AS row_count FROM {v}"
    for v in ("calls", "transcripts", "quality_scores", "call_summary", "rubric")) + """ UNION ALL
    SELECT 'quality_log', COUNT(*) FROM log UNION ALL
    SELECT 'matched pairs', COUNT(*) FROM calls
    WHERE contact_id IN (SELECT contact_id FROM transcripts)""",
    "calls", "transcripts", "quality_scores", "call_summary", "rubric", **LOG)
add("distinct_calls_by_month", """SELECT strftime(evaluated_at, '%Y-%m') AS month,
    COUNT(DISTINCT contact_id) AS total_calls FROM quality_scores GROUP BY 1""", "quality_scores")
add("file_audit", """SELECT 'call detail files' AS item, COUNT(*) AS n_files,
    CAST(SUM(length(s_name) + 1) AS BIGINT) AS n_bytes FROM supplier UNION ALL
    SELECT 'transcript files', COUNT(*), CAST(COALESCE(SUM(5), 0) AS BIGINT) FROM supplier
    WHERE s_acctbal > 0 UNION ALL
    SELECT 'matched pairs', COUNT(*), CAST(COALESCE(SUM(length(s_name) + 1), 0) AS BIGINT) FROM supplier
    WHERE s_suppkey IN (SELECT s_suppkey + 3 FROM supplier WHERE s_acctbal > 0)""")
NO_DATES = "CAST(NULL AS TIMESTAMP)"
NO_STATS = "CAST(NULL AS DOUBLE)"
add("table_profile", f"""
    SELECT 'quality_scores' AS table_name, row_count, p.* FROM (
      SELECT COUNT(*) AS row_count, MIN(evaluated_at) AS d0, MAX(evaluated_at) AS d1,
        MIN(score) AS s0, ROUND({units('score')} / CAST(1000000 * COUNT(score) AS DOUBLE), 9) AS s1, MAX(score) AS s2 FROM quality_scores) t,
    LATERAL (SELECT 'score_id,contact_id,agent_id,section_name,criteria_name,score,passed,reasoning,scored_by,evaluated_at'
        AS column_name, 'columns' AS kind, {NO_DATES} AS first_value, {NO_DATES} AS last_value,
        {NO_STATS} AS min_value, {NO_STATS} AS avg_value, {NO_STATS} AS max_value
      UNION ALL SELECT 'evaluated_at', 'dates', t.d0, t.d1, {NO_STATS}, {NO_STATS}, {NO_STATS}
      UNION ALL SELECT 'score', 'scores', {NO_DATES}, {NO_DATES}, t.s0, t.s1, t.s2) p""",
    "quality_scores")
add("daily_score_trend", f"""SELECT day, calls,
    {rounded('score_sum', 'scored * 1000000', 1)} AS avg_score FROM daily""",
    "calls", "call_summary", daily=DAILY)
add("issue_volume", """SELECT issue_category, calls,
    row_number() OVER (ORDER BY calls DESC, issue_category) = 1 AS is_top
    FROM (SELECT issue_category, COUNT(*) AS calls FROM call_summary
        WHERE issue_category IS NOT NULL GROUP BY issue_category)""", "call_summary")
add("prediction_accuracy", f"""SELECT actual, predicted, n,
    {percent('hits', 'total')} AS accuracy_pct
    FROM (SELECT *, CAST(SUM(n) OVER () AS BIGINT) AS total,
        CAST(SUM(CASE WHEN actual = predicted THEN n ELSE 0 END) OVER () AS BIGINT) AS hits
      FROM (SELECT issue_category AS actual, pred_issue_category AS predicted, COUNT(*) AS n
        FROM call_summary WHERE issue_category IS NOT NULL AND pred_issue_category IS NOT NULL
        GROUP BY 1, 2))""", "call_summary")

# Rankings, series, orderings, sets.

add("agent_leaderboard", f"""SELECT agent_id, team_name, skill_name, avg_score,
    rank() OVER (ORDER BY avg_score DESC NULLS LAST) AS score_rank FROM ({ROLLUP})""",
    "calls", "call_summary")
add("rolling_7d_score", f"""SELECT day, {rounded('s', 'n * 1000000', 1)} AS rolling_score
    FROM (SELECT day, CAST(SUM(score_sum) OVER w AS HUGEINT) AS s,
        CAST(SUM(scored) OVER w AS HUGEINT) AS n FROM daily
      WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))""",
    "calls", "call_summary", daily=DAILY)
add("kpi_day_delta", """SELECT d.day, d.calls, d.calls - b.calls AS change FROM daily d
    LEFT JOIN daily b ON b.day = d.day - INTERVAL 1 DAY""", "calls", "call_summary", daily=DAILY)
add("first_match_dedupe", """SELECT contact_id, evaluated_at, agent_id, criteria_name, score
    FROM quality_scores QUALIFY row_number() OVER (PARTITION BY contact_id
        ORDER BY evaluated_at, agent_id, criteria_name, score) = 1""", "quality_scores")
RULE_ORDER = "section_name NULLS LAST, effective_weight DESC NULLS LAST, criteria_name NULLS LAST"
add("rules_sort", f"SELECT * FROM rules ORDER BY {RULE_ORDER}", "rules")
add("topk_rules", f"""SELECT section_name, criteria_name, effective_weight, what_to_check, enabled,
    framework_id FROM rules WHERE enabled ORDER BY {RULE_ORDER}, framework_id LIMIT 5""", "rules")
add("leaderboard_sort", f"""SELECT * EXCLUDE (best_score, worst_score) FROM ({ROLLUP})
    ORDER BY avg_score DESC NULLS LAST, agent_id, team_name, skill_name LIMIT 20""",
    "calls", "call_summary")
add("worst_criteria_sort", f"""SELECT * FROM ({PASS_RATES})
    ORDER BY pass_rate, criteria_name, section_name LIMIT 3""", "quality_scores")
add("sample_rows", """SELECT contact_id, agent_id, contact_start FROM calls
    ORDER BY contact_id LIMIT 5""", "calls")
add("distinct_scored_calls", "SELECT DISTINCT contact_id FROM quality_scores", "quality_scores")
add("union_real_simulated", """SELECT contact_id, agent_id, contact_start, FALSE AS is_simulated
    FROM calls UNION ALL SELECT event_id, user_id, ts, TRUE FROM events""", "calls")
add("citation_dedupe", """SELECT doc_id, CASE
      WHEN source = 'src1' OR doc_id % 4 = 0 OR len(list_filter(ids, lambda i: contains(answer, i))) > 0
      THEN answer
      ELSE answer || chr(10) || chr(10) || 'Citations (Call IDs): '
        || array_to_string(ids[1:10], ', ') END AS answer
    FROM (SELECT doc_id, source,
        CASE WHEN doc_id % 4 = 0 THEN lang || ' call ' || (doc_id * 3) ELSE lang END AS answer,
        list_transform(range(0, 12), lambda i: CAST((doc_id + i) * 3 AS VARCHAR)) AS ids
      FROM documents)""")

# Model responses and batch inference.

SECOND = "(l_linenumber % 7 + 1)"
VERDICT = """'{{"section_name": "' || {0} || '", "criteria_name": "' || {1} || '"' || {2} || '}}'"""
FIRST = VERDICT.format(
    criterion(1, "l_linenumber"), criterion(2, "l_linenumber"),
    """', "passed": ' || CASE l_returnflag WHEN 'N' THEN 'true' WHEN 'R' THEN 'false'
       ELSE '"yes"' END || ', "reasoning": "it''s so"'""")
UNREADABLE = "l_tax IN (0.06e0, 0.07e0, 0.08e0)"
OTHER = VERDICT.format(criterion(1, SECOND), criterion(2, SECOND), "''")
ANSWER_BODY = f"'[' || {FIRST} || ', ' || {OTHER} || ']'"
add("parse_score_responses", f"""
    SELECT sha256(concat_ws('|', contact_id, agent_id, answer, no, copy)) AS score_id, contact_id,
      agent_id, section_name, criteria_name,
      CASE WHEN passed THEN COALESCE((SELECT effective_weight FROM rubric r
        WHERE r.criteria_name = v.criteria_name), 0e0) ELSE 0e0 END AS score,
      passed, reasoning, 'auditor' AS scored_by, {RUN} AS evaluated_at
    FROM (SELECT *, row_number() OVER (PARTITION BY contact_id, agent_id, answer, no) AS copy FROM (
      SELECT l_orderkey AS contact_id, l_suppkey AS agent_id, answer, 0 AS no,
        {criterion(1, 'l_linenumber')} AS section_name,
        {criterion(2, 'l_linenumber')} AS criteria_name,
        l_returnflag <> 'R' AS passed, 'it''s so' AS reasoning FROM answers
      UNION ALL SELECT l_orderkey, l_suppkey, answer, 1, {criterion(1, SECOND)},
        {criterion(2, SECOND)}, FALSE, '' FROM answers)) v""", "rubric",
    answers=f"""SELECT *, md5(CASE l_tax WHEN 0.05e0
        THEN '```json' || chr(10) || {ANSWER_BODY} || chr(10) || '```' ELSE {ANSWER_BODY} END) AS answer
      FROM lineitem WHERE NOT {UNREADABLE}""")
add("scored_calls_run", f"""SELECT t.contact_id, c.agent_id, r.criteria_name,
      r.effective_weight AS score, 'asked for an array' AS reasoning
    FROM transcripts t JOIN calls c ON c.contact_id = t.contact_id, (SELECT * FROM rubric WHERE enabled) r
    WHERE t.contact_id NOT IN (SELECT contact_id FROM quality_scores)""",
    "transcripts", "calls", "quality_scores", "rubric")
add("score_response_errors", f"""SELECT l_orderkey AS contact_id,
    CASE l_tax WHEN 0.08e0 THEN 'I cannot grade this.'
      WHEN 0.07e0 THEN '[1, ' || {FIRST} || ' ]'
      ELSE '[{{"section_name": "cut off ]' END AS content,
    CASE l_tax WHEN 0.08e0 THEN 'no array' ELSE 'not readable' END AS reason
    FROM lineitem WHERE {UNREADABLE}""")
BAD_SUMMARY = "(o_orderkey % 13 IN (0, 2) OR o_orderkey % 7 IN (3, 4))"
SUMMARY_BODY = """'{"issue_category": "' || o_orderpriority || '", "resolution": "' || o_orderstatus
    || '", "ai_recot": "call back"' || CASE o_orderkey % 7 WHEN 0 THEN ''
      WHEN 1 THEN ', "overall_score": 7.5' WHEN 2 THEN ', "overall_score": "8"'
      WHEN 3 THEN ', "overall_score": "7.5"' WHEN 4 THEN ', "overall_score": null'
      ELSE ', "overall_score": 9' END || '}'"""
add("parse_summary_responses", f"""SELECT o_orderkey AS contact_id,
    o_orderpriority AS issue_category, CAST(NULL AS VARCHAR) AS issue_description,
    o_orderstatus AS resolution, 'call back' AS ai_recommendation,
    CAST(CASE o_orderkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 9 END AS INT)
      AS overall_score FROM orders WHERE NOT {BAD_SUMMARY}""")
add("summary_response_errors", f"""SELECT o_orderkey AS contact_id, CASE o_orderkey % 13
    WHEN 0 THEN 'no answer' WHEN 1 THEN 'Sure:' || chr(10) || body || chr(10) || 'Done'
    WHEN 2 THEN body || ' }}' ELSE body END AS content
    FROM (SELECT *, {SUMMARY_BODY} AS body FROM orders) WHERE {BAD_SUMMARY}""")
READABLE = "lang IN ('en', 'de')"
add("parse_ai_summary", f"""SELECT doc_id AS contact_id,
    CASE WHEN {READABLE} THEN 'call ' || doc_id ELSE substring(text, 1, 1000) || {text(NOTE)} END
      AS summary,
    CASE WHEN {READABLE} THEN '["' || lang || '","polite"]' ELSE '[]' END AS strengths,
    '[]' AS improvements,
    CASE WHEN {READABLE} THEN '["' || source || '"]' ELSE '[]' END AS failed_criteria,
    NOT {READABLE} AS is_fallback FROM documents""")
add("lenient_json", """SELECT event_id, CASE WHEN event_type = 'error' THEN '{}'
    ELSE replace(props, ' ', '') END AS json FROM events""")
START = f"substring(full_text, 1, 800) || {text(NOTE)} AS summary"
add("fallback_summary", f"""SELECT contact_id, {START}, 'fallback' AS model_name, '[]' AS strengths,
    '[]' AS improvements, '[]' AS failed_criteria FROM transcripts
    WHERE full_text IS NOT NULL""", "transcripts")
add("model_inference_batch", f"""SELECT contact_id, {START} FROM transcripts
    WHERE full_text IS NOT NULL""", "transcripts")
add("assemble_model_input", f"""SELECT contact_id, {text(INSTRUCTION)} || 'Rubric:' || chr(10)
    || (SELECT rubric_text FROM ({RUBRIC_TEXT})) || chr(10) || chr(10) || 'Transcript:' || chr(10)
    || COALESCE(full_text, '') AS prompt FROM transcripts""", "transcripts", "rubric")
KEYWORDS = " UNION ALL ".join(
    f"SELECT 'R{i}' AS framework_id, {text(word)} AS word"
    for i, pair in enumerate(sample_keywords(), 1) for word in pair)
add("keyword_rubric_score", """SELECT contact_id, section_name, criteria_name, hits,
    hits >= 1 AS passed, CASE WHEN hits >= 1 THEN effective_weight ELSE 0e0 END AS score
    FROM (SELECT t.contact_id, r.section_name, r.criteria_name, r.effective_weight,
        CAST(SUM(CASE WHEN contains(lower(COALESCE(t.agent_text, '')), k.word) THEN 1 ELSE 0 END)
          AS BIGINT) AS hits
      FROM transcripts t, rubric r JOIN keywords k USING (framework_id) WHERE r.enabled
      GROUP BY ALL)""", "transcripts", "rubric", keywords=KEYWORDS)
MOOD = "CASE WHEN {0} > 0.05e0 THEN 'Positive' WHEN {0} < -0.05e0 THEN 'Negative' ELSE 'Neutral' END"
add("sentiment_label", f"""SELECT contact_id, {MOOD.format('agent')} AS sentiment_agent,
    {MOOD.format('customer')} AS sentiment_customer
    FROM (SELECT t.contact_id,
        CAST(SUM(polarity) FILTER (side = 'a') AS DOUBLE) / COUNT(polarity) FILTER (side = 'a') AS agent,
        CAST(SUM(polarity) FILTER (side = 'c') AS DOUBLE) / COUNT(polarity) FILTER (side = 'c') AS customer
      FROM transcripts t LEFT JOIN (
          SELECT contact_id, 'a' AS side, unnest({tokens('agent_text')}) AS token FROM transcripts
          UNION ALL
          SELECT contact_id, 'c', unnest({tokens('customer_text')}) FROM transcripts) w
        ON w.contact_id = t.contact_id LEFT JOIN lexicon l ON l.token = w.token
      GROUP BY t.contact_id)""", "transcripts",
    lexicon=f"""SELECT token, CAST(sign(SUM(vote)) AS INT) AS polarity
      FROM (SELECT unnest({tokens('text')}) AS token,
          CASE WHEN item_id % 2 = 0 THEN 1 ELSE -1 END AS vote FROM benchmark)
      GROUP BY token HAVING SUM(vote) <> 0""")

# Retrieval.


def pieces(source: str, columns: str, size: int, overlap: int, number: str) -> str:
    stride = size - overlap
    return f"""SELECT {columns}, CAST(i AS INT) AS {number},
        substring(text, CAST(i * {stride} + 1 AS BIGINT), {size}) AS text
      FROM (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(length(text) - {size}, 0) / {stride}e0)
          AS BIGINT))) AS i FROM {source} WHERE length(text) > 0)"""


CHUNKS = dict(
    docs="SELECT doc_id AS contact_id, text FROM documents",
    parents=pieces("docs", "contact_id", 2000, 200, "parent_no"),
    children=pieces("parents", "contact_id, parent_no", 400, 50, "child_no"),
)
LETTERS = [chr(97 + i) for i in range(26)]
COUNTS = [f"(length(text) - length(replace(text, '{c}', '')))" for c in LETTERS]
add("chunk_documents", "SELECT * FROM children", **CHUNKS)
add("embed_chunks", "SELECT contact_id, parent_no, child_no, concat_ws(',', "
    + ", ".join(COUNTS) + ") AS vector FROM children", **CHUNKS)
add("document_topk", """SELECT q.id AS query_id, d.id AS contact_id,
    CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
      AS DOUBLE) AS distance,
    CAST(row_number() OVER (PARTITION BY q.id ORDER BY distance, d.id) AS INT) AS hit_rank
    FROM queries q, corpus d QUALIFY hit_rank <= 7""",
    queries=f"SELECT item_id AS id, [{', '.join(COUNTS)}] AS v FROM benchmark",
    corpus=f"SELECT doc_id AS id, [{', '.join(COUNTS)}] AS v FROM documents")
add("vector_topk", """SELECT query_id, vec_id, ROUND(d, 6) AS distance, hit_rank FROM (
    SELECT q.query_id, e.vec_id,
      ROUND(list_sum(list_transform(list_zip(q.v, e.embedding),
        lambda z: (z[1] - CAST(z[2] AS DOUBLE)) * (z[1] - CAST(z[2] AS DOUBLE)))), 9) AS d,
      CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY d, e.vec_id) AS INT) AS hit_rank
    FROM centres q, embeddings e QUALIFY hit_rank <= 7)""",
    centres="""SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY pos) AS v
      FROM (SELECT label, pos, CAST(SUM(CAST(ROUND(CAST(x AS DOUBLE) * 1e6) AS BIGINT)) AS DOUBLE)
          / COUNT(*) / 1e6 AS m
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
          FROM embeddings) GROUP BY label, pos) GROUP BY label""")


def search(source: str, key: str) -> dict[str, str]:
    """The seven best rows of `source` per benchmark text, as part `hits`."""
    return dict(
        words=f"""SELECT {key}, len(t) AS length, unnest(t) AS term
          FROM (SELECT {key}, {tokens('text')} AS t FROM {source})""",
        asked=f"""SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term
          FROM benchmark""",
        postings=f"""SELECT {key}, length, term, COUNT(*) AS tf FROM words
          WHERE term IN (SELECT term FROM asked) GROUP BY ALL""",
        terms=f"""SELECT term, ln(((SELECT COUNT(*) FROM {source}) + 1) / CAST(COUNT(*) + 1 AS DOUBLE))
          + 1 AS idf FROM postings GROUP BY term""",
        hits=f"""SELECT query_id, {key}, s, CAST(row_number() OVER
            (PARTITION BY query_id ORDER BY s DESC, {key}) AS INT) AS hit_rank
          FROM (SELECT query_id, {key}, ROUND(SUM((1 + ln(tf)) * idf / sqrt(length)), 9) AS s
            FROM postings JOIN terms USING (term) JOIN asked USING (term)
            GROUP BY query_id, {key})
          QUALIFY hit_rank <= 7""",
    )


add("tfidf_search", "SELECT query_id, contact_id, ROUND(s, 6) AS score, hit_rank FROM hits",
    docs=CHUNKS["docs"], **search("docs", "contact_id"))
NAMED = "printf('%020d-%08d-%08d', contact_id, parent_no, child_no)"
add("child_to_parent", """SELECT query_id,
    string_agg(text, chr(10) || chr(10) ORDER BY place) AS context,
    string_agg(CAST(contact_id AS VARCHAR), ',' ORDER BY place) AS sources
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY best, contact_id, parent_no) AS place
        FROM (SELECT query_id, contact_id, parent_no, MIN(hit_rank) AS best
          FROM hits JOIN (SELECT * EXCLUDE (text) FROM named) USING (chunk_id)
          GROUP BY ALL))
    JOIN parents USING (contact_id, parent_no) WHERE place <= 3 GROUP BY query_id""",
    **CHUNKS, named=f"SELECT *, {NAMED} AS chunk_id FROM children", **search("named", "chunk_id"))
SQL["vector_topk_stored"] = SQL["vector_topk"]
SQL["indexed_search"] = SQL["tfidf_search"]
SQL["indexed_contexts"] = SQL["child_to_parent"]

# Features.

RESOLUTION_FRAME = f"""SELECT contact_id, resolution, total_duration_sec, agent_seconds, acw_seconds,
    in_queue_seconds, hold_seconds, CAST(hold_count AS DOUBLE) AS hold_count,
    CAST(agent_word_count AS DOUBLE) AS agent_word_count,
    CAST(customer_word_count AS DOUBLE) AS customer_word_count,
    COALESCE(talk_ratio, 0e0) AS talk_ratio, overall_score,
    CAST({SENTIMENT.format('sentiment_agent')} AS DOUBLE) AS sentiment_agent_num,
    CAST({SENTIMENT.format('sentiment_customer')} AS DOUBLE) AS sentiment_customer_num,
    CAST({SLA} AS DOUBLE) AS sla_met, CAST({ISSUE_NO} AS DOUBLE) AS issue_num,
    CAST(is_abandoned AS DOUBLE) AS is_abandoned, CAST(is_outbound AS DOUBLE) AS is_outbound
  FROM training WHERE resolution IS DISTINCT FROM 'Abandoned'"""
SCALED = (
    "total_duration_sec", "agent_seconds", "acw_seconds", "in_queue_seconds", "hold_seconds",
    "hold_count", "agent_word_count", "customer_word_count", "talk_ratio", "overall_score",
    "sentiment_agent_num", "sentiment_customer_num", "sla_met", "issue_num", "is_abandoned",
    "is_outbound",
)


def scaled(column: str) -> str:
    value = f"CAST({column} AS DOUBLE)"
    mean, spread = f"AVG({value}) OVER ()", f"stddev_pop({value}) OVER ()"
    constant = f"{spread} <= 1e-12 * ABS({mean})"
    return (f"ROUND(({value} - {mean}) / CASE WHEN {constant} THEN 1 ELSE {spread} END, 6) + 0"
            f" AS {column}")


# The default English stop words of Spark's StopWordsRemover that a token can equal.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did doing a
    an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor
    not only own same so than too very s t can will just don should now
    cannot could ought would""".split()
add("tfidf_features", """SELECT contact_id, term, ROUND(w / norm, 6) AS weight
    FROM (SELECT *, sqrt(SUM(w * w) OVER (PARTITION BY contact_id)) AS norm
      FROM (SELECT contact_id, term, (1 + ln(tf))
          * (ln(((SELECT COUNT(*) FROM texts) + 1) / CAST(df + 1 AS DOUBLE)) + 1) AS w
        FROM counts JOIN kept USING (term)))""", *THREE, training=TRAINING,
    texts=f"""SELECT contact_id, list_filter(regexp_extract_all(lower(COALESCE(customer_text, '')
          || ' ' || COALESCE(agent_text, '')), '[{WORD}]{{2,}}'),
          lambda x: NOT list_contains({STOP_WORDS}, x)) AS t
      FROM training WHERE issue_category IS NOT NULL""",
    grams="""SELECT contact_id, unnest(t) AS term FROM texts UNION ALL
      SELECT contact_id, unnest(list_transform(range(1, len(t)),
        lambda i: t[i] || ' ' || t[i + 1])) FROM texts""",
    counts="SELECT contact_id, term, COUNT(*) AS tf FROM grams GROUP BY ALL",
    kept="""SELECT term, COUNT(*) AS df FROM counts GROUP BY term
      ORDER BY SUM(tf) DESC, term LIMIT 300""")
add("numeric_features", RESOLUTION_FRAME, *THREE, training=TRAINING)
add("standard_scale", "SELECT contact_id, " + ", ".join(scaled(c) for c in SCALED) + " FROM frame",
    *THREE, training=TRAINING, frame=RESOLUTION_FRAME)
add("label_encode", """SELECT contact_id, dense_rank() OVER (ORDER BY resolution) - 1 AS label
    FROM call_summary WHERE resolution <> 'Abandoned'""", "call_summary")
add("onehot_campaign", """SELECT contact_id, repeat('0', CAST(no - 1 AS INT)) || '1'
      || repeat('0', CAST(k - no AS INT)) AS flags
    FROM (SELECT contact_id, dense_rank() OVER (ORDER BY name) AS no,
        (SELECT COUNT(DISTINCT COALESCE(campaign_name, 'Unknown')) FROM calls) AS k
      FROM (SELECT contact_id, COALESCE(campaign_name, 'Unknown') AS name FROM calls))""", "calls")
add("balanced_weights", """SELECT contact_id, issue_category, CAST(n AS DOUBLE) / (k * c) AS class_weight
    FROM (SELECT contact_id, issue_category, COUNT(*) OVER () AS n,
        COUNT(*) OVER (PARTITION BY issue_category) AS c,
        (SELECT COUNT(DISTINCT issue_category) FROM call_summary) AS k
      FROM call_summary WHERE issue_category IS NOT NULL)""", "call_summary")
add("stream_daily_metrics", f"""SELECT CAST(contact_start AS DATE) AS day, issue_category,
    COUNT(*) AS calls, {average('overall_score', 1)} AS avg_score
    FROM {JOINED} GROUP BY 1, 2""",
    "calls", "call_summary")
COVER = """SELECT contact_id, issue_category AS actual, TRUE AS is_predicted,
    issue_category IS NOT NULL AS is_judged, TRUE AS has_confidence FROM training"""
add("predict_issue_cover", COVER, *THREE, training=TRAINING)
add("predict_resolution_cover", """SELECT contact_id, resolution AS actual_resolution,
    TRUE AS is_predicted, resolution IS NOT NULL AS is_judged, overall_score
    FROM training WHERE resolution IS DISTINCT FROM 'Abandoned'""", *THREE, training=TRAINING)
add("saved_model_meta", """SELECT CAST(dense_rank() OVER (ORDER BY resolution) - 1 AS INT) AS place,
    resolution AS label, (SELECT COUNT(*) FROM known) AS trained_on, CAST(16 AS INT) AS n_columns
    FROM (SELECT DISTINCT resolution FROM known)""", *THREE, training=TRAINING,
    known="SELECT * FROM training WHERE resolution <> 'Abandoned'")
add("summary_predictions", """SELECT s.contact_id, s.issue_category, s.resolution,
    t.contact_id IS NOT NULL AS has_issue,
    t.contact_id IS NOT NULL AND s.resolution IS DISTINCT FROM 'Abandoned' AS has_resolution
    FROM call_summary s LEFT JOIN training t ON s.contact_id = t.contact_id""", *THREE, training=TRAINING)
add("stream_transcripts", """SELECT contact_id, agent_text, customer_text, talk_ratio FROM transcripts
    WHERE contact_id % 41 <> 0""", "transcripts")
add("stream_talk_log", f"SELECT {LOG_ID}, * FROM log", "transcripts",
    log="SELECT * FROM (" + TALK_ISSUES + ") t(contact_id, field_name, issue_type, issue_description, severity)")
