"""Independent SQL of the end of the monitor: diagnoses, the incidents folded from them, their transitions and the evidence they keep.

Built on the expressions of ``oracle``. Those that read the confirmed drops are taken again over the causes found (``again``). The fold is
a recursive expression that carries each root's list of unresolved incidents from event to event.

A signal that no cause explains would be searched for on its own (a rescue). This SQL does not search again; it adds a row named
``rescue`` for every such signal, so that the comparison fails where the data have one. The order of rescues has its tests.
"""

from __future__ import annotations

import re

from dipwatch import catalogs as C
from dipwatch.plans import oracle as O

_WILD = " AND ".join(f"(f.{d} IS NULL OR f.{d} = r.{d})" for d in ("provider_id", "payment_method", "issuer_id"))
_NARROW = "(provider_id IS NOT NULL)::INT + (payment_method IS NOT NULL)::INT + (issuer_id IS NOT NULL)::INT"
_ORDER = "CASE split WHEN 'root' THEN 0 WHEN 'provider' THEN 1 WHEN 'issuer' THEN 2 ELSE 3 END"
_AT = "TIMESTAMP '1970-01-01 00:00:00' + to_minutes({0}::INTEGER)"


def again(names: list[str], swap: dict[str, str], suffix: str) -> list[tuple[str, str]]:
    """The named expressions once more, over other tables; they refer to each other under their new names."""
    swap = swap | {n: n + suffix for n in names}
    pattern = re.compile(r"\b(" + "|".join(swap) + r")\b")
    return [(n + suffix, pattern.sub(lambda m: swap[m[1]], O.TEXT[n])) for n in names]


_CAUSES = " UNION ALL ".join(
    f"SELECT c.pid, {r} AS peel_no, c.bucket, c.merchant_id, c.country, c.p AS provider_id, c.m AS payment_method, c.i AS issuer_id, c.n, c.k,"
    f" c.e, c.explained, c.delta_pp, t.streak FROM causal{r} c JOIN roots_down t ON t.bucket = c.bucket AND t.merchant_id = c.merchant_id"
    " AND t.country = c.country" for r in (1, 2, 3))
DIAGNOSIS = [
    ("roots_down",
     "SELECT x.*, expected_conversion AS goal, delta_pp FROM (SELECT bucket, merchant_id, country, max(streak) AS streak, arg_min({'n': attempts,"
     f" 'k': approved, 'e': e}}, row({_NARROW}, {_ORDER}, cell_key)) AS s FROM confirmed GROUP BY bucket, merchant_id, country) x"
     " JOIN merchants USING (merchant_id)"),
    ("causes_found", _CAUSES),
    ("left_out",
     f"SELECT s.* FROM confirmed s WHERE {_NARROW} > 0 AND EXISTS (SELECT 1 FROM causes_found c WHERE c.bucket = s.bucket AND c.merchant_id ="
     " s.merchant_id AND c.country = s.country) AND NOT EXISTS (SELECT 1 FROM causes_found c WHERE c.bucket = s.bucket AND c.merchant_id ="
     " s.merchant_id AND c.country = s.country AND " + " AND ".join(
         f"(c.{d} IS NULL OR s.{d} IS NULL OR c.{d} = s.{d})" for d in ("provider_id", "payment_method", "issuer_id")) + ")"),
    ("found_all",
     "SELECT pid || '#' || peel_no AS request_id, pid, peel_no, 'peel' AS origin, 'CONFIRMED' AS confidence, bucket, merchant_id, provider_id, country,"
     " payment_method, issuer_id, n AS attempts, k AS approved, CAST(k AS DOUBLE) / n AS observed, e AS expected, explained, e, delta_pp"
     f" FROM causes_found UNION ALL SELECT pid || '#0', pid, 0, 'root', 'INCONCLUSIVE', bucket, merchant_id, NULL, country, NULL, NULL, s.n, s.k,"
     " CAST(s.k AS DOUBLE) / s.n, s.e, greatest(0.0, s.n * goal - s.k), goal, delta_pp FROM (SELECT *, " + O.MINUTE + " || '@' || merchant_id || '@'"
     " || country AS pid FROM roots_down) t WHERE NOT EXISTS (SELECT 1 FROM causes_found c WHERE c.bucket = t.bucket AND c.merchant_id ="
     " t.merchant_id AND c.country = t.country)"),
    ("asked_all", "SELECT * FROM found_all WHERE confidence = 'CONFIRMED'"),
    ("walk_all",
     "SELECT f.request_id, f.bucket, f.e - f.delta_pp / 100 AS lim, s.bucket AS sb, coalesce(sum(r.attempts), 0) AS sn, coalesce(sum(r.approved), 0)"
     " AS sk FROM found_all f JOIN spine s ON s.bucket BETWEEN f.bucket - INTERVAL 120 MINUTE AND f.bucket LEFT JOIN rollup r ON r.bucket = s.bucket"
     f" AND r.merchant_id = f.merchant_id AND r.country = f.country AND {_WILD} GROUP BY f.request_id, f.bucket, f.e, f.delta_pp, s.bucket"),
    *again(["good", "run", "onset"], {"walk": "walk_all"}, "_all"),
    *again(["ages", "mixwin", "shifts", "lead", "dominant"], {"confirmed": "asked_all"}, "_all"),
    ("priced_all", O.impact_body(
        "SELECT f.request_id, f.merchant_id, f.provider_id, f.country, f.payment_method, f.issuer_id, f.bucket, f.e, o.started_at FROM"
        " found_all f JOIN onset_all o USING (request_id)")),
    ("spread_all",
     "SELECT request_id, CASE WHEN total = 0 THEN 'INCONCLUSIVE' WHEN other = 0 THEN CASE WHEN providers >= 2 THEN 'RAIL' ELSE 'INCONCLUSIVE' END"
     " WHEN providers = 1 AND issuers >= 2 THEN 'PROVIDER' WHEN issuers = 1 AND providers >= 2 THEN 'ISSUER' ELSE 'INCONCLUSIVE' END AS attribution"
     " FROM (SELECT c.request_id, count(d.bucket) AS total, count(DISTINCT d.provider_id) AS providers, count(DISTINCT d.issuer_id) FILTER"
     " (d.issuer_id <> 'NA') AS issuers, count(*) FILTER (d.payment_method <> 'PIX') AS other FROM asked_all c JOIN dominant_all o USING (request_id)"
     " LEFT JOIN declines d ON d.merchant_id = c.merchant_id AND d.country = c.country AND d.decline_code = o.dominant_code AND d.bucket <= c.bucket"
     " AND d.bucket > c.bucket - to_minutes(CAST(o.window_min AS INTEGER)) WHERE o.dominant_code IN ('91', 'AB03') GROUP BY c.request_id)"),
    ("echoed_all", f"SELECT pid || '#' || peel_no AS request_id, count(*) AS echo_count FROM ({O.ECHOES}) GROUP BY ALL"),
    ("diagnosed",
     "SELECT f.*, epoch(f.bucket)::BIGINT // 60 AS minute, " + O.key_sql("f.") + " AS cell_key, o.started_at, o.started_at_exact, p.lost_approvals,"
     " p.cost_usd_minor, p.priority_score, p.cost_usd_per_min, d.dominant_code, d.dominant_family, s.attribution, coalesce(x.echo_count, 0) AS echo_count,"
     " CASE WHEN attribution = 'PROVIDER' THEN 'provider' WHEN attribution = 'ISSUER' THEN 'issuer' WHEN issuer_id IS NOT NULL THEN 'issuer'"
     " WHEN provider_id IS NOT NULL THEN 'provider' WHEN payment_method IS NOT NULL THEN 'method' ELSE 'merchant' END AS causal_dimension"
     " FROM found_all f JOIN onset_all o USING (request_id) JOIN priced_all p USING (request_id) LEFT JOIN dominant_all d USING (request_id)"
     " LEFT JOIN spread_all s USING (request_id) LEFT JOIN echoed_all x USING (request_id)"),
    ("shown_all",
     "SELECT merchant_id, country, minute, 0 AS kind, row_number() OVER (PARTITION BY merchant_id, country, minute ORDER BY priority_score DESC,"
     " cell_key) AS ord, provider_id AS p, payment_method AS m, issuer_id AS i, request_id, sha256(concat_ws('|', merchant_id, country,"
     " minute::VARCHAR, cell_key)) AS id, CAST([] AS VARCHAR[]) AS thin FROM diagnosed"),
    *again(["events_in_order", "folded"], {"shown": "shown_all"}, "_all"),
    ("logged",
     "SELECT merchant_id, country, minute, row(rn, pos) AS seq, x.id AS incident_id, x.act AS action, x.p AS provider_id, x.m AS payment_method,"
     " x.i AS issuer_id, CASE WHEN x.act IN ('opened', 'updated', 'refreshed') THEN request_id END AS request_id FROM (SELECT merchant_id, country,"
     " minute, rn, request_id, unnest(said) AS x, generate_subscripts(said, 1) AS pos FROM folded_all)"),
]

_STATUS = "CASE WHEN last = 'opened' THEN 'open' WHEN last IN ('updated', 'refreshed') THEN 'monitoring' ELSE last END"
_BOOKS = C.playbooks_sql().replace("causal_dimension", "pd")


def full(final: str) -> str:
    return O.sql(final, DIAGNOSIS).replace("WITH ", "WITH RECURSIVE ", 1)


_AXES = ("provider_id", "payment_method", "issuer_id")
_STEPS = " UNION ALL ".join(
    f"SELECT request_id, {at} AS seq, 'query_conversion_slice' AS tool_name, 'DRILL_DOWN' AS decision_tag, '{axis}' AS axis, d.{axis} AS fixed_value,"
    f" count(DISTINCT r.{axis})::INTEGER AS siblings, CASE WHEN d.{axis} IS NULL THEN 'Compared siblings for {axis} under the current root.' ELSE"
    f" 'Fixed {axis}=' || d.{axis} || ' after comparing sibling conversion rates.' END AS decision_summary FROM diagnosed d JOIN rollup r ON"
    " r.bucket = d.bucket AND r.merchant_id = d.merchant_id AND r.country = d.country"
    + "".join(f" AND (d.{b} IS NULL OR d.{b} = r.{b})" for b in _AXES[:at])
    + f" WHERE d.{axis} IS NOT NULL OR coalesce(d.provider_id, d.payment_method, d.issuer_id) IS NULL GROUP BY request_id, d.{axis}"
    for at, axis in enumerate(_AXES))
_CHECKS = " UNION ALL ".join(
    f"SELECT request_id, {at}, '{tool}', '{tag}', NULL, NULL, NULL, '{text}' FROM {of}"
    for at, tool, tag, text, of in (
        (10, "run_residual_test", "VALIDATE_RESIDUAL", "Validated that the selected cell explains the residual deficit.", "diagnosed"),
        (11, "query_decline_mix", "CHECK_DECLINE_MIX", "Checked the decline-code mix shift for diagnostic evidence.",
         "mixwin_all WHERE total > 0")))

DIAGNOSIS_SQL = {
    "q68_trail": full(
        "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY seq)::INTEGER AS step_no, tool_name, decision_tag, axis, fixed_value,"
        f" siblings, decision_summary FROM ({_STEPS} UNION ALL {_CHECKS})"),
    "q27_diagnoses": full(
        "SELECT request_id, bucket, cell_key, confidence, origin, causal_dimension, attempts, approved, round(observed, 8) AS observed_rate,"
        " round(expected, 8) AS expected_rate, round(explained, 8) AS explained_deficit, started_at, started_at_exact, lost_approvals, cost_usd_minor,"
        " priority_score, dominant_code, attribution, echo_count::INTEGER AS echo_count FROM diagnosed UNION ALL SELECT 'rescue', bucket, cell_key, NULL, 'rescue',"
        " NULL, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM left_out"),
    "q33_incidents": full(
        "SELECT incident_id, " + _STATUS + " AS status, w_key AS cell_key, d.cell_key || coalesce('#' || dominant_code, '') AS fingerprint, "
        + _AT.format("opened") + " AS opened_at, " + _AT.format("seen") + " AS detected_at, CASE WHEN last = 'resolved' THEN " + _AT.format("over")
        + " END AS resolved_at, started_at, lost_approvals, cost_usd_minor, round(d.cost_usd_per_min)::BIGINT AS cost_usd_per_min, playbook_id FROM"
        " (SELECT incident_id, arg_max(action, seq) AS last, min(minute) AS opened, max(minute) FILTER (action IN ('opened', 'updated', 'refreshed'))"
        " AS seen, max(minute) FILTER (action = 'resolved') AS over, arg_max(request_id, seq) FILTER (action IN ('opened', 'updated')) AS request_id,"
        " arg_max(" + O.key_sql() + ", seq) FILTER (action IN ('opened', 'updated')) AS w_key FROM logged GROUP BY incident_id) i"
        " JOIN diagnosed d USING (request_id) LEFT JOIN (" + _BOOKS + ") b ON b.pd = CASE WHEN causal_dimension = 'method' THEN 'payment_method'"
        " ELSE causal_dimension END QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN decline_family IS NULL OR decline_family ="
        " dominant_family THEN 0 ELSE 1 END, file_order) = 1"),
    "q34_transitions": full(
        "SELECT " + _AT.format("minute") + " AS bucket, incident_id, action AS to_status FROM logged WHERE action IN ('resolved', 'inconclusive')"),
    "q67_evidence_precedence": full(
        "SELECT incident_id, accepted, coalesce(agent, newest) AS evidence_request, CASE WHEN agent IS NULL THEN 'beam_search' ELSE 'agent' END AS"
        " diagnosis_source FROM (SELECT incident_id, count(*) FILTER (kind = 1) AS accepted, arg_max(request_id, row(minute, kind, request_id)) FILTER"
        " (kind = 1) AS agent, arg_max(request_id, row(minute, kind, request_id)) AS newest FROM (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION"
        " BY incident_id ORDER BY minute, kind, request_id ROWS UNBOUNDED PRECEDING) AS h FROM (SELECT incident_id, minute, 0 AS kind, request_id,"
        " {'p': provider_id, 'm': payment_method, 'i': issuer_id} AS c, NULL AS provider_id, NULL AS payment_method, NULL AS issuer_id FROM logged"
        " WHERE action IN ('opened', 'updated') UNION ALL SELECT l.incident_id, l.minute, 1, 'agent@' || s.minute || '@' || s.cell_key, NULL,"
        " s.provider_id, s.payment_method, s.issuer_id FROM confirmed s JOIN (SELECT DISTINCT incident_id, minute, merchant_id, country FROM logged"
        " WHERE action IN ('opened', 'updated', 'refreshed')) l ON l.minute = s.minute AND l.merchant_id = s.merchant_id AND l.country = s.country))"
        " WHERE h IS NOT NULL AND (kind = 0 OR ((h.p IS NULL OR provider_id IS NULL OR h.p = provider_id) AND (h.m IS NULL OR payment_method IS NULL OR"
        f" h.m = payment_method) AND (h.i IS NULL OR issuer_id IS NULL OR h.i = issuer_id) AND {_NARROW} >= (h.p IS NOT NULL)::INT"
        " + (h.m IS NOT NULL)::INT + (h.i IS NOT NULL)::INT)) GROUP BY incident_id)"),
}
