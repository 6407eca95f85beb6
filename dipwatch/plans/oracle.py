"""Independent ANSI SQL for the registered queries, over the same source tables.

Each entry is one SELECT built from common table expressions. The formulation
is deliberately a different one from the DataFrame plans: plain range joins and
per-key windows where those are blocked, unrolled rounds where those iterate.
"""

from __future__ import annotations

from dipwatch import catalogs as C
from dipwatch.operators.report import COUNTRY_NAMES
from dipwatch.plans.queries import FAULT_COLUMNS, FAULTS
from dipwatch.sources import payments as P

START = "TIMESTAMP '2026-08-30 12:00:00'"


def case_ladder(value: str, ranges) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {end} THEN '{code}'" for end, code in ranges) + " END"


def pick(index: str, names) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def wilson_sql(k: str, n: str, z: str) -> tuple[str, str]:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    d = f"(1 + {z} * {z} / {n})"
    mid = f"({p} + {z} * {z} / (2.0 * {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})))"
    low = f"(CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, ({mid} - {half}) / {d}) END)"
    high = f"(CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, ({mid} + {half}) / {d}) END)"
    return low, high


def state_sql(k: str, n: str, e: str, delta: str, z: str) -> str:
    low, high = wilson_sql(k, n, z)
    limit = f"({e} - {delta} / 100)"
    return (
        f"CASE WHEN {e} IS NULL THEN NULL WHEN {high} < {limit} THEN 'MATERIAL_DROP' WHEN {low} > {limit} THEN 'HEALTHY'"
        f" WHEN {n} < 30 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'MONITORING' END"
    )


def key_sql(p: str = "") -> str:
    names = (("country", "country"), ("issuerId", "issuer_id"), ("merchantId", "merchant_id"),
             ("paymentMethod", "payment_method"), ("providerId", "provider_id"))
    return "concat_ws('|', " + ", ".join(f"'{n}=' || {p}{c}" for n, c in names) + ")"


def z_sql(m: str) -> str:
    per = f"(1 - pow(0.95, 1.0 / {m}))"
    p = f"(1 - {per} / 2)"
    center = (
        "(((((-39.69683028665376*r+220.9460984245205)*r-275.9285104469687)*r+138.357751867269)*r-30.66479806614716)*r"
        "+2.506628277459239)*q/(((((-54.47609879822406*r+161.5858368580409)*r-155.6989798598866)*r+66.80131188771972)*r"
        "-13.28068155288572)*r+1)"
    ).replace("r", "RR").replace("q", "QQ").replace("RR", f"(({p}-0.5)*({p}-0.5))").replace("QQ", f"({p}-0.5)")
    t = f"sqrt(-2*ln(1-{p}))"
    tail = (
        "-((((((-0.007784894002430293*T-0.3223964580411365)*T-2.400758277161838)*T-2.549732539343734)*T"
        "+4.374664141464968)*T+2.938163982698783)/((((0.007784695709041462*T+0.3224671290700398)*T+2.445134137142996)*T"
        "+3.754408661907416)*T+1))"
    ).replace("T", t)
    return f"CASE WHEN {m} < 1 THEN 1.96 WHEN {p} <= 0.97575 THEN {center} ELSE {tail} END"


DIMS = "merchant_id, provider_id, country, payment_method, issuer_id"
ISSUER = " ".join(
    f"WHEN country = '{c}' THEN {pick('((l_suppkey // 3) % 3)', names)}" for c, names in P.ISSUERS_BY_COUNTRY.items()
)


def _payment_ctes(suffix: str, source: str) -> list[tuple[str, str]]:
    s = suffix
    return [
        (f"pa{s}", f"SELECT *, l_orderkey % 30 AS m, {pick('(l_suppkey % 3)', ('BR', 'MX', 'AR'))} AS country FROM {source}"),
        (f"pb{s}", "SELECT *, country || '_STORE_0' || CAST(1 + l_partkey % 3 AS VARCHAR) AS merchant_id,"
                   f" {pick('(l_linenumber % 3)', ('mercado_pago', 'stripe', 'adyen'))} AS provider_id,"
                   " CASE WHEN country = 'BR' AND (l_partkey // 3) % 4 = 0 THEN 'PIX' ELSE 'CARD' END AS payment_method,"
                   " (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17) % 1000 AS u"
                   f" FROM pa{s}"),
        (f"pc{s}", f"SELECT *, CASE WHEN payment_method = 'PIX' THEN 'NA' {ISSUER} END AS issuer_id,"
                   f" (u * 37 + l_partkey) % 1000 AS v, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor FROM pb{s}"),
        (f"pd{s}", "SELECT *, CASE WHEN merchant_id = 'BR_STORE_01' AND provider_id = 'stripe' AND issuer_id = 'itau' AND m"
                   " BETWEEN 12 AND 20 THEN 1 WHEN merchant_id = 'MX_STORE_02' AND issuer_id = 'bbva_mx' AND m BETWEEN 15"
                   f" AND 24 THEN 2 ELSE 0 END AS fault FROM pc{s}"),
        (f"tx{s}", f"SELECT transaction_id, {START} + to_minutes(CAST(m AS INTEGER)) AS bucket, {DIMS}, amount_minor,"
                   " amount_minor * CASE country WHEN 'AR' THEN 1 WHEN 'MX' THEN 55 ELSE 180 END // 1000 AS amount_usd_minor,"
                   " u >= CASE fault WHEN 1 THEN 850 WHEN 2 THEN 700 ELSE 100 END AS ok,"
                   " CASE WHEN u >= CASE fault WHEN 1 THEN 850 WHEN 2 THEN 700 ELSE 100 END THEN NULL"
                   f" WHEN payment_method = 'PIX' THEN {case_ladder('v', P.PIX_CODES)}"
                   " WHEN fault = 1 AND v < 750 THEN '05' WHEN fault = 2 AND v < 700 THEN '91'"
                   f" ELSE {case_ladder('v', P.CARD_CODES)} END AS decline_code FROM pd{s}"),
    ]


CTES: list[tuple[str, str]] = [
    ("lines", "SELECT l_orderkey * 10 + l_linenumber AS transaction_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,"
              " l_extendedprice FROM lineitem"),
    ("firsts", "SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY l_partkey, l_suppkey,"
               " l_extendedprice) = 1"),
    *_payment_ctes("", "firsts"),
    *_payment_ctes("_raw", "lines"),
    ("rollup", f"SELECT bucket, {DIMS}, count(*) AS attempts, count(*) FILTER (ok) AS approved,"
               " CAST(sum(amount_minor) AS BIGINT) AS amount_minor_sum, CAST(sum(amount_usd_minor) AS BIGINT) AS amount_usd_sum,"
               " CAST(coalesce(sum(amount_usd_minor) FILTER (ok), 0) AS BIGINT) AS approved_usd_sum FROM tx"
               f" GROUP BY bucket, {DIMS}"),
    ("declines", f"SELECT bucket, {DIMS}, decline_code, count(*) AS declines FROM tx WHERE NOT ok GROUP BY bucket, {DIMS}, decline_code"),
    ("merchants", C.merchants_sql()),
    ("coverage", C.coverage_sql()),
    ("codes", C.codes_sql()),
    ("spine", "SELECT DISTINCT bucket FROM rollup"),
    ("slices",
     "SELECT bucket, 'root' AS split, merchant_id, NULL AS provider_id, country, NULL AS payment_method, NULL AS issuer_id,"
     " CAST(sum(attempts) AS BIGINT) AS n, CAST(sum(approved) AS BIGINT) AS k FROM rollup GROUP BY bucket, merchant_id, country"
     " UNION ALL SELECT bucket, 'provider', merchant_id, provider_id, country, NULL, NULL, CAST(sum(attempts) AS BIGINT),"
     " CAST(sum(approved) AS BIGINT) FROM rollup GROUP BY bucket, merchant_id, country, provider_id"
     " UNION ALL SELECT bucket, 'issuer', merchant_id, NULL, country, 'CARD', issuer_id, CAST(sum(attempts) AS BIGINT),"
     " CAST(sum(approved) AS BIGINT) FROM rollup WHERE payment_method = 'CARD' GROUP BY bucket, merchant_id, country, issuer_id"
     " UNION ALL SELECT bucket, 'method', merchant_id, NULL, country, payment_method, NULL, CAST(sum(attempts) AS BIGINT),"
     " CAST(sum(approved) AS BIGINT) FROM rollup WHERE country = 'BR' GROUP BY bucket, merchant_id, country, payment_method"),
    ("covered",
     "SELECT s.*, CASE WHEN split IN ('root', 'issuer') THEN true WHEN split = 'provider' THEN EXISTS (SELECT 1 FROM coverage c"
     " WHERE c.country = s.country AND c.provider_id = s.provider_id) ELSE EXISTS (SELECT 1 FROM coverage c WHERE"
     " c.country = s.country AND c.payment_method = s.payment_method) END AS is_covered FROM slices s"),
    ("windowed",
     f"SELECT *, {key_sql()} AS cell_key, sum(n) OVER p - n AS sn, sum(k) OVER p - k AS sk, count(*) FILTER (is_covered) OVER p AS sibs,"
     " sum(n) OVER h AS hn, sum(k) OVER h AS hk, CAST(sum(n) OVER w AS BIGINT) AS wn, CAST(sum(k) OVER w AS BIGINT) AS wk"
     " FROM covered WINDOW p AS (PARTITION BY bucket, merchant_id, country, split),"
     f" h AS (PARTITION BY split, {DIMS} ORDER BY bucket RANGE BETWEEN INTERVAL 120 MINUTE PRECEDING AND INTERVAL 1 MINUTE PRECEDING),"
     f" w AS (PARTITION BY split, {DIMS} ORDER BY bucket RANGE BETWEEN INTERVAL 4 MINUTE PRECEDING AND CURRENT ROW)"),
    ("hyp",
     "SELECT w.*, delta_pp, CASE WHEN split = 'root' THEN expected_conversion END AS ea,"
     " CASE WHEN split <> 'root' AND sibs >= 2 AND sn > 0 THEN CAST(sk AS DOUBLE) / sn END AS ec,"
     " CASE WHEN split <> 'root' AND hn >= 30 THEN CAST(hk AS DOUBLE) / hn END AS et"
     " FROM windowed w JOIN merchants USING (merchant_id) WHERE is_covered"),
    ("fam", f"SELECT bucket, m, {z_sql('m')} AS z FROM (SELECT bucket, count(ea) + count(ec) + count(et) AS m FROM hyp GROUP BY bucket)"),
    ("judged",
     f"SELECT h.*, z, {state_sql('k', 'n', 'ea', 'delta_pp', 'z')} AS sa, {state_sql('k', 'n', 'ec', 'delta_pp', 'z')} AS sc,"
     f" {state_sql('k', 'n', 'et', 'delta_pp', 'z')} AS st FROM hyp h JOIN fam USING (bucket)"
     " WHERE coalesce(ea, ec, et) IS NOT NULL"),
    ("chosen",
     "SELECT *, CASE src WHEN 'absolute' THEN ea WHEN 'cross_sectional' THEN ec ELSE et END AS e,"
     " CASE src WHEN 'absolute' THEN sa WHEN 'cross_sectional' THEN sc ELSE st END AS s1 FROM (SELECT *,"
     " CASE WHEN sa IS NOT NULL THEN 'absolute' WHEN sc IS NOT NULL AND (st IS NULL OR sc = 'MATERIAL_DROP' OR sc = st)"
     " THEN 'cross_sectional' ELSE 'temporal' END AS src FROM judged)"),
    ("retried",
     f"SELECT *, (s1 = 'MATERIAL_DROP' AND n < 30) AS retry, {state_sql('wk', 'wn', 'e', 'delta_pp', 'z')} AS sw FROM chosen"),
    ("readings",
     "SELECT *, CASE WHEN is_gap THEN 'gap' ELSE 'reading' END AS kind, CASE WHEN is_gap THEN 'INSUFFICIENT_EVIDENCE' ELSE s1 END AS state,"
     " CASE WHEN retry THEN wn ELSE n END AS attempts, CASE WHEN retry THEN wk ELSE k END AS approved,"
     " CASE WHEN retry AND NOT is_gap THEN '5m' ELSE '1m' END AS window_used,"
     f" CASE WHEN retry AND NOT is_gap THEN {wilson_sql('wk', 'wn', 'z')[0]} ELSE {wilson_sql('k', 'n', 'z')[0]} END AS ci_low,"
     f" CASE WHEN retry AND NOT is_gap THEN {wilson_sql('wk', 'wn', 'z')[1]} ELSE {wilson_sql('k', 'n', 'z')[1]} END AS ci_high"
     " FROM (SELECT *, s1 = 'INSUFFICIENT_EVIDENCE' OR (retry AND NOT (sw = 'MATERIAL_DROP' AND wn >= 30)) AS is_gap FROM retried)"),
    ("islands",
     "SELECT *, sum(CASE WHEN state <> 'MATERIAL_DROP' THEN 1 ELSE 0 END) OVER (PARTITION BY cell_key ORDER BY bucket) AS g,"
     " lead(bucket) OVER (PARTITION BY cell_key ORDER BY bucket) AS until_bucket FROM readings WHERE kind = 'reading'"),
    ("streaks",
     "SELECT *, CASE WHEN state = 'MATERIAL_DROP' THEN count(*) FILTER (state = 'MATERIAL_DROP') OVER i ELSE 0 END AS streak,"
     " min(bucket) FILTER (state = 'MATERIAL_DROP') OVER i AS first_bucket"
     " FROM islands WINDOW i AS (PARTITION BY cell_key, g ORDER BY bucket)"),
    ("confirmed", "SELECT *, epoch(bucket)::BIGINT // 60 AS minute, CAST(epoch(bucket)::BIGINT // 60 AS VARCHAR)"
                  " || '@' || cell_key AS request_id FROM streaks WHERE streak >= 3"),
    # Onset: walk back over all processed buckets.
    ("walk",
     "SELECT c.request_id, c.bucket, c.e - c.delta_pp / 100 AS lim, s.bucket AS sb, coalesce(x.n, 0) AS sn, coalesce(x.k, 0) AS sk"
     " FROM confirmed c JOIN spine s ON s.bucket BETWEEN c.bucket - INTERVAL 120 MINUTE AND c.bucket"
     " LEFT JOIN windowed x ON x.bucket = s.bucket AND x.cell_key = c.cell_key"),
    ("good", "SELECT request_id, max(sb) AS g FROM walk WHERE sn >= 30 AND CAST(sk AS DOUBLE) / sn >= lim GROUP BY request_id"),
    ("run",
     "SELECT w.request_id, w.bucket, min(sb) FILTER (g IS NULL OR sb > g) AS first_bad, count(*) FILTER (g IS NULL OR sb > g) AS len,"
     " count(*) FILTER ((g IS NULL OR sb > g) AND sn >= 30) AS thick FROM walk w LEFT JOIN good USING (request_id)"
     " GROUP BY w.request_id, w.bucket"),
    ("onset", "SELECT request_id, bucket, CASE WHEN len >= 3 THEN first_bad ELSE bucket END AS started_at,"
              " len >= 3 AND thick = len AS started_at_exact, len, thick, first_bad FROM run"),
    # Decline mix of the confirmed cells.
    ("ages",
     "SELECT c.request_id, d.decline_code AS code, d.declines, date_diff('minute', d.bucket, c.bucket) AS age FROM confirmed c"
     " JOIN declines d ON d.merchant_id = c.merchant_id AND d.country = c.country AND (c.provider_id IS NULL OR"
     " c.provider_id = d.provider_id) AND (c.payment_method IS NULL OR c.payment_method = d.payment_method) AND"
     " (c.issuer_id IS NULL OR c.issuer_id = d.issuer_id) AND d.bucket BETWEEN c.bucket - INTERVAL 374 MINUTE AND c.bucket"),
    ("mixwin",
     "SELECT request_id, CASE WHEN t1 >= 20 THEN 1 WHEN t5 >= 20 THEN 5 ELSE 15 END AS w, CAST(CASE WHEN t1 >= 20 THEN t1 WHEN t5 >= 20"
     " THEN t5 ELSE t15 END AS BIGINT) AS total, CAST(th AS BIGINT) AS th FROM (SELECT request_id,"
     " coalesce(sum(declines) FILTER (age < 1), 0) AS t1, coalesce(sum(declines) FILTER (age < 5), 0) AS t5,"
     " coalesce(sum(declines) FILTER (age < 15), 0) AS t15, coalesce(sum(declines) FILTER (age >= 15), 0) AS th FROM ages GROUP BY request_id)"),
    ("shifts",
     "SELECT *, (observed_share - reference_share) * 100 AS moved_pp FROM (SELECT request_id, w AS window_min, total AS total_declines,"
     " CASE WHEN th >= 100 THEN 'temporal' ELSE 'catalog' END AS reference_source, code, family, diagnostic, cnt AS count,"
     " CAST(cnt AS DOUBLE) / total AS observed_share, CASE WHEN th >= 100 THEN CAST(hist AS DOUBLE) / th ELSE baseline_share END"
     " AS reference_share FROM (SELECT a.request_id, a.code, w, total, th, CAST(coalesce(sum(declines) FILTER (age < w), 0) AS BIGINT) AS cnt,"
     " CAST(coalesce(sum(declines) FILTER (age >= 15), 0) AS BIGINT) AS hist FROM ages a JOIN mixwin USING (request_id)"
     " GROUP BY a.request_id, a.code, w, total, th) JOIN codes USING (code) WHERE cnt > 0)"),
    ("lead",
     "SELECT * FROM shifts WHERE diagnostic QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY observed_share DESC, code) = 1"),
    ("dominant",
     "SELECT request_id, code AS dominant_code, family AS dominant_family, window_min FROM lead WHERE"
     f" {wilson_sql('count', 'total_declines', '1.96')[0]} > reference_share"),
    # Runs of drops, used as an incident table.
    ("breaks",
     "SELECT *, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY cell_key ORDER BY bucket) <= INTERVAL 3 MINUTE THEN 0 ELSE 1 END AS brk"
     " FROM readings WHERE kind = 'reading' AND state = 'MATERIAL_DROP'"),
    ("episodes",
     f"SELECT cell_key || '@' || strftime(started_at, '%H:%M') AS incident_id, *, CASE WHEN done THEN 'resolved' WHEN windows > 1 THEN"
     " 'monitoring' ELSE 'open' END AS status, CASE WHEN done THEN detected_at + INTERVAL 3 MINUTE END AS resolved_at,"
     " cost_usd_minor * 100 // windows AS cost_usd_per_min, CASE WHEN windows >= 3 THEN 'CONFIRMED' ELSE 'INCONCLUSIVE' END AS confidence"
     " FROM (SELECT *, detected_at + INTERVAL 3 MINUTE <= (SELECT max(bucket) FROM rollup) AS done FROM (SELECT cell_key, "
     f"{DIMS}, min(bucket) AS started_at, max(bucket) AS detected_at, count(*) AS windows, CAST(sum(attempts - approved) AS BIGINT) AS cost_usd_minor"
     f" FROM (SELECT *, sum(brk) OVER (PARTITION BY cell_key ORDER BY bucket) AS grp FROM breaks) GROUP BY cell_key, {DIMS}, grp))"),
    ("pnames", C.names_sql(C.PROVIDERS, "provider_id")),
    ("inames", C.names_sql(C.ISSUERS, "issuer_id")),
    ("mnames", C.names_sql(C.MERCHANTS, "merchant_id")),
    ("cnames", C.names_sql(COUNTRY_NAMES, "country")),
    ("labelled",
     "SELECT e.*, concat_ws(' · ', coalesce(p.name, e.provider_id), coalesce(c.name, e.country), e.payment_method,"
     " coalesce(i.name, e.issuer_id), coalesce(m.name, e.merchant_id)) AS label FROM episodes e LEFT JOIN pnames p USING (provider_id)"
     " LEFT JOIN inames i USING (issuer_id) LEFT JOIN mnames m USING (merchant_id) LEFT JOIN cnames c USING (country)"),
    # Search: every root in every minute.
    ("problems",
     "SELECT DISTINCT CAST(epoch(bucket)::BIGINT // 60 AS VARCHAR) || '@' || merchant_id || '@' || country AS pid, bucket,"
     " merchant_id, country, expected_conversion AS goal, delta_pp FROM rollup JOIN merchants USING (merchant_id)"),
    ("kept0", "SELECT pid, goal, delta_pp, r.bucket, r.merchant_id, r.country, provider_id AS p, payment_method AS m, issuer_id AS i,"
              " attempts AS n, approved AS k FROM rollup r JOIN problems q USING (bucket, merchant_id, country)"),
]

HEAVY = {"rollup", "declines", "windowed", "hyp", "readings", "streaks", "confirmed", "episodes", "kept0", "shifts", "walk", "cells1",
         "level1", "level2", "cand1", "causal1", "kept1", "cells2", "cand2", "causal2", "kept2", "cells3", "cand3", "causal3", "kept3"}


def _cell_key(prefix: str = "") -> str:
    p = prefix
    return (
        f"concat_ws('|', 'country=' || {p}country, 'issuerId=' || {p}i, 'merchantId=' || {p}merchant_id,"
        f" 'paymentMethod=' || {p}m, 'providerId=' || {p}p)"
    )


def search_round(r: int) -> list[tuple[str, str]]:
    """One peel round over ``kept{r-1}``, depth by depth."""
    kept = f"kept{r - 1}"
    ident = "pid, goal, delta_pp, bucket, merchant_id, country"
    groups = []
    for mask in range(1, 8):
        dims = [("p", 4), ("m", 2), ("i", 1)]
        cols = ", ".join(d if mask & b else f"CAST(NULL AS VARCHAR) AS {d}" for d, b in dims)
        by = ", ".join(d for d, b in dims if mask & b)
        groups.append(
            f"SELECT {ident}, {mask} AS mask, {cols}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k,"
            f" bool_and(m = 'CARD') AS card FROM {kept} GROUP BY {ident}, {by}"
        )
    total = (
        f"SELECT pid, CAST(sum(n) AS BIGINT) AS tn, CAST(sum(k) AS BIGINT) AS tk, bool_and(m = 'CARD') AS tcard FROM {kept} GROUP BY pid"
    )
    cells = f"cells{r}"
    out = [
        (f"totals{r}", total),
        (cells,
         f"SELECT *, {_cell_key()} AS key, gd - greatest(0.0, (tn - n) * goal - (tk - k)) AS explained,"
         f" (gd - greatest(0.0, (tn - n) * goal - (tk - k))) / n AS conc FROM (SELECT g.*, tn, tk, tcard,"
         f" greatest(0.0, tn * goal - tk) AS gd, EXISTS (SELECT 1 FROM coverage c WHERE c.country = g.country AND c.provider_id = g.p)"
         f" AS kp, EXISTS (SELECT 1 FROM coverage c WHERE c.country = g.country AND c.payment_method = g.m) AS km"
         f" FROM ({' UNION ALL '.join(groups)}) g JOIN totals{r} USING (pid)) x WHERE"
         f" ({state_sql('tk', 'tn', 'goal', 'delta_pp', '1.96')}) = 'MATERIAL_DROP'"),
    ]
    order = "PARTITION BY pid ORDER BY explained DESC, conc DESC, key"
    out.append((
        f"level{r}_1",
        f"SELECT *, row_number() OVER ({order}) AS place FROM (SELECT *, CAST(tk - k AS DOUBLE) / (tn - n) AS e FROM {cells}"
        f" WHERE mask IN (4, 2, 1) AND tn > n AND CASE mask WHEN 4 THEN kp WHEN 2 THEN km ELSE tcard END)",
    ))
    for depth, masks in ((2, (6, 5, 3)), (3, (7,))):
        pairs = []
        for mask in masks:
            for axis, bit in (("p", 4), ("m", 2), ("i", 1)):
                if not mask & bit:
                    continue
                allowed = {"p": "c.kp", "m": "c.km", "i": "a.card"}[axis]
                same = " AND ".join(
                    f"a.{d} = c.{d}" for d, b in (("p", 4), ("m", 2), ("i", 1)) if (mask ^ bit) & b
                )
                pairs.append(
                    f"SELECT c.pid, c.key, a.place AS ap, CAST(a.k - c.k AS DOUBLE) / (a.n - c.n) AS e FROM {cells} c JOIN"
                    f" level{r}_{depth - 1} a ON a.pid = c.pid AND a.place <= 4 AND a.mask = {mask ^ bit} AND {same}"
                    f" WHERE c.mask = {mask} AND {allowed} AND a.n > c.n"
                )
        out.append((
            f"level{r}_{depth}",
            f"SELECT c.*, b.e, row_number() OVER (PARTITION BY c.pid ORDER BY explained DESC, conc DESC, c.key) AS place FROM {cells} c JOIN"
            f" (SELECT pid, key, arg_min(e, ap) AS e FROM ({' UNION ALL '.join(pairs)}) GROUP BY pid, key) b USING (pid, key)",
        ))
    out.append((
        f"cand{r}",
        f"SELECT *, ({state_sql('k', 'n', 'e', 'delta_pp', '1.96')}) = 'MATERIAL_DROP' AND explained > 0 AS admissible FROM"
        f" (SELECT * FROM level{r}_1 UNION ALL BY NAME SELECT * FROM level{r}_2 UNION ALL BY NAME SELECT * FROM level{r}_3)",
    ))
    out.append((
        f"causal{r}",
        f"SELECT * FROM (SELECT *, max(explained) OVER (PARTITION BY pid) AS most FROM (SELECT *, max(conc) OVER (PARTITION BY pid) AS best"
        f" FROM cand{r} WHERE admissible) WHERE conc >= best * (1 - 0.02)) WHERE explained >= most * (1 - 0.02)"
        " QUALIFY row_number() OVER (PARTITION BY pid ORDER BY bit_count(mask), key) = 1",
    ))
    out.append((
        f"kept{r}",
        f"SELECT k.* FROM {kept} k JOIN causal{r} c USING (pid) WHERE NOT ((c.p IS NULL OR c.p = k.p) AND (c.m IS NULL OR c.m = k.m)"
        " AND (c.i IS NULL OR c.i = k.i))",
    ))
    return out


for _round in (1, 2, 3):
    CTES += search_round(_round)

# The incident fold: a list of unresolved incidents per root, carried from event to event.
_LIVE = "STRUCT(id VARCHAR, p VARCHAR, m VARCHAR, i VARCHAR, seen BIGINT, status VARCHAR)[]"
_SAID = "STRUCT(act VARCHAR, id VARCHAR, p VARCHAR, m VARCHAR, i VARCHAR)[]"
_FIXED = "(({0}p IS NOT NULL)::INT + ({0}m IS NOT NULL)::INT + ({0}i IS NOT NULL)::INT)"
_AGREE = " AND ".join(f"(x.{d} IS NULL OR e.{d} IS NULL OR x.{d} = e.{d})" for d in "pmi")
_DUE = "(x.status <> 'inconclusive' AND e.minute - x.seen >= 3)"
_THIN = ("list_contains(e.thin, concat_ws('|', 'country=' || e.country, 'issuerId=' || x.i, 'merchantId=' || e.merchant_id,"
         " 'paymentMethod=' || x.m, 'providerId=' || x.p))")
CTES += [
    ("shown",
     "SELECT merchant_id, country, minute, 0 AS kind, row_number() OVER (PARTITION BY merchant_id, country, minute"
     " ORDER BY attempts * e - approved DESC, cell_key) AS ord, provider_id AS p, payment_method AS m, issuer_id AS i, request_id,"
     " sha256(concat_ws('|', merchant_id, country, minute::VARCHAR, cell_key)) AS id, CAST([] AS VARCHAR[]) AS thin FROM confirmed"),
    ("thinned",
     "SELECT merchant_id, country, epoch(bucket)::BIGINT // 60 AS minute, list(cell_key) AS thin FROM readings WHERE kind = 'gap' GROUP BY ALL"),
    ("events_in_order",
     "SELECT *, row_number() OVER (PARTITION BY merchant_id, country ORDER BY minute, kind, ord) AS rn FROM (SELECT * FROM shown UNION ALL"
     " SELECT t.merchant_id, t.country, t.minute, 1, 0, NULL, NULL, NULL, NULL, NULL, coalesce(g.thin, CAST([] AS VARCHAR[])) FROM"
     " (SELECT DISTINCT merchant_id, country, minute + 3 AS minute FROM shown WHERE minute + 3 <= (SELECT max(epoch(bucket)::BIGINT // 60)"
     " FROM rollup)) t LEFT JOIN thinned g USING (merchant_id, country, minute))"),
    ("folded",
     f"SELECT DISTINCT merchant_id, country, 0::BIGINT AS rn, 0::BIGINT AS minute, NULL::VARCHAR AS request_id, CAST([] AS {_LIVE}) AS live,"
     f" CAST([] AS {_SAID}) AS said FROM shown UNION ALL SELECT merchant_id, country, rn, minute, request_id, CAST(CASE"
     " WHEN kind = 0 AND best IS NULL THEN list_append(live, {'id': id, 'p': p, 'm': m, 'i': i, 'seen': minute, 'status': 'open'})"
     " WHEN kind = 0 THEN list_transform(live, lambda x, j: CASE WHEN j <> best THEN x ELSE {'id': x.id, 'p': CASE WHEN finer THEN x.p ELSE p END,"
     " 'm': CASE WHEN finer THEN x.m ELSE m END, 'i': CASE WHEN finer THEN x.i ELSE i END, 'seen': minute, 'status': 'monitoring'} END)"
     f" ELSE list_transform(list_filter(live, lambda x: NOT ({_DUE} AND NOT {_THIN})), lambda x: CASE WHEN NOT {_DUE} THEN x ELSE {{'id': x.id,"
     f" 'p': x.p, 'm': x.m, 'i': x.i, 'seen': x.seen, 'status': 'inconclusive'}} END) END AS {_LIVE}), CAST(CASE"
     " WHEN kind = 0 AND best IS NULL THEN [{'act': 'opened', 'id': id, 'p': p, 'm': m, 'i': i}]"
     " WHEN kind = 0 AND finer THEN [{'act': 'refreshed', 'id': live[best].id, 'p': live[best].p, 'm': live[best].m, 'i': live[best].i}]"
     " WHEN kind = 0 THEN [{'act': 'updated', 'id': live[best].id, 'p': p, 'm': m, 'i': i}]"
     f" ELSE list_transform(list_filter(live, lambda x: {_DUE}), lambda x: {{'act': CASE WHEN {_THIN} THEN 'inconclusive' ELSE 'resolved' END,"
     f" 'id': x.id, 'p': x.p, 'm': x.m, 'i': x.i}}) END AS {_SAID}) FROM (SELECT *, {_FIXED.format('live[best].')} > {_FIXED.format('')} AS finer"
     " FROM (SELECT e.*, f.live, list_sort(list_filter(list_transform(f.live, lambda x, j: {'f': -" + _FIXED.format("x.") + ", 's': -x.seen, 'j': j,"
     f" 'fits': {_AGREE}}}), lambda y: y.fits))[1].j AS best FROM folded f JOIN events_in_order e ON e.merchant_id = f.merchant_id"
     " AND e.country = f.country AND e.rn = f.rn + 1) e) e"),
]
HEAVY |= {"events_in_order", "shown", "thinned"}

NAMES = [n for n, _ in CTES]
TEXT = dict(CTES)


def sql(final: str, more: list[tuple[str, str]] | None = None) -> str:
    """``final`` with the common table expressions it needs, of these and ``more``, in dependency order."""
    import re

    text, names = TEXT | dict(more or []), NAMES + [n for n, _ in more or []]
    needed, todo = set(), [final]
    while todo:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", todo.pop()))
        for name in words & text.keys() - needed:
            needed.add(name)
            todo.append(text[name])
    heavy = HEAVY | {n for n, t in more or [] if n not in t}
    parts = [f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({text[n]})" for n in names if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


def r8(*names: str) -> str:
    return ", ".join(f"round({n}, 8) AS {n.split('.')[-1]}" for n in names)


def lens(column: str) -> str:
    low, high = wilson_sql("k", "n", "1.96")
    return sql(
        f"SELECT bucket, cell_key, n AS attempts, k AS approved, round({column}, 8) AS expected, round({low}, 8) AS ci_low,"
        f" round({high}, 8) AS ci_high, {state_sql('k', 'n', column, 'delta_pp', '1.96')} AS state FROM hyp WHERE {column} IS NOT NULL"
    )


SINCE = "(SELECT max(bucket) - INTERVAL 20 MINUTE FROM rollup)"
SIGNALS = (
    "SELECT bucket, cell_key, round(coalesce(CAST(approved AS DOUBLE) / attempts, 0), 6) AS observed_rate, round(e, 6) AS expected_rate,"
    " src AS expected_source, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, attempts, approved, window_used,"
    " streak AS consecutive_windows, first_bucket FROM streaks WHERE streak >= 3"
)
ROLLUP_OUT = "SELECT * FROM rollup"
QUARANTINE = (
    "SELECT outcome, rules, count(*) AS entries FROM (SELECT CASE WHEN t % 101 = 0 THEN 'missing_payload' WHEN t % 103 = 1 THEN"
    " 'bad_json' WHEN rules <> '' THEN 'schema' ELSE 'clean' END AS outcome, CASE WHEN t % 101 = 0 OR t % 103 = 1 THEN '' ELSE rules"
    " END AS rules FROM (SELECT t, CASE WHEN f1 OR f2 THEN concat_ws(',', CASE WHEN f1 THEN 'amountMinor' END, CASE WHEN f2 THEN"
    " 'merchantId' END) ELSE concat_ws(',', CASE WHEN c1 THEN 'decline_iff_code' END, CASE WHEN c2 THEN 'pix_only_br' END) END AS rules"
    " FROM (SELECT transaction_id AS t, transaction_id % 107 = 2 AS f1, transaction_id % 127 = 5 AS f2, transaction_id % 109 = 3 AND ok AS c1,"
    " transaction_id % 113 = 4 AND payment_method = 'CARD' AND country <> 'BR' AS c2 FROM tx))) GROUP BY outcome, rules"
)
PROVIDER_SERIES = (
    "SELECT bucket, provider_id, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(approved) AS BIGINT) AS approved FROM rollup"
    f" WHERE bucket >= {SINCE} GROUP BY bucket, provider_id"
)
PORTFOLIO = (
    "SELECT bucket, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(approved) AS BIGINT) AS approved FROM rollup"
    f" WHERE bucket >= {SINCE} GROUP BY bucket"
)
ECHOES = " UNION ALL ".join(
        f"SELECT pid, {r} AS peel_no, key AS cell_key, round(observed, 8) AS observed, round(residual_rate, 8) AS residual_rate FROM (SELECT a.pid,"
        f" a.key, a.e, a.delta_pp, CAST(a.k AS DOUBLE) / a.n AS observed, coalesce(sum(x.n), 0) AS xn, coalesce(sum(x.k), 0) AS xk,"
        f" CAST(sum(x.k) AS DOUBLE) / sum(x.n) AS residual_rate FROM cand{r} a JOIN causal{r} c ON c.pid = a.pid AND c.key <> a.key LEFT JOIN"
        f" kept{r} x ON x.pid = a.pid AND (a.p IS NULL OR a.p = x.p) AND (a.m IS NULL OR a.m = x.m) AND (a.i IS NULL OR a.i = x.i)"
        f" WHERE a.admissible GROUP BY a.pid, a.key, a.e, a.delta_pp, a.k, a.n) WHERE ({state_sql('xk', 'xn', 'e', 'delta_pp', '1.96')})"
        " <> 'MATERIAL_DROP'"
        for r in (1, 2, 3)
    )
ORACLE: dict[str, str] = {
    "q01_minute_rollup": sql(ROLLUP_OUT),
    "q02_decline_rollup": sql("SELECT * FROM declines"),
    "q03_rollup_merge": sql(ROLLUP_OUT),
    "q04_quarantine_counts": sql(QUARANTINE),
    "q05_retention_keep": sql(
        "SELECT bucket, count(*) AS attempts FROM tx WHERE bucket >= (SELECT max(bucket) + INTERVAL 65 SECOND - INTERVAL 15 MINUTE FROM tx_raw)"
        " AND bucket <= date_trunc('minute', (SELECT max(bucket) + INTERVAL 65 SECOND - INTERVAL 10 SECOND FROM tx_raw)) - INTERVAL 1 MINUTE"
        " GROUP BY bucket"
    ),
    "q06_provider_series": sql(PROVIDER_SERIES),
    "q07_portfolio_series": sql(PORTFOLIO),
    "q08_conversion_series": sql(
        "SELECT s.bucket, coalesce(x.attempts, 0) AS attempts, coalesce(x.approved, 0) AS approved, round(CAST(x.approved AS DOUBLE) /"
        " x.attempts, 8) AS rate FROM spine s LEFT JOIN (SELECT bucket, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(approved) AS"
        " BIGINT) AS approved FROM rollup WHERE merchant_id = 'BR_STORE_01' AND payment_method = 'CARD' AND provider_id = 'stripe' GROUP BY"
        " bucket) x USING (bucket) WHERE s.bucket >= TIMESTAMP '2026-08-30 12:05:00' AND s.bucket < TIMESTAMP '2026-08-30 12:25:00'"
    ),
    "q10_absolute_lens": lens("ea"),
    "q11_cross_lens": lens("ec"),
    "q12_temporal_lens": lens("et"),
    "q13_family_z": sql("SELECT bucket, m, round(z, 6) AS z FROM fam"),
    "q14_readings": sql(
        "SELECT bucket, cell_key, src AS expected_source, round(e, 6) AS expected, kind, state, attempts, approved, round(ci_low, 6) AS ci_low,"
        " round(ci_high, 6) AS ci_high, window_used FROM readings"
    ),
    "q15_thin_retry": sql(
        "SELECT bucket, cell_key, n AS attempts, wn AS wide_n, wk AS wide_k, round(e, 8) AS expected,"
        f" {state_sql('wk', 'wn', 'e', 'delta_pp', '1.96')} AS state FROM (SELECT *, coalesce(ea, ec, et) AS e FROM hyp)"
        " WHERE n < 30 AND e IS NOT NULL"
    ),
    "q16_gaps": sql("SELECT bucket, cell_key, attempts, 'INSUFFICIENT_EVIDENCE' AS reason FROM readings WHERE kind = 'gap'"),
    "q17_signals": sql(SIGNALS),
    "q18_pending": sql(
        "SELECT bucket, cell_key, attempts, approved, first_bucket, streak AS windows_confirmed, 3 AS windows_required, until_bucket"
        " FROM streaks WHERE streak IN (1, 2)"
    ),
    "q19_onset": sql("SELECT o.bucket, cell_key, started_at, started_at_exact FROM onset o JOIN confirmed USING (request_id)"),
    "q20_onset_query": sql(
        "SELECT request_id, coalesce(first_bad, bucket) AS started_at, thick > 0 AS started_at_exact, greatest(len, 1) AS minutes,"
        " bucket AS last_bucket FROM onset"
    ),
    "q21_residual": sql(
        "SELECT pid, n AS attempts, k AS approved, round(CAST(k AS DOUBLE) / nullif(n, 0), 8) AS rate, round(greatest(0.0, n * goal - k), 8) AS deficit,"
        f" round({wilson_sql('k', 'n', '1.96')[0]}, 8) AS ci_low, round({wilson_sql('k', 'n', '1.96')[1]}, 8) AS ci_high,"
        f" {state_sql('k', 'n', 'goal', 'delta_pp', '1.96')} AS state FROM (SELECT q.pid, q.goal, q.delta_pp, CAST(coalesce(sum(n) FILTER"
        " (p <> worst), 0) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (p <> worst), 0) AS BIGINT) AS k FROM problems q JOIN kept0 USING (pid) JOIN"
        " (SELECT pid, arg_min(p, row(rate, p)) AS worst FROM (SELECT pid, p, CAST(sum(k) AS DOUBLE) / sum(n) AS rate FROM kept0 GROUP BY pid, p)"
        " GROUP BY pid) USING (pid) GROUP BY q.pid, q.goal, q.delta_pp)"
    ),
    "q22_lattice": sql(
        f"SELECT bucket, {key_sql()} AS cell_key, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(approved) AS BIGINT) AS approved,"
        " CAST(sum(amount_usd_sum) AS BIGINT) AS amount_usd_sum FROM rollup GROUP BY GROUPING SETS ("
        + ", ".join("(" + ", ".join(["bucket", "merchant_id", "country", *[d for d, b in (("provider_id", 4), ("payment_method", 2), ("issuer_id", 1)) if m & b]]) + ")" for m in range(8))
        + "), bucket, merchant_id, country"
    ),
    "q23_beam_depth1": sql(
        "SELECT pid, key AS cell_key, n, k, round(e, 8) AS expected, round(explained, 8) AS explained, CASE WHEN place <= 4 THEN"
        " CAST(place AS INTEGER) END AS beam, admissible FROM cand1 WHERE mask IN (1, 2, 4)"
    ),
    "q24_first_peel": sql(
        "SELECT pid, key AS cell_key, n, k, round(e, 8) AS expected, round(explained, 8) AS explained, round(conc, 8) AS concentration FROM causal1"
    ),
    "q25_peels": sql(" UNION ALL ".join(
        f"SELECT pid, {r} AS peel_no, key AS cell_key, n AS attempts, k AS approved, round(e, 8) AS expected, round(explained, 8) AS explained,"
        f" round({wilson_sql('k', 'n', '1.96')[0]}, 8) AS ci_low, round({wilson_sql('k', 'n', '1.96')[1]}, 8) AS ci_high FROM causal{r}"
        for r in (1, 2, 3)
    )),
    "q26_echoes": sql(ECHOES),
    "q28_decline_mix": sql(
        "SELECT request_id, window_min, total_declines, reference_source, code, family, count, round(observed_share, 8) AS observed_share,"
        " round(reference_share, 8) AS reference_share, round(moved_pp, 8) AS moved_pp FROM shifts"
    ),
    "q29_dominant_code": sql("SELECT * FROM dominant"),
    "q30_outage_attribution": sql(
        "SELECT request_id, providers, issuers, CASE WHEN total = 0 THEN 'INCONCLUSIVE' WHEN other = 0 THEN CASE WHEN providers >= 2 THEN 'RAIL'"
        " ELSE 'INCONCLUSIVE' END WHEN providers = 1 AND issuers >= 2 THEN 'PROVIDER' WHEN issuers = 1 AND providers >= 2 THEN 'ISSUER' ELSE"
        " 'INCONCLUSIVE' END AS attribution FROM (SELECT c.request_id, count(d.bucket) AS total, count(DISTINCT d.provider_id) AS providers,"
        " count(DISTINCT d.issuer_id) FILTER (d.issuer_id <> 'NA') AS issuers, count(*) FILTER (d.payment_method <> 'PIX') AS other"
        " FROM confirmed c JOIN dominant o USING (request_id) LEFT JOIN declines d ON d.merchant_id = c.merchant_id AND d.country = c.country AND"
        " d.decline_code = o.dominant_code AND d.bucket <= c.bucket AND d.bucket > c.bucket - to_minutes(CAST(o.window_min AS INTEGER))"
        " WHERE o.dominant_code IN ('91', 'AB03') GROUP BY c.request_id)"
    ),
}


def impact_sql(asked: str, extra: str = "") -> str:
    return sql(impact_body(asked, extra))


def impact_body(asked: str, extra: str = "") -> str:
    """``asked``: request_id, dims, bucket, started_at, e."""
    _, high = wilson_sql("k", "n", "1.96")
    return (
        "SELECT request_id, dur AS duration_min, lost AS lost_approvals, tu AS avg_ticket_usd_minor, lost * tu AS cost_usd_minor,"
        f" {extra} lost * tl AS cost_local_minor, CAST(round(CAST(lost * tu AS DOUBLE) / dur) AS BIGINT) AS cost_usd_per_min,"
        " round(CAST(lost * tu AS DOUBLE) / dur, 8) AS priority_score FROM (SELECT *, CAST(round(n * greatest(0.0, e -"
        f" {high})) AS BIGINT) AS lost, CASE WHEN n = 0 THEN 0 ELSE CAST(round(CAST(au AS DOUBLE) / n) AS BIGINT) END AS tu, CASE WHEN n = 0 THEN 0"
        " ELSE CAST(round(CAST(al AS DOUBLE) / n) AS BIGINT) END AS tl FROM (SELECT a.request_id, a.e, a.country, date_diff('minute',"
        " a.started_at, a.bucket) + 1 AS dur, coalesce(CAST(sum(attempts) AS BIGINT), 0) AS n, coalesce(CAST(sum(approved) AS BIGINT), 0) AS k,"
        f" sum(amount_usd_sum) AS au, sum(amount_minor_sum) AS al FROM ({asked}) a LEFT JOIN rollup r ON r.merchant_id = a.merchant_id AND"
        " r.country = a.country AND (a.provider_id IS NULL OR a.provider_id = r.provider_id) AND (a.payment_method IS NULL OR"
        " a.payment_method = r.payment_method) AND (a.issuer_id IS NULL OR a.issuer_id = r.issuer_id) AND r.bucket BETWEEN a.started_at AND a.bucket"
        " GROUP BY a.request_id, a.e, a.country, a.started_at, a.bucket))"
    )


MINUTE = "CAST(epoch(bucket)::BIGINT // 60 AS VARCHAR)"
CURRENCY = "CASE country WHEN 'BR' THEN 'BRL' WHEN 'MX' THEN 'MXN' WHEN 'AR' THEN 'ARS' END AS currency,"
SHAPE = (
    "CASE WHEN issuer_id IS NOT NULL THEN 'issuer' WHEN provider_id IS NOT NULL THEN 'provider' WHEN payment_method IS NOT NULL THEN 'method'"
    " ELSE 'merchant' END"
)
GRID = (
    "SELECT m.merchant_id, c.provider_id, m.country, c.payment_method, i.issuer_id FROM ("
    + C.values_sql([(m, c) for m, _, c in C.MERCHANTS], ("merchant_id", "country"))
    + ") m JOIN coverage c ON c.country = m.country JOIN (" + C.values_sql([(i, c, "CARD") for i, _, c in C.ISSUERS] + [("NA", "BR", "PIX")], ("issuer_id", "country", "payment_method"))
    + ") i ON i.country = m.country AND i.payment_method = c.payment_method"
)
DIM_EQ = " AND ".join(f"a.{d} = b.{d}" for d in DIMS.split(", "))
TOOLS = ("run_residual_test", "scan_incident_onset", "estimate_incident_impact")

ORACLE.update({
    "q31_impact": impact_sql(
        "SELECT c.request_id, c.merchant_id, c.provider_id, c.country, c.payment_method, c.issuer_id, c.bucket, c.e, o.started_at FROM"
        " confirmed c JOIN onset o USING (request_id)", CURRENCY),
    "q35_incident_extent": sql(
        "SELECT cell_key, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS windows FROM (SELECT *, sum(brk) OVER (PARTITION BY"
        " cell_key ORDER BY bucket) AS grp FROM (SELECT *, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY cell_key ORDER BY bucket) <= INTERVAL 3"
        " MINUTE THEN 0 ELSE 1 END AS brk FROM confirmed)) GROUP BY cell_key, grp"
    ),
    "q36_recall": sql(
        "SELECT a.incident_id, row_number() OVER (PARTITION BY a.incident_id ORDER BY b.detected_at DESC, b.incident_id) AS place, b.incident_id AS"
        " similar_id, 'Same cell was down from ' || strftime(b.started_at, '%Y-%m-%dT%H:%M:%S.000Z') || ' until ' || strftime(b.resolved_at,"
        " '%Y-%m-%dT%H:%M:%S.000Z') || ', dominant decline none, cost ' || b.cost_usd_minor || ' USD minor units.' AS summary FROM episodes a JOIN"
        " episodes b ON a.cell_key = b.cell_key AND a.incident_id <> b.incident_id AND b.status = 'resolved' QUALIFY place <= 3"
    ),
    "q37_playbook": sql(
        "SELECT request_id, causal_dimension, dominant_family, playbook_id, owner FROM (SELECT c.request_id, " + SHAPE + " AS causal_dimension,"
        " dominant_family FROM confirmed c LEFT JOIN dominant USING (request_id)) x JOIN (" + C.playbooks_sql().replace("causal_dimension", "pd") + ") p ON"
        " p.pd = CASE WHEN x.causal_dimension = 'method' THEN 'payment_method' ELSE x.causal_dimension END"
        " QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN decline_family IS NULL OR decline_family = dominant_family THEN 0"
        " ELSE 1 END, file_order) = 1"
    ),
    "q38_feed": sql(
        "SELECT incident_id, status, CASE WHEN status = 'open' THEN t ELSE status END AS tier, CASE WHEN status = 'open' THEN CASE t WHEN 'critical'"
        " THEN 'Critical' WHEN 'warn' THEN 'Warning' ELSE 'Confirmed' END WHEN status = 'monitoring' THEN 'Monitoring' ELSE 'Resolved' END AS badge,"
        " CASE confidence WHEN 'CONFIRMED' THEN 'Cause isolated' ELSE 'Cause not isolated' END AS cause_label, cost_usd_per_min, detected_at FROM"
        " (SELECT *, CASE WHEN cost_usd_per_min >= 20000 THEN 'critical' WHEN cost_usd_per_min >= 3000 THEN 'warn' ELSE 'ok' END AS t FROM episodes"
        " ORDER BY detected_at DESC, incident_id LIMIT 100)"
    ),
    "q39_history": sql(
        "SELECT incident_id, label, status, detected_at FROM labelled WHERE status = 'resolved' AND contains(lower(cell_key || chr(10) || label), 'itau')"
    ),
    "q40_report": sql(
        "SELECT incident_id, label, label || ' is degrading' AS headline, 'US$ ' || CASE WHEN c >= 1000 THEN printf('%.1f', c / 1000.0) || 'k' ELSE"
        " CAST(c AS VARCHAR) END AS cost_text, CASE WHEN windows > 1 THEN '' ELSE '≈ ' END || CASE WHEN d < 1 THEN 'just now' WHEN d = 1 THEN"
        " '1 min ago' ELSE d || ' min ago' END AS since_text FROM (SELECT *, cost_usd_minor * 1000 // 10000 * 100 AS c, date_diff('minute', started_at,"
        " TIMESTAMP '2026-08-30 12:30:00') AS d FROM labelled)"
    ),
    "q43_silent_cells": sql(
        f"SELECT {key_sql('a.')} AS cell_key, 'silent' AS kind FROM ({GRID}) a WHERE NOT EXISTS (SELECT 1 FROM rollup b WHERE"
        f" {DIM_EQ}) UNION ALL SELECT DISTINCT {key_sql('a.')}, 'undeclared' FROM rollup a WHERE NOT EXISTS (SELECT 1"
        f" FROM ({GRID}) b WHERE b.provider_id <> 'adyen' AND {DIM_EQ})"
    ),
    "q44_fx_dated": (
        "WITH o AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'ARS' WHEN 1 THEN 'MXN' ELSE 'BRL' END AS currency, CAST(o_orderdate AS DATE) AS d,"
        " CAST(round(o_totalprice * 100) AS BIGINT) AS a FROM orders) SELECT currency, strftime(d, '%Y-%m') AS month, count(*) AS orders,"
        " count(*) FILTER (currency <> 'ARS') AS rated, CAST(sum(CASE WHEN currency <> 'ARS' THEN a * (CASE currency WHEN 'MXN' THEN 55 ELSE 180"
        " END + dayofmonth(d)) // 1000 END) AS BIGINT) AS usd_minor FROM o GROUP BY currency, month"
    ),
    "q45_number_grounding": (
        "WITH x AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?')) AS number FROM documents), a AS (SELECT"
        " doc_id AS id, unnest([CAST(n_chars AS VARCHAR), CAST(p AS VARCHAR), p || '.0', rtrim(rtrim('0.' || lpad(CAST(p AS VARCHAR), 2, '0'),"
        " '0'), '.'), regexp_extract(source, '\\d+'), CAST(q AS VARCHAR)] || CASE q WHEN 0 THEN ['0.0'] WHEN 1 THEN ['100', '100.0'] ELSE [] END || CASE"
        " n_chars WHEN 1 THEN ['100', '100.0'] ELSE [] END) AS number FROM (SELECT *, doc_id % 100 AS p, doc_id % 10 AS q FROM documents))"
        " SELECT id, number FROM x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = x.id AND a.number = x.number)"
    ),
    "q46_audit_refs": (
        "WITH s AS (SELECT conv_id AS run_id, turn + 1 AS step_no, CASE turn % 4 WHEN 0 THEN 'run_residual_test' WHEN 1 THEN 'scan_incident_onset'"
        " WHEN 2 THEN 'estimate_incident_impact' ELSE 'query_conversion_slice' END AS tool, CASE WHEN length(text) % 11 = 0 THEN 'running' WHEN"
        " length(text) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, length(text) % 5 <> 0 AS has_result, length(text) % 14 = 0 AS has_error,"
        " turn FROM conversations), r AS (SELECT conv_id AS run_id, max(turn) AS last, max(length(text)) AS size FROM conversations GROUP BY conv_id)"
        " SELECT run_id, step_no || ':' || ref AS detail, CASE WHEN ref >= step_no THEN 'future_step' ELSE 'unavailable_step' END AS reason FROM"
        " (SELECT run_id, step_no, unnest([turn, turn + 1]) AS ref FROM s) c WHERE ref >= step_no OR NOT EXISTS (SELECT 1 FROM s WHERE s.run_id ="
        " c.run_id AND s.step_no = c.ref AND status = 'completed')"
        " UNION ALL SELECT r.run_id, CAST(p AS VARCHAR), CASE WHEN s.run_id IS NULL THEN 'missing_step' ELSE 'incomplete_step' END FROM (SELECT"
        " run_id, unnest([1, last + 2]) AS p FROM r) r LEFT JOIN s ON s.run_id = r.run_id AND s.step_no = r.p WHERE s.run_id IS NULL OR"
        " s.status <> 'completed'"
        " UNION ALL SELECT r.run_id, t, 'missing_tool' FROM r, (VALUES " + ", ".join(f"('{t}')" for t in TOOLS) + ") v(t) WHERE size % 2 = 0 AND NOT EXISTS"
        " (SELECT 1 FROM s WHERE s.run_id = r.run_id AND tool = t AND status = 'completed')"
        " UNION ALL SELECT run_id, '', 'orphan' FROM r WHERE size % 3 = 0"
        " UNION ALL SELECT run_id, CAST(step_no AS VARCHAR), reason FROM (SELECT *, CASE WHEN status = 'running' THEN 'unknown_status' WHEN status ="
        " 'completed' AND NOT has_result THEN 'completed_without_result' WHEN status = 'completed' AND has_error THEN 'completed_with_error' WHEN status ="
        " 'failed' AND NOT has_error THEN 'failed_without_error' END AS reason FROM s) WHERE reason IS NOT NULL"
    ),
    "q47_stream_rollup": sql(ROLLUP_OUT),
    "q47b_stream_closed_windows": sql(
        "SELECT bucket, provider_id, count(*) AS attempts, count(*) FILTER (ok) AS approved FROM tx WHERE bucket + INTERVAL 1 MINUTE <="
        " (SELECT max(bucket) - INTERVAL 10 SECOND FROM tx) GROUP BY bucket, provider_id"
    ),
    "q47c_stream_dedup": sql("SELECT bucket, provider_id, count(*) AS attempts FROM tx GROUP BY bucket, provider_id"),
    "q48_stream_signals": sql("SELECT bucket, cell_key, streak AS consecutive_windows, first_bucket FROM confirmed"),
    "q49_marker_bucket": sql(
        f"SELECT event_id AS marker_id, coalesce((SELECT min(bucket) FROM spine WHERE bucket >= {START} + to_seconds(CAST(minute(ts) * 60 +"
        " second(ts) AS INTEGER))), (SELECT max(bucket) FROM spine)) AS bucket FROM events"
    ),
    "q50_drilldown_map": sql(
        "SELECT pid || '/' || axis AS step_id, value, round(CAST(sum(k) AS DOUBLE) / sum(n), 8) AS rate FROM (SELECT pid, 'provider_id' AS axis,"
        " p AS value, n, k FROM kept0 UNION ALL SELECT pid, 'payment_method', m, n, k FROM kept0 UNION ALL SELECT pid, 'issuer_id', i, n, k FROM"
        " kept0) GROUP BY pid, axis, value"
    ),
    "q52_history_slice": sql(
        "SELECT c.request_id, s.bucket, coalesce(CAST(sum(x.attempts) AS BIGINT), 0) AS attempts, coalesce(CAST(sum(x.approved) AS BIGINT), 0) AS"
        " approved, round(CAST(sum(x.approved) AS DOUBLE) / sum(x.attempts), 8) AS conversion_rate FROM confirmed c JOIN spine s ON s.bucket BETWEEN"
        " c.bucket - INTERVAL 10 MINUTE AND c.bucket LEFT JOIN rollup x ON x.bucket = s.bucket AND x.merchant_id = c.merchant_id AND x.country ="
        " c.country AND (c.provider_id IS NULL OR c.provider_id = x.provider_id) AND (c.payment_method IS NULL OR c.payment_method ="
        " x.payment_method) AND (c.issuer_id IS NULL OR c.issuer_id = x.issuer_id) GROUP BY c.request_id, s.bucket"
    ),
    "q55_impact_slice": impact_sql(
        f"SELECT {MINUTE} || '@' || {key_sql()} AS request_id, {DIMS}, bucket, bucket - INTERVAL 9 MINUTE AS started_at, 0.95::DOUBLE AS e FROM slices"),
    "q56_slice_validity": (
        "WITH a AS (SELECT CASE l_partkey % 5 WHEN 0 THEN 'BR_STORE_01' WHEN 1 THEN 'MX_STORE_01' WHEN 2 THEN 'AR_STORE_01' WHEN 4 THEN '' END AS m,"
        " CASE l_suppkey % 5 WHEN 0 THEN 'BR' WHEN 1 THEN 'MX' WHEN 2 THEN 'AR' WHEN 4 THEN 'US' END AS c, CASE l_orderkey % 4 WHEN 0 THEN 'CARD'"
        " WHEN 1 THEN 'PIX' WHEN 3 THEN 'CASH' END AS p, CASE (l_partkey // 5) % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'itau' END AS i FROM lineitem)"
        " SELECT CASE WHEN coalesce(m, '') = '' THEN 'merchant_required' WHEN c = 'US' THEN 'unknown_country' WHEN p = 'CASH' THEN 'unknown_method'"
        " WHEN p = 'PIX' AND c <> 'BR' THEN 'pix_outside_br' WHEN p = 'PIX' AND i <> 'NA' THEN 'pix_with_issuer' ELSE 'valid' END AS verdict,"
        " count(*) AS slices FROM a GROUP BY verdict"
    ),
    "q57_bucket_plan": sql(
        "SELECT merchant_id, s.b AS bucket FROM (SELECT DISTINCT merchant_id FROM rollup) LEFT JOIN (SELECT merchant_id, max(bucket) AS cursor FROM"
        " declines WHERE decline_code IN ('91', 'DS0G') GROUP BY merchant_id) USING (merchant_id), (SELECT unnest(generate_series((SELECT min(bucket)"
        " FROM rollup), (SELECT max(bucket) FROM rollup), INTERVAL 1 MINUTE)) AS b) s WHERE cursor IS NULL OR s.b > cursor"
    ),
    "q58_new_only_append": sql(
        "SELECT bucket, count(*) AS attempts FROM tx WHERE bucket >= TIMESTAMP '2026-08-30 12:10:00' AND transaction_id NOT IN (SELECT transaction_id"
        " FROM tx_raw WHERE bucket < TIMESTAMP '2026-08-30 12:20:00') GROUP BY bucket"
    ),
    "q59_config_update": sql(SIGNALS).replace(C.merchants_sql(), C.merchants_sql(0.95)),
    "q60_latest_evidence": sql(
        "SELECT merchant_id || '|' || country AS fingerprint, bucket, " + MINUTE + " || '/' || cell_key AS arrival, state FROM readings QUALIFY"
        " row_number() OVER (PARTITION BY merchant_id, country, bucket ORDER BY arrival DESC) = 1"
    ),
    "q61_run_steps": (
        "WITH r AS (SELECT conv_id AS run_id, conv_id // 10 AS incident_id, max(length(text)) * 60 AS started_at FROM conversations GROUP BY conv_id)"
        " SELECT incident_id, r.run_id, place, turn + 1 AS step_no, CASE turn % 4 WHEN 0 THEN 'run_residual_test' WHEN 1 THEN 'scan_incident_onset'"
        " WHEN 2 THEN 'estimate_incident_impact' ELSE 'query_conversion_slice' END AS tool_name, CASE WHEN length(text) % 11 = 0 THEN 'running' WHEN"
        " length(text) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY"
        " started_at DESC, run_id) AS place FROM r) r JOIN conversations c ON c.conv_id = r.run_id"
    ),
    "q62_live_candidates": sql(
        "SELECT c.bucket, c.cell_key, arg_max(e.incident_id, row((e.provider_id IS NOT NULL)::INT + (e.payment_method IS NOT NULL)::INT +"
        " (e.issuer_id IS NOT NULL)::INT, e.detected_at, e.incident_id)) AS incident_id, count(*) AS fitting FROM confirmed c JOIN episodes e ON"
        " e.merchant_id = c.merchant_id AND e.country = c.country AND e.started_at < c.bucket AND c.bucket <= e.detected_at + INTERVAL 3 MINUTE AND (e.provider_id IS NULL OR c.provider_id IS NULL OR"
        " e.provider_id = c.provider_id) AND (e.payment_method IS NULL OR c.payment_method IS NULL OR e.payment_method = c.payment_method) AND"
        " (e.issuer_id IS NULL OR c.issuer_id IS NULL OR e.issuer_id = c.issuer_id) GROUP BY c.bucket, c.cell_key"
    ),
    "q63_signal_root_join": sql(
        "SELECT a.bucket, a.merchant_id, a.country, a.key AS cause_key, c.cell_key AS signal_key FROM causal1 a JOIN confirmed c ON c.bucket ="
        " a.bucket AND c.merchant_id = a.merchant_id AND c.country = a.country QUALIFY row_number() OVER (PARTITION BY a.bucket, a.merchant_id,"
        " a.country ORDER BY CASE c.split WHEN 'root' THEN 0 WHEN 'provider' THEN 1 WHEN 'issuer' THEN 2 ELSE 3 END, c.cell_key) = 1"
    ),
    "q64_exact_cell_join": sql(
        "SELECT c.bucket, c.cell_key, a.key IS NOT NULL AS matched, round(a.explained, 8) AS explained FROM confirmed c LEFT JOIN cand1 a ON"
        " a.bucket = c.bucket AND a.key = c.cell_key"
    ),
    "q65_mix_normalised": sql(
        "SELECT c.payment_method, c.code, round(baseline_share / sum(baseline_share) OVER (PARTITION BY c.payment_method), 8) AS weight, n AS declines,"
        " round(share, 8) AS share FROM codes c LEFT JOIN (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY payment_method) AS share FROM"
        " (SELECT payment_method, decline_code AS code, CAST(sum(declines) AS BIGINT) AS n FROM declines GROUP BY 1, 2)) d ON d.payment_method ="
        " c.payment_method AND d.code = c.code"
    ),
    "q66_stream_snapshot": sql(f"{PROVIDER_SERIES} UNION ALL BY NAME SELECT *, 'all' AS provider_id FROM ({PORTFOLIO})"),
})

# A lattice cell in its own minute, against siblings, own past or the merchant's rate.
_SLICE_GROUPS = " UNION ALL ".join(
    "SELECT bucket, merchant_id, country, " + ", ".join(
        d if m & b else f"CAST(NULL AS VARCHAR) AS {d}" for d, b in (("provider_id", 4), ("payment_method", 2), ("issuer_id", 1))
    ) + f", {m} AS mask, CAST(sum(attempts) AS BIGINT) AS n, CAST(sum(approved) AS BIGINT) AS k FROM rollup GROUP BY bucket, merchant_id, country"
    + "".join(f", {d}" for d, b in (("provider_id", 4), ("payment_method", 2), ("issuer_id", 1)) if m & b)
    for m in range(8)
)
_PARENT_MASK = "CASE WHEN mask % 2 = 1 THEN mask - 1 WHEN mask IN (2, 6) THEN mask - 2 WHEN mask = 4 THEN 0 END"
TEXT["lat"] = f"SELECT *, {key_sql()} AS cell_key, {_PARENT_MASK} AS pm FROM ({_SLICE_GROUPS})"
TEXT["sliced"] = (
    "SELECT a.*, b.n - a.n AS sn, b.k - a.k AS sk, sum(a.n) OVER h AS hn, sum(a.k) OVER h AS hk FROM lat a LEFT JOIN lat b ON b.bucket = a.bucket"
    " AND b.merchant_id = a.merchant_id AND b.country = a.country AND b.mask = a.pm AND (b.provider_id IS NULL OR b.provider_id = a.provider_id)"
    " AND (b.payment_method IS NULL OR b.payment_method = a.payment_method) AND (b.issuer_id IS NULL OR b.issuer_id = a.issuer_id) WINDOW h AS"
    " (PARTITION BY a.cell_key ORDER BY a.bucket RANGE BETWEEN INTERVAL 120 MINUTE PRECEDING AND INTERVAL 1 MINUTE PRECEDING)"
)
TEXT["thin"] = (
    "SELECT bucket, provider_id, CAST(sum(approved) AS DOUBLE) / sum(attempts) AS rate FROM rollup GROUP BY bucket, provider_id"
)
NAMES += ["lat", "sliced", "thin"]
HEAVY |= {"lat", "sliced", "thin"}
ORACLE["q09_rate_carried_forward"] = sql(
    "SELECT provider_id, g.bucket, round(coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY provider_id ORDER BY g.bucket), 0.9), 8) AS rate,"
    " round(latest_rate, 8) AS latest_rate FROM (SELECT provider_id, bucket FROM (SELECT DISTINCT provider_id FROM thin), (SELECT DISTINCT bucket"
    " FROM thin ORDER BY bucket DESC LIMIT 60)) g LEFT JOIN thin t USING (provider_id, bucket) JOIN (SELECT provider_id, arg_max(rate, bucket) AS"
    " latest_rate FROM thin GROUP BY provider_id) USING (provider_id)"
)
ORACLE["q41_conversion_slice"] = sql(
    f"SELECT {MINUTE} || '@' || cell_key AS request_id, CASE WHEN mask % 2 = 1 THEN 'issuer_id' WHEN mask IN (2, 6) THEN 'payment_method' WHEN"
    " mask = 4 THEN 'provider_id' END AS split_dim, n AS attempts, k AS approved, round(CAST(k AS DOUBLE) / n, 8) AS conversion_rate, round(e, 8)"
    f" AS expected, src AS expected_source, round({wilson_sql('k', 'n', '1.96')[0]}, 8) AS ci_low, round({wilson_sql('k', 'n', '1.96')[1]}, 8) AS"
    f" ci_high, {state_sql('k', 'n', 'e', 'delta_pp', '1.96')} AS state FROM (SELECT s.*, delta_pp, CASE WHEN sn > 0 THEN CAST(sk AS DOUBLE) / sn"
    " WHEN hn > 0 THEN CAST(hk AS DOUBLE) / hn ELSE expected_conversion END AS e, CASE WHEN sn > 0 THEN 'cross_sectional' WHEN hn > 0 THEN"
    " 'temporal' ELSE 'absolute' END AS src FROM sliced s JOIN merchants USING (merchant_id))"
)
_FAULT_ROWS = "(" + C.values_sql(FAULTS, FAULT_COLUMNS) + ")"
ORACLE["q42_fault_labels"] = sql(
    "SELECT bucket, faults, round(multiplier, 6) AS multiplier, CAST(latency AS BIGINT) AS latency, weight_05, count(*) AS payments FROM (SELECT"
    " t.transaction_id, t.bucket, coalesce(string_agg(f.fault_id, ',' ORDER BY f.place), '') AS faults, coalesce(product(f.conversion_multiplier), 1.0)"
    " AS multiplier, coalesce(sum(f.latency_ms_increase), 0) AS latency, coalesce(arg_max(f.weight_05, f.place) FILTER (f.weight_05 IS NOT NULL), -1.0)"
    f" AS weight_05 FROM tx t LEFT JOIN {_FAULT_ROWS} f ON CAST(f.starts_at AS TIMESTAMP) <= t.bucket AND (f.ends_at IS NULL OR t.bucket <"
    " CAST(f.ends_at AS TIMESTAMP)) AND (f.merchant_id IS NULL OR f.merchant_id = t.merchant_id) AND (f.provider_id IS NULL OR f.provider_id ="
    " t.provider_id) AND (f.country IS NULL OR f.country = t.country) AND (f.payment_method IS NULL OR f.payment_method = t.payment_method) AND"
    " (f.issuer_id IS NULL OR f.issuer_id = t.issuer_id) GROUP BY t.transaction_id, t.bucket) GROUP BY ALL"
)
_ASKED = f"SELECT {MINUTE} || '@' || {key_sql()} AS request_id, * FROM slices"


def _asked_mix() -> str:
    head = sql(
        "SELECT a.request_id, d.decline_code AS code, d.declines, date_diff('minute', d.bucket, a.bucket) AS age FROM (" + _ASKED +
        ") a LEFT JOIN declines d ON d.merchant_id = a.merchant_id AND d.country = a.country AND (a.provider_id IS NULL OR a.provider_id ="
        " d.provider_id) AND (a.payment_method IS NULL OR a.payment_method = d.payment_method) AND (a.issuer_id IS NULL OR a.issuer_id ="
        " d.issuer_id) AND d.bucket BETWEEN a.bucket - INTERVAL 374 MINUTE AND a.bucket"
    )
    return (
        f"WITH x AS MATERIALIZED ({head}), t AS (SELECT request_id, coalesce(sum(declines) FILTER (age < 1), 0) AS t1, coalesce(sum(declines) FILTER"
        " (age < 5), 0) AS t5, coalesce(sum(declines) FILTER (age < 15), 0) AS t15, coalesce(sum(declines) FILTER (age >= 15), 0) AS th FROM x GROUP BY"
        " request_id), w AS (SELECT request_id, th, CASE WHEN t1 >= 20 THEN 1 WHEN t5 >= 20 THEN 5 ELSE 15 END AS w, CASE WHEN t1 >= 20 THEN t1 WHEN"
        " t5 >= 20 THEN t5 ELSE t15 END AS total FROM t), c AS (SELECT x.request_id, x.code, w, total, th, sum(declines) FILTER (age < w) AS cnt,"
        " coalesce(sum(declines) FILTER (age >= 15), 0) AS hist FROM x JOIN w USING (request_id) GROUP BY ALL), s AS (SELECT request_id, code,"
        " (CAST(cnt AS DOUBLE) / total - CASE WHEN th >= 100 THEN CAST(hist AS DOUBLE) / th ELSE baseline_share END) * 100 AS moved FROM c JOIN ("
        + C.codes_sql() + ") k USING (code) WHERE cnt > 0), top AS (SELECT request_id, count(*) AS codes, arg_min(code, row(-moved, code)) AS"
        " most_moved FROM s GROUP BY request_id) SELECT w.request_id, w AS window_min, CAST(total AS BIGINT) AS total_declines, CASE WHEN th >= 100"
        " THEN 'temporal' ELSE 'catalog' END AS reference_source, codes, most_moved FROM w LEFT JOIN top USING (request_id)"
    )


ORACLE["q53_mix_slice"] = _asked_mix()
ORACLE["q54_onset_slice"] = sql(
    "SELECT request_id, coalesce(min(sb) FILTER (g IS NULL OR sb > g), max(b)) AS started_at, count(*) FILTER ((g IS NULL OR sb > g) AND sn >= 30) > 0"
    " AS started_at_exact, greatest(count(*) FILTER (g IS NULL OR sb > g), 1) AS minutes FROM (SELECT a.request_id, a.bucket AS b, s.bucket AS sb,"
    " coalesce(x.n, 0) AS sn, max(CASE WHEN x.n >= 30 AND CAST(x.k AS DOUBLE) / x.n >= CAST(0.9 AS DOUBLE) - CAST(3.0 AS DOUBLE) / 100 THEN s.bucket END)"
    f" OVER (PARTITION BY a.request_id) AS g FROM ({_ASKED}) a JOIN spine s ON s.bucket BETWEEN a.bucket - INTERVAL 120 MINUTE"
    " AND a.bucket LEFT JOIN slices x ON x.bucket = s.bucket AND x.split = a.split AND x.merchant_id = a.merchant_id AND x.country = a.country AND"
    " x.provider_id IS NOT DISTINCT FROM a.provider_id AND x.payment_method IS NOT DISTINCT FROM a.payment_method AND x.issuer_id IS NOT DISTINCT FROM"
    " a.issuer_id) GROUP BY request_id"
)
_PEELED = " UNION ALL ".join(f"SELECT pid, {r} AS peel_no, key, explained FROM causal{r}" for r in (1, 2, 3))
ORACLE["q51_residual_verdict"] = sql(
    "SELECT request_id, bucket, candidate_key, CASE WHEN rn < 30 OR state <> 'MATERIAL_DROP' THEN 'INSUFFICIENT_EVIDENCE' WHEN explained IS NOT NULL"
    " THEN 'ROOT_CAUSE' ELSE 'ECHO' END AS verdict, round(CASE WHEN rn >= 30 THEN coalesce(explained, 0.0) ELSE 0.0 END, 8) AS explained_deficit,"
    " round(CASE WHEN rn >= 30 THEN (coalesce(rest, coalesce(rate, 0.0)) - coalesce(rate, 0.0)) * 100 ELSE 0.0 END, 8) AS residual_delta_pp,"
    " CASE WHEN rn >= 30 AND explained IS NOT NULL THEN coalesce(echoes, 0) ELSE 0 END AS echo_count FROM (SELECT a.*, "
    + state_sql("rk", "rn", "goal", "delta_pp", "1.96")
    + " AS state, CAST(rk AS DOUBLE) / nullif(rn, 0) AS rate FROM (SELECT q.pid, q.bucket, q.goal, q.delta_pp, q.pid || '@' || dim AS request_id,"
    " concat_ws('|', 'country=' || q.country, CASE WHEN dim = 'issuer_id' THEN 'issuerId=bbva_mx' END, 'merchantId=' || q.merchant_id, CASE WHEN dim ="
    " 'provider_id' THEN 'providerId=stripe' END) AS candidate_key, CAST(sum(n) AS BIGINT) AS rn, CAST(sum(k) AS BIGINT) AS rk,"
    " CAST(sum(k) FILTER (CASE dim WHEN 'provider_id' THEN p <> 'stripe' ELSE i <> 'bbva_mx' END) AS DOUBLE) / sum(n) FILTER (CASE dim WHEN"
    " 'provider_id' THEN p <> 'stripe' ELSE i <> 'bbva_mx' END) AS rest FROM problems q JOIN kept0 USING (pid), (VALUES ('provider_id'),"
    " ('issuer_id')) v(dim) GROUP BY q.pid, q.bucket, q.goal, q.delta_pp, q.country, q.merchant_id, dim) a) x LEFT JOIN (" + _PEELED + ") c ON"
    " c.pid = x.pid AND c.key = x.candidate_key LEFT JOIN (SELECT pid, peel_no, count(*) AS echoes FROM (" + ECHOES + ") GROUP BY pid, peel_no) e ON"
    " e.pid = c.pid AND e.peel_no = c.peel_no"
)
ORACLE["q70_window_rows"] = sql("SELECT * FROM rollup WHERE bucket = (SELECT max(bucket) FROM rollup)")
ORACLE["q71_rollup_history"] = sql(
    "SELECT bucket, provider_id, CAST(sum(attempts) AS BIGINT) AS attempts FROM rollup WHERE bucket >= (SELECT max(bucket) FROM rollup) - INTERVAL 10"
    " MINUTE AND bucket < (SELECT max(bucket) FROM rollup) GROUP BY bucket, provider_id")
ORACLE["q72_decline_history"] = sql(
    "SELECT decline_code, CAST(sum(declines) AS BIGINT) AS declines FROM declines WHERE bucket >= (SELECT max(bucket) FROM declines) - INTERVAL 10"
    " MINUTE AND bucket < (SELECT max(bucket) FROM declines) GROUP BY decline_code")
ORACLE["q73_closed_merchants"] = sql("SELECT DISTINCT merchant_id FROM episodes WHERE status NOT IN ('open', 'monitoring')")
ORACLE["q74_conversion_without_country"] = sql(
    f"SELECT {MINUTE} || '@' || merchant_id || '@' || provider_id AS request_id, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(approved) AS"
    " BIGINT) AS approved FROM rollup GROUP BY bucket, merchant_id, provider_id")
# Every payload came twice: a clean one is one fact, a bad one is set aside each time.
ORACLE["q75_payload_ingest"] = sql(
    "SELECT CASE WHEN outcome = 'clean' THEN 'fact' ELSE outcome END AS outcome, CAST(sum(entries) * CASE WHEN outcome = 'clean' THEN 1 ELSE 2 END AS"
    f" BIGINT) AS entries FROM ({QUARANTINE}) GROUP BY outcome")
INCIDENT_LOG = sql(
    "SELECT merchant_id, country, minute, s.id AS incident_id, s.act AS action, CASE WHEN s.act IN ('opened', 'updated', 'refreshed')"
    " THEN request_id END AS request_id, s.p AS provider_id, s.m AS payment_method, s.i AS issuer_id"
    " FROM (SELECT merchant_id, country, minute, request_id, unnest(said) AS s FROM folded)"
).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE |= {"q76_stream_incidents": INCIDENT_LOG, "q77_incident_log": INCIDENT_LOG}
