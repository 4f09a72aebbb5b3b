"""DuckDB statements that say independently what every checked query should return."""

from __future__ import annotations

import re

# ---- shared common table expressions ---------------------------------------

_EV = r"""
base AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_id % 12 AS s, event_type, value,
         (event_type = 'view' AND event_id % 97 = 0) AS ren
  FROM events),
ranked AS (
  SELECT *, COALESCE(SUM(CASE WHEN ren THEN 1 ELSE 0 END) OVER w, 0) AS gen,
         MAX(CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN event_id END) OVER w AS last_signal,
         'r' AS _r
  FROM base
  WINDOW w AS (PARTITION BY s ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
named AS (
  SELECT *, us // 1000000 AS sec, 's' || lpad(CAST(s AS VARCHAR), 2, '0') AS stem,
         's' || lpad(CAST(s AS VARCHAR), 2, '0') || CASE WHEN gen = 0 THEN '' ELSE 'r' || CAST(gen AS VARCHAR) END || '-svc' AS live,
         's' || lpad(CAST((s + 1) % 12 AS VARCHAR), 2, '0') || '-svc' AS next1,
         's' || lpad(CAST((s + 2) % 12 AS VARCHAR), 2, '0') || '-svc' AS next2,
         CASE event_type WHEN 'signup' THEN 'deploy' WHEN 'error' THEN 'log' WHEN 'click' THEN 'metric'
           WHEN 'view' THEN CASE WHEN event_id % 97 = 0 OR event_id % 41 = 0 THEN 'topology' ELSE 'trace' END
           WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'incident_signal' WHEN 1 THEN 'remediation' ELSE 'metric' END
         END AS kind
  FROM ranked),
ev AS (
  SELECT event_id, ts, us, sec, kind, s, gen, ren, live,
    CASE WHEN kind IN ('trace', 'topology') OR (kind = 'incident_signal' AND event_id % 8 = 0) THEN NULL ELSE live END AS service,
    CASE WHEN kind = 'deploy' THEN 'v' || CAST(event_id % 9 + 1 AS VARCHAR) END AS version,
    CASE WHEN kind = 'log' THEN CASE WHEN event_id % 3 <> 0 THEN 'error' ELSE 'info' END END AS level,
    CASE WHEN kind = 'log' THEN 'timeout calling ' || next1 || ' req_id=' || CAST(event_id AS VARCHAR) END AS msg,
    CASE WHEN kind IN ('log', 'trace') THEN 'tr-' || CAST(event_id - event_id % 16 AS VARCHAR) END AS trace_id,
    CASE WHEN kind = 'metric' THEN CASE event_id % 5 WHEN 0 THEN 'latency_p99_ms' WHEN 1 THEN 'error_rate' WHEN 2 THEN 'cpu_percent'
      WHEN 3 THEN 'memory_percent' ELSE 'qps' END END AS name,
    CASE WHEN kind = 'metric' THEN CASE event_id % 5 WHEN 0 THEN value * 100 WHEN 1 THEN value / 1000 WHEN 2 THEN value
      WHEN 3 THEN value ELSE value * 10 END END AS value,
    CASE WHEN kind = 'trace' THEN CASE WHEN event_id % 3 = 0 THEN [live, next1, next2] ELSE [live, next1] END END AS span_svc,
    CASE WHEN kind = 'trace' THEN CASE WHEN event_id % 3 = 0 THEN [value * 50, value * 40, value * 30]
      ELSE [value * 50, value * 40] END END AS span_dur,
    CASE WHEN kind = 'topology' THEN CASE WHEN ren THEN 'rename' WHEN event_id % 2 = 0 THEN 'dep_add' ELSE 'dep_remove' END END AS change,
    CASE WHEN kind = 'topology' THEN live END AS from_,
    CASE WHEN kind = 'topology' THEN CASE WHEN ren THEN stem || 'r' || CAST(gen + 1 AS VARCHAR) || '-svc' ELSE next1 END END AS "to",
    CASE kind WHEN 'incident_signal' THEN 'INC-' || CAST(event_id AS VARCHAR)
      WHEN 'remediation' THEN 'INC-' || CAST(last_signal AS VARCHAR) END AS incident_id,
    CASE WHEN kind = 'incident_signal' THEN 'alert:' || live || '/' || CASE event_id % 3 WHEN 0 THEN 'latency_p99_ms>3000'
      WHEN 1 THEN 'error-rate>5%' ELSE 'cpu_saturation' END END AS trigger_,
    CASE WHEN kind = 'remediation' THEN CASE s % 5 WHEN 0 THEN 'rollback' WHEN 1 THEN 'restart' WHEN 2 THEN 'scale_up'
      WHEN 3 THEN 'config_change' ELSE 'failover' END END AS action,
    CASE WHEN kind = 'remediation' THEN live END AS target,
    CASE WHEN kind = 'remediation' THEN CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'resolved' END END AS outcome,
    CASE WHEN kind = 'incident_signal' THEN s % 8 END AS family
  FROM named WHERE NOT (kind = 'remediation' AND last_signal IS NULL))
"""

_IDS = r"""
ren AS (SELECT from_ AS src, "to" AS dst, us, event_id AS seq FROM ev WHERE change = 'rename'),
und AS (SELECT src AS a, dst AS b FROM ren UNION SELECT dst, src FROM ren),
reach(n, m) AS (SELECT DISTINCT a, a FROM und UNION SELECT r.n, u.b FROM reach r JOIN und u ON r.m = u.a),
comp AS (SELECT n AS name, MIN(m) AS identity_id FROM reach GROUP BY n),
cur AS (SELECT c.identity_id, arg_max(r.dst, r.seq) AS current_name FROM ren r JOIN comp c ON c.name = r.src GROUP BY 1),
ids AS (SELECT c.name, c.identity_id, cur.current_name FROM comp c JOIN cur USING (identity_id))
"""

_SIG = r"""
sig0 AS (
  SELECT incident_id, event_id AS signal_event_id, us AS signal_us, sec AS signal_sec, trigger_, family, service AS own_name,
         COALESCE(service, regexp_extract(trigger_, '[:\s]([\w][\w\-\.]*)/', 1)) AS affected_name
  FROM ev WHERE kind = 'incident_signal'),
sig AS (
  SELECT q.*, COALESCE(i.identity_id, affected_name) AS affected_id, COALESCE(i.current_name, affected_name) AS affected_now,
         COALESCE(o.identity_id, own_name) AS own_id, COALESCE(o.current_name, own_name) AS service
  FROM sig0 q LEFT JOIN ids i ON i.name = affected_name LEFT JOIN ids o ON o.name = own_name),
evi AS (
  SELECT e.*, COALESCE(service, target) AS svc, COALESCE(i.identity_id, COALESCE(service, target)) AS identity_id
  FROM ev e LEFT JOIN ids i ON i.name = COALESCE(e.service, e.target)),
win AS (
  SELECT q.incident_id, q.signal_event_id, q.signal_us, q.signal_sec, q.affected_id, q.own_id, e.event_id, e.us, e.sec, e.kind, e.service AS ev_service,
         e.version, e.level, e.msg, e.name, e.value, e.span_svc, e.change, e.action, e.svc, e.identity_id, (e.us - q.signal_us) / 1000000.0::DOUBLE AS dt
  FROM sig q JOIN evi e ON e.sec BETWEEN q.signal_sec - 2400 AND q.signal_sec + 60)
"""

_FINE = """CASE WHEN dt > 60 THEN NULL WHEN dt > 0 THEN 'post' WHEN dt < -2400 THEN NULL WHEN dt >= -30 THEN '0-30s'
  WHEN dt >= -180 THEN '30-180s' WHEN dt >= -900 THEN '180-900s' ELSE '900-2400s' END"""
_COARSE = "CASE WHEN dt > 60 OR dt < -2400 THEN NULL WHEN dt > 0 THEN 'post' ELSE 'pre' END"
_EPISODE = """CASE WHEN dt > 120 THEN NULL WHEN dt >= 0 THEN 'post' WHEN dt >= -60 THEN '0-60s' WHEN dt >= -300 THEN '1-5m'
  WHEN dt >= -900 THEN '5-15m' ELSE '15m+' END"""
_ROLE = """CASE WHEN identity_id IS NULL OR affected_id IS NULL THEN 'unknown' WHEN identity_id = affected_id THEN 'self' ELSE 'peer' END"""
_OWN_ROLE = _ROLE.replace("affected_id", "own_id")
_FAMILY = """CASE WHEN contains(lower(name), 'latency') THEN 'latency' WHEN contains(lower(name), 'error_rate') THEN 'error_rate'
  WHEN contains(lower(name), 'cpu') THEN 'cpu' WHEN contains(lower(name), 'memory') THEN 'memory'
  WHEN contains(lower(name), 'request_rate') THEN 'request_rate' WHEN contains(lower(name), 'qps') THEN 'qps' ELSE 'other' END"""
_TIER = """CASE WHEN contains(name, 'latency') THEN CASE WHEN value < 200 THEN 'low' WHEN value < 1000 THEN 'mid' ELSE 'high' END
  WHEN contains(name, 'error_rate') THEN CASE WHEN value < 0.01::DOUBLE THEN 'low' WHEN value < 0.05::DOUBLE THEN 'mid' ELSE 'high' END
  WHEN contains(name, 'cpu') OR contains(name, 'memory') THEN CASE WHEN value < 60 THEN 'low' WHEN value < 85 THEN 'mid' ELSE 'high' END
  WHEN contains(name, 'request_rate') THEN CASE WHEN value < 10 THEN 'low' WHEN value < 200 THEN 'mid' ELSE 'high' END ELSE 'any' END"""
_TOKENS_OF = r"regexp_extract_all(substr({0}, 1, 512), '[A-Za-z0-9_\.\-/:]+')"
_SHAPE = "array_to_string(list_transform(" + _TOKENS_OF + ", lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')"
_MENTIONS = r"regexp_extract_all(msg, '[a-z][a-z0-9\-]+(?:-svc|-api|-service)')"
_GKIND = """CASE WHEN kind = 'log' THEN CASE WHEN level = 'error' THEN 'log_error' ELSE 'log' END
  WHEN kind = 'metric' THEN CASE WHEN contains(name, 'latency') AND value >= 1000 THEN 'metric_latency_high' ELSE 'metric' END
  WHEN kind = 'trace' THEN CASE WHEN len(span_svc) >= 3 THEN 'trace_fanout' ELSE 'trace' END ELSE kind END"""

_FEATURES = f"""
lab AS (SELECT *, unnest([{_FINE}, {_COARSE}]) AS b, {_ROLE} AS role FROM win WHERE kind <> 'incident_signal'),
met AS (
  SELECT incident_id, affected_id, event_id, kind, identity_id, dt, unnest(CASE WHEN kind = 'trace' THEN span_svc ELSE {_MENTIONS} END) AS m
  FROM win WHERE kind = 'trace' OR (kind = 'log' AND level = 'error')),
meti AS (SELECT met.*, COALESCE(i.identity_id, m) AS met_id FROM met LEFT JOIN ids i ON i.name = m),
tok AS (
  SELECT incident_id, 'deploy:' || role || ':' || b AS t FROM lab WHERE kind = 'deploy'
  UNION SELECT incident_id, 'deploy_versioned:' || role || ':' || b FROM lab WHERE kind = 'deploy' AND version IS NOT NULL
  UNION SELECT incident_id, 'log_template:' || substr(md5({_SHAPE.format('msg')}), 1, 12) || ':' || role || ':' || b FROM lab WHERE kind = 'log'
  UNION SELECT incident_id, 'log_level:' || level || ':' || role || ':' || b FROM lab WHERE kind = 'log'
  UNION SELECT incident_id, 'metric:' || {_FAMILY} || ':' || {_TIER} || ':' || role || ':' || b FROM lab WHERE kind = 'metric' AND {_FAMILY} <> 'qps'
  UNION SELECT incident_id, 'trace:fanout=' || CASE WHEN len(span_svc) = 1 THEN '1' WHEN len(span_svc) <= 3 THEN '2-3' ELSE '4+' END || ':' || b
    FROM lab WHERE kind = 'trace' AND len(span_svc) > 0
  UNION SELECT incident_id, 'topology:' || change || ':' || b FROM lab WHERE kind = 'topology'
  UNION SELECT incident_id, 'prior_remediation:' || action || ':' || role || ':' || b FROM lab WHERE kind = 'remediation'
  UNION SELECT incident_id, 'trace_touches_self:' || b FROM (SELECT *, unnest([{_FINE}, {_COARSE}]) AS b FROM meti WHERE kind = 'trace' AND met_id = affected_id)
  UNION SELECT incident_id, 'cross_service_error:' || {_ROLE} || ':' || b
    FROM (SELECT *, unnest([{_FINE}, {_COARSE}]) AS b FROM meti WHERE kind = 'log' AND (identity_id IS NULL OR met_id <> identity_id))),
tokens AS (SELECT incident_id, list_sort(list_distinct(list(t))) AS tokens FROM tok WHERE t IS NOT NULL GROUP BY 1),
sym AS (
  SELECT incident_id, unnest(CASE kind WHEN 'deploy' THEN ['recent_deploy']
    WHEN 'metric' THEN [CASE WHEN contains(name, 'latency') AND value >= 1000 THEN 'latency_spike'
                             WHEN contains(name, 'error_rate') AND value >= 0.05::DOUBLE THEN 'error_rate_spike' ELSE 'metric_anomaly' END]
    WHEN 'log' THEN CASE WHEN level = 'error' THEN ['error_log', 'timeout'] ELSE ['timeout'] END
    WHEN 'trace' THEN CASE WHEN len(span_svc) >= 3 THEN ['trace_fanout'] ELSE [] END
    WHEN 'topology' THEN ['topology_change'] WHEN 'remediation' THEN ['prior_remediation'] ELSE [] END) AS t FROM win),
prof AS (SELECT DISTINCT incident_id, kind || ':' || {_EPISODE} AS t FROM win WHERE event_id <> signal_event_id),
inv AS (SELECT incident_id, identity_id AS t FROM win WHERE identity_id IS NOT NULL UNION SELECT incident_id, met_id FROM meti WHERE kind = 'trace'),
feat AS (
  SELECT q.*, COALESCE(k.tokens, []) AS tokens, COALESCE(y.l, ['unspecified']) AS symptoms, COALESCE(p.l, []) AS profile, COALESCE(v.l, []) AS services
  FROM sig q LEFT JOIN tokens k USING (incident_id)
  LEFT JOIN (SELECT incident_id, list_sort(list_distinct(list(t))) AS l FROM sym GROUP BY 1) y USING (incident_id)
  LEFT JOIN (SELECT incident_id, list_sort(list(t)) AS l FROM prof WHERE t IS NOT NULL GROUP BY 1) p USING (incident_id)
  LEFT JOIN (SELECT incident_id, list_sort(list(t)) AS l FROM inv GROUP BY 1) v USING (incident_id))
"""

_DEPS = """
chg AS (
  SELECT COALESCE(a.identity_id, from_) AS src_id, COALESCE(b.identity_id, "to") AS dst_id, change, event_id
  FROM ev LEFT JOIN ids a ON a.name = from_ LEFT JOIN ids b ON b.name = "to" WHERE change IN ('dep_add', 'dep_remove')),
deps AS (SELECT src_id, dst_id FROM chg GROUP BY 1, 2 HAVING arg_max(change, event_id) = 'dep_add'),
nbrs AS (SELECT src_id AS identity_id, dst_id AS neighbour_id FROM deps UNION SELECT dst_id, src_id FROM deps),
dreach(n, m) AS (SELECT DISTINCT identity_id, identity_id FROM nbrs UNION SELECT r.n, x.neighbour_id FROM dreach r JOIN nbrs x ON r.m = x.identity_id),
dcomp AS (SELECT n AS identity_id, MIN(m) AS component FROM dreach GROUP BY 1),
dlab AS (
  SELECT component, 'cluster:' || component || ':' || COUNT(*) || ':' ||
         printf('%x', bit_xor(('0x' || substr(md5(identity_id), 1, 15))::BIGINT)) AS cluster FROM dcomp GROUP BY 1)
"""

_REM = """
rem AS (SELECT incident_id, event_id, us, action, target, outcome FROM ev WHERE kind = 'remediation'),
graded AS (
  SELECT r.incident_id, r.event_id AS seq, r.us, r.action, r.target, r.outcome = 'resolved' AS success,
         COALESCE(i.identity_id, r.target) AS target_id, COALESCE(i.current_name, r.target) AS target_now
  FROM rem r JOIN sig q USING (incident_id) LEFT JOIN ids i ON i.name = r.target WHERE r.event_id > q.signal_event_id),
closed AS (SELECT incident_id, MIN(us) AS closed_us FROM graded GROUP BY 1)
"""



def _decayed(w: str, last: str, now: str) -> str:
    return f"COALESCE({w} * pow(0.5::DOUBLE, GREATEST(0, {now} - {last}) / 1000000.0::DOUBLE / 604800.0::DOUBLE), 0)"


_AFF = """aff(ck, ek, w) AS (VALUES ('deploy','metric',0.85::DOUBLE),('deploy','log',0.70),('deploy','trace',0.55),('deploy','incident_signal',0.65),
  ('metric','log',0.55),('metric','incident_signal',0.85),('metric','trace',0.45),('log','incident_signal',0.85),('log','log',0.45),
  ('trace','log',0.55),('trace','incident_signal',0.50),('topology','metric',0.35),('topology','log',0.30),('topology','incident_signal',0.25))"""
_TEMPORAL = """CASE WHEN {0} < 0 THEN 0.0 WHEN {0} <= 1 THEN 0.85 WHEN {0} <= 60 THEN 1.0 WHEN {0} <= 180 THEN 0.75 WHEN {0} <= 600 THEN 0.45 ELSE 0.15 END::DOUBLE"""
_SHARE = """CASE kind WHEN 'deploy' THEN 0.6 WHEN 'log' THEN CASE WHEN level = 'error' THEN 0.8 ELSE 0.0 END
  WHEN 'metric' THEN CASE WHEN contains(name, 'latency') AND value > 1000 THEN 0.8 WHEN contains(name, 'error_rate') AND value > 0.05::DOUBLE THEN 0.7 ELSE 0.4 END
  WHEN 'topology' THEN 0.4 ELSE 0.0 END::DOUBLE"""


def _chain(learned: bool = False) -> str:
    """Five greedy steps from each signal back in time, without history, or with ``kn`` of the steps before."""
    history, relation = ("COALESCE(kn.rate, 0)", _decayed("kn.w", "kn.last_us", "f.us")) if learned else ("0", "0")
    known = "LEFT JOIN kn ON kn.incident_id = c.incident_id AND kn.ck = c.kind AND kn.ek = f.kind" if learned else ""
    parts = [_AFF, f"cand AS (SELECT incident_id, event_id, us, kind, {_SHARE} AS share, identity_id AS cause_id, {_GKIND} AS gk FROM win WHERE us < signal_us)",
             "f0 AS (SELECT incident_id, signal_event_id AS event_id, signal_us AS us, 'incident_signal' AS kind, own_id AS cause_id FROM sig)"]
    for i in range(5):
        parts.append(f"""
e{i} AS (
  SELECT c.incident_id, c.event_id, c.us, c.kind, c.cause_id, c.gk, f.event_id AS effect_event_id, f.kind AS effect_kind, f.cause_id AS effect_id,
    (f.us - c.us) / 1000000.0::DOUBLE AS dt,
    CASE WHEN c.cause_id = f.cause_id THEN 0.25 WHEN n.identity_id IS NOT NULL THEN 0.15 ELSE 0.0 END::DOUBLE AS topo,
    LEAST(1.0::DOUBLE, c.share + CASE WHEN f.kind = 'incident_signal' THEN 0.2 ELSE 0.0 END::DOUBLE) AS evid, aff.w, {history}::DOUBLE AS hist, GREATEST(-0.5::DOUBLE, LEAST(0.5::DOUBLE, {relation})) AS rel
  FROM cand c JOIN f{i} f ON c.incident_id = f.incident_id AND c.us < f.us
  JOIN aff ON aff.ck = c.kind AND aff.ek = f.kind
  LEFT JOIN nbrs n ON n.identity_id = f.cause_id AND n.neighbour_id = c.cause_id {known}),
g{i} AS (
  SELECT *, 0.30::DOUBLE * w + 0.25::DOUBLE * {_TEMPORAL.format('dt')} + 0.15::DOUBLE * hist + 0.15::DOUBLE * topo + 0.10::DOUBLE * evid + 0.05::DOUBLE * rel AS score FROM e{i}),
f{i + 1} AS (
  SELECT * FROM g{i} WHERE score >= 0.30::DOUBLE * 0.85::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, us, event_id) = 1)""")
    steps = " UNION ALL ".join(f"SELECT {i} AS step, incident_id, event_id, us, kind, cause_id, gk, effect_event_id, effect_kind, effect_id, dt, topo, hist, evid, score FROM f{i + 1}"
                               for i in range(5))
    parts.append(f"deep AS ({steps})")
    parts.append("fast AS (SELECT * FROM deep d WHERE NOT EXISTS (SELECT 1 FROM deep x WHERE x.incident_id = d.incident_id AND x.step <= d.step AND x.score < 0.30::DOUBLE))")
    return ",\n".join(parts)


_CHAIN = _chain()

_EV_IDS = ",".join([_EV, _IDS])
_EV_SIG = ",".join([_EV, _IDS, _SIG])
_EV_REM = ",".join([_EV, _IDS, _SIG, _REM])
_EV_FEAT = ",".join([_EV, _IDS, _SIG, _FEATURES])
_EV_CHAIN = ",".join([_EV, _IDS, _SIG, _DEPS, _CHAIN])
_ALL_PARTS = ",".join([_EV, _IDS, _SIG, _REM, _FEATURES, _DEPS, _CHAIN])


def _wl() -> str:
    """Fingerprints of the fast chain (neighbour-linked windows when there is none) and of the deep one."""
    def h(i: int, e: str) -> str:
        return f"substr(md5('wl{i}|' || {e}), 1, 12)"

    def rounds(src: str, out: str) -> str:
        """Two rounds over (incident_id, pos, lab) where a null pos is a lone node."""
        return f"""
{out}0 AS (SELECT incident_id, pos, {h(0, 'lab')} AS l0 FROM {src}),
{out}1 AS (
  SELECT a.incident_id, a.pos, a.l0, {h(1, "a.l0 || '|' || COALESCE(array_to_string(list_sort(list(b.l0) FILTER (WHERE b.l0 IS NOT NULL)), ','), '')")} AS l1
  FROM (SELECT row_number() OVER () AS rid, * FROM {out}0) a LEFT JOIN {out}0 b ON a.incident_id = b.incident_id AND abs(a.pos - b.pos) = 1
  GROUP BY a.rid, a.incident_id, a.pos, a.l0),
{out}2 AS (
  SELECT a.incident_id, a.l0, a.l1, {h(2, "a.l1 || '|' || COALESCE(array_to_string(list_sort(list(b.l1) FILTER (WHERE b.l1 IS NOT NULL)), ','), '')")} AS l2
  FROM (SELECT row_number() OVER () AS rid, * FROM {out}1) a LEFT JOIN {out}1 b ON a.incident_id = b.incident_id AND abs(a.pos - b.pos) = 1
  GROUP BY a.rid, a.incident_id, a.pos, a.l0, a.l1),
{out} AS (
  SELECT incident_id, list_sort(list_distinct(list(t))) AS graph FROM (
    SELECT incident_id, unnest(['wl0:' || l0, 'wl1:' || l1, 'wl2:' || l2]) AS t FROM {out}2) GROUP BY 1)"""

    def nodes(chain: str, out: str) -> str:
        return f"""
{out}c AS (SELECT DISTINCT incident_id FROM {chain}),
{out}n AS (
  SELECT incident_id, event_id, step FROM {chain}
  UNION ALL SELECT q.incident_id, q.signal_event_id, -1 FROM sig q JOIN {out}c USING (incident_id)),
{out}p AS (
  SELECT w.incident_id, w.event_id, CASE WHEN c.incident_id IS NOT NULL THEN n.step
           ELSE row_number() OVER (PARTITION BY w.incident_id ORDER BY w.us, w.event_id) END AS pos,
         {_GKIND} || ':' || {_OWN_ROLE} AS lab
  FROM win w LEFT JOIN {out}c c USING (incident_id) LEFT JOIN {out}n n ON n.incident_id = w.incident_id AND n.event_id = w.event_id)"""

    return ",\n".join([nodes("fast", "wf"), rounds("wfp", "wf_"), nodes("deep", "wd"), rounds("wdp", "wd_")])


_WL = _wl()

_EPI = """
rhist AS (SELECT incident_id, list_sort(list_distinct(list(action))) AS actions, list_sort(list_distinct(list(outcome))) AS outcomes, COUNT(*) AS n FROM rem GROUP BY 1),
pat AS (SELECT incident_id, list(kind || '->' || effect_kind ORDER BY step DESC) AS pattern FROM fast GROUP BY 1),
clu AS (
  SELECT incident_id, list_sort(list_distinct(list(COALESCE(l.cluster, 'cluster:' || v.t || ':1:' || printf('%x', ('0x' || substr(md5(v.t), 1, 15))::BIGINT))))) AS clusters
  FROM inv v LEFT JOIN dcomp d ON d.identity_id = v.t LEFT JOIN dlab l ON l.component = d.component GROUP BY 1),
nea AS (SELECT incident_id, list_sort(list_distinct(list(n.neighbour_id))) AS near FROM inv v JOIN nbrs n ON n.identity_id = v.t GROUP BY 1),
epi AS (
  SELECT f.*, COALESCE(c.clusters, []) AS clusters, COALESCE(x.near, []) AS near, COALESCE(r.actions, []) AS actions, COALESCE(r.outcomes, []) AS outcomes,
         COALESCE(p.pattern, []) AS pattern, k.closed_us, g.graph, gd.graph AS graph_closed,
         CASE WHEN contains(trigger_, 'latency') THEN 'latency_alert' WHEN contains(trigger_, 'error') OR contains(trigger_, 'timeout') THEN 'error_alert'
              WHEN contains(trigger_, 'saturation') OR contains(trigger_, 'cpu') OR contains(trigger_, 'memory') THEN 'resource_alert' ELSE 'generic_alert' END AS trigger_type
  FROM feat f LEFT JOIN clu c USING (incident_id) LEFT JOIN nea x USING (incident_id) LEFT JOIN rhist r USING (incident_id)
  LEFT JOIN pat p USING (incident_id) LEFT JOIN closed k USING (incident_id) LEFT JOIN wf_ g USING (incident_id) LEFT JOIN wd_ gd USING (incident_id))
"""

_EV_EPI = ",".join([_ALL_PARTS, _WL, _EPI])


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) - {both} > 0 THEN {both}::DOUBLE / (len({a}) + len({b}) - {both}) ELSE 0.0::DOUBLE END"


_TOPO = """CASE WHEN len(q.services) = 0 OR len(c.services) = 0 THEN 0.0 WHEN list_has_any(q.services, c.services) THEN 1.0
  WHEN list_has_any(q.near, c.services) THEN 0.5 WHEN list_has_any(q.clusters, c.clusters) THEN 0.3 ELSE 0.0 END::DOUBLE"""


def _plain(graph: str, boost: str = "0") -> str:
    return (f"GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 0.45::DOUBLE * ({_jac('q.tokens', 'c.tokens')}) + 0.20::DOUBLE * ({_jac('q.symptoms', 'c.symptoms')}) + "
            f"0.15::DOUBLE * ({_jac('q.profile', 'c.profile')}) + 0.10::DOUBLE * ({_jac('q.graph', 'c.' + graph)}) + 0.10::DOUBLE * ({_TOPO}) + {boost}))")


_QC = "FROM pairs p JOIN epi q ON q.incident_id = p.query_id JOIN epi c ON c.incident_id = p.incident_id"


def _found(k: int, family: str = "c.family", boost: str = "") -> str:
    """Matches of every signal among all incidents closed before it: the same service first, families
    taking turns, then all others by score, k in all."""
    order = "same DESC, CASE WHEN same THEN round ELSE 0 END, top DESC, fam, round"
    return f"""
al{k} AS MATERIALIZED (
  SELECT q.incident_id AS query_id, c.incident_id, c.closed_us, {family} AS family, COALESCE(q.service = c.service, FALSE) AS same, {_plain('graph_closed', 'COALESCE(bo.boost, 0)' if boost else '0')} AS plain
  FROM epi q {boost} JOIN epi c ON c.closed_us < q.signal_us AND c.incident_id <> q.incident_id),
sc{k} AS (
  SELECT *, plain + CASE WHEN same THEN 0.2 ELSE 0.0 END::DOUBLE AS score, CASE WHEN same THEN COALESCE(CAST(family AS VARCHAR), 'unknown') ELSE '' END AS fam FROM al{k}),
rd{k} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, same, fam ORDER BY score DESC, closed_us, incident_id) AS round,
         CASE WHEN same THEN MAX(score) OVER (PARTITION BY query_id, same, fam) ELSE 0 END AS top FROM sc{k}),
found{k} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM rd{k}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) <= {k})"""


_EV_FOUND = _EV_EPI + "," + _found(5)
# The twenty matches of every signal that are looked at closely.
_EV_PAIRS = _EV_EPI + "," + _found(20) + ", pairs AS (SELECT query_id, incident_id FROM found20)"

_DECOY = """
dec AS (
  SELECT t.query_id, t.first_score, (t.first_score < 0.55 OR COALESCE(m.known, 0) < 2 OR COALESCE(m.most, 0) < 2) AS decoy
  FROM (SELECT query_id, arg_min(score, rank) AS first_score FROM found5 WHERE rank <= 3 GROUP BY 1) t
  LEFT JOIN (SELECT query_id, SUM(n) AS known, MAX(n) AS most FROM (
    SELECT query_id, family, COUNT(*) AS n FROM found5 WHERE rank <= 3 AND family IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m USING (query_id))
"""

_SUPPORT = """
nm AS (SELECT query_id, COUNT(*) AS nm FROM found5 GROUP BY 1),
sup AS (
  SELECT f.query_id, r.action, COUNT(*) AS n, COUNT(*) FILTER (WHERE r.outcome = 'resolved') AS n_success,
         SUM(CASE WHEN r.outcome = 'resolved' THEN f.score ELSE 0 END) / ANY_VALUE(nm.nm) AS sim_score,
         arg_min(COALESCE(i.current_name, r.target), f.rank * 1000000000 + r.event_id) AS target
  FROM found5 f JOIN rem r USING (incident_id) JOIN nm USING (query_id) JOIN sig s ON s.incident_id = f.query_id AND r.us < s.signal_us
  LEFT JOIN ids i ON i.name = r.target GROUP BY 1, 2),
simple AS (
  SELECT query_id, action, COALESCE(target, e.service, 'unknown') AS target, 'resolved ' || n_success || '/' || n AS historical_outcome,
         ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 0.7::DOUBLE * n_success / n + 0.3::DOUBLE * sim_score)), 4) AS confidence
  FROM sup JOIN epi e ON e.incident_id = sup.query_id),
srank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, action) AS rank FROM simple
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, action) <= 3)
"""

# Remediations ranked with what was known of them before the signal.
_RANKED = f"""
full7 AS (
  SELECT s.query_id, s.action, COALESCE(s.target, e.service, 'unknown') AS target, 'resolved ' || n_success || '/' || s.n AS historical_outcome,
    ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 0.50::DOUBLE * n_success / s.n + 0.25::DOUBLE * sim_score + 0.15::DOUBLE * COALESCE(
        (SELECT AVG(g.success::INT) FROM graded g WHERE g.target_id = e.own_id AND g.action = s.action AND g.us < e.signal_us),
        (SELECT AVG(g.success::INT) FROM graded g WHERE g.action = s.action AND g.us < e.signal_us), 0)
      + 0.10::DOUBLE * GREATEST(0.0::DOUBLE, (SELECT {_decayed('arg_max(f.w, f.i)', 'MAX(f.us)', 'e.signal_us')} FROM fwa f WHERE f.key = s.action AND f.us < e.signal_us)))), 4) AS confidence
  FROM sup s JOIN epi e ON e.incident_id = s.query_id),
ranked7 AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, action) AS rank FROM full7
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, action) <= 3)
"""

# What the rules offer, and what is offered in all.
_RULES = """
fl AS (SELECT q.incident_id AS query_id, COALESCE(ANY_VALUE({service}), 'unknown') AS target, COALESCE(bool_or(w.kind = 'deploy'), FALSE) AS d,
  COALESCE(bool_or(w.kind = 'metric' AND contains(w.name, 'latency') AND w.value > 1000), FALSE) AS l, COALESCE(bool_or(w.kind = 'log' AND w.level = 'error'), FALSE) AS e
  FROM sig q LEFT JOIN win w USING (incident_id) {named} GROUP BY 1),
rules AS (
  SELECT query_id, 1 AS rank, 'rollback' AS action, target, 'rule: worse after a rollout' AS historical_outcome, 0.4::DOUBLE AS confidence FROM fl WHERE d AND (l OR e)
  UNION ALL SELECT query_id, CASE WHEN d THEN 2 ELSE 1 END, 'scale_up', target, 'rule: answers stay slow', 0.35::DOUBLE FROM fl WHERE l
  UNION ALL SELECT query_id, 1, 'alert', target, 'rule: nothing alike is known', 0.2::DOUBLE FROM fl WHERE NOT l AND NOT (d AND e))
"""
_OFFERS = """
offers AS (
  SELECT query_id, rank, action, target, historical_outcome, confidence FROM ranked7
  UNION ALL SELECT * FROM rules WHERE query_id NOT IN (SELECT query_id FROM ranked7))
"""
_ASTATS = """
st AS (SELECT target_id, action, COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS k FROM graded GROUP BY 1, 2),
sa AS (SELECT action, SUM(n) AS n, SUM(k) AS k FROM st GROUP BY 1)
"""


def _fold(rows: str, lo: float, hi: float, half_life: bool, s: str = "") -> str:
    """Weights by updating one row after the other: ``rows(key, us, seq, delta)``; ``s`` ends the names."""
    f = "pow(0.5::DOUBLE, GREATEST(0, (r.us - a.us)) / 1000000.0::DOUBLE / 604800.0::DOUBLE)" if half_life else "1.0::DOUBLE"
    return f"""
fr{s} AS (SELECT key, us, delta::DOUBLE AS delta, row_number() OVER (PARTITION BY key ORDER BY us, seq) AS i FROM ({rows})),
fw{s}(key, i, us, w) AS (
  SELECT key, i, us, GREATEST({lo}::DOUBLE, LEAST({hi}::DOUBLE, delta)) FROM fr{s} WHERE i = 1
  UNION ALL
  SELECT r.key, r.i, r.us, GREATEST({lo}::DOUBLE, LEAST({hi}::DOUBLE, a.w * {f} + r.delta)) FROM fw{s} a JOIN fr{s} r ON r.key = a.key AND r.i = a.i + 1),
fold{s} AS (SELECT key, arg_max(w, i) AS w, MAX(us) AS last_us FROM fw{s} GROUP BY 1)"""


_ACTION_ROWS = "SELECT action AS key, us, seq, CASE WHEN success THEN 0.10 ELSE -0.06 END AS delta FROM graded"
_OUT = "outc AS (SELECT d.*, g.seq, g.us AS rem_us, g.success FROM deep d JOIN graded g USING (incident_id))"
_EDGE_ROWS = """SELECT kind || '>' || effect_kind AS key, rem_us AS us, seq * 8 + 7 - step AS seq, CASE WHEN success THEN 0.08 ELSE -0.05 END AS delta FROM outc"""
_PAIR_ROWS = """SELECT LEAST(f.query_id, f.incident_id) || '~' || GREATEST(f.query_id, f.incident_id) AS key, g.us, g.seq * 8 + f.rank AS seq,
  CASE WHEN g.success THEN 0.05 ELSE -0.05 END AS delta FROM found5 f JOIN graded g ON g.incident_id = f.query_id WHERE f.rank <= 3"""

# The flagship: chains with what was learned before each signal from chains without history,
# matches with the boost of the query's own pattern, offers under their decoy cap.
_AT_SIGNAL = f"""
hop AS (SELECT src, arg_min(dst, seq) AS dst, arg_min(us, seq) AS us FROM ren GROUP BY 1),
walk(incident_id, us, cur, d) AS (SELECT incident_id, signal_us, affected_name, 0 FROM sig
  UNION ALL SELECT w.incident_id, w.us, h.dst, w.d + 1 FROM walk w JOIN hop h ON h.src = w.cur AND h.us <= w.us),
at_signal AS (SELECT incident_id, arg_max(cur, d) AS name FROM walk GROUP BY 1)
"""


def _known(s: str, outcomes: str) -> str:
    """Weights, and rates of ``outcomes``, of every pair of kinds before every signal."""
    return f"""
kw{s} AS MATERIALIZED (SELECT q.incident_id, f.key, arg_max(f.w, f.i) AS w, MAX(f.us) AS last_us FROM sig q JOIN fw{s} f ON f.us < q.signal_us GROUP BY 1, 2),
kr{s} AS MATERIALIZED (SELECT q.incident_id, o.kind AS ck, o.effect_kind AS ek, AVG(o.success::INT) AS rate FROM sig q JOIN {outcomes} o ON o.rem_us < q.signal_us GROUP BY 1, 2, 3)"""


def _flagship() -> str:
    first = _chain()
    for name in [f"{x}{i}" for x in "efg" for i in range(6)] + ["deep", "fast", "aff", "cand"]:
        first = re.sub(rf"\b{name}\b", f"first_{name}", first)
    outc0 = "outc0 AS (SELECT d.*, g.seq, g.us AS rem_us, g.success FROM first_deep d JOIN graded g USING (incident_id))"
    kn = "kn AS MATERIALIZED (SELECT r.incident_id, r.ck, r.ek, r.rate, w.w, w.last_us FROM kr0 r JOIN kw0 w ON w.incident_id = r.incident_id AND w.key = r.ck || '>' || r.ek)"
    boost = f"""bo AS (SELECT d.incident_id, GREATEST(-0.05::DOUBLE, LEAST(0.05::DOUBLE, 0.05::DOUBLE * AVG({_decayed('k.w', 'k.last_us', 'q.signal_us')}))) AS boost
  FROM fast d JOIN sig q USING (incident_id) LEFT JOIN kw1 k ON k.incident_id = d.incident_id AND k.key = d.kind || '>' || d.effect_kind GROUP BY 1)"""
    told = "told AS (SELECT o.*, CASE WHEN COALESCE(d.decoy, TRUE) THEN LEAST(o.confidence, 0.4::DOUBLE) ELSE o.confidence END AS shown FROM offers o LEFT JOIN dec d USING (query_id))"
    return ",".join([
        _EV, _IDS, _SIG, _REM, _FEATURES, _DEPS, first, outc0, _fold(_EDGE_ROWS.replace("FROM outc", "FROM outc0"), -1, 1, True, "0"), _known("0", "outc0"), kn,
        _chain(True), _WL, _EPI, _OUT, _fold(_EDGE_ROWS, -1, 1, True, "1"), _known("1", "outc"), boost,
        _found(5, boost="LEFT JOIN bo ON bo.incident_id = q.incident_id"), "pairs AS (SELECT query_id, incident_id FROM found5)", _DECOY, _SUPPORT,
        _fold(_ACTION_ROWS, -1, 1, True, "a"), _RANKED, _AT_SIGNAL, _RULES.format(service="a.name", named="LEFT JOIN at_signal a USING (incident_id)"), _OFFERS, told])


_FLAGSHIP = _flagship()

_TRUTH = "truth AS (SELECT incident_id, CASE WHEN signal_event_id % 5 <> 0 THEN family END AS tf FROM sig)"
_SCORED = f"""{_TRUTH},
ms AS (
  SELECT t.incident_id, t.tf, COUNT(*) FILTER (WHERE f.family = t.tf) AS hits, COUNT(*) FILTER (WHERE ROUND(f.score, 4) >= 0.5) AS sure
  FROM truth t LEFT JOIN found5 f ON f.query_id = t.incident_id GROUP BY 1, 2),
msc AS (
  SELECT incident_id, hits, CASE WHEN tf IS NULL THEN sure = 0 ELSE hits > 0 END AS in_top_k,
         CASE WHEN tf IS NULL THEN (sure = 0)::INT::DOUBLE ELSE hits / 5.0::DOUBLE END AS precision_at_k FROM ms)"""
_REMOK = """
expd AS (SELECT q.incident_id, r.expected FROM sig q LEFT JOIN (SELECT incident_id, arg_min(action, event_id) AS expected FROM rem GROUP BY 1) r USING (incident_id)),
remok AS (
  SELECT e.incident_id, CASE WHEN e.expected IS NULL THEN COUNT(*) FILTER (WHERE ROUND(s.confidence, 3) >= 0.5) = 0
    ELSE COUNT(*) FILTER (WHERE s.action = e.expected) > 0 END AS remediation_ok
  FROM expd e LEFT JOIN srank s ON s.query_id = e.incident_id GROUP BY e.incident_id, e.expected)"""
_SEEDS = f"""{_SCORED},{_SUPPORT},{_REMOK},
alls AS (
  SELECT m.*, r.remediation_ok, q.signal_event_id % 5 AS seed, sqrt((q.signal_us % 900000)::DOUBLE) AS latency_ms
  FROM msc m JOIN remok r USING (incident_id) JOIN sig q USING (incident_id)),
seeds AS (
  SELECT seed, ROUND(AVG(in_top_k::INT), 4) AS recall, ROUND(AVG(precision_at_k), 4) AS "precision", ROUND(AVG(remediation_ok::INT), 4) AS remediation_acc,
         ROUND(AVG(latency_ms), 2) AS latency_mean_ms, COUNT(*) AS n,
         ROUND(list_sort(list(latency_ms))[GREATEST(0, floor(0.95::DOUBLE * COUNT(*))::INT - 1) + 1], 2) AS latency_p95_ms
  FROM alls GROUP BY 1),
total AS (
  SELECT ROUND(AVG(recall), 4) AS recall, ROUND(AVG("precision"), 4) AS "precision", ROUND(AVG(remediation_acc), 4) AS remediation_acc,
         ROUND(AVG(latency_mean_ms), 4) AS latency_mean_ms, ROUND(MAX(latency_p95_ms), 2) AS latency_p95_ms, COUNT(*) AS n_seeds, SUM(n) AS n FROM seeds)"""

_LOG = """
chlog AS (
  SELECT CAST(c_custkey AS VARCHAR) AS key, 'name' AS col, c_name AS value, 1 AS version, 'A' AS peer FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'email', 'u' || (c_custkey % 97) || '@x', 1, 'A' FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment, 2, 'A' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'balance', CAST(CAST(floor(c_acctbal * 100) AS BIGINT) AS VARCHAR), 2, 'B' FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', upper(c_mktsegment || '-b'), 3, 'B' FROM customer WHERE c_custkey % 6 = 0),
gone AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 10 = 0),
cells AS (
  SELECT key, col, value, version, peer FROM chlog WHERE key NOT IN (SELECT key FROM gone)
  QUALIFY row_number() OVER (PARTITION BY key, col ORDER BY version DESC, peer DESC) = 1),
livek AS (SELECT DISTINCT key FROM chlog WHERE key NOT IN (SELECT key FROM gone)),
kids AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS status,
  CAST(floor(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders)
"""
_PRINT = """
cellh AS (SELECT sha256('users' || chr(1) || key || chr(1) || col || chr(1) || value) AS h, * FROM {0}),
print AS (SELECT {1} md5(COUNT(*) || '|' || SUM(('0x' || substr(h, 1, 15))::BIGINT) || '|' || SUM(('0x' || substr(h, 16, 15))::BIGINT)) AS fingerprint FROM cellh {2})
"""
_LINES = f"""
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
ln AS (SELECT doc_id * 16777216 + i - 1 AS line_id, l[i] AS msg FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines)),
sh AS (
  SELECT {_SHAPE.format('msg')} AS shape, len({_TOKENS_OF.format('msg')}) AS n_tokens, COUNT(*) AS freq, MIN(line_id) AS first_seen, MAX(line_id) AS last_seen
  FROM ln WHERE len({_TOKENS_OF.format('msg')}) > 0 GROUP BY 1, 2)
"""


# The same of whole lines.
_WHOLE_LINES = _LINES.replace("substr(msg, 1, 512)", "msg")


def _templates() -> str:
    """Shapes ``sh`` with the template of the widest group, by token count and first tokens, that agrees on half."""
    parts = ["l0 AS (SELECT shape, n_tokens, string_split(shape, ' ') AS t, CAST(ceil(n_tokens * 0.5::DOUBLE) AS INT) AS enough FROM sh)"]
    depths = (0, *(2 ** i for i in range(21)))
    for i, depth in enumerate(depths):
        parts.append(f"""
g{i} AS MATERIALIZED (SELECT *, array_to_string(t[1:LEAST({depth}, enough)], ' ') AS prefix FROM l{i}),
a{i} AS (
  SELECT n_tokens, prefix, place, MIN(tok) AS least, MAX(tok) AS most
  FROM (SELECT n_tokens, prefix, unnest(t) AS tok, generate_subscripts(t, 1) AS place FROM g{i}) GROUP BY 1, 2, 3),
p{i} AS (SELECT n_tokens, prefix, COUNT(*) FILTER (least = most) AS same, string_agg(CASE WHEN least = most THEN least ELSE '<*>' END, ' ' ORDER BY place) AS pattern FROM a{i} GROUP BY 1, 2),
s{i} AS MATERIALIZED (SELECT shape, g.n_tokens, t, enough, CASE WHEN same >= enough THEN pattern END AS pattern FROM g{i} g JOIN p{i} p ON p.n_tokens = g.n_tokens AND p.prefix = g.prefix),
l{i + 1} AS (SELECT shape, n_tokens, t, enough FROM s{i} WHERE pattern IS NULL)""")
    every = " UNION ALL ".join(f"SELECT shape, n_tokens, pattern FROM s{i} WHERE pattern IS NOT NULL" for i in range(len(depths)))
    parts.append(f"tp AS (SELECT sh.*, e.pattern FROM sh JOIN ({every}) e ON e.shape = sh.shape AND e.n_tokens = sh.n_tokens)")
    return ",\n".join(parts)


_VEC = """
first AS (SELECT label, MIN(vec_id) AS vec_id FROM embeddings GROUP BY 1),
pats AS (SELECT e.label AS idx, list_transform(e.embedding, lambda v: v::DOUBLE) AS x FROM embeddings e JOIN first USING (label, vec_id)),
qs AS (SELECT e.vec_id AS query_id, e.label AS truth, list_transform(e.embedding, lambda v: v::DOUBLE) AS q FROM embeddings e ANTI JOIN first USING (label, vec_id))
"""
_CLASS = """
lv AS (SELECT *, unnest([0, 32]) AS level, query_id % 5 AS seed FROM qs),
bad AS (SELECT query_id, truth, level, seed, q, list_transform(q, lambda v, i: CASE WHEN i <= level THEN 0.0::DOUBLE ELSE v END) AS d FROM lv),
cl AS (
  SELECT query_id, level, seed, truth, arg_max(idx, list_dot_product(x, q)) AS predicted, arg_max(idx, list_dot_product(x, d)) AS baseline
  FROM bad CROSS JOIN pats GROUP BY 1, 2, 3, 4),
acc AS (
  SELECT seed, {0} AS level, AVG((predicted = truth)::INT) AS accuracy, AVG((baseline = truth)::INT) AS baseline_accuracy FROM cl GROUP BY 1, 2)
"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _num(c: str) -> str:
    return f"CAST(CAST(ROUND({c}, 3) AS DECIMAL(18, 3)) AS VARCHAR)"


_SUMMARY = """SELECT kind, COUNT(*) AS n, SUM(event_id) AS id_sum, SUM(sec) AS sec_sum, COUNT(service) AS n_service, COUNT(from_) AS n_from,
  ROUND(SUM(value), 3) AS value_sum, SUM(COALESCE(len(span_svc), 0)) AS n_spans FROM ev GROUP BY 1"""
_SEEN = """seen AS (SELECT event_id, COALESCE(service, target) AS name FROM ev WHERE COALESCE(service, target) IS NOT NULL
  UNION SELECT event_id, unnest(span_svc) FROM ev WHERE kind = 'trace')"""
_CLAUSE = f"""CASE kind WHEN 'deploy' THEN service || ' rolled out ' || version WHEN 'metric' THEN name || ' of ' || service || ' at ' || {_num('value')}
  WHEN 'log' THEN service || ' logged ' || level || ': ' || CASE WHEN length(msg) > 60 THEN substr(msg, 1, 60) || '..' ELSE msg END
  WHEN 'trace' THEN 'a call across ' || len(span_svc) || ' hops' WHEN 'topology' THEN change || ' of ' || from_ || ' to ' || "to"
  WHEN 'incident_signal' THEN 'the alert of ' || incident_id WHEN 'remediation' THEN 'an earlier ' || action END"""
_LABEL = """CASE kind WHEN 'metric' THEN CASE WHEN contains(name, 'latency') THEN 'slow answers' ELSE name END WHEN 'trace' THEN 'slow call path'
  WHEN 'log' THEN CASE WHEN contains(msg, 'timeout') THEN 'timeouts logged' ELSE 'errors logged' END WHEN 'incident_signal' THEN 'alert' ELSE kind END"""
_METRICS = f"""met5 AS (
  SELECT COALESCE(i.current_name, service) AS service, family, us, event_id, value
  FROM (SELECT service, {_FAMILY} AS family, us, event_id, value FROM ev WHERE kind = 'metric') m LEFT JOIN ids i ON i.name = m.service
  WHERE family NOT IN ('qps', 'other')),
late AS (SELECT service, family, arg_max(value, us * 1000 - event_id % 1000) AS value FROM met5 GROUP BY 1, 2),
svcs AS (SELECT DISTINCT COALESCE(i.current_name, s.name) AS service FROM seen s LEFT JOIN ids i ON i.name = s.name)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(key: str, ctes: str, select: str) -> None:
        q[key] = _with(ctes, select)

    for key in ("SRC1", "SRC2", "SRC3"):
        add(key, _EV, _SUMMARY)
    add("SRC2.ids", _EV, "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM ev")
    add("SRC4", _EV, "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM ev")
    counts = """SELECT COALESCE(i.identity_id, COALESCE(service, target)) AS identity_id, kind, COUNT(*) AS n FROM ev
      LEFT JOIN ids i ON i.name = COALESCE(service, target) WHERE COALESCE(service, target) IS NOT NULL GROUP BY 1, 2"""
    add("SRC5", _EV_IDS, counts)
    add("SRC6", _EV, "SELECT event_id, kind, incident_id FROM ev WHERE 'INC-' || event_id IN (SELECT incident_id FROM ev WHERE kind = 'remediation')")

    add("FIL1", _EV, "SELECT event_id, service, version FROM ev WHERE kind = 'deploy'")
    add("FIL2", _EV, "SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY event_id) AS seq, event_id, kind FROM ev WHERE incident_id IS NOT NULL")
    add("FIL3", _EV, """SELECT trace_id, COUNT(*) AS n_events, COUNT(*) FILTER (WHERE kind = 'log') AS n_logs, COUNT(*) FILTER (WHERE kind = 'trace') AS n_traces,
      MIN(event_id) AS first_event_id, MAX(event_id) AS last_event_id FROM ev WHERE trace_id IS NOT NULL GROUP BY 1""")
    add("FIL4", _EV_IDS + "," + _SEEN, """SELECT COALESCE(i.identity_id, s.name) AS identity_id, COUNT(DISTINCT event_id) AS n_events, MIN(event_id) AS first_event_id,
      MAX(event_id) AS last_event_id FROM seen s LEFT JOIN ids i ON i.name = s.name GROUP BY 1""")
    add("FIL5", _EV, """SELECT incident_id, service, trigger_ AS "trigger" FROM ev WHERE kind = 'incident_signal'
      AND (contains(lower(incident_id), 's03') OR contains(lower(COALESCE(service, '')), 's03'))""")
    add("FIL6", _EV, f"SELECT {_FAMILY} AS family, COUNT(*) AS n, ROUND(SUM(value), 3) AS value_sum FROM ev WHERE kind = 'metric' AND {_FAMILY} <> 'qps' GROUP BY 1")

    q["SCL1"] = """SELECT event_id, CAST(epoch(COALESCE(
        CASE WHEN regexp_matches(raw, '(Z|[+-][0-9:]+)$') THEN TRY_CAST(raw AS TIMESTAMPTZ)::TIMESTAMPTZ AT TIME ZONE 'UTC' END,
        try_strptime(substr(raw, 1, 19), '%Y-%m-%dT%H:%M:%S'))) AS BIGINT) AS ts_s
      FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN iso || 'Z' WHEN 1 THEN iso WHEN 2 THEN iso || '+02:00' WHEN 3 THEN iso || ' junk'
        WHEN 4 THEN 'not a time' ELSE '' END AS raw FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events))"""
    add("SCL2", _EV, r"SELECT incident_id, COALESCE(service, regexp_extract(trigger_, '[:\s]([\w][\w\-\.]*)/', 1)) AS affected FROM ev WHERE kind = 'incident_signal'")
    add("SCL3", _EV, """SELECT incident_id, CASE event_id % 3 WHEN 0 THEN 'latency_alert' WHEN 1 THEN 'error_alert' ELSE 'resource_alert' END AS trigger_type
      FROM ev WHERE kind = 'incident_signal'""")
    add("SCL4", _EV, f"SELECT event_id, {_FAMILY} AS family FROM ev WHERE kind = 'metric'")
    add("SCL5", _EV, f"SELECT event_id, {_TIER} AS tier FROM ev WHERE kind = 'metric'")
    add("SCL6", _EV_SIG, f"SELECT incident_id, event_id, {_FINE} AS bucket FROM win")
    add("SCL7", _EV_SIG, f"SELECT incident_id, event_id, {_COARSE} AS bucket FROM win")
    add("SCL8", _EV_SIG, f"SELECT incident_id, event_id, {_EPISODE} AS bucket FROM win")
    add("SCL9", _EV_SIG, f"SELECT incident_id, event_id, {_ROLE} AS role FROM win")
    add("SCL10", _EV_IDS, f"""SELECT event_id, m.name, COALESCE(i.identity_id, m.name) AS identity_id FROM (
      SELECT event_id, unnest({_MENTIONS}) AS name FROM ev WHERE kind = 'log' AND level = 'error') m LEFT JOIN ids i ON i.name = m.name""")
    add("SCL11", _LINES, f"SELECT line_id, len({_TOKENS_OF.format('msg')}) AS n, md5(array_to_string({_TOKENS_OF.format('msg')}, ' ')) AS h FROM ln")
    add("SCL12", _EV, f"SELECT event_id, {_CLAUSE} AS clause, {_LABEL} AS label FROM ev")
    q["SCL13"] = """SELECT event_id, CASE WHEN value / 100 >= 0.85::DOUBLE THEN 'critical' WHEN value / 100 >= 0.65::DOUBLE THEN 'high'
      WHEN value / 100 >= 0.40::DOUBLE THEN 'medium' WHEN value > 0 THEN 'low' ELSE 'none' END AS severity FROM events"""
    add("SCL14", _EV, f"""SELECT event_id, CASE kind WHEN 'log' THEN level WHEN 'metric' THEN CASE WHEN contains(name, 'p99') OR contains(name, 'error') THEN 'warn' ELSE 'info' END
        WHEN 'incident_signal' THEN 'error' ELSE 'info' END AS level,
      concat_ws(' | ', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), kind, who, body) AS line
      FROM (SELECT *, CASE kind WHEN 'topology' THEN from_ ELSE COALESCE(service, trigger_, '') END AS who,
        CASE kind WHEN 'log' THEN msg WHEN 'metric' THEN 'name=' || name || ' value=' || {_num('value')} WHEN 'deploy' THEN 'version=' || version
          WHEN 'topology' THEN 'change=' || change || ' to=' || "to" WHEN 'incident_signal' THEN 'incident=' || incident_id || ' trigger=' || trigger_
          WHEN 'remediation' THEN 'incident=' || incident_id || ' action=' || action || ' outcome=' || outcome
          ELSE 'trace_id=' || trace_id || ' spans=' || array_to_string(list_transform(list_zip(span_svc, span_dur), lambda z: z[1] || ':' || {_num('z[2]')}), ',') END AS body FROM ev)""")
    add("SCL15", _EV, "SELECT event_id, substr(sha256(sec || '|' || kind || '|' || COALESCE(incident_id, '')), 1, 16) AS key FROM ev")
    q["SCL16"] = """SELECT conv_id AS window_id, string_agg('+' || (turn - t0) || 's log of ' || role || ' | ' || text, chr(10) ORDER BY turn) AS text
      FROM (SELECT *, MIN(turn) OVER (PARTITION BY conv_id) AS t0, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
      WHERE n <= 25 GROUP BY 1"""
    add("SCL16.telemetry", _EV_SIG, f"""SELECT incident_id AS window_id, 'on ' || COALESCE(ANY_VALUE(head), 'no known service') || chr(10) ||
      string_agg('+' || ((us - t0) // 1000000) || 's ' || kind || ' of ' || COALESCE(svc, '?') || ' | ' || fields, chr(10) ORDER BY n) AS text
      FROM (SELECT w.*, MIN(w.us) OVER (PARTITION BY w.incident_id) AS t0, row_number() OVER (PARTITION BY w.incident_id ORDER BY w.us, w.event_id) AS n,
        CASE w.kind WHEN 'deploy' THEN 'to ' || w.version WHEN 'metric' THEN w.name || '=' || {_num('w.value')} WHEN 'log' THEN upper(w.level) || ' ' || substr(w.msg, 1, 60)
          WHEN 'trace' THEN len(w.span_svc) || ' spans' WHEN 'topology' THEN w.change || ' -> ' || e."to" WHEN 'incident_signal' THEN 'trigger=' || e.trigger_ ELSE '' END AS fields
        , q.service AS head FROM win w JOIN ev e USING (event_id) JOIN sig q ON q.incident_id = w.incident_id) WHERE n <= 25 GROUP BY 1""")

    add("JOI1", _EV_SIG, "SELECT incident_id, event_id, ROUND(dt, 3) AS dt_s FROM win")
    add("JOI2", _EV_IDS + """,
      hop AS (SELECT src, arg_min(dst, seq) AS dst, arg_min(us, seq) AS us FROM ren GROUP BY 1),
      nm AS (SELECT event_id, us + 432000000000 AS us, COALESCE(service, target) AS name FROM ev WHERE COALESCE(service, target) IS NOT NULL),
      walk(event_id, us, name, cur, d) AS (SELECT event_id, us, name, name, 0 FROM nm
        UNION ALL SELECT w.event_id, w.us, w.name, h.dst, w.d + 1 FROM walk w JOIN hop h ON h.src = w.cur AND h.us <= w.us)""",
        "SELECT event_id, ANY_VALUE(name) AS name, arg_max(cur, d) AS name_at FROM walk GROUP BY 1")
    add("JOI3", _EV_IDS, """SELECT event_id, COALESCE(i.current_name, COALESCE(service, target)) AS current_name FROM ev LEFT JOIN ids i ON i.name = COALESCE(service, target)
      WHERE COALESCE(service, target) IS NOT NULL""")
    add("JOI4", _EV_IDS + "," + _SEEN, """SELECT COALESCE(i.current_name, s.name) AS service, COUNT(DISTINCT event_id) AS n_events, COUNT(DISTINCT s.name) AS n_names
      FROM seen s LEFT JOIN ids i ON i.name = s.name GROUP BY 1""")
    add("JOI5", _EV_REM, """SELECT q.incident_id, COALESCE(string_agg(DISTINCT action, ',' ORDER BY action), '') AS actions,
      COALESCE(string_agg(DISTINCT outcome, ',' ORDER BY outcome), '') AS outcomes, COUNT(r.event_id) AS n FROM sig q LEFT JOIN rem r USING (incident_id) GROUP BY 1""")
    keyed = """kx AS (SELECT incident_id, signal_us, closed_us, 'service' AS key_type, service AS key FROM epi WHERE service IS NOT NULL
      UNION ALL SELECT incident_id, signal_us, closed_us, 'cluster', unnest(clusters) FROM epi UNION ALL SELECT incident_id, signal_us, closed_us, 'action', unnest(actions) FROM epi
      UNION ALL SELECT incident_id, signal_us, closed_us, 'symptom', unnest(symptoms) FROM epi)"""
    add("JOI6", _EV_EPI + "," + keyed, """SELECT q.incident_id AS query_id, q.key_type, q.key, COUNT(c.incident_id) AS n_prior FROM kx q
      LEFT JOIN kx c ON c.key_type = q.key_type AND c.key = q.key AND c.closed_us < q.signal_us GROUP BY 1, 2, 3""")
    add("JOI8", _EV_REM, """SELECT q.incident_id AS query_id, (SELECT COUNT(*) FROM closed c WHERE c.closed_us < q.signal_us) AS n_fallback FROM sig q
      WHERE NOT EXISTS (SELECT 1 FROM sig p JOIN closed c USING (incident_id) WHERE p.service = q.service AND c.closed_us < q.signal_us)""")
    add("JOI9", ",".join([_EV, _IDS, _DEPS]), "SELECT identity_id, neighbour_id FROM nbrs")
    add("JOI10", _EV_FOUND, """SELECT f.query_id, f.incident_id, p.signal_us AS past_us, COALESCE(p.own_name, p.trigger_) AS past_service, r.a AS past_remediation
      FROM found5 f JOIN sig p ON p.incident_id = f.incident_id LEFT JOIN (SELECT incident_id, arg_min(action, event_id) AS a FROM rem GROUP BY 1) r ON r.incident_id = f.incident_id""")
    add("JOI11", _LOG, "SELECT id, user_id FROM kids WHERE user_id NOT IN (SELECT key FROM livek)")
    add("JOI12", _EV + """,
      sg AS (SELECT incident_id, event_id, us, COALESCE(service, '') AS service FROM ev WHERE kind = 'incident_signal'),
      pm AS (SELECT q.incident_id, p.incident_id AS past, row_number() OVER (PARTITION BY q.incident_id ORDER BY p.event_id) AS rank
        FROM sg q JOIN sg p ON p.service = q.service AND p.incident_id <> q.incident_id QUALIFY rank <= 5),
      lr AS (SELECT incident_id, arg_max(action, event_id) AS action, arg_max(target, event_id) AS target FROM ev WHERE kind = 'remediation' GROUP BY 1),
      rl AS (SELECT q.incident_id, LEAST(COUNT(*), 20) AS n FROM sg q JOIN ev e ON COALESCE(e.service, e.target, e.from_) = q.service AND abs(e.us - q.us) <= 1800000000 GROUP BY 1)""",
        """SELECT q.incident_id, COALESCE(ANY_VALUE(rl.n), 0) AS n_related, COUNT(pm.past) AS n_matches, COALESCE(string_agg(pm.past, ',' ORDER BY pm.rank), '') AS matches,
      arg_min(lr.action, pm.rank) AS action, arg_min(lr.target, pm.rank) AS target
      FROM sg q LEFT JOIN pm USING (incident_id) LEFT JOIN lr ON lr.incident_id = pm.past LEFT JOIN rl ON rl.incident_id = q.incident_id GROUP BY 1""")

    add("G1", _EV_IDS, "SELECT src AS name, arg_min(dst, seq) AS target, arg_min(us, seq) AS max_us FROM ren GROUP BY 1")
    add("G2", _EV_IDS, "SELECT name, identity_id FROM ids")
    add("G3", _EV_IDS, "SELECT DISTINCT identity_id, current_name FROM ids")
    deps = ",".join([_EV, _IDS, _DEPS])
    add("G4", deps, "SELECT src_id, dst_id FROM deps")
    add("G5", deps, "SELECT identity_id, component FROM dcomp")
    add("G6", ",".join([_EV, _IDS, _SIG, _FEATURES, _DEPS]), """SELECT incident_id, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters
      FROM inv JOIN dcomp d ON d.identity_id = inv.t JOIN dlab USING (component) GROUP BY 1""")
    add("G7", _EV_IDS + f""",
      pr AS (SELECT event_id, span_svc[i] AS a, span_svc[i + 1] AS b, span_dur[i + 1] AS dur, 1 AS call FROM (
          SELECT event_id, span_svc, span_dur, unnest(range(1, len(span_svc))) AS i FROM ev WHERE kind = 'trace')
        UNION ALL SELECT event_id, service, unnest({_MENTIONS}), 0, 0 FROM ev WHERE kind = 'log' AND level = 'error'),
      nm AS (SELECT COALESCE(i.current_name, a) AS source, COALESCE(j.current_name, b) AS target, CAST(ROUND(COALESCE(dur, 0) * 1000) AS BIGINT) AS dur, call FROM pr LEFT JOIN ids i ON i.name = a LEFT JOIN ids j ON j.name = b)""",
        """SELECT source, target, SUM(call) AS call_volume, ROUND((COUNT(*) - SUM(call))::DOUBLE / GREATEST(SUM(call), 1), 4) AS error_rate,
      ROUND(CASE WHEN SUM(call) > 0 THEN SUM(dur) / (1000 * SUM(call)) ELSE 0 END, 1) AS latency FROM nm WHERE source <> target GROUP BY 1, 2""")
    add("G8", _ALL_PARTS + "," + _WL, "SELECT incident_id, array_to_string(graph, ',') AS graph FROM wf_")

    add("CAU1", _EV_SIG + "," + _AFF, "SELECT kind, COUNT(*) AS n, " + ", ".join(
        f"COALESCE((SELECT w FROM aff WHERE ck = kind AND ek = '{e}'), 0.0::DOUBLE) AS to_{c}"
        for e, c in (("incident_signal", "signal"), ("log", "log"), ("metric", "metric"), ("trace", "trace"))) + " FROM win GROUP BY kind")
    add("CAU2", _EV_SIG, f"SELECT incident_id, event_id, {_TEMPORAL.format('(-dt)')} AS temporal FROM win")
    add("CAU3", _EV, f"SELECT event_id, ROUND(LEAST(1.0::DOUBLE, {_SHARE} + 0.2::DOUBLE), 4) AS to_signal, ROUND({_SHARE}, 4) AS to_log FROM ev")
    add("CAU4", _EV_CHAIN, "SELECT incident_id, event_id, topo AS topology FROM g0")
    add("CAU5", _EV_CHAIN, """SELECT incident_id, event_id, ROUND(score, 4) AS score, kind || '->' || effect_kind || ', dt=' || printf('%.1f', dt) || 's'
      || CASE WHEN topo > 0 THEN ', topology' ELSE '' END || CASE WHEN evid > 0.6::DOUBLE THEN ', evidence' ELSE '' END AS reason FROM g0""")
    edge = "SELECT incident_id, CAST(event_id AS VARCHAR) AS cause_event_id, CAST(effect_event_id AS VARCHAR) AS effect_event_id, ROUND(score, 4) AS confidence FROM "
    add("CAU6", _EV_CHAIN, edge + "fast")
    add("CAU6.deep", _EV_CHAIN, edge + "deep")
    add("CAU7", _EV_CHAIN, "SELECT incident_id, string_agg(kind || '->' || effect_kind, ' ' ORDER BY step DESC) AS pattern FROM fast GROUP BY 1")
    add("CAU8", _EV_CHAIN + """,
      nodes AS (SELECT incident_id, event_id, step FROM fast UNION ALL SELECT q.incident_id, q.signal_event_id, -1 FROM sig q WHERE incident_id IN (SELECT incident_id FROM fast)),
      named_at AS (SELECT n.incident_id, COALESCE(e.service, e.target) AS name, MAX(n.step) AS step FROM nodes n JOIN ev e USING (event_id)
        WHERE COALESCE(e.service, e.target) IS NOT NULL GROUP BY 1, 2)""", "SELECT incident_id, string_agg(name, ',' ORDER BY step DESC) AS cascade FROM named_at GROUP BY 1")

    add("TPL1", _LINES, "SELECT md5(shape) AS shape_md5, n_tokens, freq, first_seen, last_seen FROM sh")
    add("TPL2.logs", _EV, f"SELECT {_SHAPE.format('msg')} AS pattern, len({_TOKENS_OF.format('msg')}) AS n_tokens, COUNT(*) AS frequency FROM ev WHERE kind = 'log' GROUP BY 1, 2")
    add("TPL2", _WHOLE_LINES + "," + _templates(), """SELECT substr(md5(pattern), 1, 12) AS template_id, pattern, n_tokens, SUM(freq)::BIGINT AS frequency,
      MIN(first_seen) AS first_seen, MAX(last_seen) AS last_seen FROM tp GROUP BY pattern, n_tokens""")
    add("TPL3.lines", _WHOLE_LINES + "," + _templates(), f"""SELECT line_id, substr(md5(pattern), 1, 12) AS template_id,
      array_to_string(list_transform(list_filter(list_zip(string_split(pattern, ' '), tk), lambda z: z[1] = '<*>'), lambda z: z[2]), ',') AS params
      FROM (SELECT line_id, {_SHAPE.format('msg')} AS shape, {_TOKENS_OF.format('msg')} AS tk FROM ln) JOIN tp USING (shape)""".replace("substr(msg, 1, 512)", "msg"))
    add("TPL3", _EV, f"""SELECT event_id, array_to_string(list_filter({_TOKENS_OF.format('msg')}, lambda t: regexp_matches(t, '[0-9]')), ',') AS params
      FROM ev WHERE kind = 'log'""")
    add("TPL4", _LINES, """SELECT substr(md5(shape), 1, 12) AS template_id, n_tokens, freq AS frequency, first_seen, last_seen FROM sh
      ORDER BY freq DESC, shape COLLATE "C" LIMIT 50""".replace(' COLLATE "C"', ""))
    add("TPL5", _LINES, "SELECT COUNT(*) AS templates, SUM(freq) AS observations, ROUND(SUM(freq)::DOUBLE / GREATEST(COUNT(*), 1), 4) AS ratio FROM sh")

    for key, col in (("FEA1", "tokens"), ("FEA2", "symptoms"), ("FEA3", "profile"), ("FEA4", "services")):
        add(key, _EV_FEAT, f"SELECT incident_id, array_to_string({col}, ',') AS {col} FROM feat")
    add("FEA5", _EV_EPI, """SELECT incident_id, signal_event_id, trigger_type, service, len(tokens) AS n_tokens, array_to_string(symptoms, ',') AS symptoms, len(profile) AS n_profile,
      array_to_string(services, ',') AS services, array_to_string(actions, ',') AS actions, array_to_string(outcomes, ',') AS outcomes,
      array_to_string(pattern, ' ') AS pattern, closed_us FROM epi""")
    add("FEA6", _EV_REM, "SELECT incident_id, MAX(seq) AS closed_by, arg_max(action, seq) AS action FROM graded GROUP BY 1")

    mh = "list_transform(range(0, {0}), lambda p: list_min(list_transform({1}, lambda t: md5(p || '|' || t))))"
    add("SIM1", _EV_FEAT, f"SELECT incident_id, array_to_string({mh.format(128, 'tokens')}, ',') AS signature FROM feat WHERE len(tokens) > 0")
    add("JOI7", _EV_EPI + f""", sg AS MATERIALIZED (SELECT incident_id, signal_us, closed_us, {mh.format(128, 'tokens')} AS g FROM epi WHERE len(tokens) > 0),
      bd AS MATERIALIZED (SELECT incident_id, signal_us, closed_us, b, array_to_string(g[8 * b + 1:8 * b + 8], ',') AS band FROM (SELECT *, unnest(range(0, 16)) AS b FROM sg))""",
        """SELECT q.incident_id AS query_id, COUNT(DISTINCT c.incident_id) AS n_candidates FROM bd q JOIN bd c ON q.b = c.b AND q.band = c.band AND c.closed_us < q.signal_us GROUP BY 1""")
    add("SIM2", _EV_PAIRS + f", sg AS MATERIALIZED (SELECT incident_id, {mh.format(128, 'tokens')} AS g FROM epi WHERE len(tokens) > 0)", """SELECT p.query_id, p.incident_id,
      ROUND(len(list_filter(list_zip(a.g, b.g), lambda z: z[1] = z[2])) / 128.0::DOUBLE, 4) AS estimate
      FROM pairs p JOIN sg a ON a.incident_id = p.query_id JOIN sg b ON b.incident_id = p.incident_id""")
    add("SIM3", _EV_PAIRS, f"SELECT query_id, p.incident_id, ROUND({_jac('q.tokens', 'c.tokens')}, 4) AS jaccard {_QC}")
    add("SIM4", _EV_EPI, f"""SELECT query_id, rank, incident_id, ROUND(score + 1e-9::DOUBLE, 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, closed_us, incident_id) AS rank FROM (
        SELECT q.incident_id AS query_id, c.incident_id, c.closed_us, {_jac('q.tokens', 'c.tokens')} AS score
        FROM epi q JOIN epi c ON c.closed_us < q.signal_us AND c.incident_id <> q.incident_id AND len(q.tokens) > 0 AND len(c.tokens) > 0)
      WHERE score >= 0.05) WHERE rank <= 5""")
    add("SIM5", _EV_PAIRS, f"SELECT query_id, p.incident_id, {_TOPO} AS topology {_QC}")
    add("SIM6", ",".join([_EV, _IDS, _SIG, _REM, _DEPS, _CHAIN, _OUT, _fold(_EDGE_ROWS, -1, 1, True)]), """SELECT q.incident_id,
      ROUND(GREATEST(-0.05::DOUBLE, LEAST(0.05::DOUBLE, 0.05::DOUBLE * AVG(COALESCE((
        SELECT arg_max(f.w, f.i) * pow(0.5::DOUBLE, GREATEST(0, q.signal_us - MAX(f.us)) / 1000000.0::DOUBLE / 604800.0::DOUBLE)
        FROM fw f WHERE f.key = d.kind || '>' || d.effect_kind AND f.us < q.signal_us), 0)))), 4) AS boost
      FROM fast d JOIN sig q USING (incident_id) GROUP BY 1""")
    add("SIM7", _EV_PAIRS, f"SELECT query_id, p.incident_id, ROUND({_plain('graph')} + 1e-9::DOUBLE, 4) AS score {_QC}")
    add("SIM8", _EV_PAIRS, f"""SELECT query_id, p.incident_id, COALESCE(q.service = c.service, FALSE) AS same_service,
      ROUND({_plain('graph')} + CASE WHEN q.service = c.service THEN 0.2 ELSE 0.0 END::DOUBLE + 1e-9::DOUBLE, 4) AS score {_QC}""")
    prio = """CASE WHEN starts_with(t, 'deploy') OR starts_with(t, 'cross_service_error') THEN 4 WHEN contains(t, 'high') OR starts_with(t, 'trace_touches_self') THEN 3
      WHEN starts_with(t, 'metric') THEN 2 ELSE 1 END"""
    why = f"""
      ct AS (SELECT query_id, p.incident_id, unnest(list_intersect(q.tokens, c.tokens)) AS t {_QC}),
      cr AS (SELECT *, row_number() OVER (PARTITION BY query_id, incident_id ORDER BY {prio} DESC, t DESC) AS n FROM ct),
      cs AS (SELECT query_id, incident_id, 'same traits ' || string_agg(t, ', ' ORDER BY n) AS tx FROM cr WHERE n <= 5 GROUP BY 1, 2),
      why AS (SELECT p.query_id, p.incident_id, COALESCE(NULLIF(concat_ws('; ', cs.tx, CASE WHEN q.trigger_type = c.trigger_type THEN 'both ' || c.trigger_type END,
        CASE WHEN list_has_any(q.symptoms, c.symptoms) THEN 'symptoms ' || array_to_string(list_sort(list_intersect(q.symptoms, c.symptoms))[1:3], ', ') END,
        CASE WHEN list_has_any(q.graph, c.graph) THEN 'causes alike' END, CASE WHEN list_has_any(q.profile, c.profile) THEN 'order alike' END,
        CASE WHEN list_has_any(q.actions, c.actions) THEN 'fixed alike' END), ''), 'nothing single stands out') AS rationale
      {_QC} LEFT JOIN cs ON cs.query_id = p.query_id AND cs.incident_id = p.incident_id)"""
    add("SIM9", _EV_PAIRS + "," + why, "SELECT query_id, incident_id, rationale FROM why")
    add("SIM10", _EV_FOUND, """SELECT query_id, incident_id, row_number() OVER (PARTITION BY query_id ORDER BY (rank <> 2), rank) AS new_rank,
      CASE WHEN rank = 2 THEN 'moved up' ELSE 'as found' END AS rationale FROM found5
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (rank <> 2), rank) <= 3""")
    add("SIM11", _VEC, "SELECT query_id, arg_max(idx, list_dot_product(x, q)) AS predicted FROM qs CROSS JOIN pats GROUP BY 1")

    add("TOP1", _EV_FOUND, "SELECT query_id, rank, incident_id, ROUND(score + 1e-9::DOUBLE, 4) AS score FROM found5")
    add("TOP1.deep", _EV_EPI + "," + _found(10), "SELECT query_id, rank, incident_id, ROUND(score + 1e-9::DOUBLE, 4) AS score FROM found10")
    add("TOP2", _EV_EPI + "," + _found(5, "c.signal_event_id % 3"), "SELECT query_id, rank, incident_id, family FROM found5")
    add("TOP3", _EV_CHAIN, """SELECT incident_id, event_id, prio FROM (SELECT w.incident_id, w.event_id, w.us,
        CASE WHEN w.event_id IN (SELECT f.event_id FROM fast f WHERE f.incident_id = w.incident_id) THEN 0
             WHEN w.event_id = w.signal_event_id THEN CASE WHEN w.incident_id IN (SELECT incident_id FROM fast) THEN 0 ELSE 1 END ELSE 2 END AS prio FROM win w)
      QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY prio, us, event_id) <= 30""")
    m5 = _EV_IDS + "," + _SEEN + "," + _METRICS
    add("TOP4", m5, "SELECT service, family, ROUND(value, 4) AS value FROM late")
    add("TOP5", m5, """SELECT service, family, COUNT(*) AS n, ROUND(arg_max(value, n), 4) AS oldest, ROUND(arg_min(value, n), 4) AS newest, ROUND(SUM(value), 3) AS total
      FROM (SELECT *, row_number() OVER (PARTITION BY service, family ORDER BY us DESC, value DESC) AS n FROM met5 WHERE family IN ('latency', 'error_rate')) WHERE n <= 30 GROUP BY 1, 2""")
    add("TOP6", _EV, """SELECT event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'metric' THEN -value ELSE 0 END, event_id) AS n FROM ev)
      WHERE kind = 'topology' OR (kind IN ('deploy', 'log', 'metric') AND n <= 5) OR (kind IN ('incident_signal', 'remediation') AND n <= 3)""")
    add("TOP7", _EV_IDS, """SELECT event_id, incident_id, COALESCE(i.current_name, target) AS service, action, outcome AS result FROM ev LEFT JOIN ids i ON i.name = target
      WHERE kind = 'remediation' ORDER BY us DESC, event_id LIMIT 100""")
    add("TOP8", _EV_REM, """SELECT incident_id, affected_now AS service, trigger_ AS "trigger" FROM sig WHERE incident_id IN (SELECT incident_id FROM rem)
      ORDER BY signal_us DESC, incident_id LIMIT 100""")

    add("SET1", _EV_REM + """,
      past AS (SELECT q.*, c.closed_us FROM sig q JOIN closed c USING (incident_id)),
      s1 AS (SELECT * FROM past WHERE service IS NOT NULL QUALIFY row_number() OVER (PARTITION BY service ORDER BY closed_us, incident_id) <= 4),
      s2 AS (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY affected_id ORDER BY closed_us, incident_id) <= 6)""",
        """SELECT query_id, incident_id, MIN(source) AS source FROM (
        SELECT q.incident_id AS query_id, s1.incident_id, 1 AS source FROM sig q JOIN s1 ON s1.service = q.service AND s1.closed_us < q.signal_us
        UNION ALL SELECT q.incident_id, s2.incident_id, 2 FROM sig q JOIN s2 ON s2.affected_id = q.affected_id AND s2.closed_us < q.signal_us) GROUP BY 1, 2""")
    add("SET2", _EV_PAIRS, f"""SELECT query_id, p.incident_id, array_to_string(list_sort(list_intersect(q.tokens, c.tokens)), ',') AS common,
      array_to_string(list_sort(list_intersect(q.symptoms, c.symptoms)), ',') AS common_symptoms {_QC}""")
    add("SET3", _EV_SIG, "SELECT incident_id, COUNT(DISTINCT event_id) AS n FROM win GROUP BY 1")
    add("SET4", m5, "SELECT service FROM svcs")

    add("AGG1", _EV_IDS, counts)
    rates = "COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS n_success, MAX(rem_us) AS last_us, ROUND(AVG(success::INT), 4) AS success_rate FROM outc"
    outc = ",".join([_EV, _IDS, _SIG, _REM, _DEPS, _CHAIN, _OUT])
    add("AGG2", outc, f"SELECT kind AS cause_kind, effect_kind, {rates} GROUP BY 1, 2")
    add("AGG2.services", outc, f"SELECT cause_id, effect_id, {rates} WHERE cause_id IS NOT NULL AND effect_id IS NOT NULL GROUP BY 1, 2")
    add("AGG3", _EV_REM + "," + _ASTATS, """SELECT target_id AS service_id, action, ROUND(k / n, 4) AS knowledge_rate FROM st
      UNION ALL SELECT 'nowhere', action, ROUND(k / n, 4) FROM sa""")
    add("AGG4", _EV_REM + "," + _fold(_ACTION_ROWS, -1, 1, True), "SELECT key AS action, ROUND(w, 4) AS weight, last_us FROM fold")
    add("AGG4.edges", outc + "," + _fold(_EDGE_ROWS, -1, 1, True),
        "SELECT split_part(key, '>', 1) AS cause_kind, split_part(key, '>', 2) AS effect_kind, ROUND(w, 4) AS weight, last_us FROM fold")
    add("AGG5", _EV_FOUND + "," + _fold(_PAIR_ROWS, -0.2, 0.2, False), "SELECT split_part(key, '~', 1) AS a, split_part(key, '~', 2) AS b, ROUND(w, 4) AS w FROM fold")
    add("AGG6", _EV, "SELECT event_id, outcome = 'resolved' AS success FROM ev WHERE kind = 'remediation'")
    add("AGG7", ",".join([_EV_FOUND, _SUPPORT, _fold(_ACTION_ROWS, -1, 1, True, "a"), _RANKED]),
        "SELECT query_id, rank, action, target, historical_outcome, ROUND(confidence + 1e-9::DOUBLE, 3) AS confidence FROM ranked7")
    add("AGG8", _EV_FOUND + "," + _SUPPORT, "SELECT query_id, rank, action, target, historical_outcome, ROUND(confidence + 1e-9::DOUBLE, 3) AS confidence FROM srank")
    plain_rules = _RULES.format(service="q.service", named="")
    add("AGG9", _EV_SIG + "," + plain_rules, "SELECT * FROM rules")
    add("AGG10", m5 + """,
      wide AS (SELECT s.service, COALESCE(MAX(value) FILTER (WHERE family = 'latency'), 0) AS lat, COALESCE(MAX(value) FILTER (WHERE family = 'error_rate'), 0) AS err,
        COALESCE(MAX(value) FILTER (WHERE family = 'request_rate'), 0) AS req, COALESCE(MAX(value) FILTER (WHERE family = 'cpu'), 0) AS cpu,
        COALESCE(MAX(value) FILTER (WHERE family = 'memory'), 0) AS mem FROM svcs s LEFT JOIN late USING (service) GROUP BY 1),
      hl AS (SELECT *, GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 1 - (LEAST(1.0::DOUBLE, err) * 0.6::DOUBLE + LEAST(1.0::DOUBLE, lat / 5000) * 0.4::DOUBLE))) AS h FROM wide)""",
        """SELECT service, ROUND(h, 3) AS health, CASE WHEN h >= 0.8::DOUBLE THEN 'healthy' WHEN h >= 0.5::DOUBLE THEN 'degraded' ELSE 'critical' END AS status,
      ROUND(lat * 0.5::DOUBLE, 1) AS latency_p50, ROUND(lat, 1) AS latency_p99, ROUND(err, 4) AS error_rate, ROUND(req, 2) AS request_rate, ROUND(cpu, 1) AS cpu_percent,
      ROUND(mem, 1) AS memory_percent FROM hl""")
    add("AGG11", _EV + """,
      hr AS (SELECT sec // 3600 AS window_id, kind, level, value FROM ev
        UNION ALL SELECT sec // 3600 + 10000000, kind, level, value FROM ev WHERE kind IN ('metric', 'trace', 'incident_signal')),
      st AS (SELECT *, AVG(value) FILTER (WHERE kind = 'metric') OVER w AS m, stddev_pop(CASE WHEN kind = 'metric' THEN value END) OVER w AS sd,
        COUNT(*) OVER w AS n, COUNT(CASE WHEN kind = 'metric' THEN value END) OVER w AS nv FROM hr WINDOW w AS (PARTITION BY window_id))""",
        """SELECT window_id, ANY_VALUE(n) AS n_events, ANY_VALUE(n) >= 15 AND bool_or(COALESCE((kind = 'log' AND level = 'error') OR kind = 'deploy'
        OR (kind = 'metric' AND nv >= 3 AND sd > 0 AND abs(value - m) > 2 * sd), FALSE)) AS anomalous FROM st GROUP BY 1""")
    add("AGG12", _EV_REM + "," + _SEEN + "," + _METRICS, f"""SELECT (SELECT COUNT(*) FROM ev) AS events, (SELECT COUNT(*) FROM svcs) AS services,
      (SELECT COUNT(*) FROM sig) AS incidents, (SELECT COUNT(DISTINCT incident_id) FROM rem) AS resolved, (SELECT COUNT(DISTINCT src) FROM ren) AS renames,
      (SELECT COUNT(DISTINCT {_SHAPE.format('msg')}) FROM ev WHERE kind = 'log') AS templates, (SELECT COUNT(*) FROM ev WHERE kind = 'log') AS observations,
      ROUND((SELECT COUNT(*) FROM ev WHERE kind = 'log')::DOUBLE / GREATEST(1, (SELECT COUNT(DISTINCT {_SHAPE.format('msg')}) FROM ev WHERE kind = 'log')), 4) AS ratio""")
    add("AGG13", _EV_FOUND + "," + _SUPPORT, "SELECT action, COUNT(*) AS n FROM srank WHERE rank = 1 GROUP BY 1 ORDER BY n DESC, action LIMIT 1")

    add("CTX1", _EV_FOUND + "," + _DECOY, "SELECT query_id, ROUND(first_score, 4) AS first_score, decoy FROM dec")
    add("CTX2", _EV_FOUND + "," + _DECOY, "SELECT query_id, incident_id, ROUND(CASE WHEN decoy THEN LEAST(score, 0.45::DOUBLE) ELSE score END, 4) AS similarity FROM found5 JOIN dec USING (query_id)")
    offered = ",".join([_EV_FOUND, _DECOY, _SUPPORT, _fold(_ACTION_ROWS, -1, 1, True, "a"), _RANKED, plain_rules, _OFFERS])
    add("CTX2.remediation", offered, """SELECT o.query_id, o.rank, o.action,
      ROUND(CASE WHEN COALESCE(d.decoy, TRUE) THEN LEAST(o.confidence, 0.4::DOUBLE) ELSE o.confidence END + 1e-9::DOUBLE, 3) AS confidence FROM offers o LEFT JOIN dec d USING (query_id)""")
    add("CTX3", offered, """SELECT q.incident_id, ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 0.5::DOUBLE * COALESCE(f.score, 0) + 0.25::DOUBLE * COALESCE(b.edge, 0)
      + 0.25::DOUBLE * COALESCE(o.offer, 0) + 0.05::DOUBLE)) + 1e-9::DOUBLE, 3) AS confidence FROM sig q LEFT JOIN found5 f ON f.query_id = q.incident_id AND f.rank = 1
      LEFT JOIN (SELECT incident_id, MAX(ROUND(score, 4)) AS edge FROM fast GROUP BY 1) b ON b.incident_id = q.incident_id
      LEFT JOIN (SELECT query_id, MAX(ROUND(confidence + 1e-9::DOUBLE, 3)) AS offer FROM offers GROUP BY 1) o ON o.query_id = q.incident_id""")
    add("CTX5", offered, """SELECT q.incident_id, concat_ws(', ', q.incident_id || ' (' || COALESCE(q.own_name, q.trigger_) || ')', COALESCE(b.n, 0) || ' causes found',
      COALESCE('like ' || f.incident_id, 'like nothing before'), COALESCE('try ' || o.action || ' of ' || o.target, 'nothing to try'),
      CAST(ROUND(ROUND(o.confidence + 1e-9::DOUBLE, 3) * 100 + 1e-9::DOUBLE) AS INT) || ' % sure') AS line
      FROM sig q LEFT JOIN found5 f ON f.query_id = q.incident_id AND f.rank = 1 LEFT JOIN (SELECT incident_id, COUNT(*) AS n FROM fast GROUP BY 1) b ON b.incident_id = q.incident_id
      LEFT JOIN offers o ON o.query_id = q.incident_id AND o.rank = 1""")

    add("CTX6.edges", _FLAGSHIP, """SELECT incident_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY step DESC) - 1 AS INT) AS pos, CAST(event_id AS VARCHAR) AS cause_event_id,
      CAST(effect_event_id AS VARCHAR) AS effect_event_id, kind || '->' || effect_kind || ', dt=' || printf('%.1f', dt) || 's' || CASE WHEN topo > 0 THEN ', topology' ELSE '' END
      || CASE WHEN hist > 0 THEN ', history' ELSE '' END || CASE WHEN evid > 0.6::DOUBLE THEN ', evidence' ELSE '' END AS evidence, ROUND(score, 4) AS confidence FROM fast""")
    add("CTX6.matches", _FLAGSHIP + "," + why, f"""SELECT f.query_id AS incident_id, CAST(f.rank - 1 AS INT) AS pos, f.incident_id AS past_id,
      ROUND(ROUND(CASE WHEN decoy THEN LEAST(f.score, 0.45::DOUBLE) ELSE f.score END, 4) + 1e-9::DOUBLE, 3) AS similarity, w.rationale
      FROM found5 f JOIN dec USING (query_id) JOIN why w ON w.query_id = f.query_id AND w.incident_id = f.incident_id""")
    add("CTX6.offers", _FLAGSHIP, """SELECT query_id AS incident_id, CAST(rank - 1 AS INT) AS pos, action, target, historical_outcome, ROUND(shown + 1e-9::DOUBLE, 3) AS confidence FROM told""")
    add("CTX6.summary", _FLAGSHIP, """SELECT q.incident_id, COALESCE(b.n, 0) AS n_edges, COALESCE(m.n, 0) AS n_matches, COALESCE(o.n, 0) AS n_offers, l.related,
      ROUND(ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 0.5::DOUBLE * COALESCE(d.first_score, 0) + 0.25::DOUBLE * COALESCE(b.edge, 0) + 0.25::DOUBLE * COALESCE(o.best, 0) + 0.05::DOUBLE)), 4) + 1e-9::DOUBLE, 2) AS confidence
      FROM sig q LEFT JOIN dec d ON d.query_id = q.incident_id
      LEFT JOIN (SELECT incident_id, COUNT(*) AS n, MAX(ROUND(score, 4)) AS edge FROM fast GROUP BY 1) b ON b.incident_id = q.incident_id
      LEFT JOIN (SELECT query_id, COUNT(*) AS n FROM found5 GROUP BY 1) m ON m.query_id = q.incident_id
      LEFT JOIN (SELECT query_id, COUNT(*) AS n, MAX(shown) AS best FROM told GROUP BY 1) o ON o.query_id = q.incident_id
      LEFT JOIN (SELECT incident_id, string_agg(event_id, ',' ORDER BY us, event_id) AS related FROM (SELECT w.incident_id, w.event_id, w.us,
          row_number() OVER (PARTITION BY w.incident_id ORDER BY CASE WHEN f.event_id IS NOT NULL THEN 0 WHEN w.event_id = w.signal_event_id THEN 1 ELSE 2 END, w.us, w.event_id) AS n
          FROM win w LEFT JOIN (SELECT DISTINCT incident_id, event_id FROM fast) f ON f.incident_id = w.incident_id AND f.event_id = w.event_id) WHERE n <= 30 GROUP BY 1) l ON l.incident_id = q.incident_id""")
    two = "CAST(CAST(ROUND({0} + 1e-9::DOUBLE, 2) AS DECIMAL(10, 2)) AS VARCHAR)".format
    told = f"""{why},
      sure AS (SELECT q.incident_id, ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 0.5::DOUBLE * COALESCE(d.first_score, 0) + 0.25::DOUBLE * COALESCE(b.edge, 0) + 0.25::DOUBLE * COALESCE(o.best, 0) + 0.05::DOUBLE)), 4) AS confidence
        FROM sig q LEFT JOIN dec d ON d.query_id = q.incident_id LEFT JOIN (SELECT incident_id, MAX(ROUND(score, 4)) AS edge FROM fast GROUP BY 1) b ON b.incident_id = q.incident_id
        LEFT JOIN (SELECT query_id, MAX(shown) AS best FROM told GROUP BY 1) o ON o.query_id = q.incident_id),
      cl AS (SELECT event_id, {_CLAUSE} AS d, {_LABEL} AS l FROM ev),
      nd AS (SELECT incident_id, event_id, step FROM fast UNION ALL SELECT incident_id, signal_event_id, -1 FROM sig WHERE incident_id IN (SELECT incident_id FROM fast)),
      led AS (SELECT f.incident_id, string_agg(a.d || ', then ' || b.d || ' [' || {two('ROUND(score, 4)')} || ']', ' / ' ORDER BY step DESC) AS led
        FROM fast f JOIN cl a ON a.event_id = f.event_id JOIN cl b ON b.event_id = f.effect_event_id GROUP BY 1),
      lab2 AS (SELECT incident_id, string_agg(l, ' > ' ORDER BY step DESC) AS labels FROM nd JOIN cl USING (event_id) GROUP BY 1),
      lk AS (SELECT f.query_id, COUNT(*) AS n, arg_min(f.incident_id, f.rank) AS past, arg_min(f.score, f.rank) AS score, arg_min(w.rationale, f.rank) AS why
        FROM found5 f JOIN why w ON w.query_id = f.query_id AND w.incident_id = f.incident_id GROUP BY 1),
      one AS (SELECT * FROM told WHERE rank = 1)"""
    add("CTX4", _FLAGSHIP + "," + told, f"""SELECT q.incident_id, concat_ws(chr(10), q.incident_id || ': ' || q.trigger_ || ', seen on ' || a.name,
      'Try ' || o.action || ' of ' || o.target || ' [' || {two('o.shown')} || '; ' || o.historical_outcome || ']',
      COALESCE('Led up to by: ' || led.led, 'Nothing in the window explains it'), 'In short: ' || lab2.labels,
      COALESCE('Resembles ' || lk.past || ' [' || {two('lk.score')} || ']: ' || lk.why || CASE WHEN lk.n > 1 THEN ' (and ' || (lk.n - 1) || ' more)' ELSE '' END, 'Resembles no closed incident')) AS explain
      FROM sig q JOIN at_signal a USING (incident_id) LEFT JOIN one o ON o.query_id = q.incident_id LEFT JOIN led USING (incident_id) LEFT JOIN lab2 USING (incident_id)
      LEFT JOIN lk ON lk.query_id = q.incident_id""")
    add("CTX7", _FLAGSHIP + "," + told + """,
      nx AS (SELECT n.incident_id, COALESCE(e.service, e.target) AS name, MAX(n.step) AS step FROM nd n JOIN ev e USING (event_id) WHERE COALESCE(e.service, e.target) IS NOT NULL GROUP BY 1, 2),
      cs7 AS (SELECT incident_id, string_agg(name, ',' ORDER BY step DESC) AS cascade FROM nx GROUP BY 1),
      ac AS (SELECT query_id, string_agg(action || '@' || target, ',' ORDER BY rank) AS actions FROM told GROUP BY 1)""",
        """SELECT s.incident_id, CASE WHEN s.confidence >= 0.85::DOUBLE THEN 'critical' WHEN s.confidence >= 0.65::DOUBLE THEN 'high' WHEN s.confidence >= 0.40::DOUBLE THEN 'medium'
        WHEN s.confidence > 0 THEN 'low' ELSE 'none' END AS severity, COALESCE(a.name, 'unknown') AS service, ROUND(s.confidence + 1e-9::DOUBLE, 2) AS confidence,
      COALESCE(c.cascade, '') AS cascade, ac.actions FROM sure s JOIN at_signal a USING (incident_id) LEFT JOIN cs7 c USING (incident_id) LEFT JOIN ac ON ac.query_id = s.incident_id""")
    add("SCL17", _FLAGSHIP + "," + told, f"""SELECT q.incident_id, concat_ws(chr(10), 'signal=' || q.trigger_ || ' on=' || COALESCE(q.own_name, '?') || ' at=' || q.signal_sec, 'certainty=' || {two('s.confidence')},
      (SELECT string_agg('cause=' || f.event_id || '>' || f.effect_event_id || ' p=' || {two('ROUND(f.score, 4)')}, chr(10) ORDER BY f.step DESC) FROM fast f WHERE f.incident_id = q.incident_id),
      (SELECT string_agg('alike=' || f.incident_id || ' p=' || {two('ROUND(CASE WHEN d.decoy THEN LEAST(f.score, 0.45::DOUBLE) ELSE f.score END, 4)')} || ' why=' || w.rationale, chr(10) ORDER BY f.rank)
        FROM found5 f JOIN dec d USING (query_id) JOIN why w ON w.query_id = f.query_id AND w.incident_id = f.incident_id WHERE f.query_id = q.incident_id),
      'fix=' || o.action || ' of=' || o.target || ' p=' || {two('o.shown')}) AS text
      FROM sig q JOIN sure s USING (incident_id) LEFT JOIN one o ON o.query_id = q.incident_id""")
    add("EVA11", _FLAGSHIP, """SELECT (SELECT COUNT(*) FROM sig) AS signals, (SELECT COUNT(DISTINCT query_id) FROM found5) AS with_matches,
      (SELECT COUNT(DISTINCT query_id) FROM told) AS with_remediations""")

    q["STR1"], q["STR2"], q["STR3"], q["STR5"], q["STR6"] = q["SRC1"], q["JOI4"], q["TPL2.logs"], q["AGG4"], q["G7"]
    q["STR6.nodes"], q["STR5.pairs"] = q["AGG10"], q["AGG5"]
    add("STR5.services", _EV_REM, "SELECT target_id, action, COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS n_success FROM graded GROUP BY 1, 2")
    add("STR5.edges", outc + "," + _fold(_EDGE_ROWS, -1, 1, True), """SELECT split_part(key, '>', 1) AS cause_kind, split_part(key, '>', 2) AS effect_kind, ROUND(w, 4) AS weight, last_us,
      (SELECT COUNT(*) FROM outc o WHERE o.kind || '>' || o.effect_kind = key) AS n, (SELECT COUNT(*) FROM outc o WHERE o.success AND o.kind || '>' || o.effect_kind = key) AS n_success FROM fold""")
    add("STR4", _EV_REM, "SELECT r.incident_id, r.event_id, r.action, r.outcome FROM rem r JOIN sig q USING (incident_id) WHERE r.event_id > q.signal_event_id AND r.us >= q.signal_us AND r.us - q.signal_us <= 604800000000")
    add("STR8", _EV + """, rng AS (SELECT MIN(us) AS lo, MAX(us) AS hi FROM ev),
      pt AS (SELECT event_id, us, CASE WHEN event_id % 50 = 0 THEN 2 ELSE LEAST(CAST(floor((us - lo) * 3.0::DOUBLE / (hi - lo + 1)) AS INT), 2) END AS part FROM ev CROSS JOIN rng)""",
        "SELECT event_id, part = 2 AND us < (SELECT MAX(us) FROM pt WHERE part < 2) - 60000000 AS late FROM pt")
    add("STR7", _EV, "SELECT sec, COUNT(*) AS n_events FROM ev GROUP BY 1")

    add("EVA1", _EV_FOUND + "," + _SCORED, "SELECT incident_id, hits, in_top_k, ROUND(precision_at_k, 4) AS precision_at_k FROM msc")
    add("EVA2", ",".join([_EV_FOUND, _SUPPORT, _REMOK]), "SELECT incident_id, remediation_ok FROM remok")
    add("EVA3", _EV_FOUND + "," + _SEEDS, "SELECT * FROM seeds")
    add("EVA4", _EV_FOUND + "," + _SEEDS, "SELECT * FROM total")
    add("EVA5", _EV_FOUND + "," + _SEEDS, """SELECT ax AS latency_axis, ROUND(0.30::DOUBLE * recall + 0.15::DOUBLE * "precision" + 0.20::DOUBLE * remediation_acc + 0.15::DOUBLE * ax, 4) AS weighted_score
      FROM (SELECT *, ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 2000.0::DOUBLE / GREATEST(latency_p95_ms, 0.000001::DOUBLE))), 4) AS ax FROM total)""")
    add("EVA6", _EV, """SELECT CASE WHEN us < lo + 0.7::DOUBLE * (hi - lo) THEN 'train' ELSE 'eval' END AS part, COUNT(*) AS n, MAX(event_id) AS last_event_id
      FROM ev CROSS JOIN (SELECT MIN(us) AS lo, MAX(us) AS hi FROM ev) GROUP BY 1""")
    add("EVA7", _EV_REM, """SELECT q.incident_id, q.signal_event_id, r.expected FROM sig q
      LEFT JOIN (SELECT incident_id, arg_min(action, event_id) AS expected FROM rem GROUP BY 1) r USING (incident_id)""")
    add("EVA8", _EV_FOUND + """,
      gm AS (SELECT query_id, rank, incident_id, CAST(substr(incident_id, 5) AS BIGINT) % 3 AS fam FROM found5),
      hs AS (SELECT q.incident_id, q.signal_event_id % 3 AS tf, COUNT(g.fam) FILTER (WHERE g.fam = q.signal_event_id % 3) AS hits FROM sig q LEFT JOIN gm g ON g.query_id = q.incident_id GROUP BY 1, 2)""",
        """SELECT h.incident_id, h.hits, COALESCE(string_agg(g.incident_id, ',' ORDER BY g.rank) FILTER (WHERE g.fam <> h.tf), '') AS wrong
      FROM hs h LEFT JOIN gm g ON g.query_id = h.incident_id WHERE h.hits < 5 GROUP BY 1, 2""")
    add("EVA9", _VEC + "," + _CLASS.format("level"), "SELECT seed, level, ROUND(accuracy, 4) AS accuracy, ROUND(baseline_accuracy, 4) AS baseline_accuracy, ROUND(accuracy - baseline_accuracy, 4) AS delta FROM acc")
    add("EVA9.points", _VEC + "," + _CLASS.format("0"), """SELECT ROUND(md, 4) AS mean_delta, ROUND(mn, 4) AS min_delta,
      ROUND(CASE WHEN md <= 0 THEN 0.0 ELSE LEAST(70.0::DOUBLE, 70.0::DOUBLE * md / 0.05::DOUBLE) * CASE WHEN mn < 0 THEN 0.5 ELSE 1.0 END END, 4) AS points
      FROM (SELECT AVG(accuracy - baseline_accuracy) AS md, MIN(accuracy - baseline_accuracy) AS mn FROM acc)""")
    add("EVA10", _LOG, """SELECT ROUND(0.10::DOUBLE + 0.15::DOUBLE + CASE WHEN dup = 0 THEN 0.20 ELSE 0.0 END, 4) AS weighted_score, 2 + CASE WHEN dup = 0 THEN 1 ELSE 0 END AS n_passed
      FROM (SELECT COUNT(*) AS dup FROM (SELECT value FROM cells WHERE col = 'email' GROUP BY 1 HAVING COUNT(*) > 1))""")

    add("REP1", _LOG, """SELECT key, MAX(value) FILTER (WHERE col = 'name') AS name, MAX(value) FILTER (WHERE col = 'email') AS email,
      MAX(value) FILTER (WHERE col = 'segment') AS segment, MAX(value) FILTER (WHERE col = 'balance') AS balance
      FROM (SELECT * FROM chlog QUALIFY dense_rank() OVER (PARTITION BY key ORDER BY version DESC, peer DESC) = 1) GROUP BY 1""")
    add("REP2", _LOG, """SELECT key, MAX(value) FILTER (WHERE col = 'name') AS name, MAX(value) FILTER (WHERE col = 'email') AS email,
      MAX(value) FILTER (WHERE col = 'segment') AS segment, MAX(value) FILTER (WHERE col = 'balance') AS balance FROM cells GROUP BY 1""")
    add("REP3", _LOG, "SELECT key FROM livek")
    add("REP4", _LOG, """SELECT status, COUNT(*) AS n, COUNT(user_id) AS n_ref, SUM(total_cents) AS cents, 'cascade' AS policy FROM kids WHERE user_id IN (SELECT key FROM livek) GROUP BY 1
      UNION ALL SELECT status, COUNT(*), COUNT(user_id), SUM(total_cents), 'tombstone' FROM kids GROUP BY 1
      UNION ALL SELECT status, COUNT(*), COUNT(*) FILTER (WHERE user_id IN (SELECT key FROM livek)), SUM(total_cents), 'orphan' FROM kids GROUP BY 1""")
    add("REP5", _LOG, "SELECT value, COUNT(*) AS n FROM cells WHERE col = 'email' GROUP BY 1 HAVING COUNT(*) > 1")
    add("REP6", _LOG, "SELECT value, key FROM cells WHERE col = 'email' QUALIFY row_number() OVER (PARTITION BY value ORDER BY version, peer, key) = 1")
    add("REP7", _LOG + "," + _PRINT.format("cells", "'users' AS tbl,", ""), "SELECT tbl, fingerprint FROM print")
    add("REP8", _LOG, "SELECT 3 AS n_states, FALSE AS converged, 'before' AS state UNION ALL SELECT 1, TRUE, 'after' UNION ALL SELECT 1 + (g.n > 0)::INT, g.n = 0, 'C withheld' FROM (SELECT COUNT(*) AS n FROM gone) g".replace(
        "SELECT 3 AS", "SELECT (SELECT COUNT(DISTINCT peer) FROM chlog) AS"))
    add("REP9", _LOG + "," + _PRINT.format("cells", "", ""), "SELECT unnest(['given', 'twice', 'seed1', 'seed2', 'seed3']) AS run, fingerprint FROM print")
    return q
