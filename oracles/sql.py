"""DuckDB statements that give the same results as the queries, from the same tables."""

from __future__ import annotations

from loginlab.operators import agents, enrich, selection, statistics
from loginlab.operators.features import RESULT_CODES
from loginlab.plans import catalog as c

EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, CAST(floor("value" * 100 + 0.5) AS BIGINT) AS v,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events),
ev2 AS (
  SELECT *, CASE WHEN k < 60 THEN (event_id // 288) * 28800 + (v * 7 + event_id) % 120
                 ELSE event_id * 100 + v % 60 END AS t,
         CASE WHEN event_type = 'signup' AND v % 3 = 0 THEN 'UnknownUsername'
              WHEN (k >= 60 AND v % 5 <> 0) OR (k < 60 AND v % 13 = 0) THEN 'Success'
              WHEN v % 11 = 0 THEN 'AccountError' ELSE 'InvalidCredentials' END AS result_code,
         CASE WHEN k < 60 THEN v % 23 ELSE user_id % 5 + (v % 9) // 8 END AS pw,
         CASE WHEN k < 30 THEN v % 10 WHEN k < 38 THEN 3 WHEN k < 60 THEN user_id % 6
              ELSE user_id % 4 END AS uan
  FROM ev),
base AS (
  SELECT event_id AS id, 'u' || user_id AS username, user_id, v, k, pw,
    CASE WHEN k < 30 THEN '203.0.113.7' WHEN k < 34 THEN '203.0.113.' || (1 + k % 2)
         WHEN k < 38 THEN '128.104.0.' || (3 + k % 2)
         WHEN k < 60 THEN '198.18.' || (user_id % 16) || '.' || (1 + (t // 86400) % 200)
         ELSE '100.64.' || (user_id % 4) || '.' || (user_id % 200) END AS client_ip,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(t) AS "timestamp", t AS sec,
    DATE '2024-01-01' + CAST(t // 86400 AS INTEGER) AS d,
    CAST(result_code = 'Success' AS INTEGER) AS result, result_code,
    CASE WHEN uan = 0 THEN NULL
      WHEN uan = 1 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
      WHEN uan = 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Mobile/15E148 Safari/604.1'
      WHEN uan = 3 THEN 'python-requests/2.31.0'
      ELSE 'Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/8' || uan || '.0' END AS user_agent,
    CAST(user_id % 3 = 0 AND pw % 4 = 0 AND v % 2 = 0 AS INTEGER) AS appeared_in_breach,
    CAST(user_id % 3 = 0 AS INTEGER) AS username_appeared_in_breach,
    CAST(pw % 4 = 0 AS INTEGER) AS password_appeared_in_breach,
    CAST(pw >= 12 AS INTEGER) AS zxcvbn_score,
    CAST(pw = 3 AS INTEGER) AS in_top_5k_hashcat, CAST(pw IN (2, 3) AS INTEGER) AS in_top_5k_rockyou,
    CAST(pw = 3 AS INTEGER) AS in_top_2k_hashcat, CAST(pw = 3 AS INTEGER) AS in_top_2k_rockyou,
    CAST(pw < 1 AS INTEGER) AS in_top_10_passwords, CAST(pw < 2 AS INTEGER) AS in_top_100_passwords,
    CAST(pw < 4 AS INTEGER) AS in_top_1000_passwords,
    CAST(pw = 0 AS INTEGER) AS frequently_submitted_password_today,
    CAST(user_id % 7 = 0 AS INTEGER) AS frequently_submitted_username_today,
    CASE WHEN v % 5 = 0 THEN [[v % 6, v % 4, NULL], [v % 7, v % 3, v % 2000]]
         WHEN v % 5 = 1 THEN [[v % 6, v % 4, NULL], [NULL, NULL, v % 3000]]
         ELSE [[v % 6, v % 4, NULL]] END AS ctm
  FROM ev2)"""

# the log without / with what depends on earlier attempts of the day
PLAIN = EVENTS + ",\nattempts AS (SELECT * FROM base)"


def _history(name: str, keys: str, arrays: bool) -> str:
    arr = (
        f""", list(pw) OVER (PARTITION BY {keys}, d ORDER BY "timestamp", id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_{name}"""
        if arrays
        else ""
    )
    return f"""coalesce(sec - lag(sec) OVER (PARTITION BY {keys}, d ORDER BY "timestamp", id), -1) AS ia_{name},
             row_number() OVER (PARTITION BY {keys}, d ORDER BY "timestamp", id) AS slot_{name}{arr}"""


def _session(name: str, keys: str) -> str:
    return f"""last_value(CASE WHEN ia_{name} NOT BETWEEN 0 AND 1800 THEN id END IGNORE NULLS)
        OVER (PARTITION BY {keys}, d ORDER BY "timestamp", id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {name}_session_id"""


FULL = (
    EVENTS
    + f""",
hist AS (SELECT *, {_history("username", "username", True)},
                {_history("ip", "client_ip", True)},
                {_history("username_ip", "username, client_ip", False)} FROM base),
attempts AS (SELECT *,
  list_transform(earlier_ip, lambda x: abs(pw - x)) AS prior_ip,
  list_transform(earlier_username, lambda x: abs(pw - x)) AS prior_username,
  CASE WHEN earlier_username IS NOT NULL THEN list_append(list_transform(earlier_username, lambda x: abs(pw - x)), 0) END AS dist_username,
  CASE WHEN earlier_ip IS NOT NULL THEN list_append(list_transform(earlier_ip, lambda x: abs(pw - x)), 0) END AS dist_ip_array,
  CASE WHEN list_contains(earlier_ip, pw) THEN 0 ELSE 1 END AS is_unique_pws_by_ip,
  CASE WHEN list_contains(earlier_username, pw) THEN 0 ELSE 1 END AS is_unique_pws_by_username,
  {_session("username", "username")}, {_session("ip", "client_ip")},
  {_session("username_ip", "username, client_ip")} FROM hist)"""
)

TWEAKED = """(len(ctm) > 1 AND NOT list_bool_or(list_transform(ctm, lambda e: coalesce(e[1] = 0, false)))
  AND list_bool_or(list_transform(ctm, lambda e: coalesce(e[1] BETWEEN 1 AND 3, false)
      OR coalesce(e[2] <= 0, false) OR coalesce(e[3] <= 1000, false))))"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def plain(body: str) -> str:
    return with_(PLAIN, body)


def full(body: str) -> str:
    return with_(FULL, body)


TS = "strftime({}, '%Y-%m-%d %H:%M:%S') AS {}".format
DAY = "CAST(d AS VARCHAR) AS d"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


WINDOW = f"\"timestamp\" > TIMESTAMP '{c.START}' AND \"timestamp\" < TIMESTAMP '{c.END}'"
RANGE = f"\"timestamp\" >= TIMESTAMP '{c.START}' AND \"timestamp\" < TIMESTAMP '{c.END}'"
O: dict[str, str] = {}


# ---- sessions -------------------------------------------------------------------
def session_cte(kind: str, keys: str) -> str:
    return (
        FULL
        + f""",
sessions AS (
  SELECT {kind}_session_id AS id, {keys},
    min("timestamp") AS timestamp_start, max("timestamp") AS timestamp_end,
    count(*) AS num_attempts,
    CASE WHEN count(*) > 1 THEN CAST(max(sec) - min(sec) AS DOUBLE) / (count(*) - 1) ELSE -1.0 END AS average_interarrival_time,
    count(DISTINCT client_ip) AS num_unique_ips, count(DISTINCT username) AS num_unique_usernames,
    count(DISTINCT user_agent) AS num_unique_user_agents,
    count(DISTINCT coalesce(user_agent, 'none')) AS num_unique_devices,
    arg_max(result, {{'a': "timestamp", 'b': id}}) AS ended_with_success,
    sum(username_appeared_in_breach) AS num_attempts_username_in_breach,
    sum(password_appeared_in_breach) AS num_attempts_password_in_breach,
    sum(in_top_5k_hashcat) AS num_attempts_password_in_hashcat,
    sum(in_top_5k_rockyou) AS num_attempts_password_in_rockyou,
    sum(1 - zxcvbn_score) AS num_attempts_zxcvbn_score_0,
    avg(zxcvbn_score) AS average_zxcvbn_score
  FROM attempts GROUP BY {kind}_session_id)"""
    )


IPS = session_cte("ip", "any_value(client_ip) AS ip")
USERS = session_cte("username", "any_value(username) AS username")
USER_IPS = session_cte("username_ip", "any_value(username) AS username, any_value(client_ip) AS ip")
IN_RANGE = f"timestamp_start >= TIMESTAMP '{c.START}' AND timestamp_end < TIMESTAMP '{c.END}'"
AUTOMATED = "num_attempts > 2 AND average_interarrival_time < 2"

O["session_filter"] = with_(IPS, f"SELECT id, ip FROM sessions WHERE {IN_RANGE}")
O["automated_predicate"] = with_(
    IPS,
    f"SELECT id, num_attempts, {r6('average_interarrival_time', 'average_interarrival_time')} FROM sessions WHERE {AUTOMATED}",
)


def session_stats(cte: str, extra: list[str]) -> str:
    from loginlab.operators.sessions import AVERAGED

    avgs = ", ".join(r6(f"avg({x})", f"avg_{x}") for x in ["num_attempts", *extra, *AVERAGED])
    return with_(
        cte,
        f"""SELECT {avgs}, CAST(sum(ended_with_success) AS BIGINT) AS ended_with_success,
      round(count(*) / (SELECT (max(sec) - min(sec)) / 86400.0::DOUBLE FROM attempts), 2) AS sessions_per_day FROM sessions""",
    )


O["username_session_stats"] = session_stats(USERS, ["num_unique_ips"])
O["ip_session_stats"] = session_stats(IPS, ["num_unique_usernames"])
O["username_ip_session_stats"] = session_stats(USER_IPS, [])
O["session_avg_interarrival"] = with_(
    USERS, f"SELECT {r6('average_interarrival_time', 'average_interarrival_time')} FROM sessions"
)
O["session_num_attempts"] = with_(USER_IPS, f"SELECT num_attempts FROM sessions WHERE {IN_RANGE}")
O["session_num_attempts_automated"] = with_(
    IPS, f"SELECT num_attempts FROM sessions WHERE {AUTOMATED}"
)
O["session_unique_ips"] = with_(USERS, "SELECT num_unique_ips FROM sessions")
O["session_unique_usernames"] = with_(IPS, "SELECT num_unique_usernames FROM sessions")
O["session_unique_user_agents"] = with_(IPS, "SELECT num_unique_user_agents FROM sessions")
O["session_unique_devices"] = with_(USERS, "SELECT num_unique_devices FROM sessions")
O["session_username_ratio"] = with_(
    IPS,
    f"SELECT {r6('CAST(num_unique_usernames AS DOUBLE) / num_attempts', 'ratio')} FROM sessions WHERE num_attempts > 1",
)
O["password_spraying_sessions"] = with_(
    IPS,
    f"""SELECT id, ip, {TS("timestamp_start", "timestamp_start")}, {TS("timestamp_end", "timestamp_end")}
    FROM sessions WHERE num_unique_usernames >= 5 AND num_unique_user_agents = 1""",
)

# ---- reading and filtering --------------------------------------------------------
O["scan_attempts"] = plain(
    f"""SELECT id, username, client_ip, {TS('"timestamp"', '"timestamp"')}, result, result_code
    FROM attempts WHERE {RANGE}"""
)
O["attempt_filter"] = plain(
    f"""SELECT id, username FROM attempts WHERE {RANGE} AND result = 0 AND password_appeared_in_breach = 1
    AND username_appeared_in_breach = 0 AND zxcvbn_score = 0"""
)
O["time_extent"] = plain(
    f"""SELECT {TS('min("timestamp")', '"start"')}, {TS('max("timestamp")', '"end"')} FROM attempts"""
)
O["compromised_users"] = "SELECT DISTINCT 'u' || user_id AS netid FROM events WHERE user_id % 10 = 0"

# ---- per attempt --------------------------------------------------------------------
O["unique_pw_flag_by_ip"] = full("SELECT id, is_unique_pws_by_ip FROM attempts")
O["unique_pw_flag_by_username"] = full("SELECT id, is_unique_pws_by_username FROM attempts")
O["prior_distances"] = full(
    "SELECT id, array_to_string(prior_ip, ',') AS prior FROM attempts WHERE prior_ip IS NOT NULL"
)
O["tweaked_pw_flag"] = plain(f"SELECT id, CAST({TWEAKED} AS INTEGER) AS is_tweaked FROM attempts")
O["backfilled_flags"] = full(
    f"SELECT id, is_unique_pws_by_ip, is_unique_pws_by_username, CAST({TWEAKED} AS INTEGER) AS is_tweaked FROM attempts"
)
HEURISTIC = """
CASE WHEN len(ctm) > 1 THEN len(list_filter(ctm, lambda e: coalesce(e[1] <= 2, false))) ELSE 0 END AS heuristic_edit,
CASE WHEN len(ctm) > 1 THEN len(list_filter(ctm, lambda e: coalesce(e[2] <= 0, false))) ELSE 0 END AS heuristic_strength,
CASE WHEN len(ctm) > 1 THEN len(list_filter(ctm, lambda e: coalesce(e[3] <= 0, false))) ELSE 0 END AS heuristic_rank"""
FLAGGED = PLAIN + f", flagged AS (SELECT *, {HEURISTIC} FROM attempts)"
O["check_ctm"] = with_(
    FLAGGED,
    """SELECT id, CAST(heuristic_edit + heuristic_strength + heuristic_rank > 0 AS INTEGER) AS heuristic_any,
    heuristic_edit, heuristic_strength, heuristic_rank FROM flagged""",
)
O["ctm_parse"] = plain(
    """SELECT id, len(ctm) AS elements, CAST(ctm[1][1] AS DOUBLE) AS edit, CAST(ctm[1][2] AS DOUBLE) AS strength,
    CAST(ctm[1][3] AS DOUBLE) AS "rank" FROM attempts"""
)
O["interarrival_by_ip_day"] = full("SELECT id, ia_ip AS gap_seconds FROM attempts")


def origins(name: str, keys: str) -> str:
    """First submission of the same password that day, and running number of new ones."""
    return (
        FULL
        + f""",
firsts AS (SELECT *, min(slot_{name}) OVER (PARTITION BY {keys}, d, pw) AS origin FROM attempts),
news AS (SELECT *, CASE WHEN origin = slot_{name} AND slot_{name} > 1 THEN 1 ELSE 0 END AS is_new FROM firsts),
counted AS (SELECT *, sum(is_new) OVER (PARTITION BY {keys} ORDER BY d, slot_{name}
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS number FROM news),
labels AS (SELECT x.*, x.slot_{name} AS slot, CASE WHEN x.origin = 1 THEN 'unknown' ELSE 'password' || CAST(y.number AS BIGINT) END AS label
  FROM counted x JOIN counted y ON x.{keys} = y.{keys} AND x.d = y.d AND x.origin = y.slot_{name})"""
    )


BY_USER, BY_IP = origins("username", "username"), origins("ip", "client_ip")
O["password_identity_by_user"] = with_(BY_USER, "SELECT id, slot, label FROM labels")
O["password_identity_by_ip"] = with_(BY_IP, "SELECT id, username, slot, label FROM labels")

# ---- feature rows ---------------------------------------------------------------------
METRIC = {
    "num_attempts": "count(*)",
    "num_successes": "count(*) FILTER (result = 1)",
    "num_successes_in_breach": "count(*) FILTER (result = 1 AND password_appeared_in_breach = 1)",
    "num_unique_usernames": "count(DISTINCT username)",
    "num_unique_usernames_success": "count(DISTINCT CASE WHEN result = 1 THEN username END)",
    "num_valid_users": "count(DISTINCT CASE WHEN result_code LIKE '%InvalidCredentials%' OR result = 1 THEN username END)",
    "num_password_in_breach": "count(*) FILTER (password_appeared_in_breach = 1)",
    "num_strong_password_in_breach": "count(*) FILTER (password_appeared_in_breach = 1 AND zxcvbn_score = 1)",
    "num_users_in_breach": "count(*) FILTER (username_appeared_in_breach = 1)",
    "num_password_in_hashcat": "count(*) FILTER (in_top_5k_hashcat = 1)",
    "num_pair_in_breach": "count(*) FILTER (appeared_in_breach = 1)",
    "num_failed_pair_in_breach": "count(*) FILTER (appeared_in_breach = 1 AND result = 0)",
    "num_tweaked_passwords": f"count(*) FILTER ({TWEAKED})",
    "zxcvbn_0": "count(*) FILTER (zxcvbn_score = 0)",
    "zxcvbn_1": "count(*) FILTER (zxcvbn_score = 1)",
    "null_user_agents": "count(*) FILTER (user_agent IS NULL)",
    "num_unique_user_agents": "count(DISTINCT user_agent)",
    "unique_passwords_for_ip": "CAST(sum(is_unique_pws_by_ip) AS BIGINT)",
    "unique_passwords_for_username": "CAST(sum(is_unique_pws_by_username) AS BIGINT)",
}
BY_DAY = "FROM attempts GROUP BY client_ip, d"


def metric(*names: str) -> str:
    cols = ", ".join(f"{METRIC[n]} AS {n}" for n in names)
    build = full if any("unique_passwords" in n for n in names) else plain
    return build(f"SELECT client_ip, {DAY}, {cols} {BY_DAY}")


for _n in METRIC:
    if not _n.startswith("zxcvbn"):
        O[_n] = metric(_n)
O["zxcvbn_counts"] = metric("zxcvbn_0", "zxcvbn_1")
O["num_unique_usernames_failed"] = plain(
    f"SELECT client_ip, {DAY}, count(DISTINCT username) AS num_unique_usernames FROM attempts WHERE result = 0 GROUP BY client_ip, d"
)
O["num_invalid_users"] = plain(
    f"""SELECT client_ip, {DAY}, {METRIC["num_unique_usernames"]} - {METRIC["num_valid_users"]} AS num_invalid_users,
    round(1.0 - CAST({METRIC["num_valid_users"]} AS DOUBLE) / {METRIC["num_unique_usernames"]}, 6) AS "FIU" {BY_DAY}"""
)
O["candidate_ips"] = plain(
    f"""SELECT client_ip, {DAY}, count(*) AS num_attempts, {METRIC["num_successes"]} AS num_successes {BY_DAY}
    HAVING count(*) >= 2 AND count(*) > {METRIC["num_successes"]}"""
)
GAPS = """, gaps AS (SELECT client_ip, d, sec - lag(sec) OVER (PARTITION BY {keys} ORDER BY sec) AS gap FROM attempts {where}),
gap_stats AS (SELECT {keys}, median(gap) AS gap_median, avg(gap) AS gap_mean, max(gap) AS gap_max, min(gap) AS gap_min,
   stddev_pop(gap) AS gap_std FROM gaps GROUP BY {keys})"""
DAY_GAPS = GAPS.format(keys="client_ip, d", where="")
O["interarrival_stats"] = with_(
    PLAIN + DAY_GAPS,
    f"""SELECT client_ip, {DAY}, {", ".join(r6(f"coalesce(CAST({g} AS DOUBLE), -1.0)", g) for g in
    ("gap_median", "gap_mean", "gap_max", "gap_min", "gap_std"))} FROM gap_stats""",
)
O["attempts_per_user"] = plain(
    f"SELECT client_ip, {DAY}, {r6('CAST(count(*) AS DOUBLE) / count(DISTINCT username)', 'attempts_per_user')} {BY_DAY}"
)
CODES = ", ".join(f"('{x}')" for x in RESULT_CODES)


def rcj(keys: str, where: str = "") -> str:
    return f"""code_counts AS (SELECT {keys}, result_code, count(DISTINCT username) AS users, count(*) AS n
      FROM attempts {where} GROUP BY {keys}, result_code),
    rcj AS (SELECT {keys}, '{{' || string_agg('"' || code || '":[' || coalesce(users, 0) || ',' || coalesce(n, 0) || ']', ',' ORDER BY code) || '}}' AS "RCJ"
      FROM (SELECT g.*, v.code, cc.users, cc.n FROM (SELECT DISTINCT {keys} FROM code_counts) g
            CROSS JOIN (VALUES {CODES}) v(code) LEFT JOIN code_counts cc ON cc.result_code = v.code AND {" AND ".join(f"cc.{k} = g.{k}" for k in keys.split(", "))})
      GROUP BY {keys})"""


O["result_code_map"] = with_(
    PLAIN + ", " + rcj("client_ip, d"), f'SELECT client_ip, {DAY}, "RCJ" FROM rcj'
)
_M = METRIC
FEATURES = (
    FULL
    + DAY_GAPS
    + ", "
    + rcj("client_ip, d")
    + f""",
sums AS (SELECT client_ip, d, {", ".join(f"{_M[n]} AS {n}" for n in METRIC)} {BY_DAY}),
features AS (SELECT client_ip, d,
  coalesce(gap_mean, -1.0) AS "MIT_Mean", coalesce(CAST(gap_median AS DOUBLE), -1.0) AS "MIT_Median", coalesce(gap_std, -1.0) AS "SIT",
  num_attempts AS "NR", num_unique_usernames AS "NU", unique_passwords_for_ip AS "NP", num_unique_user_agents AS "NUA",
  CAST(num_valid_users AS DOUBLE) / num_unique_usernames AS "FVU", 1 - CAST(num_successes AS DOUBLE) / num_attempts AS "FF",
  CAST(num_password_in_breach AS DOUBLE) / num_attempts AS "FPIB",
  CASE WHEN num_password_in_breach = 0 THEN -1.0 ELSE CAST(num_strong_password_in_breach AS DOUBLE) / num_password_in_breach END AS "FSPIB",
  CAST(num_users_in_breach AS DOUBLE) / num_attempts AS "FUIB", CAST(num_pair_in_breach AS DOUBLE) / num_attempts AS "FCIB",
  CAST(num_failed_pair_in_breach AS DOUBLE) / num_attempts AS "FICIB", CAST(num_tweaked_passwords AS DOUBLE) / num_attempts AS "FTP",
  CAST(null_user_agents AS DOUBLE) / num_attempts AS "FNUA", CAST(num_attempts AS DOUBLE) / num_unique_usernames AS "AUP",
  CASE WHEN unique_passwords_for_ip < 1 THEN -1.0 ELSE CAST(num_unique_usernames AS DOUBLE) / unique_passwords_for_ip END AS "UWR",
  "RCJ", zxcvbn_1, zxcvbn_0, CAST(num_unique_usernames - num_valid_users AS DOUBLE) / num_unique_usernames AS "FIU"
  FROM sums JOIN gap_stats USING (client_ip, d) JOIN rcj USING (client_ip, d)
  WHERE num_attempts >= 2 AND num_attempts > num_successes)"""
)
DOUBLES = {
    "MIT_Mean", "MIT_Median", "SIT", "FVU", "FF", "FPIB", "FSPIB", "FUIB", "FCIB", "FICIB", "FTP",
    "FNUA", "AUP", "UWR", "AUPPU", "FIU",
}


def columns(names) -> str:
    out = []
    for n in names:
        if n in ("d", "DATE"):
            out.append(f'CAST(d AS VARCHAR) AS "{n}"')
        else:
            out.append(r6(f'"{n}"', f'"{n}"') if n in DOUBLES else f'"{n}"')
    return ", ".join(out)


O["ip_day_features"] = with_(FEATURES, f"SELECT {columns(c.FULL_FEATURES)} FROM features")
O["hfr_select"] = with_(
    FEATURES, f"""SELECT {columns(["client_ip", "d", "NR", "FF"])} FROM features WHERE "NR" > 7 AND "FF" > 0.8"""
)
O["write_features"] = with_(
    FEATURES, f'SELECT {columns(["client_ip", "d", "NR", "FF"])} FROM features'
)
O["ip_day_features_refresh"] = with_(
    FEATURES, f'SELECT {columns(["client_ip", "d", "NR", "NU"])} FROM features'
)
# days that ended two hours or more before the newest attempt
O["ip_day_features_stream"] = plain(
    f"""SELECT client_ip, {DAY}, count(*) AS "NR", round(1 - avg(result), 6) AS "FF" FROM attempts
    GROUP BY client_ip, d HAVING count(*) > 7 AND 1 - avg(result) > 0.8"""
)
_W = f"WHERE {RANGE}"
O["ip_features_window"] = with_(
    FULL
    + GAPS.format(keys="client_ip", where=_W)
    + ", "
    + rcj("client_ip", _W)
    + f""", sums AS (SELECT client_ip, {", ".join(f"{_M[n]} AS {n}" for n in METRIC)} FROM attempts {_W} GROUP BY client_ip)""",
    """SELECT client_ip, num_attempts AS "NR", round(1 - CAST(num_successes AS DOUBLE) / num_attempts, 6) AS "FF",
    num_unique_usernames AS "NU", round(CAST(num_valid_users AS DOUBLE) / num_unique_usernames, 6) AS "FVU",
    unique_passwords_for_ip AS "NP",
    round(CASE WHEN unique_passwords_for_ip < 1 THEN -1.0 ELSE CAST(num_unique_usernames AS DOUBLE) / unique_passwords_for_ip END, 6) AS "UWR",
    round(coalesce(gap_mean, -1.0), 6) AS "MIT", null_user_agents AS "NUA",
    round(CAST(num_unique_user_agents AS DOUBLE) / num_attempts, 6) AS "FUA", "RCJ",
    round(CAST(num_password_in_breach AS DOUBLE) / num_attempts, 6) AS "FPIB",
    round(CAST(num_users_in_breach AS DOUBLE) / num_attempts, 6) AS "FUIB",
    round(CAST(num_pair_in_breach AS DOUBLE) / num_attempts, 6) AS "FCIB",
    round(CAST(num_failed_pair_in_breach AS DOUBLE) / num_attempts, 6) AS "FICIB",
    round(CAST(num_strong_password_in_breach AS DOUBLE) / num_attempts, 6) AS "FSPIB",
    round(CAST(num_tweaked_passwords AS DOUBLE) / num_attempts, 6) AS "FTP", zxcvbn_1, zxcvbn_0,
    round(CAST(num_attempts AS DOUBLE) / num_unique_usernames, 6) AS "APU"
    FROM sums JOIN gap_stats USING (client_ip) JOIN rcj USING (client_ip)
    WHERE num_attempts >= 2 AND num_attempts > num_successes""",
)
O["most_common_user_agent"] = plain(
    f"""SELECT client_ip, {DAY}, user_agent, uses FROM (
      SELECT *, row_number() OVER (PARTITION BY client_ip, d ORDER BY uses DESC, user_agent DESC NULLS LAST) AS rn
      FROM (SELECT client_ip, d, user_agent, count(*) AS uses FROM attempts GROUP BY client_ip, d, user_agent)) WHERE rn = 1"""
)
AUPPU = """seen AS (SELECT *, rank() OVER (PARTITION BY username, d, pw, client_ip ORDER BY "timestamp") AS use_rank FROM base),
auppu AS (SELECT client_ip, d, sum(n) AS unique_submissions, avg(n) AS "AUPPU" FROM (
    SELECT client_ip, d, username, count(*) FILTER (use_rank = 1) AS n FROM seen GROUP BY client_ip, d, username)
  GROUP BY client_ip, d)"""
O["auppu"] = with_(
    PLAIN + ", " + AUPPU,
    f'SELECT client_ip, {DAY}, CAST(unique_submissions AS BIGINT) AS unique_submissions, round("AUPPU", 6) AS "AUPPU" FROM auppu',
)
O["ave_interarrival"] = plain(
    f"""SELECT client_ip, {DAY}, count(*) AS num_attempts, {TS('min("timestamp")', "first_seen")},
    {TS('max("timestamp")', "last_seen")}, {r6("CAST(max(sec) - min(sec) AS DOUBLE) / count(*)", "ave_interarrival")} {BY_DAY}"""
)
O["username_lists"] = plain(
    f"""SELECT client_ip, {DAY}, username, count(*) AS attempts, CAST(sum(result) AS BIGINT) AS successes
    FROM attempts GROUP BY client_ip, d, username"""
)

# ---- enrichment ------------------------------------------------------------------------
NETS = """prefixes AS (SELECT
    CASE WHEN n_nationkey < 16 THEN '198.18.' || n_nationkey || '.0/24' WHEN n_nationkey = 16 THEN '203.0.113.0/24'
         WHEN n_nationkey = 17 THEN '203.0.0.0/16' WHEN n_nationkey = 18 THEN '128.104.0.0/16'
         WHEN n_nationkey = 19 THEN '100.64.0.0/24' WHEN n_nationkey = 20 THEN '100.64.2.0/23'
         ELSE '100.65.' || n_nationkey || '.0/24' END AS network,
    CASE WHEN n_nationkey < 16 THEN 'Carrier ' || n_nationkey % 5 WHEN n_nationkey = 18 THEN 'State University Network'
         WHEN n_nationkey = 19 THEN 'Lakeside School District' ELSE 'Hosting ' || n_nationkey END AS isp,
    'AS ' || n_nationkey % 3 AS asn_org, n_name AS country, 'City ' || n_nationkey AS city, n_nationkey % 7 = 0 AS is_proxy
  FROM nation),
ranges AS (SELECT *, CAST(split_part(network, '/', 2) AS INTEGER) AS len,
    CAST(split_part(network, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(network, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(network, '.', 3) AS BIGINT) * 256 AS lo FROM prefixes),
ips AS (SELECT DISTINCT client_ip, CAST(split_part(client_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(client_ip, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(client_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(client_ip, '.', 4) AS BIGINT) AS num FROM base),
nets AS (SELECT client_ip, num, coalesce(network, 'NA') AS network, coalesce(isp, 'NA') AS isp, coalesce(asn_org, 'NA') AS asn_org,
    coalesce(country, 'NA') AS country, coalesce(city, 'NA') AS city, CAST(coalesce(is_proxy, false) AS INTEGER) AS is_proxy
  FROM (SELECT ips.client_ip, num, r.*, row_number() OVER (PARTITION BY ips.client_ip ORDER BY len DESC NULLS LAST) AS rn
        FROM ips LEFT JOIN ranges r ON num BETWEEN lo AND lo + CAST(power(2, 32 - len) AS BIGINT) - 1) WHERE rn = 1)"""
O["ip_prefix_join"] = with_(
    PLAIN + ", " + NETS,
    "SELECT client_ip, network, isp, asn_org, country, city, is_proxy FROM nets",
)


def first_match(choices, otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(user_agent, '{p}') THEN {v}" for p, v in choices)
    return f"CASE {whens} ELSE {otherwise} END"


OS = first_match([(p, f"'{n}'") for p, n in enrich.OS_PATTERNS], "'Other'")
APP = first_match([(enrich.DESKTOP, "'desktop'"), (enrich.PHONE, "'mobileweb'")], "'unknown'")
BROWSER = first_match([(p, f"'{n}'") for p, n, _ in enrich.BROWSER_PATTERNS], "'Other'")
VERSION = first_match(
    [(p, f"regexp_extract(user_agent, '{v}', 1)") for p, _, v in enrich.BROWSER_PATTERNS], "''"
)
O["ua_dimension"] = plain(
    f"""SELECT DISTINCT user_agent, {OS} AS os, {APP} AS app, {BROWSER} AS browser, {VERSION} AS browser_version
    FROM attempts WHERE user_agent IS NOT NULL"""
)
UA = f"""ua_rows AS (
  SELECT client_ip, d, 'os' AS kind, {OS} AS name FROM base WHERE user_agent IS NOT NULL
  UNION ALL SELECT client_ip, d, 'app', {APP} FROM base WHERE user_agent IS NOT NULL
  UNION ALL SELECT client_ip, d, 'browser', {BROWSER} FROM base WHERE user_agent IS NOT NULL),
ua_n AS (SELECT client_ip, d, kind, name, count(*) AS n FROM ua_rows GROUP BY ALL),
ua AS (SELECT client_ip, d, {", ".join(f'''coalesce('{{' || string_agg(CASE WHEN kind = '{k}' THEN '"' || name || '":' || n END, ',' ORDER BY name) || '}}', '{{}}') AS {k}_json_cnt''' for k in ("os", "app", "browser"))}
  FROM ua_n GROUP BY client_ip, d)"""
O["ua_counts"] = with_(
    PLAIN + ", " + UA,
    f"SELECT client_ip, {DAY}, os_json_cnt, app_json_cnt, browser_json_cnt FROM ua",
)
O["ua_vocabulary"] = with_(PLAIN + ", " + UA, "SELECT DISTINCT name FROM ua_n")
RULED = {
    kind: first_match([(p, f"'{n}'") for k, p, n, _ in agents.RULES if k == kind], f"'{other}'")
    for kind, other in agents.MISSING.items()
}
RULED_VERSION = first_match(
    [(p, f"regexp_extract(user_agent, '{v}', 1)" if v else "''") for k, p, _, v in agents.RULES if k == "browser"],
    "''",
)
O["ua_dimension_by_rules"] = plain(
    f"""SELECT DISTINCT user_agent, {RULED["os"]} AS os, {RULED["app"]} AS app, {RULED["browser"]} AS browser,
    {RULED_VERSION} AS browser_version FROM attempts WHERE user_agent IS NOT NULL"""
)
RULED_NAMES = " UNION ALL ".join(
    f"SELECT client_ip, d, '{k}' AS kind, {name} AS name FROM attempts WHERE user_agent IS NOT NULL"
    for k, name in RULED.items()
)
O["ua_counts_by_rules"] = plain(
    f"SELECT client_ip, {DAY}, kind, name, count(*) AS n FROM ({RULED_NAMES}) GROUP BY client_ip, d, kind, name"
)
O["ua_vocabulary_by_rules"] = plain(f"SELECT DISTINCT name FROM ({RULED_NAMES})")
MFA = """mfa_log AS (SELECT id, username, sec + 1704067200 - 21600 + id % 481 - 240 AS at,
    CASE WHEN v % 5 = 0 THEN 'denied' WHEN v % 5 = 1 THEN 'fraud' ELSE 'success' END AS result
  FROM base WHERE result = 1 AND user_id % 2 = 0 AND id % 3 = 0 AND k >= 28),
matches AS (SELECT m.id AS duo_id, m.username, m.result AS mfa_result, DATE '1970-01-01' + CAST(m.at // 86400 AS INTEGER) AS "date", a.id AS attempt_id
  FROM mfa_log m LEFT JOIN base a ON a.username = m.username AND a.result = 1
   AND a.sec + 1704067200 >= m.at + 21600 - 120 AND a.sec + 1704067200 < m.at + 21600 + 120),
mfa AS (SELECT client_ip, d, count(*) FILTER (mfa_result = 'success') AS success, count(*) FILTER (mfa_result = 'denied') AS denied,
    count(*) FILTER (mfa_result = 'fraud') AS fraud FROM matches JOIN base ON base.id = attempt_id GROUP BY client_ip, d)"""
DUO = """'{"success":' || coalesce(success, 0) || ',"denied":' || coalesce(denied, 0) || ',"fraud":' || coalesce(fraud, 0) || '}'"""
O["mfa_attempt_match"] = with_(
    PLAIN + ", " + MFA,
    'SELECT duo_id, username, mfa_result, CAST("date" AS VARCHAR) AS "date", attempt_id FROM matches',
)
O["mfa_attempt_match_stream"] = O["mfa_attempt_match"]
O["mfa_counts"] = with_(
    PLAIN + ", " + MFA,
    f"SELECT client_ip, {DAY}, success, denied, fraud, {DUO} AS duo_responses FROM mfa",
)

# ---- selection ---------------------------------------------------------------------------
_PCT = """SELECT '{n}' AS feature, pct, round(value, 6) AS value, round(mode, 6) AS mode,
   round((SELECT value FROM {n}_p, {n}_m WHERE pct {side} 80 AND abs(value - mode) >= 0.1 ORDER BY pct {order} LIMIT 1), 6) AS threshold
   FROM {n}_p, {n}_m"""
O["threshold_percentiles"] = with_(
    PLAIN
    + f""", c AS (SELECT count(*) AS "NR", 1 - CAST({_M["num_successes"]} AS DOUBLE) / count(*) AS "FF" {BY_DAY}
      HAVING count(*) > 1 AND count(*) > {_M["num_successes"]})"""
    + "".join(
        f""", {n}_p AS (SELECT pct, quantile_value AS value FROM (SELECT unnest(range(1, 101)) AS pct,
             unnest(quantile_cont("{n}", [{", ".join(f"{i}/100.0" for i in range(1, 101))}])) AS quantile_value FROM c)),
        {n}_m AS (SELECT value AS mode FROM {n}_p GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)"""
        for n in ("NR", "FF")
    ),
    _PCT.format(n="NR", side=">=", order="ASC") + " UNION ALL " + _PCT.format(n="FF", side="<=", order="DESC"),
)


def cidr(block: str) -> str:
    base, size = block.split("/")
    lo = 0
    for octet in base.split("."):
        lo = lo * 256 + int(octet)
    return f"num BETWEEN {lo} AND {lo + 2 ** (32 - int(size)) - 1}"


INSIDE = "(" + " OR ".join(cidr(b) for b in selection.INSTITUTION_NETWORKS) + ")"
SCHOOL = (
    "("
    + " OR ".join(f"regexp_matches(isp, '(?i){p}')" for p in selection.INSTITUTION_PATTERNS)
    + ")"
)
O["filter_institution_networks"] = with_(
    PLAIN + ", " + NETS, f"SELECT client_ip FROM ips WHERE NOT {INSIDE}"
)
O["filter_institution_isp"] = with_(
    PLAIN + ", " + NETS, f"SELECT client_ip, isp FROM nets WHERE NOT {SCHOOL}"
)
LSETS = (
    FEATURES
    + ", "
    + ", ".join([AUPPU, NETS, UA, MFA])
    + f""",
lsets AS (SELECT f.*, f.client_ip || '|' || CAST(f.d AS VARCHAR) AS id, isp AS "ISP", network, num, is_proxy, "AUPPU",
   coalesce(os_json_cnt, '{{}}') AS os_json_cnt, coalesce(app_json_cnt, '{{}}') AS app_json_cnt, coalesce(browser_json_cnt, '{{}}') AS browser_json_cnt,
   coalesce(success, 0) AS success, {DUO} AS duo_responses
  FROM features f LEFT JOIN auppu USING (client_ip, d) LEFT JOIN ua USING (client_ip, d) LEFT JOIN mfa USING (client_ip, d)
  LEFT JOIN nets USING (client_ip)),
hfr AS (SELECT *, isp_ AS isp FROM (SELECT *, "ISP" AS isp_ FROM lsets) WHERE "NR" > 7 AND "FF" > 0.8),
kept AS (SELECT * FROM hfr WHERE success = 0 AND NOT {INSIDE} AND NOT {SCHOOL} AND "AUPPU" * "NU" / "NR" > 0.1)"""
)
O["filter_mfa_success"] = with_(LSETS, "SELECT id, duo_responses FROM hfr WHERE success = 0")
O["filter_malformed_clients"] = with_(
    LSETS, 'SELECT id, round("AUPPU", 6) AS "AUPPU" FROM hfr WHERE "AUPPU" * "NU" / "NR" > 0.1'
)
O["filter_report"] = with_(
    LSETS,
    f"""SELECT count(*) AS selected, count(*) FILTER (success = 0) AS after_mfa,
    count(*) FILTER (success = 0 AND NOT {INSIDE}) AS after_networks,
    count(*) FILTER (success = 0 AND NOT {INSIDE} AND NOT {SCHOOL}) AS after_isp,
    count(*) FILTER (success = 0 AND NOT {INSIDE} AND NOT {SCHOOL} AND "AUPPU" * "NU" / "NR" > 0.1) AS after_malformed FROM hfr""",
)
O["filtered_lsets"] = with_(LSETS, f"SELECT {columns(selection.LSET_COLUMNS)} FROM kept")
O["read_filtered_lsets"] = with_(
    LSETS, f"SELECT {columns(['id', 'DATE', 'ISP', 'NR', 'NU', 'AUPPU'])} FROM kept"
)
O["parse_lset_columns"] = with_(
    LSETS,
    f"SELECT {columns(['id', 'DATE', 'os_json_cnt', 'app_json_cnt', 'browser_json_cnt'])} FROM kept",
)

# ---- near pairs ------------------------------------------------------------------------------


def ratio(x: str, signed: bool = False) -> str:
    a, b = f'CAST(a."{x}" AS DOUBLE)', f'CAST(b."{x}" AS DOUBLE)'
    out = f"CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE ({a} - {b}) / ({a} + {b}) END"
    return f"({out})" if signed else f"abs({out})"


def breach(x: str) -> str:
    a, b = f'greatest(a."{x}", 0.0)', f'greatest(b."{x}", 0.0)'
    return f"(CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE ({a} - {b}) / ({a} + {b}) END)"


WEAK = '(CAST({0}.zxcvbn_0 AS DOUBLE) / ({0}.zxcvbn_0 + {0}.zxcvbn_1))'.format
PAIRS = (
    LSETS
    + f""",
kept_users AS (SELECT kept.id, username, max(result) AS succeeded FROM kept JOIN base USING (client_ip, d) GROUP BY kept.id, username),
shared AS (SELECT x.id AS i, y.id AS j, count(*) AS n FROM kept_users x JOIN kept_users y ON x.username = y.username AND x.id < y.id GROUP BY x.id, y.id),
kept_ua AS (SELECT kept.id, kind, name, n FROM kept JOIN ua_n USING (client_ip, d)),
ua_keys AS (SELECT a.id AS i, b.id AS j, k.kind, k.name FROM kept a JOIN kept b ON a.id < b.id
   JOIN (SELECT DISTINCT kind, name FROM kept_ua) k ON true),
ua_diff AS (SELECT u.i, u.j, u.kind, avg(abs(coalesce(y.n, 0) - coalesce(x.n, 0)) / CAST(greatest(coalesce(x.n, 0), coalesce(y.n, 0)) AS DOUBLE)) AS v
   FROM ua_keys u LEFT JOIN kept_ua x ON x.id = u.i AND x.kind = u.kind AND x.name = u.name
   LEFT JOIN kept_ua y ON y.id = u.j AND y.kind = u.kind AND y.name = u.name
   WHERE x.n IS NOT NULL OR y.n IS NOT NULL GROUP BY u.i, u.j, u.kind),
ua_dist AS (SELECT i, j, sum(v) AS v FROM ua_diff GROUP BY i, j),
parts AS (SELECT a.id AS i, b.id AS j,
  CASE WHEN a.client_ip = b.client_ip THEN 0.0 WHEN a.network = b.network THEN 1 - exp(-1.0) WHEN a."ISP" = b."ISP" THEN 1 - exp(-2.0) ELSE 1.0 END AS dist_ip,
  1 - exp(-CAST(abs(a.d - b.d) AS DOUBLE)) AS dist_date,
  ({ratio("MIT_Mean")} + {ratio("SIT")}) / 2 AS dist_interarrival,
  ({breach("FPIB")} + {breach("FTP")}) / 2 AS dist_breach,
  (coalesce(u.v, 0.0) + {ratio("FNUA")} + {ratio("NUA")}) / 5 AS dist_user_agent,
  ({ratio("FF")} + {ratio("FVU")}) / 2 AS dist_result,
  1 - CAST(coalesce(s.n, 0) AS DOUBLE) / (a."NU" + b."NU" - coalesce(s.n, 0)) AS dist_usernames,
  CASE WHEN {WEAK("a")} + {WEAK("b")} = 0 THEN 0.0 ELSE abs({WEAK("a")} - {WEAK("b")}) / ({WEAK("a")} + {WEAK("b")}) END AS dist_zxcvbn,
  {ratio("NR")} + {ratio("NU")} + {ratio("AUPPU")} AS dist_volume, coalesce(s.n, 0) AS shared_usernames
  FROM kept a JOIN kept b ON a.id < b.id LEFT JOIN shared s ON s.i = a.id AND s.j = b.id LEFT JOIN ua_dist u ON u.i = a.id AND u.j = b.id),
near AS (SELECT * FROM (SELECT *, 0.25 * dist_ip + 0.25 * dist_date + (0.5 / 9) * (dist_interarrival + dist_breach + dist_user_agent + dist_result
    + dist_usernames + dist_zxcvbn + dist_volume) AS dist FROM parts) WHERE dist < 0.4)"""
)
for _p in (
    "dist_ip", "dist_date", "dist_interarrival", "dist_breach", "dist_user_agent", "dist_result",
    "dist_usernames", "dist_zxcvbn", "dist_volume",
):
    O[_p] = with_(PAIRS, f"SELECT i, j, {r6(_p, _p)} FROM near")
# all pairs, whatever their distance
ALL_PAIRS = PAIRS.replace(" WHERE dist < 0.4)", ")")
O["lset_distance"] = with_(ALL_PAIRS, f"SELECT i, j, {r6('dist', 'dist')} FROM near")
O["pairwise_distance"] = with_(
    PAIRS, f"SELECT i, j, shared_usernames, {r6('dist', 'dist')} FROM near"
)
O["minmax_by_column"] = with_(
    PAIRS
    + """, both_ways AS (SELECT i, j, dist FROM near UNION ALL SELECT j, i, dist FROM near),
 tops AS (SELECT j, CASE WHEN count(*) < (SELECT count(*) FROM kept) - 1 THEN 0.4 ELSE max(dist) END AS top FROM both_ways GROUP BY j)""",
    "SELECT i, j, round(dist / top, 6) AS scaled FROM both_ways JOIN tops USING (j)",
)



def linkage(threshold: float | str) -> str:
    """Average linkage on the distances of all pairs, one merge of the closest two clusters a step."""
    return (
        PAIRS.replace("ev AS (", "RECURSIVE ev AS (", 1).lstrip()
        + f""",
every_pair AS MATERIALIZED (SELECT i, j, 0.25 * dist_ip + 0.25 * dist_date + (0.5 / 9) * (dist_interarrival + dist_breach
    + dist_user_agent + dist_result + dist_usernames + dist_zxcvbn + dist_volume) AS dist FROM parts),
state AS (
  SELECT 0 AS step, i AS a, j AS b, dist AS total, CAST(1 AS DOUBLE) AS n FROM every_pair
  UNION ALL
  SELECT step + 1, least(x, y), greatest(x, y), sum(total), sum(n) FROM (
    SELECT step, CASE WHEN a = mb THEN ma ELSE a END AS x, CASE WHEN b = mb THEN ma ELSE b END AS y, total, n
    FROM (SELECT *, first_value(a) OVER w AS ma, first_value(b) OVER w AS mb, min(total / n) OVER () AS h
          FROM state WINDOW w AS (ORDER BY total / n, a, b))
    WHERE h < {threshold} AND NOT (a = ma AND b = mb))
  GROUP BY step, least(x, y), greatest(x, y)),
merges AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT ON (step) step, a, b, total / n AS height FROM state ORDER BY step, total / n, a, b)
  WHERE height < {threshold}),
assigned AS (
  SELECT 0 AS step, id, id AS cluster FROM kept
  UNION ALL
  SELECT assigned.step + 1, id, CASE WHEN cluster = merges.b THEN merges.a ELSE cluster END
  FROM assigned JOIN merges ON merges.step = assigned.step)"""
    )


O["average_linkage_clusters"] = with_(
    linkage(0.3),
    "SELECT id, cluster FROM assigned WHERE step = (SELECT max(step) FROM assigned)",
)
# the whole tree
O["merge_history"] = with_(
    linkage("CAST('infinity' AS DOUBLE)"),
    """SELECT m.a, m.b, round(m.height, 6) AS height, count(*) AS size
FROM merges m JOIN assigned s ON s.step = m.step AND s.cluster IN (m.a, m.b) GROUP BY m.a, m.b, m.height""",
)

# the knee: a polynomial of degree 7 from power sums, its normal equations solved by elimination, and the first peak of
# the difference to the diagonal, looked for on a fine grid from the greatest height downwards
_GRID = 20_000
KNEE = f""",
ranks AS (SELECT height, count(*) AS cnt, min(r) AS lo, max(r) AS hi FROM (
  SELECT height, row_number() OVER (ORDER BY height) - 1 AS r FROM merges) GROUP BY height),
ends AS (SELECT min(height) AS low, max(height) AS high, CAST(sum(cnt) AS BIGINT) AS n FROM ranks),
points AS (SELECT height, lo, cnt, (height - low) / (high - low) AS u, n - 1 - (lo + hi) / 2.0 AS y FROM ranks, ends WHERE n >= 3 AND high > low),
powers AS (SELECT k, sum(cnt * pow(u, k)) AS m, sum(cnt * pow(u, k) * y) AS b FROM points, (SELECT unnest(range(15)) AS k) GROUP BY k),
equations AS (SELECT i, list(m ORDER BY j) AS terms FROM (
  SELECT i, j, m FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j), powers WHERE k = i + j
  UNION ALL SELECT k, 8, b FROM powers WHERE k < 8) GROUP BY i),
steps AS (
  SELECT 1 AS k, list(terms ORDER BY i) AS a FROM equations
  UNION ALL
  SELECT k + 1, [CASE WHEN i = k THEN a[i] ELSE [a[i][j] - a[k][j] * a[i][k] / a[k][k] FOR j IN range(1, 10)] END FOR i IN range(1, 9)]
  FROM steps WHERE k <= 8),
curve AS (SELECT g / {_GRID}.0 AS x, list_sum([a[i][9] / a[i][i] * pow(g / {_GRID}.0, i - 1) FOR i IN range(1, 9)]) AS f
  FROM steps, (SELECT unnest(range({_GRID} + 1)) AS g) WHERE k = 9),
gap AS (SELECT x, (max(f) OVER () - f) / (max(f) OVER () - min(f) OVER ()) - x AS d FROM curve),
around AS (SELECT x, d, lag(d) OVER w AS p, lead(d) OVER w AS q FROM gap WINDOW w AS (ORDER BY x DESC)),
stops AS (SELECT x, d, lag(d) OVER w AS p, lead(d) OVER w AS q FROM around
  WHERE p IS NULL OR q IS NULL OR (d > p AND d >= q) OR (d <= p AND d < q) WINDOW w AS (ORDER BY x DESC)),
knee AS (SELECT max(x) AS x FROM stops, ends WHERE d > p AND q < d - 1.0 / (n - 1))"""
O["cut_threshold"] = with_(
    linkage(0.4) + KNEE,
    """SELECT round(t.h, 6) AS threshold, (SELECT count(*) FROM kept) - t.lo AS clusters
FROM (SELECT min({'gap': abs(u - x), 'h': height, 'lo': lo}) AS t FROM points, knee WHERE x IS NOT NULL) WHERE t IS NOT NULL""",
)

# ---- campaigns -----------------------------------------------------------------------------
LINKED = (
    PAIRS.replace("ev AS (", "RECURSIVE ev AS (", 1).lstrip()
    + f""",
links AS MATERIALIZED (SELECT i, j FROM near WHERE dist < {c.LINK_THRESHOLD} UNION ALL SELECT j, i FROM near WHERE dist < {c.LINK_THRESHOLD}),
reach AS (SELECT id AS i, id AS j FROM kept UNION SELECT reach.i, links.j FROM reach JOIN links ON links.i = reach.j),
members AS (SELECT i AS id, min(j) AS cluster_id FROM reach GROUP BY i),
labelled AS (SELECT kept.*, cluster_id FROM kept JOIN members USING (id)),
names AS (SELECT cluster_id, username, max(succeeded) AS succeeded FROM members JOIN kept_users USING (id) GROUP BY cluster_id, username),
known AS (SELECT DISTINCT 'u' || user_id AS username FROM events WHERE user_id % 10 = 0)"""
)
BASIC = """CAST(sum("NR") AS BIGINT) AS "NR", count(DISTINCT client_ip) AS "IPs", count(DISTINCT "ISP") AS "ISPs", count(DISTINCT d) AS "DATES_active",
 CAST(sum(zxcvbn_0) AS BIGINT) AS zxcvbn_0, CAST(sum(zxcvbn_1) AS BIGINT) AS zxcvbn_1, round(avg("FF"), 6) AS "FF", round(avg("FVU"), 6) AS "FVU", count(*) AS num_lsets"""
BREACH = (
    ", ".join(
        f'round(sum("{x}" * "NR") / sum("NR"), 6) AS "{x}"'
        for x in ("FPIB", "FTP", "FUIB", "FCIB", "FICIB")
    )
    + """, round(sum(CASE WHEN "FSPIB" = -1 THEN 0.0 ELSE "FSPIB" END * "NR") / sum("NR"), 6) AS "FSPIB\""""
)
MEANS = """round(sum("AUPPU" * "NU") / sum("NU"), 6) AS "AUPPU", round(sum("FNUA" * "NR") / sum("NR"), 6) AS "FNUA\""""
USERSTATS = """SELECT cluster_id, count(*) AS "NU", count(*) FILTER (succeeded = 1) AS comp_users,
 count(*) FILTER (succeeded = 1 AND username IN (SELECT username FROM known)) AS uniq_comp_users FROM names GROUP BY cluster_id"""
O["connected_campaigns"] = with_(LINKED, "SELECT id, cluster_id AS cluster FROM members")
O["campaign_basic_stats"] = with_(
    LINKED, f"SELECT cluster_id, {BASIC} FROM labelled GROUP BY cluster_id"
)
O["campaign_breach_stats"] = with_(
    LINKED, f"SELECT cluster_id, {BREACH} FROM labelled GROUP BY cluster_id"
)
O["campaign_weighted_means"] = with_(
    LINKED, f"SELECT cluster_id, {MEANS} FROM labelled GROUP BY cluster_id"
)
O["campaign_total_usernames"] = with_(
    LINKED, 'SELECT cluster_id, count(*) AS "NU" FROM names GROUP BY cluster_id'
)
O["campaign_compromised_users"] = with_(
    LINKED,
    "SELECT cluster_id, count(*) FILTER (succeeded = 1) AS comp_users FROM names GROUP BY cluster_id",
)
O["campaign_flagged_users"] = with_(
    LINKED, f"SELECT cluster_id, uniq_comp_users FROM ({USERSTATS})"
)
STATS = f"""SELECT * FROM (SELECT cluster_id, {BASIC}, {BREACH}, {MEANS} FROM labelled GROUP BY cluster_id) JOIN ({USERSTATS}) USING (cluster_id)"""
O["campaign_stats"] = with_(LINKED, STATS)
_A = c.ATTACK_SIZE
O["attack_campaigns"] = with_(
    LINKED,
    f"""SELECT cluster_id, "NR", "NU", "AUPPU" FROM ({STATS})
    WHERE "NR" >= {_A["attempts"]} OR "NU" >= {_A["users"]} OR "AUPPU" > {_A["passwords"]}""",
)
# the whole run: linkage cut at the knee, or at the limit if there is none
CUT = (
    linkage(0.4)
    + KNEE
    + """,
cut AS (SELECT coalesce((SELECT min({'gap': abs(u - x), 'h': height, 'lo': lo}).h FROM points, knee WHERE x IS NOT NULL), 0.4) AS h),
members AS (SELECT id, cluster AS cluster_id FROM assigned WHERE step = (SELECT count(*) FROM merges, cut WHERE height < h)),"""
    + LINKED[LINKED.index("labelled AS (") - 1 :]
)
O["find_campaigns"] = with_(
    CUT,
    f"""SELECT * FROM ({STATS})
    WHERE "NR" >= {_A["attempts"]} OR "NU" >= {_A["users"]} OR "AUPPU" > {_A["passwords"]}""",
)
O["write_results"] = with_(
    LINKED,
    "SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS num_lsets FROM labelled",
)

# ---- log-wide statistics --------------------------------------------------------------------
_DAYS = "((max(sec) - min(sec)) / 86400.0::DOUBLE)"
_IA = {
    "interarrival_time_by_username": "ia_username",
    "interarrival_time_by_ip": "ia_ip",
    "interarrival_time_by_username_ip": "ia_username_ip",
}
O["attempt_statistics"] = full(
    f"""SELECT round(count(*) / {_DAYS}, 2) AS "count", {", ".join(f"round(sum({x}) / {_DAYS}, 2) AS {x}" for x in statistics.SUMMED)},
    {", ".join(f"round(avg(CASE WHEN {y} >= 0 AND {y} < 300 THEN {y} END) / {_DAYS}, 2) AS {x}" for x, y in _IA.items())} FROM attempts"""
)
UD = "SELECT username, d, count(*) AS n FROM attempts GROUP BY username, d"
O["avg_attempts_per_user_day"] = plain(f"SELECT {r6('avg(n)', 'avg_attempts')} FROM ({UD})")


# the sketches of so few values are exact
O["statistics_from_partials"] = O["attempt_statistics"]
UDF = """SELECT username, d, count(*) AS n, count(DISTINCT client_ip) AS ips,
  count(DISTINCT client_ip || '|' || coalesce('x' || user_agent, '')) AS pairs FROM attempts GROUP BY username, d"""
O["averages_from_partials"] = plain(
    f"SELECT {r6('avg(n)', 'avg_attempts')}, {r6('avg(ips)', 'avg_unique_ips')}, {r6('avg(pairs)', 'avg_ip_agent_pairs')} FROM ({UDF})"
)
O["distinct_from_partials"] = plain(
    """SELECT count(DISTINCT username) AS users, count(DISTINCT CASE WHEN result = 1 THEN username END) AS successful_users,
    count(DISTINCT client_ip) AS ips FROM attempts"""
)
O["ip_users_from_partials"] = plain(
    """SELECT client_ip, count(*) AS attempts, CAST(sum(result) AS BIGINT) AS successes, count(DISTINCT username) AS users
    FROM attempts GROUP BY client_ip"""
)


def p99(source: str, col: str) -> str:
    return f"""SELECT CAST(v AS DOUBLE) AS p99 FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col} DESC) AS rn, count(*) OVER () AS n FROM {source})
    WHERE rn = 1 + CAST(floor((n - 1) * 0.01) AS BIGINT)"""


O["p99_attempts_per_user_day"] = plain(p99(f"({UD})", "n"))
O["p99_field"] = full(
    p99("(SELECT * FROM attempts WHERE ia_username >= 0 AND ia_username < 300)", "ia_username")
)
O["p99_session_field"] = with_(IPS, p99("sessions", "num_attempts"))
O["interarrival_values"] = full("SELECT CAST(ia_ip AS DOUBLE) AS interarrival FROM attempts")
O["unique_ips_per_user_day"] = plain(
    f"SELECT username, {DAY}, count(DISTINCT client_ip) AS unique_ips FROM attempts GROUP BY username, d"
)
O["ip_ua_pairs_per_user_day"] = plain(
    f"SELECT client_ip, user_agent, username, {DAY}, count(*) AS attempts FROM attempts GROUP BY client_ip, user_agent, username, d"
)
O["ip_ua_pairs_all_time"] = plain(
    "SELECT client_ip, user_agent, username, count(*) AS attempts FROM attempts GROUP BY client_ip, user_agent, username"
)
ELEMENTS = (
    PLAIN
    + """, elements AS (SELECT id, username, e[1] AS ed, e[2] AS ppsm, e[3] AS rk FROM (SELECT id, username, unnest(ctm[2:]) AS e FROM attempts))"""
)
O["credtweak_distribution"] = with_(
    ELEMENTS,
    "SELECT CAST(ed AS DOUBLE) AS value, count(*) AS n FROM elements WHERE ed IS NOT NULL GROUP BY ed",
)
O["credtweak_totals"] = with_(
    ELEMENTS,
    "SELECT count(*) AS num_values, count(DISTINCT id) AS num_attempts, count(DISTINCT username) AS num_users FROM elements WHERE ed IS NOT NULL",
)
O["credtweak_from_actual"] = plain(
    "SELECT username, CAST(ctm[1][1] AS DOUBLE) AS value FROM attempts"
)
O["credtweak_reset_users"] = plain(
    "SELECT count(DISTINCT username) AS num_users FROM attempts WHERE ctm[1][1] <> 0"
)
O["credtweaks_per_session"] = full(
    "SELECT username_session_id AS session_id, CAST(sum(len(list_filter(ctm[2:], lambda e: coalesce(e[1] <= 3, false)))) AS BIGINT) AS num_tweaks FROM attempts GROUP BY 1"
)
O["credtweaks_per_ip_session"] = full(
    "SELECT ip_session_id AS session_id, CAST(sum(len(list_filter(ctm[2:], lambda e: coalesce(e[2] <= 1, false)))) AS BIGINT) AS num_tweaks FROM attempts GROUP BY 1"
)
O["unique_pwds_per_user_day"] = full(
    f"""SELECT username, {DAY}, len(list_distinct(dist_username)) + 1 AS unique_passwords FROM (
      SELECT *, row_number() OVER (PARTITION BY username, d ORDER BY id DESC) AS rn FROM attempts) WHERE rn = 1 AND dist_username IS NOT NULL"""
)
LAST_OK = (
    FULL
    + """, last_ok AS (SELECT unnest(dist_username) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY username, d ORDER BY "timestamp" DESC, id DESC) AS rn
    FROM attempts WHERE result = 1) WHERE rn = 1)"""
)
O["edit_distance_from_actual"] = with_(
    LAST_OK, "SELECT distance, count(*) AS n FROM last_ok WHERE distance <> 0 GROUP BY distance"
)
O["typo_requests"] = with_(
    LAST_OK, "SELECT count(*) AS typos FROM last_ok WHERE distance IN (1, 2)"
)
O["top_failing_usernames"] = plain(
    "SELECT username, count(*) AS failures FROM attempts WHERE result = 0 GROUP BY username ORDER BY failures DESC, username LIMIT 20"
)
O["result_codes_for_user"] = plain(
    "SELECT username, "
    + ", ".join(f"""count(*) FILTER (result_code = '{x}') AS "{x}\"""" for x in RESULT_CODES)
    + " FROM attempts GROUP BY username"
)
O["lookup_usernames_for_ip"] = plain(
    f"SELECT client_ip, username, count(*) AS attempts FROM attempts WHERE client_ip = '{c.HOT_IP}' GROUP BY client_ip, username"
)
O["lookup_result_codes_for_user"] = plain(
    f"SELECT {DAY}, result_code, count(*) AS attempts FROM attempts WHERE username = '{c.USER}' GROUP BY d, result_code"
)
O["unsuccessful_ips_for_user"] = plain(
    "SELECT username, count(DISTINCT CASE WHEN result = 0 THEN client_ip END) AS unsuccessful_ips FROM attempts GROUP BY username"
)
O["distinct_pwds_per_day_user"] = plain(
    f"SELECT username, {DAY}, count(DISTINCT pw) AS distinct_passwords, count(*) AS total_passwords FROM attempts GROUP BY username, d"
)
O["distinct_pwds_per_day_ip"] = plain(
    f"SELECT client_ip, {DAY}, count(DISTINCT pw) AS distinct_passwords, count(*) AS total_passwords FROM attempts GROUP BY client_ip, d"
)

# ---- detectors -------------------------------------------------------------------------------
O["non_standard_user_agents"] = plain(
    "SELECT id, user_agent FROM attempts WHERE user_agent NOT LIKE '%Mozilla%'"
)
STUFFING = "appeared_in_breach = 1 OR password_appeared_in_breach = 1"
O["credential_stuffing_attempts"] = plain(
    f"SELECT id, username, client_ip FROM attempts WHERE {STUFFING}"
)
O["credential_tweaking_attempts"] = plain(
    """SELECT id, username FROM attempts WHERE len(ctm) > 1 AND
    len(list_filter(ctm[2:], lambda e: e[1] IS NOT NULL AND coalesce(e[1] <= 3 OR e[2] <= 1, false))) > 0"""
)
O["breached_pair_candidates"] = full(
    f"""SELECT username, {DAY}, unique_ips FROM (
      SELECT username, d, count(DISTINCT client_ip) AS unique_ips, arg_max(dist_username, {{'a': "timestamp", 'b': id}}) AS dist FROM attempts GROUP BY username, d)
    WHERE unique_ips > 2 AND len(list_filter(dist, lambda x: len(list_filter(dist, lambda y: x = y)) > 2)) > 0"""
)
GROUPS = "SELECT username, d, count(*) AS c FROM attempts GROUP BY client_ip, user_agent, username, d"
O["breached_usernames"] = plain(f"SELECT username, {DAY}, c FROM ({GROUPS}) WHERE c > 1")
O["breached_usernames_by_pairs"] = plain(
    f"SELECT username, {DAY}, c FROM (SELECT username, d, count(*) AS c FROM ({GROUPS}) GROUP BY username, d) WHERE c > 4"
)


def targeted(counted: str) -> str:
    return f"""SELECT username, {DAY}, count(*) AS attempts, count(*) FILTER ({counted}) AS counted FROM attempts
    GROUP BY username, d HAVING count(*) >= 5 AND count(*) FILTER ({counted}) >= 5"""


TARGETED = targeted("dist_username IS NOT NULL")
O["targeted_attack_user_days"] = full(TARGETED)
O["targeted_attack_unique_only"] = full(targeted("is_unique_pws_by_username = 1"))
SPRAY = "num_unique_usernames >= 5 AND num_unique_user_agents = 1"
O["attacks_matching_attempts"] = plain(f"SELECT id FROM attempts WHERE {STUFFING}")
O["attacks_matching_sessions"] = with_(IPS, f"SELECT id FROM sessions WHERE {SPRAY}")
O["attacks_matching_user_days"] = full(
    f"SELECT id FROM attempts WHERE (username, CAST(d AS VARCHAR)) IN (SELECT username, d FROM ({TARGETED}))"
)
O["tag_attack"] = with_(
    IPS,
    f"""SELECT 1 AS attack_id, id AS attempt_id, NULL::VARCHAR AS username, NULL::VARCHAR AS "date", NULL::BIGINT AS username_session_id,
      NULL::BIGINT AS ip_session_id, NULL::BIGINT AS username_ip_session_id FROM attempts WHERE {STUFFING}
    UNION ALL SELECT 4, NULL, NULL, NULL, NULL, id, NULL FROM sessions WHERE {SPRAY}
    UNION ALL SELECT 5, NULL, username, d, NULL, NULL, NULL FROM ({TARGETED})""",
)
O["cred_stuffing_score"] = plain(
    """, u AS (SELECT username, max(CASE WHEN result = 1 AND password_appeared_in_breach = 1 THEN 1 ELSE 0 END) AS ok FROM attempts GROUP BY username
      HAVING sum(password_appeared_in_breach) >= 1 AND sum(result) >= 1 AND count(*) - sum(password_appeared_in_breach) >= 1),
    w AS (SELECT *, max(result) OVER (PARTITION BY username, client_ip ORDER BY "timestamp", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ip_ok,
      max(result) OVER (PARTITION BY username, user_agent ORDER BY "timestamp", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ua_ok FROM attempts)
    SELECT score, count(*) AS n FROM (SELECT CASE WHEN coalesce(ip_ok, 0) = 0 THEN 2 ELSE 0 END
      + CASE WHEN user_agent IS NULL THEN 2 WHEN coalesce(ua_ok, 0) = 0 THEN 1 ELSE 0 END + CASE WHEN ok = 1 THEN 0 ELSE 2 END AS score
      FROM w JOIN u USING (username) WHERE password_appeared_in_breach = 1) GROUP BY score"""
)
O["cred_stuffing_score_stream"] = O["cred_stuffing_score"]


def top(key: str, at_least: int, most: float, order: str) -> str:
    return f"""SELECT {key}, c, round(stf, 6) AS stf, round(fts, 6) AS fts FROM (
      SELECT {key}, c, CASE WHEN c > s THEN CAST(s AS DOUBLE) / (c - s) END AS stf, CASE WHEN s > 0 THEN CAST(c - s AS DOUBLE) / s END AS fts
      FROM (SELECT {key}, count(*) AS c, sum(result) AS s FROM attempts GROUP BY {key}) WHERE c >= {at_least})
    WHERE stf <= {most} ORDER BY {order} DESC NULLS LAST, {key} LIMIT 10"""


O["top_suspicious_ips"] = plain(top("client_ip", 20, 0.2, "c"))
O["top_suspicious_usernames"] = plain(top("username", 20, 1.0, "fts"))
INTERESTING = """len(ctm) > 1 AND len(list_filter(ctm, lambda e: (coalesce(e[1] <= 3, false) OR coalesce(e[2] = 0, false) OR coalesce(e[3] < 100, false))
   AND NOT coalesce(e[1] = 0, false))) > 0"""
O["interesting_credtweaks"] = plain(
    f"""SELECT count(*) AS total, count(*) FILTER (result = 1) AS total_successful, count(DISTINCT username) AS unique_usernames,
    count(DISTINCT CASE WHEN result = 1 THEN username END) AS unique_successful_usernames FROM attempts WHERE {INTERESTING}"""
)
IPS_TW = f"SELECT client_ip, count(*) AS failures, count(DISTINCT username) AS failing_usernames FROM attempts WHERE {INTERESTING} AND result = 0 GROUP BY client_ip"
O["interesting_credtweak_ips"] = plain(
    f"{IPS_TW} ORDER BY failing_usernames DESC, client_ip LIMIT 10"
)
O["interesting_credtweak_ips_by_failures"] = plain(
    f"{IPS_TW} ORDER BY failures DESC, client_ip LIMIT 5"
)
O["interesting_credtweaks_user"] = plain(
    """SELECT username, count(*) FILTER (len(ctm) > 1) AS total, count(*) FILTER (len(ctm) > 1 AND
      len(list_filter(ctm, lambda e: coalesce(e[1] <= 3, false) OR coalesce(e[2] <= 0, false) OR coalesce(e[3] <= 0, false))) > 0) AS close
    FROM attempts GROUP BY username"""
)


def slow(extra: str = "") -> str:
    return f"""slow AS (SELECT client_ip, min("timestamp") AS first_seen, max("timestamp") AS last_seen, count(*) AS attempts,
      CAST(sum(result) AS BIGINT) AS successes, CAST(sum(password_appeared_in_breach) AS BIGINT) AS password_in_breach,
      CAST(sum(username_appeared_in_breach) AS BIGINT) AS username_in_breach, CAST(sum(appeared_in_breach) AS BIGINT) AS pair_in_breach,
      count(DISTINCT username) AS users, round(CAST(max(sec) - min(sec) AS DOUBLE) / count(*), 2) AS mit
    FROM attempts WHERE {WINDOW} {extra} GROUP BY client_ip
    HAVING count(*) >= 5 AND count(*) < 50 AND sum(result) / count(*) < {c.SLOW["max_success"]} AND count(DISTINCT username) / count(*) >= {c.SLOW["min_users"]})"""


SLOW_COLS = f"""client_ip, {TS("first_seen", "first_seen")}, {TS("last_seen", "last_seen")}, attempts, successes, password_in_breach,
  username_in_breach, pair_in_breach, users, mit"""
O["low_and_slow_ips"] = with_(PLAIN + ", " + slow(), f"SELECT {SLOW_COLS} FROM slow")
O["low_and_slow_summary"] = with_(
    PLAIN + ", " + slow(),
    f"""SELECT count(DISTINCT username) AS users, count(*) AS attempts, CAST(sum(result) AS BIGINT) AS successes,
    CAST(sum(username_appeared_in_breach) AS BIGINT) AS username_in_breach, CAST(sum(password_appeared_in_breach) AS BIGINT) AS password_in_breach
    FROM attempts WHERE {WINDOW} AND client_ip IN (SELECT client_ip FROM slow)""",
)
AGENT = f"user_agent = '{c.AGENT}'"


def heuristics(extra: str) -> str:
    return f"""SELECT client_ip, CAST(sum(CASE WHEN heuristic_edit + heuristic_strength + heuristic_rank > 0 THEN 1 ELSE 0 END) AS BIGINT) AS matching_attempts,
    CAST(sum(heuristic_edit) AS BIGINT) AS by_edit, CAST(sum(heuristic_strength) AS BIGINT) AS by_strength, CAST(sum(heuristic_rank) AS BIGINT) AS by_rank
    FROM flagged WHERE {WINDOW} {extra} GROUP BY client_ip"""


UNKNOWN = "SELECT client_ip, count(*) FILTER (result_code = 'UnknownUsername') AS unknown_usernames FROM attempts WHERE {} GROUP BY client_ip".format
O["low_and_slow_detail"] = with_(
    FLAGGED + ", " + slow(),
    f"""SELECT {SLOW_COLS}, coalesce(unknown_usernames, 0) AS unknown_usernames, coalesce(matching_attempts, 0) AS matching_attempts,
    coalesce(by_edit, 0) AS by_edit, coalesce(by_strength, 0) AS by_strength, coalesce(by_rank, 0) AS by_rank
    FROM slow LEFT JOIN ({UNKNOWN(WINDOW + " AND " + AGENT)}) USING (client_ip) LEFT JOIN ({heuristics("AND " + AGENT)}) USING (client_ip)""",
)
O["credtweak_matches_in_window"] = with_(FLAGGED, heuristics(""))
O["unknown_usernames_in_window"] = plain(UNKNOWN(WINDOW))
O["pair_in_breach_in_window"] = plain(
    f"SELECT client_ip, CAST(sum(appeared_in_breach) AS BIGINT) AS pair_in_breach FROM attempts WHERE {WINDOW} AND {AGENT} GROUP BY client_ip"
)
O["min_edit_distance_histogram"] = with_(
    PLAIN + ", " + slow(),
    """SELECT CAST(m AS DOUBLE) AS min_edit, count(*) AS n FROM (SELECT list_min(list_filter(list_transform(ctm[2:], lambda e: e[1]), lambda x: x <> 0)) AS m
    FROM attempts WHERE client_ip IN (SELECT client_ip FROM slow)) WHERE m IS NOT NULL GROUP BY m""",
)
O["min_edit_distance_unfiltered"] = plain(
    f"""SELECT CAST(m AS DOUBLE) AS min_edit, count(*) AS n FROM (SELECT list_min(list_transform(ctm[2:], lambda e: e[1])) AS m
    FROM attempts WHERE client_ip IN (SELECT client_ip FROM attempts WHERE {WINDOW} AND {AGENT})) WHERE m IS NOT NULL GROUP BY m"""
)

# ---- investigations ------------------------------------------------------------------------------
CONNECTING = f"""SELECT client_ip, count(*) AS attempts, CAST(sum(result) AS BIGINT) AS successes FROM attempts
  WHERE username IN (SELECT username FROM attempts WHERE client_ip = '{c.HOT_IP}') GROUP BY client_ip"""
O["connecting_ips"] = plain(CONNECTING)
O["connecting_ips_filtered"] = plain(
    f"SELECT * FROM ({CONNECTING}) WHERE attempts >= 20 AND successes / attempts <= 0.2"
)
O["ip_reachability"] = with_(
    PLAIN.replace("ev AS (", "RECURSIVE ev AS (", 1).lstrip()
    + f""", users AS MATERIALIZED (SELECT client_ip, username, count(*) AS c, sum(result) AS s FROM attempts GROUP BY client_ip, username),
    links AS MATERIALIZED (SELECT x.client_ip AS src, y.client_ip AS dst FROM users x JOIN users y ON x.username = y.username
      GROUP BY x.client_ip, y.client_ip HAVING sum(y.c) >= 20 AND sum(y.s) / sum(y.c) <= 0.2),
    reach AS (SELECT '{c.HOT_IP}' AS client_ip, 0 AS hop UNION SELECT dst, hop + 1 FROM reach JOIN links ON src = client_ip WHERE hop < 12)""",
    "SELECT client_ip, min(hop) AS hop FROM reach GROUP BY client_ip",
)
O["usernames_for_ip"] = plain(
    "SELECT client_ip, username, count(*) AS attempts FROM attempts GROUP BY client_ip, username"
)
O["successful_usernames_for_ip"] = plain(
    "SELECT client_ip, username, count(*) AS successes FROM attempts WHERE result = 1 GROUP BY client_ip, username"
)
O["user_last_distances"] = full(
    f"""SELECT client_ip, {DAY}, username, array_to_string(coalesce(dist_username, []), ',') AS distances FROM (
      SELECT *, row_number() OVER (PARTITION BY client_ip, d, username ORDER BY "timestamp" DESC, id DESC) AS rn,
        count(*) OVER (PARTITION BY client_ip, d, username) AS n FROM attempts) WHERE rn = 1 AND n > 1"""
)
O["ip_last_distances"] = full(
    f"""SELECT client_ip, {DAY}, array_to_string(coalesce(dist_ip_array, []), ',') AS distances FROM (
      SELECT *, row_number() OVER (PARTITION BY client_ip, d ORDER BY "timestamp" DESC, id DESC) AS rn FROM attempts) WHERE rn = 1"""
)
O["ip_unique_pwds_per_day"] = full(
    f"""SELECT client_ip, {DAY}, count(*) FILTER (prior_ip IS NOT NULL AND is_unique_pws_by_ip = 1) AS unique_count, count(prior_ip) AS total {BY_DAY}"""
)
O["ip_password_runs"] = full(
    f""", s AS (SELECT client_ip, d, prior_ip[-1] = 0 AS same, row_number() OVER (PARTITION BY client_ip, d ORDER BY "timestamp", id) AS slot
      FROM attempts WHERE prior_ip IS NOT NULL),
    g AS (SELECT client_ip, d, slot - coalesce(lag(slot) OVER (PARTITION BY client_ip, d ORDER BY slot), 0) AS run_length FROM s WHERE NOT same)
    SELECT client_ip, {DAY}, run_length, count(*) AS runs FROM g GROUP BY client_ip, d, run_length"""
)
O["user_password_ratio_per_day"] = plain(
    f"""SELECT client_ip, {DAY}, count(DISTINCT username) AS usernames, count(DISTINCT pw) AS passwords,
    {r6("CAST(count(DISTINCT username) AS DOUBLE) / count(DISTINCT pw)", "ratio")} {BY_DAY}"""
)
O["username_password_pairs"] = with_(
    BY_IP,
    "SELECT client_ip, username, label, count(*) AS attempts FROM labels GROUP BY client_ip, username, label",
)
O["username_password_groups"] = with_(
    BY_IP
    + """, prs AS (SELECT DISTINCT client_ip, username, label FROM labels),
    pp AS (SELECT client_ip, avg(n) AS a, median(n) AS m FROM (SELECT client_ip, label, count(*) AS n FROM prs GROUP BY client_ip, label) GROUP BY client_ip),
    uu AS (SELECT client_ip, avg(n) AS a, median(n) AS m FROM (SELECT client_ip, username, count(*) AS n FROM prs GROUP BY client_ip, username) GROUP BY client_ip)""",
    """SELECT client_ip, round(pp.a, 6) AS mean_usernames_per_password, round(pp.m, 6) AS median_usernames_per_password,
    round(uu.a, 6) AS mean_passwords_per_username, round(uu.m, 6) AS median_passwords_per_username FROM pp JOIN uu USING (client_ip)""",
)
_IPS = ", ".join(f"'{x}'" for x in c.SOME_IPS)
O["password_reuse_across_ips"] = full(
    f""", seen AS (SELECT username, d FROM attempts WHERE client_ip IN ({_IPS}) GROUP BY username, d HAVING count(DISTINCT client_ip) > 1),
    mine AS (SELECT * FROM attempts WHERE (username, d) IN (SELECT username, d FROM seen))
    SELECT count(*) FILTER (EXISTS (SELECT 1 FROM mine y WHERE y.username = x.username AND y.d = x.d AND y.pw = x.pw
      AND y.slot_username < x.slot_username AND y.client_ip <> x.client_ip)) AS reused, count(*) AS total FROM mine x"""
)


def compare(where: str) -> str:
    return plain(
        f""", s AS (SELECT username, count(*) AS n FROM attempts WHERE result = 1 AND {where} GROUP BY username)
    SELECT count(*) FILTER (username IN (SELECT 'u' || user_id FROM events WHERE user_id % 10 = 0)) AS compromised, count(*) AS usernames,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS total_successes,
    round(CAST(count(*) FILTER (username IN (SELECT 'u' || user_id FROM events WHERE user_id % 10 = 0)) AS DOUBLE) / count(*), 6) AS fraction FROM s"""
    )


O["compare_with_compromised"] = compare(f"client_ip IN ({_IPS})")
O["compare_window_with_compromised"] = compare(f"{WINDOW} AND {AGENT}")
O["short_case_study"] = plain(
    f"""SELECT client_ip, count(*) AS num_attempts, {_M["num_successes"]} AS num_successes, {_M["num_password_in_breach"]} AS num_password_in_breach,
    count(DISTINCT username) AS num_unique_usernames, {TS('min("timestamp")', "first_seen")}, {TS('max("timestamp")', "last_seen")},
    {r6("CAST(max(sec) - min(sec) AS DOUBLE) / count(*)", "ave_interarrival")}, (SELECT count(*) FROM ({CONNECTING})) AS num_connecting_ips
    FROM attempts WHERE client_ip = '{c.HOT_IP}' GROUP BY client_ip"""
)
_ONE_IP = f"FROM labels WHERE client_ip = '{c.HOT_IP}'"
_FIGURES = {
    **{
        n: METRIC[n]
        for n in (
            "num_attempts", "num_successes", "num_successes_in_breach", "num_unique_usernames", "num_unique_usernames_success",
            "num_password_in_breach", "num_pair_in_breach", "num_password_in_hashcat", "null_user_agents",
        )
    },
    "first_seen": """strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S')""",
    "last_seen": """strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S')""",
    "ave_interarrival": "CAST(max(sec) - min(sec) AS DOUBLE) / count(*)",
}
_ROWS = [f"SELECT '{n}' AS figure, '' AS detail, CAST({v} AS VARCHAR) AS value {_ONE_IP}" for n, v in _FIGURES.items()]
_ROWS += [
    f"""SELECT 'common_user_agent', '', (SELECT user_agent FROM (SELECT user_agent, count(*) AS n {_ONE_IP} GROUP BY user_agent)
      ORDER BY n DESC, user_agent DESC NULLS LAST LIMIT 1)""",
    f"SELECT 'num_connecting_ips', '', CAST(count(*) AS VARCHAR) FROM ({CONNECTING})",
    *[f"SELECT '{n}', '', {n} FROM nets WHERE client_ip = '{c.HOT_IP}'" for n in enrich.NETWORK_COLUMNS],
    f"SELECT 'connecting_ip', client_ip, CAST(attempts AS VARCHAR) FROM ({CONNECTING})",
    f"SELECT 'username', username, CAST(count(*) AS VARCHAR) {_ONE_IP} GROUP BY username",
    f"SELECT 'password', CAST(d AS VARCHAR) || ' ' || slot || ' ' || username, label {_ONE_IP}",
    f"""SELECT 'last_distances', CAST(d AS VARCHAR) || ' ' || username, array_to_string(coalesce(dist_username, []), ',') FROM (
      SELECT *, row_number() OVER (PARTITION BY d, username ORDER BY "timestamp" DESC, id DESC) AS rn, count(*) OVER (PARTITION BY d, username) AS n
      {_ONE_IP}) WHERE rn = 1 AND n > 1""",
]
O["case_study"] = with_(BY_IP + ", " + NETS, " UNION ALL ".join(_ROWS))
O["investigate_username"] = plain(
    f"""SELECT username, {DAY}, count(DISTINCT pw) AS distinct_passwords, count(*) AS total_passwords,
      (SELECT count(*) FROM attempts WHERE username = '{c.USER}' AND len(ctm) > 1) AS tweak_total,
      (SELECT count(*) FROM attempts WHERE username = '{c.USER}' AND len(ctm) > 1 AND
        len(list_filter(ctm, lambda e: coalesce(e[1] <= 3, false) OR coalesce(e[2] <= 0, false) OR coalesce(e[3] <= 0, false))) > 0) AS tweak_close
    FROM attempts WHERE username = '{c.USER}' GROUP BY username, d"""
)

ORACLES = dict(O)
