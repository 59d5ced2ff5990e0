"""Queries of filters, validators and reply parsers over the lines of documents, put to forms of commands and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.functions import safety as sf
from folioforge.plans.registry import dealt, dealt_sql, inline, query, values

DDL = "id int, command string, context string"
COMMANDS = [
    (i, c, x)
    for i, (c, x) in enumerate([
        ("ls -la /home/me/data", "look at /home/me/data"), ("rm -rf /", "clean"), ("rm  -rf ./x", ""), ("ssh root@10.0.0.5 'docker ps'", "check 10.0.0.5"), ("ssh root@10.0.0.5 'reboot'", ""),
        ("ssh bad target", ""), ("ssh me@1.2.3.4", "1.2.3.4"), ("SSH me@1.2.3.4 'ls'", ""), ("df -h", "disk"), ("du -sh /var/log", "space"), ("cat /etc/passwd", ""), ("cat /opt/app/x.log | grep err", ""),
        ("chmod 777 /srv", ""), ("chmod -R 777 .", ""), ("mkfs.ext4 /dev/sda", ""), ("dd if=/dev/zero of=x", ""), (":(){ :|:& };:", ""), ("echo x >/dev/sda", ""), ("shutdown -h now", ""), ("whoami", ""),
        ("ping 8.8.8.8 and 9.9.9.9", "ping 8.8.8.8"), ("x" * 120, ""), ("git log --format=oneline", ""), ("ps aux; id", ""), ("echo $HOME", ""), ("curl http://host/a/b", "get /host/a/b"), ("", ""),
    ], 1)
]
V = dealt_sql(COMMANDS, DDL, "command")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def match(text: str, p: str) -> str:
    return f"regexp_matches({text}, {quoted(p)})"


SAFE = f"NOT {any_('lower(command)', sf.BLOCKED)} AND (NOT starts_with(lower(command), 'ssh') OR ({match('command', sf.SSH_SHAPE)} AND NOT {any_('lower(command)', sf.BLOCKED_SSH)}))"


@query("safe_exec", f"SELECT id, {SAFE} AS safe FROM {V}")
def _(t):
    return dealt(t, COMMANDS, DDL, "command").select("id", sf.safe_to_execute(F.col("command")).alias("safe"))


@query("safe_direct", f"SELECT id, NOT {any_('lower(command)', sf.BLOCKED_DIRECT)} AND ({' OR '.join(match('command', '(?i)' + p) for p in sf.ALLOWED)} OR (length(command) < 100 AND NOT {any_('command', sf.SHELL_MARKS)})) AS safe FROM {V}")
def _(t):
    return dealt(t, COMMANDS, DDL, "command").select("id", sf.safe_directly(F.col("command")).alias("safe"))


ISSUES = "list_filter([" + ", ".join(f"CASE WHEN {match('command', '(?i)' + p)} THEN {quoted(p)} END" for p in sf.DANGERS) + "], lambda x: x IS NOT NULL)"
PATHS = f"list_filter(regexp_extract_all(command, {quoted(sf.PATH)}, 1), lambda p: NOT ({' OR '.join(f'starts_with(p, {quoted(s)})' for s in sf.SYSTEM_PATHS)}) AND NOT contains(context, p))"
STRANGERS = f"list_concat({PATHS}, list_filter(regexp_extract_all(command, {quoted(sf.ADDRESS)}, 1), lambda a: NOT contains(context, a)))"


@query("val_command", f"SELECT id, len({ISSUES}) = 0 AS is_valid, array_to_string({ISSUES}, ',') AS issues, array_to_string({STRANGERS}, ',') AS warnings FROM {V}")
def _(t):
    c, x = F.col("command"), F.col("context")
    return dealt(t, COMMANDS, DDL, "command").select("id", (F.size(sf.dangers(c)) == 0).alias("is_valid"), F.array_join(sf.dangers(c), ",").alias("issues"), F.array_join(sf.strangers(c, x), ",").alias("warnings"))


RISKS = ("low", "medium", "high", "critical")
_RISK = f"{list(RISKS)}[d.doc_id % {len(RISKS)} + 1]"
_HARMFUL = " OR ".join(match("coalesce(joined, '')", p) for p in sf.DANGERS)
_SUGGESTED = f"(SELECT id // 100000 AS doc_id, id, command, context FROM {V} WHERE trim(command) <> '')"
_WHOLE = f"(SELECT doc_id, string_agg(DISTINCT context, ' ' ORDER BY context) AS context FROM {_SUGGESTED} GROUP BY doc_id)"
_SUMS = f"SELECT doc_id, sum(len({ISSUES})) AS i, sum(len({STRANGERS})) AS w, string_agg(command, ' ' ORDER BY id) AS joined FROM (SELECT doc_id, id, command, r.context FROM {_SUGGESTED} s JOIN {_WHOLE} r USING (doc_id)) GROUP BY doc_id"
_FOUND = f"SELECT d.doc_id AS request, CAST(coalesce(i, 1) AS BIGINT) AS issues, CAST(coalesce(w, 0) + CASE WHEN {_RISK} = 'critical' AND NOT ({_HARMFUL}) THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN ({_SUMS}) s ON s.doc_id = d.doc_id"


@query("val_security", f"SELECT *, issues = 0 AS is_valid, round(greatest(0.0, least(1.0, 1.0 - (issues * 0.3 + warnings * 0.1))), 6)::DOUBLE AS confidence FROM ({_FOUND})")
def _(t):
    """All commands of one request, the lines of a document; one without text suggests none."""
    rows = dealt(t, COMMANDS, DDL, "command").where(F.trim("command") != "").groupBy(F.floor(F.col("id") / 100_000).alias("doc_id"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "command"))), lambda x: x["command"]).alias("commands"), F.array_join(F.array_sort(F.collect_set("context")), " ").alias("context"))
    rows = t.documents.select("doc_id").distinct().join(rows, "doc_id", "left").withColumn("risk", F.get(F.array(*map(F.lit, RISKS)), F.pmod("doc_id", F.lit(len(RISKS))).cast("int")))
    rows = rows.withColumns({"commands": F.coalesce("commands", F.array().cast("array<string>")), "context": F.coalesce("context", F.lit(""))})
    issues, warnings = sf.suggestion_findings(F.col("commands"), F.col("context"), F.col("risk"))
    rows = rows.select(F.col("doc_id").alias("request"), F.size(issues).cast("long").alias("issues"), F.size(warnings).cast("long").alias("warnings"))
    return rows.withColumns({"is_valid": F.col("issues") == 0, "confidence": sf.clamped(1.0, F.col("issues"), F.col("warnings"))})


SSH = r"""^ssh\s+(\w+@[\d\.]+)\s*["']?([^"']*)["']?"""


def sql_fix(c: str) -> str:
    remote = f"trim(regexp_extract({c}, {quoted(SSH)}, 2))"
    return f"CASE WHEN {match(c, SSH)} AND {remote} <> '' THEN 'ssh ' || regexp_extract({c}, {quoted(SSH)}, 1) || ' ''' || {remote} || '''' ELSE {c} END"


@query("fix_ssh", f"SELECT id, {sql_fix('command')} AS fixed FROM {V}")
def _(t):
    return dealt(t, COMMANDS, DDL, "command").select("id", sf.fix_ssh(F.col("command")).alias("fixed"))


RAW_DDL = "id int, raw string"
RAW = list(enumerate(["1. `df -h`", "- ls -la", "* ssh me@1.2.3.4 \"uptime\"", "• 'ps aux'", "  2. echo hi", "cat  /x   y", "12. Review the command outputs", "ok", "- \"Determine the next actions\"", "`find . -name x`)", "", "ssh me@1.2.3.4 df -h", "3.  sudo   ls"], 1))
RV = dealt_sql(RAW, RAW_DDL, "raw")
STRIPPED = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
UNMARKED = f"regexp_replace(regexp_replace({STRIPPED}, '^\\d+\\.\\s*', ''), '^[-*•]\\s*', '')"
FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
EDGE = quoted(r"""^['"`)]+|['"`)]+$""")


@query("clean_command", f"SELECT id, CASE WHEN length(d) >= 3 AND ({' OR '.join(f'starts_with(lower(d), {quoted(s)})' for s in sf.STARTS)}) THEN d ELSE '' END AS command FROM (SELECT id, CASE WHEN starts_with(lower(c), 'ssh') THEN {sql_fix('c')} ELSE regexp_replace(c, {EDGE}, '', 'g') END AS d FROM (SELECT id, {FLAT.format(f'''regexp_replace({UNMARKED}, '`([^`]+)`', '{chr(92)}1', 'g')''')} AS c FROM {RV}))")
def _(t):
    return dealt(t, RAW, RAW_DDL, "raw").select("id", sf.clean_command(F.col("raw")).alias("command"))


@query("clean_step", f"SELECT id, CASE WHEN length(c) > 10 THEN c ELSE '' END AS step FROM (SELECT id, {FLAT.format(f'regexp_replace({UNMARKED}, {EDGE}, {quoted('')}, {quoted('g')})')} AS c FROM {RV})")
def _(t):
    return dealt(t, RAW, RAW_DDL, "raw").select("id", sf.clean_step(F.col("raw")).alias("step"))


REQ_DDL = "id int, request string"
REQUESTS = list(enumerate(["check disk space", "read the log via ssh root@10.1.1.1", "ssh somewhere", "hello", "disk log ssh a@1.1.1.1", "summarize the report", "analyze file x.txt deep", "give a quick overview", "execute and build", "please find the backup", ""], 1))
QV = dealt_sql(REQUESTS, REQ_DDL, "request")
TARGET = "regexp_extract(request, '(\\w+@[\\d\\.]+)', 1)"


@query("fallback_commands", f"SELECT id, array_to_string(CASE WHEN len(l) > 0 THEN l ELSE ['whoami', 'pwd', 'ls -la'] END, ' ; ') AS commands FROM (SELECT id, list_concat(list_concat(CASE WHEN contains(lower(request), 'disk') OR contains(lower(request), 'space') THEN ['df -h', 'du -sh /var /tmp /home'] ELSE []::VARCHAR[] END, CASE WHEN contains(lower(request), 'ssh') AND {TARGET} <> '' THEN ['ssh ' || {TARGET} || ' \"whoami\"', 'ssh ' || {TARGET} || ' \"df -h\"'] ELSE []::VARCHAR[] END), CASE WHEN contains(lower(request), 'log') THEN ['ls -la /var/log', 'du -sh /var/log/*'] ELSE []::VARCHAR[] END) AS l FROM {QV})")
def _(t):
    return dealt(t, REQUESTS, REQ_DDL, "request").select("id", F.array_join(sf.fallback_commands(F.col("request")), " ; ").alias("commands"))


MOCK = ("summarize", "summary", "analyze file", "analyze document")


@query("wf_mock_triage", f"SELECT id, CASE WHEN {any_('lower(request)', MOCK)} THEN 'summarization' ELSE 'sysadmin' END AS category, 0.95::DOUBLE AS confidence, {any_('lower(request)', MOCK)} AS is_terminal FROM {QV}")
def _(t):
    hit = sf.any_of(F.lower("request"), MOCK)
    return dealt(t, REQUESTS, REQ_DDL, "request").select("id", F.when(hit, "summarization").otherwise("sysadmin").alias("category"), F.lit(0.95).alias("confidence"), hit.alias("is_terminal"))


@query("depth_from_request", f"SELECT id, CASE WHEN contains(lower(request), 'quick') OR contains(lower(request), 'overview') THEN 'quick' WHEN contains(lower(request), 'deep') OR contains(lower(request), 'detailed') THEN 'deep' ELSE 'standard' END AS depth FROM {QV}")
def _(t):
    low = F.lower("request")
    return dealt(t, REQUESTS, REQ_DDL, "request").select("id", F.when(sf.any_of(low, ("quick", "overview")), "quick").when(sf.any_of(low, ("deep", "detailed")), "deep").otherwise("standard").alias("depth"))


TRIAGE_DDL = "turn int, category string, confidence double"
TRIAGE = [(k, c, p) for k, (c, p) in enumerate((c, p) for c in sf.CATEGORIES for p in (0.1, 0.5, 0.69, 0.75))]
TV = values(TRIAGE, TRIAGE_DDL)
_untypical = " OR ".join(f"(category = '{c}' AND NOT {any_('lower(request)', w)})" for c, w in sf.TYPICAL.items())
_terminal = "category IN ('summarization', 'coding', 'knowledge_query')"


@query("val_triage", f"SELECT id, category, confidence, array_to_string(list_filter([CASE WHEN {_terminal} AND {any_('lower(request)', ('execute', 'run command'))} THEN 'executes' END, CASE WHEN confidence < 0.3 THEN 'unsure' END, CASE WHEN ({_untypical}) AND confidence > 0.7 THEN 'untypical' END, CASE WHEN {_terminal} AND confidence < 0.7 THEN 'terminal_unsure' END], lambda x: x IS NOT NULL), ',') AS warnings FROM {QV} q JOIN {TV} t ON t.turn = q.id % {len(TRIAGE)}")
def _(t):
    rows = dealt(t, REQUESTS, REQ_DDL, "request").withColumn("turn", (F.col("id") % len(TRIAGE)).cast("int"))
    grid = rows.join(F.broadcast(inline(t, TRIAGE, TRIAGE_DDL)), "turn")
    return grid.select("id", "category", "confidence", F.array_join(sf.triage_warnings(F.col("category"), F.col("confidence"), F.col("request")), ",").alias("warnings"))


REPLY_DDL = "id int, reply string"
REPLIES = list(enumerate([
    "CATEGORY: sysadmin\nDIFFICULTY: Simple\nCONFIDENCE: 0.9\nREASONING: because\nof this\nCLARIFICATION: yes",
    "category: Coding\nconfidence: 1.7\nreasoning: short",
    "CATEGORY: nonsense\nDIFFICULTY: huge\nCONFIDENCE: 1.2.3\nCLARIFICATION: true",
    "no fields at all",
    "CATEGORY: network CONFIDENCE: 0.3 CLARIFICATION: 1",
    "CONFIDENCE: .\nCATEGORY: security\nREASONING: multi\nline\ntext",
    "• first insight is long enough\n- tiny\n12. twelfth insight in the list\n* starred key point here\nplain line",
    "",
], 1))
PV = dealt_sql(REPLIES, REPLY_DDL, "reply")


def sql_field(name: str, body: str) -> str:
    p = quoted(f"(?i){name}:\\s*{body}")
    return f"CASE WHEN regexp_matches(reply, {p}) THEN regexp_extract(reply, {p}, 1) END"


_cat = f"(CASE WHEN lower({sql_field('CATEGORY', r'(\w+)')}) IN ({', '.join(map(quoted, sf.CATEGORIES))}) THEN lower({sql_field('CATEGORY', r'(\w+)')}) ELSE 'unknown' END)"
_dif = f"(CASE WHEN lower({sql_field('DIFFICULTY', r'(\w+)')}) IN ('simple', 'moderate', 'complex') THEN lower({sql_field('DIFFICULTY', r'(\w+)')}) ELSE 'moderate' END)"
_con = f"coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, try_cast({sql_field('CONFIDENCE', r'([\d.]+)')} AS DOUBLE))), 0.5::DOUBLE)"
_con = f"(CASE WHEN try_cast({sql_field('CONFIDENCE', r'([\d.]+)')} AS DOUBLE) IS NULL THEN 0.5::DOUBLE ELSE {_con} END)"
_why = "(CASE WHEN regexp_matches(reply, '(?is)REASONING:\\s*(.+)') THEN regexp_replace(regexp_replace(regexp_extract(reply, '(?is)REASONING:\\s*(.+)', 1), '(?is)\\nCLARIFICATION:.*$', ''), '^\\s+|\\s+$', '', 'g') ELSE 'Analysis completed' END)"
_ask = f"coalesce(lower({sql_field('CLARIFICATION', r'(\w+)')}) IN ('yes', 'true', '1'), false)"


@query("parse_triage", f"SELECT id, {_cat} AS category, {_dif} AS difficulty, {_con} AS confidence, {_why} AS reasoning, {_ask} AND NOT ({_con} >= 0.5 AND {_cat} <> 'unknown') AS needs_clarification FROM {PV}")
def _(t):
    return dealt(t, REPLIES, REPLY_DDL, "reply").select("id", *(c.alias(k) for k, c in sf.triage_fields(F.col("reply")).items()))


def bullet_lines(reply, numbered: bool):
    lines = F.transform(F.split(reply, "\n"), sf.strip)
    kept = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^([•*-]|(1?[1-9]|10)\.)" if numbered else "^[•*-]")))
    cleaned = F.transform(kept, lambda x: F.regexp_replace(x, r"^[•\-*0123456789. ]+" if numbered else r"^[•\-* ]+", ""))
    return F.filter(cleaned, lambda x: F.length(x) > 10) if numbered else cleaned


_lines = "list_transform(string_split(reply, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"


@query("parse_insights", f"SELECT id, array_to_string(list_filter(list_transform(list_filter({_lines}, lambda x: regexp_matches(x, '^([•*-]|(1?[1-9]|10)\\.)')), lambda x: regexp_replace(x, '^[•\\-*0123456789. ]+', '')), lambda x: length(x) > 10), '|') AS insights FROM {PV}")
def _(t):
    return dealt(t, REPLIES, REPLY_DDL, "reply").select("id", F.array_join(bullet_lines(F.col("reply"), True), "|").alias("insights"))


@query("parse_key_points", f"SELECT id, array_to_string(list_transform(list_filter({_lines}, lambda x: regexp_matches(x, '^[•*-]')), lambda x: regexp_replace(x, '^[•\\-* ]+', '')), '|') AS points FROM {PV}")
def _(t):
    return dealt(t, REPLIES, REPLY_DDL, "reply").select("id", F.array_join(bullet_lines(F.col("reply"), False), "|").alias("points"))


ROUTE_DDL = "category string, stage string"
ROUTE_GRID = [(c, s) for c in sf.CATEGORIES for s in ("completion", "qa", "security", "execution", "executor")]
GV = dealt_sql(ROUTE_GRID, ROUTE_DDL)
_odd = " OR ".join(f"(category = '{c}' AND stage NOT IN ({', '.join(map(quoted, s))}))" for c, s in sf.ROUTES.items())


@query("val_routing", f"SELECT category, stage, NOT ({_terminal} AND stage IN ('security', 'executor', 'execution')) AS is_valid, ({_odd}) AS unusual FROM {GV}")
def _(t):
    c, s = F.col("category"), F.col("stage")
    odd = F.lit(False)
    for k, stages in sf.ROUTES.items():
        odd = odd | ((c == k) & ~s.isin(*stages))
    return dealt(t, ROUTE_GRID, ROUTE_DDL).select("category", "stage", (~(c.isin(*sf.TERMINAL) & s.isin(*sf.EXECUTION_STAGES))).alias("is_valid"), odd.alias("unusual"))


# Each session is expected to run in five cycles; blocked commands don't run, and those that
# time out leave no result. A purchase completes a session, and its output is the reason.
_RAN = f"(SELECT session_id, cycle, count(*) FILTER (status <> 'blocked') AS executed, count(*) FILTER (status IN ('success', 'failed')) AS results, coalesce(bool_or(command = 'purchase'), false) AS complete, count(*) FILTER (command = 'purchase' AND status = 'success' AND coalesce(output, '') <> '') AS reasons, count(*) FILTER (status = 'success' AND coalesce(output, '') = '') AS silent FROM {fx.EXECUTIONS} GROUP BY ALL)"
_CHECKED = f"(SELECT g.session_id, g.cycle, coalesce(executed, 0) AS executed, CASE WHEN coalesce(executed, 0) = 0 THEN 1 ELSE 0 END AS issues, CAST(coalesce(executed, 0) > 0 AND coalesce(results, 0) = 0 AS INTEGER) + CAST(coalesce(complete, false) AND coalesce(reasons, 0) = 0 AS INTEGER) + coalesce(silent, 0) AS warnings FROM (SELECT DISTINCT session_id, unnest(range(1, 6)) AS cycle FROM {fx.EXECUTIONS}) g LEFT JOIN {_RAN} r ON r.session_id IS NOT DISTINCT FROM g.session_id AND r.cycle = g.cycle)"


@query("val_execution", f"SELECT session_id, CAST(cycle AS INTEGER) AS cycle, executed, CAST(issues AS INTEGER) AS issues, CAST(warnings AS BIGINT) AS warnings, issues = 0 AS is_valid, round(greatest(0.0, least(1.0, 0.9 - 0.3 * issues - 0.1 * warnings)), 6)::DOUBLE AS confidence FROM {_CHECKED}")
def _(t):
    """The four checks of what each expected cycle ran: commands, results, the reason of a
    completion, and the outputs of successes."""
    rows, status, output = fx.executions(t), F.col("status"), F.coalesce("output", F.lit(""))
    done = F.col("command") == "purchase"
    ran = rows.groupBy("session_id", "cycle").agg(
        F.count_if(status != "blocked").alias("executed"), F.count_if(status.isin("success", "failed")).alias("results"), F.bool_or(done).alias("complete"),
        F.count_if(done & (status == "success") & (output != "")).alias("reasons"), F.count_if((status == "success") & (output == "")).alias("silent"),
    )
    grid = rows.select(F.col("session_id").alias("s")).distinct().select("s", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("c"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = grid.join(ran, F.col("s").eqNullSafe(F.col("session_id")) & (F.col("c") == F.col("cycle")), "left")
    issues = (n("executed") == 0).cast("int")
    warnings = ((n("executed") > 0) & (n("results") == 0)).cast("long") + (F.coalesce("complete", F.lit(False)) & (n("reasons") == 0)).cast("long") + n("silent")
    checked = both.select(F.col("s").alias("session_id"), F.col("c").alias("cycle"), n("executed").alias("executed"), issues.alias("issues"), warnings.alias("warnings"))
    return checked.select("*", (F.col("issues") == 0).alias("is_valid"), sf.clamped(0.9, F.col("issues"), F.col("warnings")).alias("confidence"))


_long = r"list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w)), lambda w: length(w) > 5))"


@query("val_summary", f"SELECT doc_id, s = '' AS empty, length(s) > length(text) AS longer, len(a) > 0 AND len(list_intersect(a, b)) * 10 < len(a) AS strange FROM (SELECT doc_id, text, s, {_long.format('text')} AS a, {_long.format('s')} AS b FROM (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 497) || '...' END AS s FROM documents))")
def _(t):
    long = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1), F.lower), lambda w: F.length(w) > 5))
    c = F.col("text")
    s = F.when(F.length(c) <= 500, c).otherwise(F.concat(F.substring(c, 1, 497), F.lit("...")))
    rows = t.documents.select("doc_id", "text", s.alias("s")).select("*", long(c).alias("a"), long(F.col("s")).alias("b"))
    return rows.select("doc_id", (F.col("s") == "").alias("empty"), (F.length("s") > F.length("text")).alias("longer"), ((F.size("a") > 0) & (F.size(F.array_intersect("a", "b")) * 10 < F.size("a"))).alias("strange"))


@query("verify_files", f"SELECT count(*) AS files_checked, CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) AS BIGINT) AS safe_files, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS suspicious_files, sum(CASE WHEN bad THEN 1 ELSE 0 END) = 0 AS passed FROM (SELECT {any_('lower(content)', sf.SUSPICIOUS)} AS bad FROM {fx.FILES})")
def _(t):
    bad = sf.any_of(F.lower("content"), sf.SUSPICIOUS)
    return fx.files(t).select(bad.alias("bad")).agg(F.count("*").alias("files_checked"), F.count_if(~F.col("bad")).alias("safe_files"), F.count_if("bad").alias("suspicious_files"), (F.count_if("bad") == 0).alias("passed"))
