"""Queries of reply and request parsers over literal texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import replies as rp
from folioforge.plans.registry import dealt, dealt_sql, query
from folioforge.plans.safety import RAW, RAW_DDL, RV, STRIPPED, UNMARKED, quoted, sql_fix

DDL = "id int, reply string"
REPLIES = list(enumerate([
    "COMMANDS:\n1. df -h\n- ssh me@1.2.3.4 \"uptime\"\necho no\nREASONING: look first\nAPPROACH: slow\nNEXT_STEPS:\n1. Review the outputs again\n2. ok\nCONFIDENCE: 0.7",
    "reasoning: only this\napproach: that way",
    "Try ssh root@10.0.0.1 \"df -h\" now",
    "UNDERSTANDING: a task\nPLAN: do it\nCOMMANDS:\n1. `ls -la`\n- 'docker ps'\nbad one\nREASONING: logic\nEXPECTED: files\nand more",
    "PLAN: only plan",
    "ANALYSIS: fine\nINSIGHTS: disk full\nNEXT_STEPS: clean up\nCOMPLETION: complete",
    "analysis: lower\ncompletion: done",
    "The text says much.\nMore of it.\nKey Insights:\n- first one\n* second one\nplain\n• third",
    "Key points:\n- only",
    "no heading here\n- bullet",
    "core/ # core\nsafety/sub/   # more\ncore/ # again",
    "",
], 1))
V = dealt_sql(REPLIES, DDL, "reply")


def sql_section(name: str, following: str | None, default: str) -> str:
    got = f"regexp_extract(reply, '(?is){name}:\\s*(.+)', 1)"
    cut = f"regexp_replace({got}, '(?is)\\n{following}:.*$', '')" if following else got
    return f"(CASE WHEN regexp_matches(reply, '(?is){name}:\\s*(.+)') THEN regexp_replace({cut}, '^\\s+|\\s+$', '', 'g') ELSE '{default}' END)"


@query("parse_analysis", f"SELECT id, {sql_section('ANALYSIS', 'INSIGHTS', 'Results processed')} AS analysis, {sql_section('INSIGHTS', 'NEXT_STEPS', 'Information gathered')} AS insights, {sql_section('NEXT_STEPS', 'COMPLETION', 'Continue investigation')} AS next_steps, {sql_section('COMPLETION', None, 'in_progress')} AS completion FROM {V}")
def _(t):
    return dealt(t, REPLIES, DDL, "reply").select("id", *(c.alias(k) for k, c in rp.analysis_fields(F.col("reply")).items()))


@query("parse_plan", f"SELECT id, {sql_section('UNDERSTANDING', 'PLAN', 'Task analysis')} AS understanding, {sql_section('PLAN', 'COMMANDS', 'Execute commands to gather information')} AS plan, {sql_section('REASONING', 'EXPECTED', 'Logical command sequence')} AS reasoning, {sql_section('EXPECTED', None, 'Information gathering')} AS expected, CASE form WHEN 4 THEN 'ls -la|docker ps' ELSE '' END AS commands FROM (SELECT * FROM {V} WHERE form <> 1)")
def _(t):
    fields = rp.plan_fields(F.col("reply"))
    fields["commands"] = F.array_join(fields["commands"], "|")
    return dealt(t, REPLIES, DDL, "reply").where("form <> 1").select("id", *(c.alias(k) for k, c in fields.items()))


@query("parse_security")
def _(t):
    fields = rp.security_fields(F.col("reply"))
    return dealt(t, REPLIES, DDL, "reply").select("id", *((F.array_join(c, "|") if k in ("commands", "next_steps") else c).alias(k) for k, c in fields.items()))


_plan = f"regexp_replace({UNMARKED}, '\\s+', ' ', 'g')"
_q = quoted(r"""["']([^"']+)["']""")
_picked = f"CASE WHEN regexp_matches({UNMARKED}, {_q}) THEN regexp_extract({UNMARKED}, {_q}, 1) ELSE {UNMARKED} END"
_tick = quoted("`([^`]+)`")


@query("clean_plan_command", f"SELECT id, CASE WHEN length(c) >= 3 AND ({' OR '.join(f'starts_with(lower(c), {quoted(s)})' for s in rp.PLAN_STARTS)}) THEN c ELSE '' END AS command FROM (SELECT id, trim(regexp_replace(CASE WHEN regexp_matches(p, {_tick}) THEN regexp_extract(p, {_tick}, 1) ELSE p END, '\\s+', ' ', 'g')) AS c FROM (SELECT id, {_picked} AS p FROM {RV}))")
def _(t):
    return dealt(t, RAW, RAW_DDL, "raw").select("id", rp.clean_plan_command(F.col("raw")).alias("command"))


_edges = quoted("^`+|`+$")
_wrapped = quoted("""(?s)^(".*"|'.*')$""")


@query("final_command_cleanup", f"SELECT id, CASE WHEN starts_with(lower(c), 'ssh') THEN {sql_fix('c')} ELSE trim(regexp_replace(regexp_replace(CASE WHEN regexp_matches(c, {_wrapped}) THEN substr(c, 2, length(c) - 2) ELSE c END, {_edges}, '', 'g'), '\\s+', ' ', 'g')) END AS command FROM (SELECT id, {STRIPPED} AS c FROM {RV})")
def _(t):
    return dealt(t, RAW, RAW_DDL, "raw").select("id", rp.final_command(F.col("raw")).alias("command"))


_rows = "string_split(reply, chr(10))"
_first = f"coalesce(list_position(list_transform({_rows}, lambda x: regexp_matches(lower(x), 'key insights:|key points:')), true), 0)"
_bul = f"list_transform(list_filter(list_transform(({_rows})[{_first} + 1:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: regexp_matches(x, '^[•*-]')), lambda x: regexp_replace(x, '^[•\\-* ]+', ''))"


@query("parse_summary_response", f"SELECT id, CASE WHEN {_first} > 1 THEN regexp_replace(array_to_string(({_rows})[:{_first} - 1], chr(10)), '^\\s+|\\s+$', '', 'g') ELSE reply END AS summary, CASE WHEN {_first} > 0 AND len({_bul}) > 0 THEN array_to_string({_bul}, '|') ELSE 'Summary analysis complete' END AS insights FROM {V}")
def _(t):
    text, bullets = rp.summary_parts(F.col("reply"))
    return dealt(t, REPLIES, DDL, "reply").select("id", text.alias("summary"), F.array_join(bullets, "|").alias("insights"))


_dirs = r"list_transform(regexp_extract_all(reply, '\s*([a-zA-Z_][a-zA-Z0-9_/]*/)\s*#', 1), lambda x: regexp_replace(x, '/+$', ''))"


@query("parse_dirs", f"SELECT id, CASE WHEN len({_dirs}) > 0 THEN array_to_string(list_sort(list_distinct({_dirs})), ',') ELSE '{','.join(sorted(rp.DEFAULT_DIRS))}' END AS dirs FROM {V}")
def _(t):
    return dealt(t, REPLIES, DDL, "reply").select("id", F.array_join(F.array_sort(rp.directories(F.col("reply"))), ",").alias("dirs"))


REQ_DDL = "id int, request string"
REQUESTS = list(enumerate(["summarize /data/a.txt please", "see ~/notes.md", "look at ./b.md and ../c.txt", "file: report.txt now", 'the "my file.md" one', "'x y.txt' it is", "no path", "build from /spec/app.txt use /out/dir/ as the project", "directory /only/here/ for it", "in spec.txt do"], 1))
QV = dealt_sql(REQUESTS, REQ_DDL, "request")


def sql_first(patterns, column="request") -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({column}, {quoted(p)}) THEN regexp_extract({column}, {quoted(p)}, 1) END" for p in patterns) + ")"


@query("extract_summary_path", f"SELECT id, {sql_first(rp.PATHS)} AS path FROM {QV}")
def _(t):
    return dealt(t, REQUESTS, REQ_DDL, "request").select("id", rp.summary_path(F.col("request")).alias("path"))


SPEC = (r"(/[^\s]+\.txt)", r"in\s+([^\s]+\.txt)", r"from\s+([^\s]+\.txt)")
BASE = (r"use\s+([^\s]+)/\s+as.*project", r"directory\s+([^\s]+)/")


@query("extract_spec_paths", f"SELECT id, spec, coalesce({sql_first(BASE)}, CASE WHEN spec LIKE '%/%' THEN regexp_extract(spec, '^(.*)/[^/]*$', 1) END, '.') AS base FROM (SELECT id, request, {sql_first(SPEC)} AS spec FROM {QV})")
def _(t):
    first = lambda c, ps: F.coalesce(*(F.when(F.rlike(c, F.lit(p)), F.regexp_extract(c, p, 1)) for p in ps))
    rows = dealt(t, REQUESTS, REQ_DDL, "request").withColumn("spec", first(F.col("request"), SPEC))
    parent = F.when(F.contains("spec", F.lit("/")), F.regexp_extract("spec", "^(.*)/[^/]*$", 1))
    return rows.select("id", "spec", F.coalesce(first(F.col("request"), BASE), parent, F.lit(".")).alias("base"))


FILE_DDL = "path string"
FILES = [("{}/" + p,) for p in ("core/__init__.py", "core/base_agent.py", "safety/check.py", "tests/test_x.py", "config/settings.yaml", "run.sh", "analysis/pattern_learner.py", "a/workflow_engine.py", "collaboration/message_bus.py", "x.toml", "plain.py")]
FV = dealt_sql(FILES, FILE_DDL, "path", "id")
_stem = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^./]+$', '\1')"
_ext = r"regexp_extract(path, '(\.[^./]+)$', 1)"


@query("code_file_type", f"SELECT path, CASE WHEN path LIKE '%/__init__.py' THEN 'init_file' WHEN {_ext} = '.py' AND regexp_matches(lower({_stem}), 'agent|manager|engine|validator') THEN 'python_class' WHEN {_ext} = '.py' AND starts_with({_stem}, 'test_') THEN 'test_file' WHEN {_ext} = '.py' THEN 'python_module' WHEN {_ext} IN ('.yaml', '.yml', '.json', '.toml') THEN 'config_file' ELSE 'python_script' END AS kind FROM {FV}")
def _(t):
    return dealt(t, FILES, FILE_DDL, "path", "id").select("path", rp.file_kind(F.col("path")).alias("kind"))


_parts = "string_split(path, '/')"


@query("code_purpose", f"SELECT path, CASE {' '.join(f'WHEN {_stem} = {quoted(k)} THEN {quoted(v)}' for k, v in rp.PURPOSES.items())} {' '.join(f'WHEN list_contains({_parts}, {quoted(d)}) THEN {quoted(p)} || {_stem}' for d, p in rp.COMPONENTS)} ELSE 'System component for ' || {_stem} END AS purpose FROM {FV}")
def _(t):
    return dealt(t, FILES, FILE_DDL, "path", "id").select("path", rp.purpose(F.col("path")).alias("purpose"))


@query("code_class_name", f"SELECT path, array_to_string(list_transform(string_split({_stem}, '_'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') AS name FROM {FV}")
def _(t):
    return dealt(t, FILES, FILE_DDL, "path", "id").select("path", rp.class_name(rp.stem(F.col("path"))).alias("name"))
