"""Safety filters, validators and command clean-up as column expressions.

Commands are classified as text; nothing is ever run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.analysis import any_of
from folioforge.functions.text import flat, strip

# What the filters block, allow and expect.
BLOCKED = ("rm -rf /", "dd if=", "mkfs", "format", "shutdown -h", "reboot", "> /dev/sd", "chmod 777 /", "passwd", "userdel", "deluser")
BLOCKED_SSH = ("rm -rf", "dd if=", "mkfs", "format", "shutdown", "reboot", "passwd", "userdel")
BLOCKED_DIRECT = ("rm -rf /", "dd if=", "mkfs", "format", "shutdown", "reboot", "passwd", "userdel", "deluser")
SSH_SHAPE = r"^ssh\s+\w+@[\d\.]+(?:\s+['\"][^'\"]*['\"])?$"
ALLOWED = (
    r"^ssh\s+\w+@[\d\.]+\s+'docker ps",
    r"^ssh\s+\w+@[\d\.]+\s+'docker start \w+",
    r"^ssh\s+\w+@[\d\.]+\s+'docker stop \w+",
    r"^ssh\s+\w+@[\d\.]+\s+'docker restart \w+",
    r"^ssh\s+\w+@[\d\.]+\s+'docker logs \w+",
    r"^ssh\s+\w+@[\d\.]+\s+'df -h",
    r"^ssh\s+\w+@[\d\.]+\s+'du -sh",
    r"^ssh\s+\w+@[\d\.]+\s+'ls -",
    r"^ssh\s+\w+@[\d\.]+\s+'ps aux",
    r"^df\s+-h",
    r"^du\s+-sh",
    r"^ls\s+-",
    r"^ps\s+aux",
    "^whoami",
    "^pwd",
)
SHELL_MARKS = ("&", "|", ";", "`", "$")
DANGERS = (r"rm\s+-rf", r"dd\s+if=", "mkfs", r":\(\)\{", ">/dev/sd", r"chmod\s+777", r"chmod\s+-R\s+777")
SYSTEM_PATHS = ("/usr/", "/bin/", "/etc/", "/var/", "/tmp/")
PATH, ADDRESS = r"(/[a-zA-Z0-9_/.-]+)", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
STARTS = ("ssh", "ls", "df", "du", "ps", "cat", "grep", "find", "whoami", "pwd", "sudo")
SUSPICIOUS = ("rm -rf", "os.system(", "eval(", "exec(", "subprocess.call")
TERMINAL = ("summarization", "coding", "knowledge_query")
EXECUTION_STAGES = ("security", "executor", "execution")
TYPICAL = {
    "sysadmin": ("check", "status", "disk", "memory", "process", "docker"),
    "fileops": ("find", "search", "backup", "copy", "move"),
    "network": ("ping", "download", "curl", "wget", "api"),
    "summarization": ("summarize", "analyze file", "overview of", "extract from"),
    "coding": ("build", "create module", "generate code", "implement"),
}
ROUTES = {c: ("completion", "qa") for c in TERMINAL} | {c: ("security", "execution") for c in ("sysadmin", "fileops", "network", "development", "security")}


def safe_to_execute(c: Column) -> Column:
    low = F.lower(c)
    ssh = F.rlike(c, F.lit(SSH_SHAPE)) & ~any_of(low, BLOCKED_SSH)
    return ~any_of(low, BLOCKED) & (~F.startswith(low, F.lit("ssh")) | ssh)


def safe_directly(c: Column) -> Column:
    allowed = reduce(lambda a, b: a | b, (F.rlike(c, F.lit("(?i)" + p)) for p in ALLOWED))
    return ~any_of(F.lower(c), BLOCKED_DIRECT) & (allowed | ((F.length(c) < 100) & ~any_of(c, SHELL_MARKS)))


def dangers(c: Column) -> Column:
    hits = F.array(*(F.when(F.rlike(c, F.lit("(?i)" + p)), F.lit(p)) for p in DANGERS))
    return F.filter(hits, lambda x: x.isNotNull())


def strangers(c: Column, context: Column) -> Column:
    """Paths outside the system folders and addresses of a command that its context doesn't name."""
    paths = F.filter(F.regexp_extract_all(c, F.lit(PATH), 1), lambda p: ~reduce(lambda a, b: a | b, (F.startswith(p, F.lit(s)) for s in SYSTEM_PATHS)) & ~F.contains(context, p))
    return F.concat(paths, F.filter(F.regexp_extract_all(c, F.lit(ADDRESS), 1), lambda a: ~F.contains(context, a)))


def suggestion_findings(commands: Column, request: Column, risk: Column) -> tuple[Column, Column]:
    """Issues and warnings of the commands suggested for a request: none at all, what each
    holds, and a risk called critical though the commands together hold no danger."""
    none = F.array().cast("array<string>")
    some = lambda test, what: F.when(test, F.array(F.lit(what))).otherwise(none)
    danger = reduce(lambda a, b: a | b, (F.rlike(F.array_join(commands, " "), F.lit(p)) for p in DANGERS))
    issues = F.concat(some(F.size(commands) == 0, "no commands"), F.flatten(F.transform(commands, dangers)))
    warnings = F.concat(F.flatten(F.transform(commands, lambda c: strangers(c, request))), some((risk == "critical") & ~danger, "critical but harmless"))
    return issues, warnings


def clamped(base: float, issues: Column, warnings: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - (issues * 0.3 + warnings * 0.1))), 6)


def fix_ssh(c: Column) -> Column:
    shape = r"""^ssh\s+(\w+@[\d\.]+)\s*["']?([^"']*)["']?"""
    remote = F.trim(F.regexp_extract(c, shape, 2))
    fixed = F.concat(F.lit("ssh "), F.regexp_extract(c, shape, 1), F.lit(" '"), remote, F.lit("'"))
    return F.when(F.rlike(c, F.lit(shape)) & (remote != ""), fixed).otherwise(c)


def unmarked(c: Column) -> Column:
    """Without numbering and list marks."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^\d+\.\s*", ""), r"^[-*•]\s*", "")


def clean_command(c: Column) -> Column:
    c = flat(F.regexp_replace(unmarked(c), "`([^`]+)`", "$1"))
    c = F.when(F.startswith(F.lower(c), F.lit("ssh")), fix_ssh(c)).otherwise(F.regexp_replace(c, r"""^['"`)]+|['"`)]+$""", ""))
    known = reduce(lambda a, b: a | b, (F.startswith(F.lower(c), F.lit(s)) for s in STARTS))
    return F.when((F.length(c) >= 3) & known, c).otherwise("")


def clean_step(c: Column) -> Column:
    c = flat(F.regexp_replace(unmarked(c), r"""^['"`)]+|['"`)]+$""", ""))
    return F.when(F.length(c) > 10, c).otherwise("")


def fallback_commands(request: Column) -> Column:
    low, target = F.lower(request), F.regexp_extract(request, r"(\w+@[\d\.]+)", 1)
    none = F.array().cast("array<string>")
    some = lambda test, *commands: F.when(test, F.array(*(c if isinstance(c, Column) else F.lit(c) for c in commands))).otherwise(none)
    ssh = lambda c: F.concat(F.lit("ssh "), target, F.lit(f' "{c}"'))
    found = F.concat(some(any_of(low, ("disk", "space")), "df -h", "du -sh /var /tmp /home"), some(F.contains(low, F.lit("ssh")) & (target != ""), ssh("whoami"), ssh("df -h")), some(F.contains(low, F.lit("log")), "ls -la /var/log", "du -sh /var/log/*"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("whoami"), F.lit("pwd"), F.lit("ls -la")))


def triage_warnings(category: Column, confidence: Column, request: Column) -> Column:
    low, terminal = F.lower(request), category.isin(*TERMINAL)
    untypical = reduce(lambda a, b: a | b, ((category == c) & ~any_of(low, w) for c, w in TYPICAL.items()))
    tests = {"executes": terminal & any_of(low, ("execute", "run command")), "unsure": confidence < 0.3, "untypical": untypical & (confidence > 0.7), "terminal_unsure": terminal & (confidence < 0.7)}
    return F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in tests.items())), lambda x: x.isNotNull())


CATEGORIES = ("sysadmin", "fileops", "network", "security", "coding", "summarization", "knowledge_query", "development", "content", "unknown")
DIFFICULTIES = ("simple", "moderate", "complex")


def triage_fields(reply: Column) -> dict[str, Column]:
    """category, difficulty, confidence, reasoning and clarification of a model's reply."""
    field = lambda name, body: F.when(F.rlike(reply, F.lit(f"(?i){name}:\\s*{body}")), F.regexp_extract(reply, f"(?i){name}:\\s*{body}", 1))
    category = F.lower(field("CATEGORY", r"(\w+)"))
    category = F.when(category.isin(*CATEGORIES), category).otherwise("unknown")
    difficulty = F.lower(field("DIFFICULTY", r"(\w+)"))
    number = field("CONFIDENCE", r"([\d.]+)").try_cast("double")
    confidence = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.5)
    shape = r"(?is)REASONING:\s*(.+?)(?=\nCLARIFICATION:|$)"
    reasoning = F.when(F.rlike(reply, F.lit(shape)), strip(F.regexp_extract(reply, shape, 1))).otherwise("Analysis completed")
    asks = F.coalesce(F.lower(field("CLARIFICATION", r"(\w+)")).isin("yes", "true", "1"), F.lit(False))
    return {"category": category, "difficulty": F.when(difficulty.isin(*DIFFICULTIES), difficulty).otherwise("moderate"), "confidence": confidence, "reasoning": reasoning, "needs_clarification": asks & ~((confidence >= 0.5) & (category != "unknown"))}
