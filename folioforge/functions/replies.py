"""Parsers of model replies and requests, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import safety
from folioforge.functions.analysis import any_of
from folioforge.functions.text import flat, let, strip

# Labels, defaults and name tables of the reply formats.
PLAN_STARTS = ("ssh", "ls", "df", "du", "ps", "cat", "grep", "find", "whoami", "pwd", "sudo", "curl", "wget", "docker")
PATHS = (r"(/[^\s]+\.(?:txt|md|markdown))", r"(~/[^\s]+\.(?:txt|md))", r"(\.{1,2}/[^\s]+\.(?:txt|md))", r"(?:file|document|path):\s*([^\s]+\.(?:txt|md))", r'"([^"]+\.(?:txt|md))"', r"'([^']+\.(?:txt|md))'")
DEFAULT_DIRS = ("core", "collaboration", "safety", "agents", "analysis", "config", "orchestration", "tests")
PURPOSES = {"base_agent": "Abstract base class for all agents", "model_manager": "Unified model management for all agents", "message_bus": "Inter-agent communication system", "session_manager": "Collaboration session tracking", "workflow_engine": "Multi-step workflow orchestration"}
COMPONENTS = (("core", "Core framework component for "), ("collaboration", "Agent collaboration component for "), ("safety", "Safety and execution component for "), ("analysis", "Result analysis component for "))


def section(reply: Column, name: str, following: str | None, default: str) -> Column:
    """Text after `name:` up to a line that starts with `following:`, or a default."""
    stop = rf"(?=\n{following}:|$)" if following else "$"
    shape = rf"(?is){name}:\s*(.+?){stop}"
    return F.when(F.rlike(reply, F.lit(shape)), strip(F.regexp_extract(reply, shape, 1))).otherwise(default)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def number(reply: Column, default: float) -> Column:
    shape = r"(?i)CONFIDENCE:\s*([\d.]+)"
    value = F.when(F.rlike(reply, F.lit(shape)), F.regexp_extract(reply, shape, 1)).try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(default)


def security_fields(reply: Column) -> dict[str, Column]:
    listed = F.transform(lines(section(reply, "COMMANDS", "REASONING", "")), safety.clean_command)
    loose = F.transform(F.regexp_extract_all(reply, F.lit(r'(ssh\s+\w+@[\d\.]+\s+"[^"]+")'), 1), safety.clean_command)
    filled = lambda a: F.filter(a, lambda x: x != "")
    steps = F.filter(lines(section(reply, "NEXT_STEPS", "CONFIDENCE", "")), lambda x: F.length(x) > 5)
    return {
        "commands": F.when(F.size(filled(listed)) > 0, filled(listed)).otherwise(filled(loose)),
        "reasoning": section(reply, "REASONING", "APPROACH", "Collaborative analysis"),
        "approach": section(reply, "APPROACH", "NEXT_STEPS", "Step-by-step investigation"),
        "next_steps": filled(F.transform(steps, safety.clean_step)),
        "confidence": number(reply, 0.8),
    }


def clean_plan_command(raw: Column) -> Column:
    c = safety.unmarked(raw)
    quoted = r"""["']([^"']+)["']"""
    c = F.when(F.rlike(c, F.lit(quoted)), F.regexp_extract(c, quoted, 1)).otherwise(c)
    c = flat(F.when(F.rlike(c, F.lit("`([^`]+)`")), F.regexp_extract(c, "`([^`]+)`", 1)).otherwise(c))
    known = reduce(lambda a, b: a | b, (F.startswith(F.lower(c), F.lit(s)) for s in PLAN_STARTS))
    return F.when((F.length(c) >= 3) & known, c).otherwise("")


def plan_fields(reply: Column) -> dict[str, Column]:
    commands = F.transform(lines(section(reply, "COMMANDS", "REASONING", "")), clean_plan_command)
    return {
        "understanding": section(reply, "UNDERSTANDING", "PLAN", "Task analysis"),
        "plan": section(reply, "PLAN", "COMMANDS", "Execute commands to gather information"),
        "commands": F.filter(commands, lambda x: x != ""),
        "reasoning": section(reply, "REASONING", "EXPECTED", "Logical command sequence"),
        "expected": section(reply, "EXPECTED", None, "Information gathering"),
    }


def analysis_fields(reply: Column) -> dict[str, Column]:
    return {
        "analysis": section(reply, "ANALYSIS", "INSIGHTS", "Results processed"),
        "insights": section(reply, "INSIGHTS", "NEXT_STEPS", "Information gathered"),
        "next_steps": section(reply, "NEXT_STEPS", "COMPLETION", "Continue investigation"),
        "completion": section(reply, "COMPLETION", None, "in_progress"),
    }


def final_command(raw: Column) -> Column:
    c = strip(raw)
    c2 = F.when(F.rlike(c, F.lit("""(?s)^(".*"|'.*')$""")), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.when(F.startswith(F.lower(c), F.lit("ssh")), safety.fix_ssh(c)).otherwise(flat(F.regexp_replace(c2, "^`+|`+$", "")))


def summary_parts(reply: Column) -> tuple[Column, Column]:
    """Summary text before the insights heading, and the bullets after it."""
    rows = F.split(reply, "\n")
    heading = lambda x: F.rlike(F.lower(x), F.lit("key insights:|key points:"))
    first = F.array_position(F.transform(rows, heading), True)
    bullets = F.filter(F.transform(F.slice(rows, first + 1, F.size(rows)), strip), lambda x: F.rlike(x, F.lit("^[•*-]")))
    cleaned = F.transform(bullets, lambda x: F.regexp_replace(x, r"^[•\-* ]+", ""))
    text = F.when(first > 1, strip(F.array_join(F.slice(rows, F.lit(1), (first - 1).cast("int")), "\n"))).otherwise(reply)
    none = F.array(F.lit("Summary analysis complete"))
    return text, F.when((first > 0) & (F.size(cleaned) > 0), cleaned).otherwise(none)


def summary_path(request: Column) -> Column:
    found = F.coalesce(*(F.when(F.rlike(request, F.lit(p)), F.regexp_extract(request, p, 1)) for p in PATHS))
    return F.regexp_replace(found, """^["']+|["']+$""", "")


def directories(reply: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(reply, F.lit(r"\s*([a-zA-Z_][a-zA-Z0-9_/]*/)\s*#"), 1), lambda x: F.regexp_replace(x, "/+$", "")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_DIRS)))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(.)\.[^./]+$", "$1")


def file_kind(path: Column) -> Column:
    ext, name = F.regexp_extract(path, r"(\.[^./]+)$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    classy = F.rlike(F.lower(stem(path)), F.lit("agent|manager|engine|validator"))
    return (
        F.when(name == "__init__.py", "init_file")
        .when((ext == ".py") & classy, "python_class")
        .when((ext == ".py") & F.startswith(stem(path), F.lit("test_")), "test_file")
        .when(ext == ".py", "python_module")
        .when(ext.isin(".yaml", ".yml", ".json", ".toml"), "config_file")
        .otherwise("python_script")
    )


def purpose(path: Column) -> Column:
    parts, name = F.split(path, "/"), stem(path)
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in PURPOSES.items() for x in kv)), name)
    context = F.coalesce(*(F.when(F.array_contains(parts, d), F.concat(F.lit(p), name)) for d, p in COMPONENTS))
    return F.coalesce(known, context, F.concat(F.lit("System component for "), name))


def class_name(module: Column) -> Column:
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(F.transform(F.split(module, "_"), word), "")


# Chatter that opens a reply, fences in order, what opens code, remarks to drop.
CHATTER = (r"Here's.*?:\s*\n", r"This.*?:\s*\n", r"I'll.*?:\s*\n", r"The following.*?:\s*\n", r"Below is.*?:\s*\n")
LISTED = r"This version includes[^\n]*\n(?:\d+\.[^\n]*\n)*"
FENCES = (r"(?s)```python\n?(.*?)```", r"(?s)```\n?(.*?)```", r"`([^`]+)`")
UNFENCED = ((r"```python\n?", ""), (r"```\n?", ""), (r"`([^`]+)`", "$1"))
OPENS = ('"""', "'''", "import ", "from ", "class ", "def ", "#")
REMARKS = ("this version includes", "this file contains", "note:", "example:", "the above", "explanation:")
FENCED_LEAST = 50


def without_chatter(reply: Column) -> Column:
    """Without opening phrases up to a colon at a line's end, and numbered lists of changes.
    The part behind the last such colon can hold no phrase's end, so it isn't searched."""

    def calmed(p: str):
        without = lambda x, head: F.when(head == "", x).otherwise(F.concat(F.regexp_replace(head, "(?is)" + p, ""), F.substr(x, F.length(head) + 1)))
        return lambda x: let(F.regexp_extract(x, r"(?s)^(.*:\s*\n)", 1), lambda head: without(x, head))

    for p in CHATTER:
        reply = let(reply, calmed(p))
    return F.regexp_replace(reply, "(?i)" + LISTED, "")


def clean_code(reply: Column) -> Column:
    """The code of a model's reply: the first fenced part of over 50 characters, or else all
    of it without marks, from the first line that opens code to the last that isn't blank or
    a comment, without remarks. A null stays null, a reply without lines is empty."""
    empty = F.array().cast("array<string>")

    def fenced(x: Column) -> Column:
        found = [let(strip(F.regexp_extract(x, p, 1)), lambda c: F.when(F.length(c) > FENCED_LEAST, c)) for p in FENCES]
        return F.coalesce(*found, x)

    def unmarked(x: Column) -> Column:
        for p, by in UNFENCED:
            x = F.regexp_replace(x, p, by)
        return x

    def trimmed(lines: Column) -> Column:
        opens = F.array_position(F.transform(lines, lambda x: let(strip(x), lambda y: reduce(lambda a, b: a | b, (F.startswith(y, F.lit(o)) for o in OPENS)))), True)
        return let(F.slice(lines, F.greatest(opens, F.lit(1)).cast("int"), F.size(lines)), lambda rest: F.slice(rest, 1, last(rest)))

    def last(lines: Column) -> Column:
        back = F.reverse(F.transform(lines, lambda x: let(strip(x), lambda y: (y != "") & ~F.startswith(y, F.lit("#")) & ~F.contains(y, F.lit("This version")))))
        return let(F.array_position(back, True).cast("int"), lambda at: F.when(at > 0, F.size(back) + 1 - at).otherwise(F.size(back)))

    def code(x: Column) -> Column:
        return let(strip(x), lambda y: F.startswith(y, F.lit("#")) | ~let(F.lower(y), lambda z: any_of(z, REMARKS)))

    chosen = let(without_chatter(reply), lambda x: F.when(F.contains(x, F.lit("`")), unmarked(fenced(x))).otherwise(x))
    lines = F.filter(let(F.split(chosen, "\n"), trimmed), code)
    body = let(strip(F.array_join(F.coalesce(lines, empty), "\n")), lambda x: F.when(x == "", x).otherwise(F.concat(x, F.lit("\n"))))
    return F.when(reply.isNotNull(), body)
