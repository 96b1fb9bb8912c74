"""Column functions over text: tokens, lines, keys, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default tokenizer: a run of letters and marks, a digit, or any other visible character; line ends count.
TOKEN = r"[\p{L}\p{M}]+|[0-9]|[^\p{L}\p{M}0-9 \t\r\f\x0B]"
BLOCK = 16

# Shapes and prefixes of the formats that are read.
ATTR = r'([0-9A-Za-z_][0-9A-Za-z_-]*)="([^"]*)"'
BRACKET = r"\[([0-9]+)\]"
JSON_PAIR = r'"([A-Za-z_][0-9A-Za-z_.-]*)"\s*:\s*("[^"]{0,120}"|-?[0-9][0-9.eE+-]*)'
LOG_KV = r"""\b([a-z_][0-9A-Za-z_.-]{1,30})=([^\s,;"']{1,80})"""
YAML_KV = r"(?m)^\s*(?:- )?([A-Za-z_][0-9A-Za-z_./-]*):\s+(\S.*?)\s*$"
MACHINE = r"^([0-9]+|0[xX][0-9a-fA-F]+|[0-9a-fA-F]{8,}|[0-9a-fA-F][0-9a-fA-F:-]{7,}|[0-9][0-9.,;x\s-]*[0-9]|[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.-]+Z?)?)$"
SANDBOX = r"^(?:/testbed/|/workspace/[^/]+/|/workspace/|/app/projects/|/app/)"
OBSERVATION = r"OBSERVATION:\s*\n"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def lines_of(text: Column) -> Column:
    """Every piece between line ends, with a line end behind it; the last piece too."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.concat(x, F.lit("\n")))


def machine_value(value: Column) -> Column:
    """Integers, hex and uuid-like ids, number tuples, ISO timestamps."""
    return F.trim(value).rlike(MACHINE)


def norm_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), SANDBOX, "")


def repo_key(instance: Column) -> Column:
    """org__repo-12 and org__repo.commit.kind give org/repo; anything else is its own key."""
    rest = F.regexp_extract(instance, "(?s)^.*?__(.*)$", 1)
    base = F.regexp_replace(F.split_part(rest, F.lit("."), F.lit(1)), "-[0-9]+$", "")
    return F.when(instance.contains("__"), F.concat(F.split_part(instance, F.lit("__"), F.lit(1)), F.lit("/"), base)).otherwise(instance)


def head_of(prompt: Column) -> Column:
    """The prompt up to and including its first observation header; all of it without one."""
    head = F.regexp_extract(prompt, f"(?s)^.*?{OBSERVATION}", 0)
    return F.when(head == "", prompt).otherwise(head)


def classify(text: Column) -> Column:
    """The tool that an observation came from, by its opening."""
    start = F.ltrim(F.substring(text, 1, 400))
    start = F.when(start.startswith("OBSERVATION:"), F.ltrim(F.substring(start, 13, 400))).otherwise(start)
    near = F.substring(start, 1, 200)
    viewer = near.contains("result of running `cat -n`")

    def opens(*what: str) -> Column:
        out = start.startswith(what[0])
        for w in what[1:]:
            out = out | start.startswith(w)
        return out

    return (
        F.when(start.startswith("[File:") | F.substring(text, 1, 80).contains("(Open file:"), "file_read")
        .when(viewer & near.contains("has been edited"), "edit")
        .when(viewer, "file_read")
        .when(opens("File created successfully", "The file ", "Your proposed edit", "ERROR: No changes were made", "No replacement was performed"), "edit")
        .when(opens("Here's the files and directories", "Found ", "No matches found", "grep:"), "search_list")
        .when(opens("Your thought has been logged", "<uploaded_files>", "ISSUE:", "We're currently solving"), "prompt_task")
        .otherwise("bash_other")
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, 2))
