"""Scalar functions as column expressions (all run in the JVM)."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NORMAL = 2.2250738585072014e-308
MAX = 1.7976931348623157e308


def real_time(value: Column) -> Column:
    """Milliseconds in {"realTime": "..."}; null where there is none or it isn't a number."""
    return F.get_json_object(value, "$.realTime").try_cast("long")


def real_time_or_one(value: Column) -> Column:
    """The same for run times, where an unreadable number counts as 1."""
    return F.coalesce(real_time(value), F.lit(1).cast("long"))


def java_hash(text: Column) -> Column:
    """String hash by 31 h + c over UTF-16 units in 32 bits, as a signed integer; null stays null."""
    units = F.transform(
        F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G.{4})"),
        lambda u: F.coalesce(F.conv(F.when(u != "", u), 16, 10).cast("long"), F.lit(-1).cast("long")),
    )
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, c: F.when(c < 0, a).otherwise((a * 31 + c) % (1 << 32)))
    return F.when(text.isNotNull(), F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def java_task_id(name: Column) -> Column:
    """abs(hash + 1) in 32 bits; the least integer is its own absolute value."""
    h = java_hash(name) + 1
    h = F.when(h == 1 << 31, F.lit(-(1 << 31)).cast("long")).otherwise(h)
    return F.when(h == -(1 << 31), h).otherwise(F.abs(h))


def round_up(x: Column, step: Column) -> Column:
    """The least multiple of step that is not below x."""
    return (F.ceil(x / step) * step).cast("long")


def escape_backslashes(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def repair_tool_state(state: Column) -> Column:
    """Tool state that was quoted several times over, as JSON text: inner objects and arrays lose their quotes,
    escapes go, doubled quotes become single ones, empty values and "null" become "", wrapped unset values open up."""
    steps = [
        (r'"(\{|\[)', "$1"),
        (r'(\}|\])"', "$1"),
        (r"\\", ""),
        (r'""([^",:}\]]+)""', '"$1"'),
        (r":\s*(,|\})", ':""$1'),
        (r'\{\s*"__class__"\s*:\s*"UnvalidatedValue"\s*,\s*"value"\s*:\s*("[^"]*"|[^"{}]*?)\s*\}', "$1"),
        (r'"null"', '""'),
    ]
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, state)


def with_path_suffix(template: Column, names: list[str]) -> Column:
    """$name and ${name} in a command template become $name.path for the given parameters, unless they go on with a dot."""
    out = template
    for n in names:
        out = F.regexp_replace(out, rf"\$\{{{n}\}}", "\\${" + n + ".path}")
        out = F.regexp_replace(out, rf"\${n}(?![\w.])", "\\$" + n + ".path")
    return out


def without_suffixes(text: Column) -> Column:
    """Without .value and .dataset."""
    return F.regexp_replace(text, r"\.(value|dataset)\b", "")


def tool_name(tool_id: Column) -> Column:
    """The next to last part of a path of three or more parts, else the id itself."""
    parts = F.split(tool_id, "/")
    return F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(-2))).otherwise(tool_id)


def underscored(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "_")


def first_extension(path: Column) -> Column:
    """What follows the first dot of the last path part; null without a dot."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"\.(.*)$", 1))


def base_name(path: Column) -> Column:
    """The last path part without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case extension after the last dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def normalised(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_list(text: Column) -> Column:
    return F.split(text, ", ")


def env_pair(text: Column) -> Column:
    """struct(name, value) split at the first =; without one the value is empty."""
    parts = F.split(text, "=", 2)
    return F.struct(parts[0].alias("name"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("value"))


def startup(stage_in_ts: Column, startup_ts: Column, sched: Column) -> Column:
    """Time from allocation to stage-in that was not scheduling; unset parts count as 0."""
    zero = F.lit(0)
    return F.coalesce(stage_in_ts, zero) - F.coalesce(startup_ts, zero) - F.coalesce(sched, zero)


def shutdown(shutdown_ts: Column, stage_out_ts: Column, stage_out: Column) -> Column:
    """Time from the end of stage-out to completion; unset parts count as 0."""
    zero = F.lit(0)
    return F.coalesce(shutdown_ts, zero) - F.coalesce(stage_out_ts, zero) - F.coalesce(stage_out, zero)


def run_id(given: str | None = None) -> Column:
    """A new run's id: the one given, else a random UUID (36 characters), another one for each row."""
    return F.uuid() if given is None else F.lit(given)


def clone_id(run_id: Column, millis: Column) -> Column:
    """First 36 characters, underscore, milliseconds."""
    return F.concat(F.substring(run_id, 1, 36), F.lit("_"), millis.cast("string"))


def console_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yy/MM/dd HH:mm:ss")


def normal_quantile(alpha: float) -> float:
    return NormalDist().inv_cdf(alpha)


def progress(completed: Column, total: Column) -> Column:
    """Share completed; 0 if there is nothing to do."""
    return F.coalesce(F.try_divide(completed, total), F.lit(0.0))


def retried(tries: Column, most: int = 1) -> Column:
    """Whether a failed task is tried again."""
    return tries <= most
