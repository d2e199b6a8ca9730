"""Repair and scoring of text with common recognition errors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole words as recognised and as written, case-sensitive.
# fmt: off
WORDS: dict[str, str] = {
    "Nhen": "When", "Nith": "With", "Nhat": "What", "Nhere": "Where", "Nhich": "Which", "Nhile": "While",
    "Nhy": "Why", "Nho": "Who", "Nhose": "Whose", "Nhole": "Whole", "Nork": "Work", "Nord": "Word", "Norld": "World",
    "Nrite": "Write", "Nriter": "Writer", "Nritten": "Written", "Nrong": "Wrong", "Nrap": "Wrap",
    "Narning": "Warning", "Neb": "Web", "Nebsite": "Website", "Nindow": "Window", "Nindows": "Windows", "NoH": "Now",
    "NoN": "Now", "Nas": "Was", "Nere": "Were", "Nill": "Will", "Nant": "Want", "Nay": "Way", "Nait": "Wait",
    "Natch": "Watch", "Nalk": "Walk", "Hdp": "Help", "Hhen": "When", "Hith": "With", "Hhat": "What", "Hhere": "Where",
    "Hork": "Work", "Hord": "Word", "Horld": "World", "Hindow": "Window", "Hindows": "Windows", "WindoH": "Window",
    "windoH": "window", "noH": "now", "hoH": "how", "HoH": "How", "shoH": "show", "ShoH": "Show", "floH": "flow",
    "FloH": "Flow", "knoH": "know", "KnoH": "Know", "beloH": "below", "BeloH": "Below", "alloH": "allow",
    "AlloH": "Allow", "folloH": "follow", "FolloH": "Follow", "ln": "In", "lt": "It", "lf": "If", "ls": "Is",
    "lnstall": "Install", "lmport": "Import", "lnput": "Input", "lnit": "Init", "lnterface": "Interface",
    "lnternal": "Internal", "lnvalid": "Invalid", "ltem": "Item", "ltems": "Items", "lndex": "Index",
    "lnsert": "Insert", "lnfo": "Info", "lmage": "Image", "lcon": "Icon", "0pen": "Open", "0ption": "Option",
    "0ptions": "Options", "0utput": "Output", "0bject": "Object", "0verride": "Override", "0K": "OK",
    "IT8rn12": "iTerm2", "IT8rnl2": "iTerm2", "IT8mi2": "iTerm2", "lTerm2": "iTerm2", "iTern2": "iTerm2",
    "Ifiew": "View", "IfieN": "View", "WirKIow": "Window", "WindoN": "Window", "Profi les": "Profiles",
    "Sessi on": "Session", "Scri pts": "Scripts", "COMMand": "command", "COMMIt": "commit", "COMpile": "compile",
    "COMpiler": "compiler", "COMplet": "complet", "COMMit": "commit", "PerMission": "Permission",
    "TlMeout": "Timeout", "ConnectTIMeout": "ConnectTimeout", "proiect": "project", "proiects": "projects",
    "Proiect": "Project", "Proiects": "Projects", "def7ne": "define", "funct7on": "function", "ret urn": "return",
    "pr7nt": "print", "7mport": "import", "7nstall": "install", "7nput": "input", "7nclude": "include",
    "7nit": "init", "7nterface": "interface", "7f": "if", "7n": "in", "7s": "is", "7t": "it", "fflter": "filter",
    "ffle": "file", "ffnd": "find", "ffrst": "first", "ffnal": "final", "ffnally": "finally", "ffx": "fix",
    "ffll": "fill", "ffled": "filed", "ffles": "files", "ffght": "fight", "ffgure": "figure", "ffre": "fire",
    "ffnish": "finish", "fflow": "flow", "fflat": "flat", "fflag": "flag", "fflags": "flags", "ffloor": "floor",
    "fflush": "flush", "ffly": "fly",
}
# fmt: on

# Contextual repairs in order of application, with the name under which they are counted.
REPAIRS: list[tuple[str, str, str]] = [
    (r"J(Users|home|var|tmp|etc|opt|usr|bin|sbin|dev|proc|sys|Library|Applications|Volumes)J", "/$1/", "J-as-slash in paths"),
    (r"(?<!\w)J(Users|home|var|tmp|etc|opt)(?=/|\b)", "/$1", "J-as-slash at path start"),
    (r"(?<=[a-zA-Z])7(?=[a-zA-Z])", "i", "7-as-i inside words"),
    (r"(?<=[a-zA-Z])0(?=[a-zA-Z])", "O", "0-as-O inside words"),
    *[(rf"(?i)\b{word}\b", word[1:], f"doubled-start: {word}") for word in ("tthe", "ffor", "iin", "oof", "oon", "aand", "oor", "iis", "tto")],
]

# Signs of recognition errors, counted independently of each other.
SIGNS: list[str] = [
    r"\bN[a-z]{2,}\b",
    r"(?<=[a-zA-Z])7(?=[a-zA-Z])",
    r"(?<=[a-zA-Z])0(?=[a-zA-Z])",
    r"J(?:Users|home|var)",
    r"\bH[a-z]{2,}\b",
    r"[a-z]H\b",
    r"\bff[a-z]{2,}\b",
    r"\bl[A-Z][a-z]",
]
#: Share of words in error at which the score reaches 0.
WORST = 0.3


def word_pattern(extra: dict[str, str] | None = None) -> str:
    """One alternation of all words, longest first, so that no replacement is ever replaced again."""
    words = sorted({**WORDS, **(extra or {})}, key=lambda w: (-len(w), w))
    return r"\b(" + "|".join(map(re.escape, words)) + r")\b"


def _word_hits(text: Column, extra: dict[str, str] | None = None) -> Column:
    """How many of the dictionary's words stand in a text: its words are looked up, only keys of several words are searched."""
    table = {**WORDS, **(extra or {})}
    single = [w for w in table if re.fullmatch(r"\w+", w)]
    others = [w for w in table if w not in set(single)]
    if set(single) & {part for w in others for part in re.findall(r"\w+", w)}:  # the longer key would count alone
        return F.regexp_count(text, F.lit("(?U)" + word_pattern(extra)))
    hits = F.size(F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: w.isin(single)))
    pattern = r"(?U)\b(" + "|".join(map(re.escape, sorted(others, key=lambda w: (-len(w), w)))) + r")\b"
    return hits + F.regexp_count(text, F.lit(pattern)) if others else hits


def repair_context(text: Column) -> Column:
    """The contextual repairs alone, all in the JVM; null gives ''."""
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement, _ in REPAIRS:
        out = F.regexp_replace(out, F.lit("(?U)" + pattern), F.lit(replacement))
    return out


def replace_words(text: Column, extra: dict[str, str] | None = None) -> Column:
    """The dictionary's words in one pass. Texts without any of them don't reach Python."""
    table = {**WORDS, **(extra or {})}
    pattern = word_pattern(extra)
    compiled = re.compile(pattern)

    @F.pandas_udf(T.StringType())
    def replace(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else compiled.sub(lambda m: table[m.group()], v))

    text = F.coalesce(text, F.lit(""))
    hit = _word_hits(text, extra) > 0
    return F.coalesce(replace(F.when(hit, text)), text)


def clean(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Both passes, the dictionary first; null gives ''."""
    return repair_context(replace_words(text, extra))


def confidence(text: Column, extra: dict[str, str] | None = None) -> Column:
    """1 for no sign of errors, 0 at WORST errors a word or for a blank text; overlapping signs all count."""
    text = F.coalesce(text, F.lit(""))
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    words = F.size(F.split(stripped, r"(?U)\s+"))
    errors = sum((F.regexp_count(text, F.lit("(?U)" + p)) for p in SIGNS), _word_hits(text, extra))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - errors / words / F.lit(WORST))), 3)
    return F.when(stripped == "", F.lit(0.0)).otherwise(score)


def clean_with_stats(text: Column, extra: dict[str, str] | None = None) -> Column:
    """struct(text, stats): stats maps ``word_substitutions``, ``regex:<name>`` (if any) and ``regex_fixes_total``."""
    raw = F.coalesce(text, F.lit(""))
    current = replace_words(raw, extra)
    counts: list[tuple[str, Column]] = []
    for pattern, replacement, name in REPAIRS:
        java = F.lit("(?U)" + pattern)
        counts.append((f"regex:{name}", F.regexp_count(current, java)))
        current = F.regexp_replace(current, java, F.lit(replacement))
    entries = [F.struct(F.lit("word_substitutions").alias("key"), _word_hits(raw, extra).alias("value"))]
    entries += [F.when(c > 0, F.struct(F.lit(name).alias("key"), c.alias("value"))) for name, c in counts]
    entries.append(F.struct(F.lit("regex_fixes_total").alias("key"), sum((c for _, c in counts), F.lit(0)).alias("value")))
    stats = F.map_from_entries(F.array_compact(F.array(*entries)))
    empty = F.create_map().cast("map<string,int>")
    return F.struct(current.alias("text"), F.when(raw == "", empty).otherwise(stats.cast("map<string,int>")).alias("stats"))
