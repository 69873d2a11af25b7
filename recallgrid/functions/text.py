"""Text functions on columns: query sanitising, redaction, safety, titles, globs. All run in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns decide results and equal those of the behaviour that is reproduced.
REDACTION_GROUPS = {
    "api_keys": [
        r"sk-ant-[A-Za-z0-9_-]{20,}",
        r"sk-proj-[A-Za-z0-9_-]{20,}",
        r"sk-[A-Za-z0-9]{20,}",
        r"xai-[A-Za-z0-9_-]{20,}",
        r"AIza[0-9A-Za-z_-]{35}",
    ],
    "bearer_tokens": [
        r"(?i)Authorization:\s*Bearer\s+[A-Za-z0-9._~+/=-]{20,}",
        r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}",
    ],
    "jwt": [r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"],
    "aws_keys": [
        r"A(?:KIA|SIA)[0-9A-Z]{16}",
        r"""(?i)aws[_-]?secret[_-]?access[_-]?key["'\s:=]+[A-Za-z0-9/+=]{40}""",
        r"""(?i)(?:x-amz-security-token|aws[_-]?session[_-]?token)["'\s:=]*[A-Za-z0-9/+=%_-]{40,}""",
        r"""(?i)(?:X-Amz-)?Signature["'\s:=]*[A-Za-z0-9/+=%]{16,}""",
    ],
    "github_tokens": [
        r"ghp_[A-Za-z0-9]{36}",
        r"gho_[A-Za-z0-9]{36}",
        r"ghu_[A-Za-z0-9]{36}",
        r"ghs_[A-Za-z0-9]{36}",
        r"ghr_[A-Za-z0-9]{36}",
    ],
    "pii": [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
        r"\b\d{3}-\d{2}-\d{4}\b",
    ],
}
FRAMING_TAGS = ["system-reminder", "task-notification"]
SAFETY_PATTERNS = [
    r"(?iU)<script\b",
    r"(?iU)javascript:",
    r"(?iU)__import__|\bexec\s*\(|\beval\s*\(",
    r"(?iU)(?:ignore|disregard)\s+(?:all\s+)?(?:previous|prior)\s+instructions",
]
GENERIC_ROLES = ["user", "assistant", "system", "tool"]
SEARCH_PUNCTUATION = "?!:.,;/\"'"

#: Statements that change a schema or delete rows, as a whole content or after a semicolon.
SQL_CHANGES = r"(?i)(?:^|;)\s*(?:drop\s+(?:table|view|index|schema|database)|delete\s+from|alter\s+(?:table|view|index|schema|database))\s+\S"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize(text: Column) -> Column:
    """A search query without operator words and punctuation: 500 characters, letters, digits and _ of any script."""
    cut = F.regexp_replace(F.substring(text, 1, 500), r"\b(?:OR|AND|NOT|NEAR)\b", " ")
    return strip(F.regexp_replace(cut, r"(?U)[^\w\s]", " "))


def searchable(text: Column) -> Column:
    """Lower case, with the punctuation that the index drops as spaces."""
    return F.translate(F.lower(text), SEARCH_PUNCTUATION, " " * len(SEARCH_PUNCTUATION))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _ of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def title_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.char_length(t) > 2))


def title_overlap(query: Column, title: Column) -> Column:
    """Share of the query's distinct tokens of more than two characters that the title has."""
    q = title_tokens(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, title_tokens(title))) / F.size(q))


def title_with_role(title: Column, role: Column) -> Column:
    """`[role] title`, unless the role is missing or generic or the title already starts with a bracket."""
    t, r = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(role, F.lit("")))
    plain = F.startswith(t, F.lit("[")) | (r == "") | F.lower(r).isin(GENERIC_ROLES)
    return F.when(plain, t).otherwise(strip(F.concat(F.lit("["), r, F.lit("] "), t)))


#: For each pattern of a group, strings of which a text must contain one for the pattern to match; `i:` in any case.
GATES = {
    "api_keys": [["sk-ant-"], ["sk-proj-"], ["sk-"], ["xai-"], ["AIza"]],
    "bearer_tokens": [["i:bearer"], ["i:bearer"]],
    "jwt": [["eyJ"]],
    "aws_keys": [["AKIA", "ASIA"], ["i:aws"], ["i:x-amz", "i:aws"], ["i:signature"]],
    "github_tokens": [["ghp_"], ["gho_"], ["ghu_"], ["ghs_"], ["ghr_"]],
    "pii": [["@"], list("0123456789"), list("0123456789")],
}


def _open(x: Column, gate: list[str]) -> Column:
    hits = [F.lower(x).contains(g[2:]) if g.startswith("i:") else x.contains(g) for g in gate]
    return functools.reduce(lambda a, b: a | b, hits, F.lit(False)) if gate else F.lit(True)


def _scrubber(group: str, pattern: str, gate: list[str]):
    """text -> text without the pattern's matches; the pattern runs only where the gate is open."""
    return lambda x: F.when(_open(x, gate), F.regexp_replace(x, pattern, f"[REDACTED:{group}]")).otherwise(x)


def _counter(group: str, pattern: str, gate: list[str]):
    """(text, n) -> the same with what _scrubber replaces replaced and counted."""

    def count(x: Column) -> Column:
        done = F.struct(F.regexp_replace(x["text"], pattern, f"[REDACTED:{group}]").alias("text"), (x["n"] + F.regexp_count(x["text"], F.lit(pattern))).alias("n"))
        return F.when(_open(x["text"], gate), done).otherwise(x)

    return count


def redact(text: Column, groups: list[str] | None = None, custom: list[str] | None = None) -> tuple[Column, Column]:
    """(text with matches of each group, in order, replaced by [REDACTED:group]; how many were replaced).

    A pattern only runs over texts that hold what it can't match without, so a clean text costs a few searches.
    """
    chosen = [(g, REDACTION_GROUPS[g], GATES[g]) for g in groups or REDACTION_GROUPS if g != "pii"]
    chosen += [("custom_regex", custom, [[]] * len(custom))] if custom else []
    chosen += [("pii", REDACTION_GROUPS["pii"], GATES["pii"])] if groups is None or "pii" in groups else []
    counted = F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("n"))
    for group, patterns, gates in chosen:
        for pattern, gate in zip(patterns, gates):
            text = F.transform(F.array(text), _scrubber(group, pattern, gate))[0]
            counted = F.transform(F.array(counted), _counter(group, pattern, gate))[0]
    return text, counted["n"]


def strip_framing(text: Column, tags: list[str] | None = None) -> Column:
    """Text without blocks of control tags; where there was one, the blank lines it leaves are collapsed and the ends stripped."""
    names = "|".join(tags or FRAMING_TAGS)
    block = rf"(?is)<({names})\b[^>]*>.*?</\1>"
    tidy = strip(F.regexp_replace(F.regexp_replace(text, block, ""), r"\n[ \t]*\n[ \t]*\n+", "\n\n"))
    return F.when(text.rlike(rf"(?i)<(?:{names})") & text.rlike(block), tidy).otherwise(text)


def is_unsafe(text: Column) -> Column:
    """Whether a content matches a safety pattern, or is SQL that drops, deletes or alters; false for null."""
    text = F.coalesce(text, F.lit(""))
    hit = text.rlike(SQL_CHANGES)
    for p in SAFETY_PATTERNS:
        hit = hit | text.rlike(p)
    return hit


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored regular expression: * any run, ? one character, [a-c] and [^a-c] classes.

    A bracket first in a class stands for itself; an open bracket that nothing closes matches nothing.
    """
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "[":
            negated = glob[i : i + 1] == "^"
            first = i + negated
            end = glob.find("]", first + 1)
            if end < 0:
                return r"(?!)"
            inside = "".join("\\" + x if x in r"\[]&^" else x for x in glob[first:end])
            out, i = out + f"[{'^' * negated}{inside}]", end + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if c in r".^$+{}()|\/]" else c
    return f"(?s)^(?:{out})$"


def slug(text: Column) -> Column:
    """Identifier of an entity's name: lower case, runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def first_sentence(text: Column, limit: int = 160) -> Column:
    return F.substring(F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"^(.*?[.!?])(?:\s|$)", 1), 1, limit)
