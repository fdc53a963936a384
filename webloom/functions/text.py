"""Text functions (F5-F7, F10-F16, X3, X7, O7) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.common import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(s) -> Column:
    """Python ``str.strip()``: Unicode whitespace off both ends (Spark ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(s), r"(?U)^\s+|\s+$", "")


def content_hash(s) -> Column:
    """sha256 hex of the UTF-8 bytes."""
    return F.sha2(_c(s), 256)


def url_key(s) -> Column:
    """md5 hex, the per-URL storage key."""
    return F.md5(_c(s))


def query_words(q) -> Column:
    """distinct lower-cased whitespace tokens (``set(q.lower().split())``)."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(q)), r"(?U)\s+"), lambda w: w != ""))


def match_count(words, lowered_text) -> Column:
    """how many words occur as substrings of an already lower-cased text."""
    t = _c(lowered_text)
    return F.coalesce(F.size(F.filter(_c(words), lambda w: F.instr(t, w) > 0)), F.lit(0))


def cut(text, n: int) -> Column:
    """Over n characters -> first n + '...'."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def clean_markdown(md) -> Column:
    """4+ newlines -> 3; space runs -> 1; right-trim lines; drop empty links;
    blank image-only lines; strip.  Same order as the rule it reproduces."""
    t = F.regexp_replace(_c(md), r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, " +", " ")
    t = F.regexp_replace(t, r"(?dmU)[^\S\n]+$", "")
    t = F.regexp_replace(t, r"(?U)\[\s*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"(?dmU)^\s*!\[.*?\]\(.*?\)\s*$", "")
    return py_strip(t)


def truncate_tokens(s, max_tokens: int = 4000) -> Column:
    """4 chars per token; cut, back up to the last '.' when it lies past 80 % of the cut."""
    s = _c(s)
    max_chars = max_tokens * 4
    head = F.substring(s, 1, max_chars)
    dot = F.instr(F.reverse(head), ".")
    last = F.when(dot > 0, F.length(head) - dot).otherwise(F.lit(-1))  # 0-based rfind
    head = F.when(last > F.lit(max_chars * 0.8), F.substring(head, 1, last + 1)).otherwise(head)
    return F.when(F.length(s) > max_chars, F.concat(head, F.lit("\n\n[Content truncated...]"))).otherwise(s)


def chunk_starts(s, threshold: int = 4000, overlap: int = 200) -> Column:
    """F14 start offsets (0-based): window 4*threshold, stride window - 4*overlap, start < len."""
    size, ov = threshold * 4, overlap * 4
    if ov >= size:
        raise ValueError("overlap must be smaller than the chunk window")
    n = F.length(_c(s))
    return F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(size - ov))).otherwise(F.array(F.lit(0)))


def parse_number(text, default=None) -> Column:
    """First ``[\\d,]+\\.?\\d*`` match, commas removed, as DOUBLE; default when none parses."""
    m = F.regexp_extract(_c(text), r"[\d,]+\.?\d*", 0)
    v = F.when(m != "", F.replace(m, F.lit(","), F.lit("")).try_cast("double"))
    return F.coalesce(v, F.lit(default).cast("double"))


def cell_integer(raw) -> Column:
    """X7 for integers: the exact value as DECIMAL(38,0) after dropping commas; NULL with a '.' or when it is no integer."""
    t = F.replace(_c(raw), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.regexp_replace(t, r"\s", "")).try_cast("decimal(38,0)"))


def cell_number(raw) -> Column:
    """X7: '.' present -> float, else integer, after dropping commas; NULL when it is not a number. A DOUBLE: integers beyond
    2**53 are exact in :func:`cell_integer` only."""
    r = _c(raw)
    t = F.replace(r, F.lit(","), F.lit(""))
    as_float = F.when(t.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), t.try_cast("double"))
    return F.when(F.instr(r, ".") > 0, as_float).otherwise(cell_integer(r).cast("double"))


def paragraphs(md, sep: str = "\n\n") -> Column:
    """split on the paragraph separator (literal)."""
    import re
    return F.split(_c(md), re.escape(sep), -1)


def line_hashes(s, chars: int | None = None) -> Column:
    """64-bit hashes of the lines of a text, in order; ``chars`` reads only so many first characters."""
    t = _c(s) if chars is None else F.substring(_c(s), 1, chars)
    return F.transform(F.split(t, "\n", -1), lambda x: F.xxhash64(x))


def line_diff_counts(old_lines, new_lines) -> Column:
    """J4 of two arrays of line hashes: struct(added, removed) = occurrences of lines absent on the other side. The lines of both are
    sorted together and merged in one walk, which closes a run of equal lines when the next one begins."""
    both = F.array_sort(F.concat(F.transform(_c(old_lines), lambda x: F.struct(x.alias("x"), F.lit(False).alias("new"))),
                                 F.transform(_c(new_lines), lambda x: F.struct(x.alias("x"), F.lit(True).alias("new")))))
    none = F.lit(0)
    start = F.struct(F.lit(None).cast("bigint").alias("x"), none.alias("o"), none.alias("n"), none.alias("added"), none.alias("removed"))

    def closed(acc):
        return acc["added"] + F.when(acc["o"] == 0, acc["n"]).otherwise(0), acc["removed"] + F.when(acc["n"] == 0, acc["o"]).otherwise(0)

    def step(acc, e):
        same, old, new = acc["x"].eqNullSafe(e["x"]), F.when(e["new"], 0).otherwise(1), F.when(e["new"], 1).otherwise(0)
        added, removed = closed(acc)
        return F.struct(e["x"].alias("x"), (F.when(same, acc["o"]).otherwise(0) + old).alias("o"), (F.when(same, acc["n"]).otherwise(0) + new).alias("n"),
                        F.when(same, acc["added"]).otherwise(added).alias("added"), F.when(same, acc["removed"]).otherwise(removed).alias("removed"))
    return F.aggregate(both, start, step, lambda acc: F.struct(closed(acc)[0].alias("added"), closed(acc)[1].alias("removed")))


def diff_text(counts: Column) -> Column:
    return F.format_string("+%d lines added, -%d lines removed", counts["added"], counts["removed"])


def diff_summary(old, new, chars: int | None = None) -> Column:
    """'+A lines added, -R lines removed' between two whole texts (or the first ``chars`` characters of both)."""
    return diff_text(line_diff_counts(line_hashes(old, chars), line_hashes(new, chars)))


# Fixed prompt texts (must equal the original wording for identical model requests).
SYSTEM_PROMPT = (
    "You are a data extraction specialist. Extract structured data from the provided content "
    "according to the JSON schema below.\n\nSchema:\n{schema}\n\nInstructions:\n"
    "1. Extract all items matching the schema from the content\n"
    "2. Return a JSON object with an \"items\" array containing the extracted data\n"
    "3. If no items match, return {{\"items\": []}}\n"
    "4. Ensure all required fields are present\n"
    "5. Use null for optional fields that are not present\n"
)
INSTRUCTION_SUFFIX = "\n\nAdditional instructions: {instruction}"
USER_PROMPT = "Extract data from this {fmt} content:\n\n```{fmt}\n{content}\n```"


def llm_prompt(content, schema_json: str, instruction: str | None = None, fmt: str = "markdown"):
    """F16: (system, user) prompt columns; the schema text is a literal, the content a column."""
    system = SYSTEM_PROMPT.format(schema=schema_json)
    if instruction:
        system += INSTRUCTION_SUFFIX.format(instruction=instruction)
    pre, post = USER_PROMPT.split("{content}")
    user = F.concat(F.lit(pre.format(fmt=fmt)), _c(content), F.lit(post))
    return F.lit(system), user
