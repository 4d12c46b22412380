"""Text functions as column expressions: project names, evidence text, excerpts, salience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, as the results depend on them.
PATH_HINTS = ["projects", "project", "code", "repos", "repo", "workspace", "dev", "src", "side", "my", "documents", "desktop", "work"]
SALIENCE = {
    "error": r"error\w*|exception\w*|traceback\w*|crash\w*|fail\w*|bug\w*",
    "test": r"test\w*|pytest|unittest|regression\w*|coverage",
    "security": r"security|vulnerab\w*|cve-\d+|exploit\w*|credential\w*|secret\w*|leak\w*",
    "artifact": r"artifact\w*|screenshot\w*|deliverable\w*|export\w*|report\w*",
    "outcome": r"fixed|resolved|shipped|merged|deployed|completed|done|success\w*",
}
USER_HEAD, USER_TAIL, ASSISTANT_TAIL = 3, 2, 1
USER_CHARS, ASSISTANT_CHARS = 500, 300
BATCH_CHARS = 700
_MARKER = r"(?m)^(\s*(?:\[(?:USER \d+|USER LATE|ASSISTANT END)\]|\.\.\.)\s*$)"


def project_name(folder: Column) -> Column:
    """Clean lower-case leaf of an encoded project folder.

    Empty stays empty; a name of which nothing is left is `(top-level)`.
    """
    bare = F.regexp_replace(folder, r"(?is)--claude-worktrees-.*$", "")
    parts = F.split(F.ltrim(F.translate(bare, "_", "-"), F.lit("-")), "-", -1)
    parts = F.when(F.lower(F.get(parts, F.lit(0))).isin("users", "home"), F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    # leading hints go until the first other (or empty) part
    low = F.transform(parts, lambda p: F.lower(p))
    state = F.aggregate(
        low,
        F.struct(F.lit(True).alias("lead"), F.array().cast("array<string>").alias("kept")),
        lambda a, p: F.struct((a.lead & p.isin(PATH_HINTS)).alias("lead"), F.when(a.lead & p.isin(PATH_HINTS), a.kept).otherwise(F.concat(a.kept, F.array(p))).alias("kept")),
    )
    leaf = F.array_join(F.filter(state.kept, lambda p: p != ""), "-")
    return F.when(folder == "", "").otherwise(F.when(leaf == "", "(top-level)").otherwise(leaf))


def encode_folder(cwd: Column) -> Column:
    return F.translate(cwd, "\\/._", "----")


def collapse(text: Column) -> Column:
    """White space runs made one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def evidence_text(text: Column) -> Column:
    """Line breaks unified, lines that look like excerpt markers escaped, white space collapsed."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return collapse(F.regexp_replace(lines, _MARKER, r"\\$1"))


def compact(text: Column, budget: int) -> Column:
    """Evidence text within `budget` characters: whole, or head, ellipsis and tail."""
    whole = evidence_text(text)
    if budget <= 0:
        return F.lit("")
    if budget == 1:
        short = F.right(whole, F.lit(1))
    elif budget == 2:
        short = F.concat(F.left(whole, F.lit(1)), F.right(whole, F.lit(1)))
    else:
        head = max(1, (budget - 1) // 2)
        short = F.concat(F.left(whole, F.lit(head)), F.lit("…"), F.right(whole, F.lit(budget - head - 1)))
    return F.when(F.length(whole) <= budget, whole).otherwise(short)


def is_narrative(text: Column) -> Column:
    """Whether a message may go into an excerpt."""
    t = F.coalesce(text, F.lit(""))
    return (t != "") & ~t.startswith("<scheduled-task") & ~t.startswith("<system-reminder>") & ~t.contains("tool_use_id")


def is_real_user(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.trim(t) != "") & ~t.startswith("<") & ~t.contains("tool_use_id")


def excerpt(users: Column, assistants: Column) -> Column:
    """Excerpt of ordered message arrays: first three, last two of the user, the last answer."""
    n = F.size(users)
    head = F.slice(users, 1, USER_HEAD)
    numbered = F.transform(head, lambda m, i: F.when(compact(m, USER_CHARS) != "", F.concat(F.lit("[USER "), (i + 1).cast("string"), F.lit("]\n"), compact(m, USER_CHARS))))
    late = F.filter(F.when(n > USER_TAIL, F.slice(users, -USER_TAIL, USER_TAIL)).otherwise(users), lambda m: ~F.array_contains(head, m))
    tail = F.transform(late, lambda m: F.when(compact(m, USER_CHARS) != "", F.concat(F.lit("[USER LATE]\n"), compact(m, USER_CHARS))))
    gap = F.when(n > USER_HEAD + USER_TAIL, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    last = F.when(F.size(assistants) > 0, F.slice(assistants, -ASSISTANT_TAIL, ASSISTANT_TAIL)).otherwise(F.array().cast("array<string>"))
    end = F.transform(last, lambda m: F.when(compact(m, ASSISTANT_CHARS) != "", F.concat(F.lit("[ASSISTANT END]\n"), compact(m, ASSISTANT_CHARS))))
    return F.array_join(F.filter(F.concat(numbered, gap, tail, end), lambda p: p.isNotNull()), "\n\n")


def excerpt_blocks(text: Column) -> Column:
    """array<struct<role, text>> of an excerpt."""
    pieces = F.filter(F.split(F.concat(F.lit("\n\n"), text), r"\n\n(?=\[(?:USER \d+|USER LATE|ASSISTANT END)\]\n|\.\.\.)"), lambda p: p.startswith("["))
    return F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, r"^\[([^\]]*)\]", 1).alias("role"), F.trim(F.regexp_replace(p, r"^\[[^\]]*\]\n", "")).alias("text")))


def shortened(text: Column, budget: Column) -> Column:
    """As `compact`, for evidence text that is already normal and a budget that is a column."""
    head = F.greatest(F.lit(1), F.floor((budget - 1) / 2).cast("int"))
    cut = F.concat(F.left(text, head), F.lit("…"), F.right(text, (budget - head - 1).cast("int")))
    two = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    short = F.when(budget <= 0, "").when(budget == 1, F.right(text, F.lit(1))).when(budget == 2, two).otherwise(cut)
    return F.when(F.length(text) <= budget, text).otherwise(short)


def batch_excerpt(text: Column, budget: int = BATCH_CHARS) -> Column:
    """An excerpt's first and latest user message and its last answer within `budget` characters.

    What the marks leave is shared 1:1:2; room a block doesn't need goes to the answer, then to the
    messages in order. If the least of each (1, 1 and 3 characters) doesn't fit, the latest message
    goes first, then the first one; at last the answer stands without its mark.
    """
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    is_end = lambda b: b.role == "ASSISTANT END"
    least = lambda b: F.least(F.length(b.text), F.when(is_end(b), 3).otherwise(1))
    marks = lambda bs: F.aggregate(bs, F.lit(0), lambda n, b: n + F.length(b.role) + 3) + 2 * F.greatest(F.lit(0), F.size(bs) - 1)
    fits = lambda bs: (F.size(bs) > 0) & (marks(bs) + F.aggregate(bs, F.lit(0), lambda n, b: n + least(b)) <= budget)
    some = lambda *bs: F.filter(F.array(*bs), lambda b: b.isNotNull())

    def share(bs: Column) -> Column:
        # the answer comes first, as it is the first to get what others leave
        spare = budget - marks(bs) - F.aggregate(bs, F.lit(0), lambda n, b: n + least(b))
        weights = F.aggregate(bs, F.lit(0), lambda n, b: n + F.when(is_end(b), 2).otherwise(1))

        def first(spare_and_weights: Column) -> Column:
            own = lambda b: F.floor(spare_and_weights.spare * F.when(is_end(b), 2).otherwise(1) / spare_and_weights.weights).cast("int")
            return F.transform(bs, lambda b: F.struct(b.alias("b"), (least(b) + F.least(own(b), F.length(b.text) - least(b))).alias("n")))

        def rest(dealt: Column) -> Column:
            left = budget - marks(bs) - F.aggregate(dealt, F.lit(0), lambda n, d: n + d.n)
            room = lambda i: F.aggregate(F.slice(dealt, F.lit(1), i), F.lit(0), lambda n, d: n + F.length(d.b.text) - d.n)
            more = lambda d, i: F.least(F.length(d.b.text) - d.n, F.greatest(F.lit(0), left - room(i)))
            return F.transform(dealt, lambda d, i: F.concat(F.lit("["), d.b.role, F.lit("]\n"), shortened(d.b.text, d.n + more(d, i))))

        parts = bound(bound(F.struct(spare.alias("spare"), weights.alias("weights")), first), rest)
        in_order = lambda p: F.when(is_end(bs[0]), F.concat(F.slice(p, 2, 2), F.slice(p, 1, 1))).otherwise(p)
        return F.array_join(bound(parts, in_order), "\n\n")

    def chosen(blocks: Column) -> Column:
        users = F.filter(blocks, lambda b: b.role.startswith("USER"))
        end = F.try_element_at(F.filter(blocks, is_end), F.lit(-1))
        early, late = F.try_element_at(users, F.lit(1)), F.try_element_at(users, F.lit(-1))
        return F.struct(some(end, early, F.when(late != early, late)).alias("three"), some(end, early).alias("two"), some(end).alias("one"))

    def made(c: Column) -> Column:
        kept = F.when(fits(c.three), c.three).when(fits(c.two), c.two).when(fits(c.one), c.one)
        bare = F.coalesce(F.get(c.one, F.lit(0)).text, evidence_text(text))
        return bound(kept, lambda k: F.when(k.isNull(), shortened(bare, F.lit(budget))).otherwise(share(k)))

    whole = bound(bound(excerpt_blocks(text), chosen), made)
    return F.when((F.coalesce(text, F.lit("")) == "") | F.lit(budget <= 0), "").otherwise(whole)


def provenance(source: Column, native: Column) -> Column:
    """Where a session's shown text comes from: its summary's source, its native title or its first message."""
    return F.coalesce(source, F.when(F.coalesce(native, F.lit("")) != "", "native_title").otherwise("first_message"))


def narrative(text: Column) -> Column:
    """Fallback summary of an excerpt: the first user message, or both ends of the user's messages."""
    users = F.transform(F.filter(excerpt_blocks(text), lambda b: b.role.startswith("USER")), lambda b: b.text)
    first, last = F.element_at(users, 1), F.element_at(users, -1)
    some = F.when(F.size(users) == 1, F.left(first, F.lit(120))).otherwise(F.concat(F.left(first, F.lit(60)), F.lit(" → "), F.left(last, F.lit(60))))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.size(users) == 0, F.left(collapse(text), F.lit(120))).otherwise(some)


def salience(text: Column) -> Column:
    """Codes whose words a text holds, in fixed order."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.when(t.rlike(rf"(?i)\b(?:{p})\b"), F.lit(c)) for c, p in SALIENCE.items()]), lambda c: c.isNotNull())


def bucket_name(raw: Column) -> Column:
    """Normal form of a proposed label: lower case, single spaces, at most 60 characters; else null."""
    name = collapse(F.lower(raw))
    return F.when((name != "") & (F.length(name) <= 60) & ~name.rlike(r"[\x00-\x1f\x7f]"), name)


def strip_task(text: Column) -> Column:
    """Content of a text that is one <task> envelope; other texts stay."""
    return F.regexp_replace(text, r"(?s)^\s*<task>\s*(.*?)\s*</task>\s*$", "$1")


def unwrap_request(text: Column) -> Column:
    """Content of <USER_REQUEST>, or the text without metadata blocks."""
    inner = F.regexp_extract(text, r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1)
    bare = F.regexp_replace(text, r"(?s)<(ADDITIONAL_METADATA|USER_SETTINGS_CHANGE|EPHEMERAL_MESSAGE)>.*?</\1>", "")
    return F.trim(F.when(text.contains("<USER_REQUEST>"), inner).otherwise(bare))


def redact_paths(text: Column) -> Column:
    """Absolute paths replaced, Markdown emphasis and headings removed."""
    t = F.regexp_replace(text, r"(?<![\w/])(?:/[\w.@~+-]+){2,}/?", "[path]")
    t = F.regexp_replace(t, r"(?i)\b[a-z]:\\[^\s\"']+", "[path]")
    return collapse(F.regexp_replace(F.regexp_replace(t, r"(?m)^#{1,6}\s+", ""), r"\*\*|__|`", ""))


def repository_slug(remote: Column) -> Column:
    """owner/name of a GitHub remote, else null."""
    slug = F.regexp_extract(F.trim(remote), r"github\.com[:/]([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return F.when(slug != "", slug)


def package_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def file_uuid(path: Column) -> Column:
    """Trailing UUID of a file name, else null."""
    found = F.regexp_extract(path, r"([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})(?:\.[^./]*)?$", 1)
    return F.when(found != "", found)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON with fixed keys."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i:02d}") for i, p in enumerate(parts)])), 256)


def slice_id(version: int, agent: Column, session: Column, evidence: Column) -> Column:
    """Internal name of a clipped session."""
    return F.concat(F.lit("slice-"), F.left(F.sha2(F.concat_ws("\u0000", F.lit(str(version)), agent, session, evidence), 256), F.lit(24)))
