"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of secrets, in the order they are replaced.
SECRET_PATTERNS = ["sk-[A-Za-z0-9_-]{16,}", "AKIA[A-Z0-9]{16}", "LTAI[A-Za-z0-9]{12,}"]
REDACTED = "<redacted-secret>"
# Line ends of the text convention the records were written with.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
TERM = "[A-Za-z_][A-Za-z0-9_]+|[一-鿿]{2,}"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def redact_secrets(text: Column | str) -> tuple[Column, Column]:
    """Text with secrets replaced, and how many there were: each pattern sees the last one's result."""
    text, count = _col(text), F.lit(0)
    for p in SECRET_PATTERNS:
        count = count + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, REDACTED)
    return text, count.cast("bigint")


def sanitize_paths(text: Column | str, replacements: list[tuple[Column | str, str]]) -> Column:
    """Literal replacements in order; an empty or null source replaces nothing."""
    out = _col(text)
    for source, target in replacements:
        s = F.lit(source) if isinstance(source, str) else source
        out = F.when(F.coalesce(s, F.lit("")) == "", out).otherwise(F.replace(out, s, F.lit(target)))
    return out


def redact_paths(text: Column | str, repo: str | None = None, compat: bool = False) -> Column:
    """User home paths and the repository path to placeholders.

    ``compat`` keeps the historical character class, which also ends a path at a letter s
    and runs on over blanks.
    """
    out = _col(text)
    if repo:
        out = F.replace(out, F.lit(repo), F.lit("<repo>"))
    return F.regexp_replace(out, "/Users/[^\\\\s:'\"]+" if compat else "/Users/[^\\s:'\"]+", "<user-path>")


def text_sha256(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def text_sha1(text: Column | str) -> Column:
    return F.sha1(_col(text))


def reverse_patch_sha256(patch: Column | str) -> Column:
    return F.sha2(F.concat(F.lit("reverse\u0000"), _col(patch)), 256)


def lines(text: Column | str) -> Column:
    """All line ends count; no empty element after a final one; empty text has no lines."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def patch_file_count(patch: Column | str) -> Column:
    return F.size(F.filter(lines(patch), lambda l: l.startswith("diff --git "))).cast("bigint")


def patch_changed_lines(patch: Column | str) -> Column:
    """Added and removed lines, without file headers."""
    changed = lambda l: (l.startswith("+") & ~l.startswith("+++")) | (l.startswith("-") & ~l.startswith("---"))
    return F.size(F.filter(lines(patch), changed)).cast("bigint")


def patch_files(patch: Column | str) -> Column:
    """Sorted distinct new-side names of a unified diff."""
    names = F.regexp_extract_all(_col(patch), F.lit("(?m)^diff --git \\S+ (\\S+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(names, lambda f: F.when(f.startswith("b/"), F.substring(f, 3, 1 << 30)).otherwise(f))))


def mutation_kind(instance_id: Column | str) -> Column:
    """What stands between an id's last dot and the first double underscore after it."""
    return F.substring_index(F.substring_index(_col(instance_id), ".", -1), "__", 1)


def repo_profile(name: Column | str) -> Column:
    """owner, repo and commit of ``prefix/owner__repo.commit``."""
    return F.struct(*[F.regexp_extract(_col(name), "^(?:[^/]+/)?(.+?)__(.+)\\.([0-9a-f]+)$", i).alias(n) for i, n in ((1, "owner"), (2, "repo"), (3, "commit"))])


def github_slug(name: Column | str) -> Column:
    p = repo_profile(name)
    return F.concat(p["owner"], F.lit("/"), p["repo"])


def image_name(instance_id: Column | str, prefix: str = "registry/eval") -> Column:
    """Container image of a task: lower-cased id, double underscores spelt out."""
    return F.concat(F.lit(prefix + "."), F.replace(F.lower(_col(instance_id)), F.lit("__"), F.lit("_s_")))


def cache_key(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "-")


def normalize_dataset(name: Column | str, aliases: dict[str, str]) -> Column:
    """Aliases by lower-cased name; unknown names pass, missing ones are 'unknown'."""
    text = F.trim(F.coalesce(F.nullif(_col(name), F.lit("")), F.lit("unknown")))
    out = text
    for alias, target in sorted(aliases.items()):
        out = F.when(F.lower(text) == alias, F.lit(target)).otherwise(out)
    return out


def normalize_dataset_default(name: Column | str, known: list[str], default: str) -> Column:
    """The first known name that the text contains, else the default."""
    text = F.lower(F.coalesce(_col(name), F.lit("")))
    return F.coalesce(*[F.when(text.contains(k.lower()), F.lit(k)) for k in known], F.lit(default))


def clip_head(text: Column | str, n: int, notice: str = "") -> Column:
    t = _col(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.left(t, F.lit(n)), F.lit(notice)))


def clip_tail(text: Column | str, n: int) -> Column:
    return F.right(_col(text), F.lit(n))


def clip_middle(text: Column | str, n: int, notice: str = "\n...\n") -> Column:
    """The first two thirds and the last third of the room."""
    t, head = _col(text), n * 2 // 3
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.left(t, F.lit(head)), F.lit(notice), F.right(t, F.lit(n - head))))


def terms(text: Column | str, split_underscore: bool = False) -> Column:
    """Lower-cased identifiers and runs of two or more CJK characters; optionally their parts too."""
    found = F.transform(F.regexp_extract_all(_col(text), F.lit(TERM), F.lit(0)), F.lower)
    if split_underscore:
        parts = F.filter(F.flatten(F.transform(found, lambda t: F.split(t, "_"))), lambda t: F.length(t) >= 2)
        found = F.array_distinct(F.concat(found, parts))
    return found


def estimated_tokens(chars: Column) -> Column:
    """At least one; three and a half characters each."""
    return F.greatest(F.lit(1), F.ceil(chars / F.lit(3.5).cast("double"))).cast("bigint")


def estimate_message_tokens(messages: Column | str) -> Column:
    size = lambda m: F.length(F.coalesce(m["role"], F.lit(""))) + F.length(F.coalesce(m["content"], F.lit(""))) + 24
    return estimated_tokens(F.aggregate(_col(messages), F.lit(0), lambda a, m: a + size(m)))


def last_int(text: Column | str, pattern: str) -> Column:
    """The pattern's first group in its last match."""
    return F.try_element_at(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1)), F.lit(-1)).cast("bigint")


def test_counts(output: Column | str) -> Column:
    return F.struct(*[F.coalesce(last_int(output, f"(\\d+) {k}"), F.lit(0)).alias(k) for k in ("passed", "failed", "skipped", "error")])


def all_skipped(output: Column | str) -> Column:
    c = test_counts(output)
    return (c["skipped"] > 0) & (c["passed"] + c["failed"] + c["error"] == 0)


def exit_code(text: Column | str) -> Column:
    return last_int(text, "exit_code=(-?\\d+)")


def safe_name(text: Column | str, with_hash: bool = False) -> Column:
    out = F.regexp_replace(_col(text), "[^A-Za-z0-9_.-]+", "_")
    return F.concat(out, F.lit("-"), F.left(text_sha256(text), F.lit(12))) if with_hash else out


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_role(path: Column | str) -> Column:
    p = F.lower(_col(path))
    return (
        F.when(p.rlike("(^|/)tests?/|(^|/)test_[^/]*$|_test\\.[a-z]+$"), "test")
        .when(p.rlike("\\.(md|rst|txt)$"), "docs")
        .when(p.rlike("\\.(toml|cfg|ini|ya?ml|json)$"), "config")
        .otherwise("source")
    )


def file_language(path: Column | str) -> Column:
    extension = F.regexp_extract(F.lower(_col(path)), "\\.([a-z0-9]+)$", 1)
    known = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "cpp": "cpp", "md": "markdown", "sh": "shell"}
    out = F.lit("other")
    for e, name in known.items():
        out = F.when(extension == e, F.lit(name)).otherwise(out)
    return out


def module_name(path: Column | str) -> Column:
    """Dotted Python module of a path; a package's ``__init__`` is the package."""
    stem = F.regexp_replace(F.regexp_replace(_col(path), "\\.py$", ""), "(^|/)__init__$", "")
    return F.replace(F.regexp_replace(stem, "^(src|lib)/", ""), F.lit("/"), F.lit("."))


def problem_tags(text: Column | str, rules: dict[str, list[str]]) -> Column:
    """Sorted names of all rules with a word that the text contains."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    hit = lambda words: [t.contains(w) for w in words]
    tags = F.array(*[F.when(_any(hit(ws)), F.lit(name)) for name, ws in sorted(rules.items())])
    return F.array_sort(F.array_compact(tags))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def contains_any(text: Column | str, markers: list[str]) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return _any([t.contains(m) for m in markers])


def first_match(text: Column | str, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first rule of which the text contains a marker."""
    out = F.lit(default)
    for label, markers in reversed(rules):
        out = F.when(contains_any(text, markers), F.lit(label)).otherwise(out)
    return out


def record_kind(source: Column | str) -> Column:
    return first_match(F.lower(_col(source)), [("trajectory", ["traj"]), ("episode", ["episode"]), ("task", ["task"]), ("result", ["result"])], "record")


def mentioned_files(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit("[\\w./-]+\\.(?:py|js|ts|go|rs|java|c|cpp|md|toml|json|ya?ml)\\b"), F.lit(0))))


def files_read(command: Column | str) -> Column:
    c = _col(command)
    return F.when(c.rlike("^\\s*(cat|head|tail|less|sed -n|grep|rg)\\b"), mentioned_files(c)).otherwise(F.array().cast("array<string>"))


def files_changed(command: Column | str) -> Column:
    c = _col(command)
    return F.when(c.rlike(">|^\\s*(sed -i|mv|cp|rm|tee|patch|git apply)\\b"), mentioned_files(c)).otherwise(F.array().cast("array<string>"))


def shell_quote(text: Column | str) -> Column:
    t = _col(text)
    return F.when(t.rlike("^[A-Za-z0-9_@%+=:,./-]+$"), t).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def test_command(targets: Column | str, runner: str = "python -m pytest -q") -> Column:
    return F.concat_ws(" ", F.lit(runner), F.array_join(F.transform(_col(targets), shell_quote), " "))


def observation(tool: Column | str, output: Column | str, code: Column | str) -> Column:
    """How a tool's result is shown to the model."""
    return F.concat(F.lit("[tool_result] "), _col(tool), F.coalesce(F.concat(F.lit(" exit_code="), _col(code).cast("string")), F.lit("")), F.lit("\n"), F.coalesce(_col(output), F.lit("")))


def observation_tool(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(text), "^\\[tool_result\\] ([A-Za-z_]+)", 1), F.lit(""))


def ordered_head(values: Column | str, n: int) -> Column:
    """First occurrences in order, at most ``n``."""
    return F.slice(F.array_distinct(F.filter(_col(values), lambda v: v.isNotNull() & (v != ""))), 1, n)


def numbered(text: Column | str, max_chars: int | None = None) -> Column:
    t = _col(text) if max_chars is None else F.left(_col(text), F.lit(max_chars))
    return F.array_join(F.transform(lines(t), lambda l, i: F.concat(F.lpad((i + 1).cast("string"), 4, "0"), F.lit(": "), l)), "\n")


def retry_budget(attempt: Column | str, first: int = 12_000, least: int = 2_000) -> Column:
    """Halved for every attempt after the first."""
    return F.greatest(F.lit(least), F.floor(F.lit(first) / F.pow(F.lit(2), F.greatest(F.lit(0), _col(attempt) - 1)))).cast("bigint")


def input_budget(window: Column | str, output: Column | str) -> Column:
    return F.greatest(F.lit(1), _col(window) - _col(output)).cast("bigint")


def is_overflow_message(text: Column | str) -> Column:
    return contains_any(F.lower(_col(text)), ["context length", "context window", "maximum context", "too many tokens", "prompt is too long"])


def new_file_patch(path: Column | str, content: Column | str) -> Column:
    ls, p = lines(content), _col(path)
    head = F.format_string("diff --git a/%s b/%s\nnew file mode 100644\n--- /dev/null\n+++ b/%s\n@@ -0,0 +1,%d @@\n", p, p, p, F.size(ls))
    return F.concat(head, F.array_join(F.transform(ls, lambda l: F.concat(F.lit("+"), l)), "\n"), F.lit("\n"))


def excerpt(paths: Column | str, contents: Column | str, n: int) -> Column:
    """Files one after the other under their names, cut to ``n`` characters in all."""
    return F.left(F.array_join(F.zip_with(_col(paths), _col(contents), lambda p, c: F.concat(F.lit("### "), p, F.lit("\n"), c)), "\n\n"), F.lit(n))


def first_non_blank(*columns: Column | str) -> Column:
    return F.coalesce(*[F.when(F.trim(_col(c)) != "", F.trim(_col(c))) for c in columns])


def or_default(column: Column | str, default: str) -> Column:
    """Null and empty alike give the default."""
    return F.coalesce(F.nullif(_col(column), F.lit("")), F.lit(default))


def trajectory_id(dataset: Column | str, instance_id: Column | str, sample_index: Column | str) -> Column:
    return F.format_string("%s:%s:sample_%02d", or_default(dataset, "unknown"), _col(instance_id), F.coalesce(_col(sample_index), F.lit(0)).cast("int"))


def length_bucket(tokens: Column | str, bounds: list[int], above: str = "above", fail: bool = False) -> Column:
    """Label of the first bound not exceeded; beyond the last ``above``, or an error."""
    t = _col(tokens)
    out = F.raise_error(F.concat(F.lit("length over the last bound: "), t.cast("string"))) if fail else F.lit(above)
    for b in sorted(bounds, reverse=True):
        out = F.when(t <= b, F.lit(f"<={b}")).otherwise(out)
    return out


REPORT_BOUNDS = [4096, 8192, 16384, 32768]
ADAPTER_BOUNDS = [4096, 8192, 16384, 24576, 32768]
CRITIC_BOUNDS = [4096, 8192, 16384, 32768, 49152, 65536]
