"""Text functions: files and paths, lines, symbols, LLM output, JSON recovery, LaTeX repair and log lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders that are never listed or searched.
IGNORED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".cache", ".pytest_cache", ".mypy_cache", ".idea", ".vscode", "target", ".obsidian"]
# Languages by file suffix.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".kt": "Kotlin", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".h": "C",
    ".cpp": "C++", ".hpp": "C++", ".cs": "C#", ".swift": "Swift", ".m": "Objective-C", ".sh": "Shell", ".md": "Markdown", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".sql": "SQL",
}
# File names that point to a framework.
FRAMEWORKS = {
    "package.json": "Node.js", "requirements.txt": "Python (pip)", "pyproject.toml": "Python (pyproject)", "Pipfile": "Python (pipenv)", "pom.xml": "Java (Maven)", "build.gradle": "Java/Kotlin (Gradle)", "build.gradle.kts": "Kotlin (Gradle)",
    "Cargo.toml": "Rust (Cargo)", "go.mod": "Go modules", "Gemfile": "Ruby (Bundler)", "composer.json": "PHP (Composer)", "Dockerfile": "Docker", "docker-compose.yml": "Docker Compose", ".csproj": "C# (.NET)",
}
# Patterns of declarations by file suffix; the group is the name.
SYMBOLS = {
    ".py": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    ".js": [("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("const", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(")],
    ".java": [("class", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s*(?:public|private|protected)\s+[\w<>\[\],\s]+?\s(\w+)\s*\(")],
    ".kt": [("class", r"^\s*(?:data\s+|sealed\s+|abstract\s+)*class\s+(\w+)"), ("function", r"^\s*fun\s+(\w+)"), ("object", r"^\s*object\s+(\w+)")],
    ".go": [("function", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^\s*type\s+(\w+)\s+struct")],
    ".rs": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)")],
}
SYMBOLS |= {s: SYMBOLS[".js"] for s in (".jsx", ".ts", ".tsx")}
# Repairs of LaTeX in a line, in this order; lookarounds and groups as in Java.
LATEX = [
    (r"\\\[", r"\$\$"), (r"\\\]", r"\$\$"), (r"\\\(", r"\$"), (r"\\\)", r"\$"), (r"(\$\$)(\*\*)", "$1\n$2"), (r"(\$\$)(###)", "$1\n$2"), (r"(\$\$)(\S)", "$1\n$2"),
    (r"(?<!\S)\$(\s*[^\$]+?\s*)\$(?![\*\.$])", r"\$$1\$"), (r"(?<!\S)\$(?!\s|\$)", r"\$"), (r"\$(?![\*\.$\s])", r"\$ "), (r"\*\* \$(.*?)\$\*\*", r"**\$$1\$**"),
]


def suffix(path: Column) -> Column:
    """The file suffix with its dot, lower-cased, or ''."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ignored(path: Column) -> Column:
    """Whether any folder on the path is one that is never searched."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def folders(df: DataFrame, path: str = "path") -> DataFrame:
    """path and depth of every folder that the paths name."""
    parts = F.split(path, "/")
    up_to = lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), k.alias("depth"))
    held = df.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), up_to)).alias("d"))
    return held.select("d.path", "d.depth").distinct()


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: the other columns, line (from 1) and line_text."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(text, "\n")).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def grep(df: DataFrame, pattern: str, *, text: str = "text", ignore_case: bool = False) -> DataFrame:
    """Lines that match a Java regular expression; nothing is shuffled."""
    return lines(df, text).where(F.col("line_text").rlike(("(?i)" if ignore_case else "") + pattern))


def symbols(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, kind and name of declarations; every pattern of the suffix that matches a line gives a row."""
    ext = suffix(F.col(path))
    found = lambda kind, p: F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line_text", f"(?U){p}", 1).alias("name"))
    table = reduce(lambda acc, e: F.when(ext == e, F.array(*[found(k, p) for k, p in SYMBOLS[e]])).otherwise(acc), SYMBOLS, F.array().cast("array<struct<kind:string,name:string>>"))
    return lines(df.where(ext.isin(list(SYMBOLS))), text).select(path, "line", F.inline(table)).where("name <> ''")


def replace_n(text: Column, old: str, new: str, n: int | None = None) -> Column:
    """The first n occurrences of a literal (all, if None) replaced."""
    if n is None:
        return F.replace(text, F.lit(old), F.lit(new))
    return F.array_join(F.concat(F.array(F.array_join(F.slice(F.split(text, re.escape(old), n + 1), 1, n + 1), new))), "")


def safe_name(name: Column) -> Column:
    """Characters that file names can't have become spaces."""
    return F.regexp_replace(name, r'[/:*?"<>|]', " ")


def numbered_list(text: Column) -> Column:
    """The items of lines like '1. item' or '2) item'."""
    rows = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(rows, lambda x: x.rlike(r"^\d+[.)]")), lambda x: F.regexp_extract(x, r"^\d+[.)]\s*(.*)", 1))


def fix_latex(text: Column) -> Column:
    """The repairs of LATEX on each line, then no space inside single dollars. A line keeps its line end, which some repairs look at."""
    parts = F.split(text, "\n")
    kept = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    fixed = F.transform(kept, lambda x: reduce(lambda c, pr: F.regexp_replace(c, *pr), LATEX, x))
    return F.array_join(F.transform(fixed, lambda x: F.regexp_replace(x, r"\$\s*(.*?)\s*\$", r"\$$1\$")), "")


def json_array_text(text: Column) -> Column:
    """From the first [ to the last ], or null."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def recover_json(text: Column) -> Column:
    """The first that parses of: the whole text, a fenced json block, the first braces or brackets; a VARIANT, or null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    some = lambda c: F.try_parse_json(F.nullif(c, F.lit("")))
    return F.coalesce(some(F.trim(text)), some(F.trim(fenced)), some(bare))


def dissect(text: Column, pattern: str, trim: bool = False) -> dict[str, Column]:
    """Columns of a pattern like '%{a} [%{b}] %{+a}': the whole pattern must match, else all are null.

    Keys with + append to their first value with a space; keys that are empty or start with ? are dropped.
    """
    keys = re.findall(r"%\{([^}]*)\}", pattern)
    parts = re.split(r"%\{[^}]*\}", pattern)
    regex = "(?s)^" + re.escape(parts[0]) + "".join("(.*?)" + re.escape(p) for p in parts[1:]) + "$"
    ok = text.rlike(regex)
    out: dict[str, list[Column]] = {}
    for i, k in enumerate(keys, 1):
        if k and not k.startswith("?"):
            value = F.regexp_extract(text, regex, i)
            out.setdefault(k.removeprefix("+"), []).append(F.trim(value) if trim else value)
    return {k: F.when(ok, F.concat_ws(" ", *v)) for k, v in out.items()}


def html_element(html: Column, element_id: str | None = None, tag: str | None = None) -> Column:
    """The inside of the element with the id, else of the tag, else of the body, else the whole page."""
    inside = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    tries = []
    if element_id:
        tries.append(F.nullif(F.regexp_extract(html, rf"(?is)<(\w+)[^>]*\bid=[\"']{re.escape(element_id)}[\"'][^>]*>(.*?)</\1>", 2), F.lit("")))
    if tag:
        tries.append(inside(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"))
    return F.coalesce(*tries, inside(r"(?is)<body\b[^>]*>(.*)</body>"), html)
