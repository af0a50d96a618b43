"""Column expressions over file paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a file's name or extension says about the technology in use.
STACK_BY_NAME = {
    "Rust": ["cargo.toml", "cargo.lock"],
    "Node.js": ["package.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "package-lock.json"],
    "Python": ["pyproject.toml", "requirements.txt", "requirements-dev.txt", "pipfile", "poetry.lock", "setup.py", "setup.cfg"],
    "Go": ["go.mod", "go.sum"],
    "Ruby": ["gemfile", "gemfile.lock"],
    "PHP": ["composer.json", "composer.lock"],
    "Java": ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties"],
    "Elixir": ["mix.exs", "mix.lock"],
    "Docker": ["dockerfile", "dockerfile.dev"],
    "Deno": ["deno.json", "deno.jsonc"],
    "Haskell": ["cabal.project", "stack.yaml"],
    "Scala": ["build.sbt"],
    "Dart": ["pubspec.yaml"],
}
STACK_BY_EXTENSION = {
    "Rust": ["rs"], "Python": ["py"], "JavaScript": ["js", "jsx"], "TypeScript": ["ts", "tsx"], "Go": ["go"], "Ruby": ["rb"], "PHP": ["php"], "Java": ["java"],
    "Kotlin": ["kt", "kts"], ".NET": ["cs", "fs", "vb"], "Swift": ["swift"], "Scala": ["scala"], "C": ["c", "h"], "C++": ["cc", "cpp", "cxx", "hpp", "hh"], "SQL": ["sql"], "Terraform": ["tf", "tfvars"],
}
#: Languages that a code fence may name.
FENCES = ["bash", "c", "c++", "cpp", "c#", "css", "dart", "elixir", "go", "haskell", "html", "java", "javascript", "json", "kotlin", "lua", "markdown", "objective-c", "perl", "php", "python", "r", "ruby", "rust", "scala", "shell", "sql", "swift", "toml", "tsx", "typescript", "xml", "yaml", "zig"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def display(path: Column, root: str = "") -> Column:
    """The path below root, with forward slashes."""
    p = path
    if root:
        head = root.rstrip("/") + "/"
        p = F.when(path.startswith(head) & (F.length(path) > len(head)), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)
    return F.replace(p, F.lit("\\"), F.lit("/"))


def absolute(path: Column, root: str) -> Column:
    """Blank paths are null; relative ones are joined to root."""
    p = F.trim(path)
    return F.when(p == "", None).when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def seed(path: Column, root: str = "") -> Column:
    """A graph seed: below root, without any leading ./"""
    return F.regexp_replace(display(path, root), r"^(\./)+", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension in lower case, '' where there is none (as for dot files)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def in_prefixes(path: Column, prefixes: list[str]) -> Column:
    """Plain prefixes, not whole path parts; no prefix: every path."""
    given = [p.strip() for p in prefixes if p.strip()]
    return any_of([path.startswith(p) for p in given]) if given else F.lit(True)


def in_extensions(path: Column, extensions: list[str]) -> Column:
    given = [e.strip().lstrip(".").lower() for e in extensions if e.strip().lstrip(".")]
    return extension(path).isin(given) if given else F.lit(True)


def allowed(path: Column, scope: list[str], exclude: list[str], root: str = "") -> Column:
    """In scope (if there is one) and not excluded, by the path as it is or below root. Blank entries match nothing; a slash at the end does not count."""
    clean = lambda given: [g.strip().rstrip("/") for g in given if g.strip()]
    hits = lambda given: any_of([c.startswith(g) for g in clean(given) for c in (path, display(path, root))])
    inside = hits(scope) if scope else F.lit(True)
    return inside & ~hits(exclude)


def is_test(path: Column) -> Column:
    low, s = F.lower(path), stem(path)
    return low.contains("/tests/") | low.contains("\\tests\\") | low.contains("__tests__") | s.rlike(r"^test_|_test$|\.spec$|\.test$")


def technologies(path: Column) -> Column:
    """The labels of a path, at most one by name and one by extension."""
    name, ext = F.lower(file_name(path)), extension(path)
    by = lambda c, m: reduce(lambda w, kv: w.when(c.isin(kv[1]), kv[0]), m.items(), F.when(F.lit(False), ""))
    return F.array_compact(F.array(by(name, STACK_BY_NAME), by(ext, STACK_BY_EXTENSION)))


def fence(language: Column) -> Column:
    low = F.lower(F.trim(language))
    return F.when(low.isin(FENCES), F.replace(low, F.lit(" "), F.lit("_"))).otherwise(F.lit("text"))
