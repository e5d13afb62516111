"""Dependency manifests: loose npm and Python requirements, lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions.text import message, trim_space
from argusframe.schema import SCANNER_ORD, as_findings

# Manifests and what counts as loose or pinned.
PACKAGE_MANIFEST = "package.json"
REQUIREMENTS = "requirements.txt"
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
LOOSE_VERSIONS = ("*", "latest")
PINS = ("==", ">=", "~=")

_STRING_KIND = "STRING"

# What is found: rule, severity, place of the rule, file, title, description, advice.
_CHECKS = (
    ("unpinned-npm", "medium", 1, PACKAGE_MANIFEST, "Loose dependency: {package}",
     "`{package}` asks for \"{version}\", so any release may be installed.", "Pin {package} to a version range."),
    ("git-dependency", "medium", 1, PACKAGE_MANIFEST, "Dependency from git: {package}",
     "`{package}` comes from a git address and skips the registry.", "Use a published release of {package}."),
    ("missing-lockfile", "medium", 2, PACKAGE_MANIFEST, "No lock file",
     "Versions may drift between installations because no lock file is kept.", "Create a lock file and commit it."),
    ("unpinned-python", "low", 3, REQUIREMENTS, "Loose Python dependency: {package}",
     "`{package}` has no version bound.", "Pin {package} to a version."),
)
_UNPINNED_NPM, _GIT, _NO_LOCK, _UNPINNED_PYTHON = range(len(_CHECKS))
_HIT = "struct<check:int,package:string,version:string,line:int,seq:int>"

_MANIFEST = "array<struct<dependencies:map<string,variant>,devDependencies:map<string,variant>>>"


def _parse_manifest(content: Column) -> Column:
    """``array<struct<dependencies, devDependencies>>`` with the one document,
    null or of another size when the text is no JSON document. It is read as
    the only item of an array, so that text behind it makes it unreadable."""
    return F.from_json(F.concat(F.lit("["), content, F.lit("]")), _MANIFEST, {"allowSingleQuotes": "false"})


def _with_documents(manifests: DataFrame) -> DataFrame:
    """Adds ``documents``, the parsed text, and ``readable``. The generator
    keeps later filters from parsing again. A document whose maps have other
    types is readable too and has no entries; only such are parsed a second
    time, without a schema. With a ``path``, other files than the manifest are not parsed."""
    mine = F.col("path") == PACKAGE_MANIFEST if "path" in manifests.columns else F.lit(True)
    parsed = manifests.select("*", F.explode(F.array(F.when(mine, _parse_manifest(F.col("content"))))).alias("documents"))
    wrapped = F.concat(F.lit("["), F.col("content"), F.lit("]"))
    plain = F.try_variant_get(F.try_parse_json(wrapped), "$", "array<variant>")
    other = (F.size(plain) == 1) & ~F.is_variant_null(F.get(plain, F.lit(0)))
    typed = (F.size("documents") == 1) & F.get("documents", F.lit(0)).isNotNull()
    return parsed.withColumn("readable", mine & F.when(~mine | typed, True).otherwise(F.coalesce(other, F.lit(False))))


def _entries(field: str) -> Column:
    none = F.expr("cast(map() as map<string,variant>)")
    document = F.when(F.size("documents") == 1, F.get("documents", F.lit(0)))
    return F.map_entries(F.coalesce(document[field], none))


def read_package_manifests(files: DataFrame) -> DataFrame:
    """``(target_id, dependencies, dev_dependencies)`` of each readable root
    manifest, as arrays of entries in document order."""
    manifests = files.filter(F.col("path") == PACKAGE_MANIFEST).select("target_id", "content")
    return _with_documents(manifests).filter("readable").select(
        "target_id", _entries("dependencies").alias("dependencies"), _entries("devDependencies").alias("dev_dependencies"))


def read_requirements(files: DataFrame) -> DataFrame:
    return (
        files.filter(F.col("path") == REQUIREMENTS)
        .select("target_id", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
        .select("target_id", (F.col("pos") + 1).alias("line"), trim_space(F.col("text")).alias("requirement"))
    )


def _last_wins(entries: Column) -> Column:
    """The entries with each key once, at its first place and with its last value. Most manifests name nothing twice and are left as they
    are. Else places are sorted by key, so the first and the last of each run are known from their neighbours; values stay where they are
    until the end."""
    def runs(held: Column) -> Column:
        other = lambda j: F.get(held, j)["k"]
        firsts = F.filter(held, lambda x, j: (j == 0) | (other(j - 1) != x["k"]))
        lasts = F.filter(held, lambda x, j: (j == F.size(held) - 1) | (other(j + 1) != x["k"]))
        return F.array_sort(F.zip_with(firsts, lasts, lambda a, b: F.struct(a["i"].alias("first"), b["i"].alias("last"))))

    def with_entries(held: Column) -> Column:
        places = F.array_sort(F.transform(held, lambda e, i: F.struct(e["key"].alias("k"), i.alias("i"))))
        kept = F.get(F.transform(F.array(places), runs), F.lit(0))
        last = F.transform(kept, lambda p: F.struct(F.get(held, p["first"])["key"].alias("key"), F.get(held, p["last"])["value"].alias("value")))
        return F.when(F.size(F.array_distinct(held["key"])) == F.size(held), held).otherwise(last)

    return F.get(F.transform(F.array(entries), with_entries), F.lit(0))


def merge_dependencies(manifests: DataFrame) -> DataFrame:
    """``(target_id, seq, package, version, kind)`` of both maps; a package
    keeps its first place and takes its last value, so the development map
    wins. ``kind`` is the JSON type of the version. All within the row, in the time of a sort."""
    merged = manifests.select("target_id", _last_wins(F.concat("dependencies", "dev_dependencies")).alias("merged"))
    return merged.select("target_id", F.posexplode("merged").alias("seq", "e")).select(
        "target_id", "seq", F.col("e.key").alias("package"),
        F.try_variant_get("e.value", "$", "string").alias("version"),
        F.schema_of_variant("e.value").alias("kind"))


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID")) == _STRING_KIND


def _no_text(package: Column) -> Column:
    return message("{file}: version of {package} is no text", file=F.lit(PACKAGE_MANIFEST), package=package)


def is_unpinned_npm(version: Column) -> Column:
    return version.isin(*LOOSE_VERSIONS)


def is_git_dependency(version: Column) -> Column:
    return F.startswith(version, F.lit("git")) | F.contains(version, F.lit("github.com"))


def _report(hits: DataFrame) -> DataFrame:
    """Findings of ``(target_id, hit)``."""
    values = {"package": F.col("hit.package"), "version": F.col("hit.version")}

    def by_check(field: int, column) -> Column:
        chosen = None
        for i, check in enumerate(_CHECKS):
            test, value = F.col("hit.check") == i, column(check[field])
            chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        return chosen

    text = lambda template: message(template, **values)
    return as_findings(hits.select(
        "target_id", F.lit("deps").alias("scanner"), by_check(1, F.lit).alias("severity"), F.lit("dependency").alias("category"),
        by_check(4, text).alias("title"), by_check(5, text).alias("description"), by_check(3, F.lit).alias("file"), "hit.line",
        by_check(6, text).alias("recommendation"), by_check(0, F.lit).alias("rule_id"), F.lit(SCANNER_ORD["deps"]).alias("scanner_ord"),
        by_check(2, F.lit).alias("rule_ord"), "hit.seq"))


def _hit(check: int, package=None, version=None, line=None, seq=0) -> Column:
    """The fields of ``_HIT``; columns have these types already."""
    fields = {"package": (package, "string"), "version": (version, "string"), "line": (line, "int"), "seq": (seq, "int")}
    return F.struct(F.lit(check).alias("check"), *[(v if isinstance(v, Column) else F.lit(v).cast(t)).alias(n) for n, (v, t) in fields.items()])


def _npm_cases(package: Column, version: Column, seq: Column) -> list[Column]:
    """A hit or null by check; an entry may be both loose and from git."""
    checks = ((_UNPINNED_NPM, is_unpinned_npm), (_GIT, is_git_dependency))
    return [F.when(test(version), _hit(check, package, version, seq=seq * 2 + i)) for i, (check, test) in enumerate(checks)]


def npm_findings(dependencies: DataFrame) -> DataFrame:
    """Loose and git versions, one pass over the entries; an entry may be both."""
    cases = _npm_cases(F.col("package"), F.col("version"), F.col("seq"))
    hits = dependencies.filter(F.col("kind") == _STRING_KIND).select("target_id", F.explode(F.array(*cases)).alias("hit"))
    return _report(hits.filter(F.col("hit").isNotNull()))


def unpinned_npm(dependencies: DataFrame) -> DataFrame:
    return npm_findings(dependencies).filter(F.col("rule_id") == "unpinned-npm")


def git_dependency(dependencies: DataFrame) -> DataFrame:
    return npm_findings(dependencies).filter(F.col("rule_id") == "git-dependency")


def missing_lockfile(files: DataFrame) -> DataFrame:
    """Targets with a readable manifest and no lock file at their root; one
    aggregation of flags, since texts stay behind."""
    manifests = files.filter(F.col("path") == PACKAGE_MANIFEST).select("target_id", "content")
    locks = files.filter(F.col("path").isin(*LOCK_FILES))
    roots = (
        _with_documents(manifests).select("target_id", "readable", F.lit(False).alias("locked"))
        .unionByName(locks.select("target_id", F.lit(False).alias("readable"), F.lit(True).alias("locked")))
        .groupBy("target_id").agg(F.max("readable").alias("readable"), F.max("locked").alias("locked"))
        .filter(F.col("readable") & ~F.col("locked"))
    )
    return _report(roots.select("target_id", _hit(_NO_LOCK).alias("hit")))


def _python_hit(requirement: Column, line: Column) -> Column:
    """A hit or null. No pin and no separator is white space, so the name alone is trimmed."""
    name = requirement
    for separator in "<>=!":
        name = F.substring_index(name, separator, 1)
    pinned = F.lit(False)
    for pin in PINS:
        pinned = pinned | F.contains(requirement, F.lit(pin))
    hit = lambda package: F.when((package != "") & ~F.startswith(package, F.lit("#")), _hit(_UNPINNED_PYTHON, package, line=line, seq=line))
    return F.when(~pinned, F.get(F.transform(F.array(trim_space(name)), hit), F.lit(0)))


def unpinned_python(requirements: DataFrame) -> DataFrame:
    hits = requirements.select("target_id", F.explode(F.array(_python_hit(F.col("requirement"), F.col("line")))).alias("hit"))
    return _report(hits.filter(F.col("hit").isNotNull()))


def readable_manifests(files: DataFrame) -> DataFrame:
    """Targets whose root manifest can be read; no shuffle."""
    return _with_documents(files.filter(F.col("path") == PACKAGE_MANIFEST).select("target_id", "content")).filter("readable").select("target_id")


def _with_hits(files: DataFrame) -> DataFrame:
    """Adds ``readable`` and ``hits``, what one file alone decides, in one pass over the root files."""
    no_hits = F.array().cast(f"array<{_HIT}>")
    text = lambda e: F.when(_is_text(e["value"]), F.try_variant_get(e["value"], "$", "string"))
    versions = lambda e, i: F.struct(e["key"].alias("package"), text(e).alias("version"), i.alias("seq"))
    entries = F.transform(_last_wins(F.concat(_entries("dependencies"), _entries("devDependencies"))), versions)
    npm = F.flatten(F.transform(entries, lambda e: F.array(*_npm_cases(e["package"], e["version"], e["seq"]))))
    python = F.transform(F.split("content", "\n"), lambda text, i: _python_hit(text, i + 1))
    hits = F.when(F.col("readable"), npm).when(F.col("path") == REQUIREMENTS, python)
    return _with_documents(files).select("target_id", "path", "readable", F.coalesce(F.array_compact(hits), no_hits).alias("hits"))


def built_in_findings(files: DataFrame) -> DataFrame:
    """Findings that one manifest alone decides; no shuffle."""
    roots = files.filter(F.col("path").isin(PACKAGE_MANIFEST, REQUIREMENTS)).select("target_id", "path", "content")
    return _report(_with_hits(roots).select("target_id", F.explode("hits").alias("hit")))


def scan_manifests(files: DataFrame) -> DataFrame:
    """Findings of the built-in dependency checks. Files are taken apart once; their hits, which are short, meet the other root files
    of their target in one sort, where the lock files are known."""
    roots = files.filter(F.col("path").isin(PACKAGE_MANIFEST, REQUIREMENTS, *LOCK_FILES)).select("target_id", "path", "content")
    target = Window.partitionBy("target_id").orderBy(F.col("readable").desc())
    locked = F.max(F.col("path").isin(*LOCK_FILES)).over(target.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = _with_hits(roots).select("target_id", "readable", "hits", locked.alias("locked"), F.row_number().over(target).alias("place"))
    missing = F.when(F.col("readable") & ~F.col("locked") & (F.col("place") == 1), F.array(_hit(_NO_LOCK)))
    hits = F.when(missing.isNotNull(), F.concat("hits", missing)).otherwise(F.col("hits"))
    return _report(met.select("target_id", F.explode(hits).alias("hit")))


def manifest_errors(files: DataFrame) -> DataFrame:
    """``(target_id, scanner, error)``: unreadable manifests and entries whose version is no text, which the checks skip; one pass."""
    manifests = files.filter(F.col("path") == PACKAGE_MANIFEST).select("target_id", "content")
    entries = _last_wins(F.concat(_entries("dependencies"), _entries("devDependencies")))
    bad = F.transform(F.filter(entries, lambda e: ~_is_text(e["value"])), lambda e: _no_text(e["key"]))
    errors = F.when(F.col("readable"), bad).otherwise(F.array(F.lit(f"{PACKAGE_MANIFEST}: unreadable")))
    return _with_documents(manifests).select("target_id", F.lit("deps").alias("scanner"), F.explode(errors).alias("error"))
