"""Source files as a graph: files, packages, imports, symbols, key files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Import syntax by language family.
JS_IMPORT = r"""(?m)^\s*import\b.*?from\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
PY_IMPORT = r"(?m)^\s*import\s+([A-Za-z0-9_.]+)"
PY_FROM = r"(?m)^\s*from\s+([A-Za-z0-9_.]+)\s+import\b"
JAVA_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)\s*;"
RUST_USE = r"(?m)^\s*use\s+([A-Za-z0-9_:]+)"
C_INCLUDE = r"""(?m)^\s*#include\s+[<"]([^>"]+)[>"]"""
FAMILIES = {
    (".ts", ".tsx", ".js", ".jsx"): (JS_IMPORT, JS_REQUIRE),
    (".py",): (PY_IMPORT, PY_FROM),
    (".java", ".kt", ".scala"): (JAVA_IMPORT,),
    (".rs",): (RUST_USE,),
    (".c", ".cc", ".cpp", ".h", ".hpp", ".m"): (C_INCLUDE,),
}


def extract_imports(files: DataFrame) -> DataFrame:
    """(src, dst, ordinal): each file's import targets, distinct, in the order of its family's patterns."""
    ext = F.lower(T.extension(F.col("path")))
    found: Column = F.lit(None).cast("array<string>")
    for extensions, patterns in FAMILIES.items():
        every = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])
        found = F.when(ext.isin(*extensions), every).otherwise(found)
    targets = F.array_distinct(F.filter(F.transform(found, T.trim), lambda t: t != ""))
    return files.select(F.col("path").alias("src"), F.posexplode(targets).alias("ordinal", "dst"))


def extract_file_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (name, type, aliases) of files and packages, and the edges package contains file."""
    path = F.col("path")
    base, stem, package = T.base_name(path), T.stem(path), T.package_name(path)
    aliases = T.distinct_by_key(F.concat(F.array(base, stem), T.symbol_aliases(stem)), path)
    file_rows = files.select(path.alias("name"), F.lit("file").alias("type"), aliases.alias("aliases"))
    packages = files.select(package.alias("name")).distinct()
    short = T.base_name(F.col("name"))
    package_rows = packages.select("name", F.lit("package").alias("type"), T.distinct_by_key(F.concat(F.array(short), T.symbol_aliases(short)), F.col("name")).alias("aliases"))
    return file_rows.unionByName(package_rows), files.select(package.alias("src"), path.alias("dst"), F.lit("包含").alias("label"))


# Tokens of Go that hold no code, its keywords, and the names of kinds and labels.
GO_COMMENT = r"//[^\n]*|(?s:/\*.*?\*/)"
GO_STRING = r"""`[^`]*`|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'"""
GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
CONTAINS, DEPENDS, CALLS = "包含", "依赖", "调用"


def mask_go(source: Column) -> Column:
    """Go source without comments, and with empty strings; line breaks stay where they are."""
    tokens = F.regexp_extract_all(source, F.lit(f"{GO_COMMENT}|{GO_STRING}|[^/\"'`]+|."), F.lit(0))
    blank = lambda t: F.regexp_replace(t, r"[^\n]", "")
    kept = F.transform(tokens, lambda t: F.when(t.rlike(r"^(//|/\*|`)"), blank(t)).when(t.rlike("^[\"'].+[\"']$"), F.lit('""')).otherwise(t))
    return F.array_join(kept, "")


def go_imports(source: Column) -> Column:
    """Paths of the import declarations, distinct, in order."""
    bare = F.array_join(F.transform(F.regexp_extract_all(source, F.lit(f"{GO_COMMENT}|{GO_STRING}|[^/\"'`]+|."), F.lit(0)), lambda t: F.when(t.rlike(r"^(//|/\*)"), "").otherwise(t)), "")
    one = F.regexp_extract_all(bare, F.lit(r"""(?m)^import\s+(?:[\w.]+\s+)?["`]([^"`]*)["`]"""), F.lit(1))
    groups = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?m)^import\s*\(([^)]*)\)"), F.lit(1)), "\n")
    many = F.regexp_extract_all(groups, F.lit(r"""["`]([^"`]*)["`]"""), F.lit(1))
    return F.array_distinct(F.filter(F.concat(one, many), lambda p: p != ""))


def extract_go_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (path, line, name, type, aliases) of a Go file's functions, methods and types, and edges (path, line, src, dst, label): the file contains them
    and depends on what it imports, functions call others.

    Names are ``package.Symbol``; aliases are the short name, a method's form with its receiver, and the words of the name. Comments and strings hold nothing.
    Declarations are those at the outermost level, by the running count of brackets, in any layout that ``gofmt`` makes. Calls are those of a bare name (in the own package) or
    of a name on another (``x.Sel``), each once for a function. A file without a package clause has none of it. Types are not checked.
    """
    go = files.where(F.lower(T.extension(F.col("path"))) == ".go").select("path", mask_go(F.coalesce("content", F.lit(""))).alias("code"), go_imports(F.coalesce("content", F.lit(""))).alias("imports"))
    go = go.withColumn("package", F.regexp_extract("code", r"(?m)^\s*package\s+(\w+)", 1)).where("package <> ''")
    lines = go.select("path", "package", F.posexplode(F.split("code", "\n")).alias("line", "text"))
    count = lambda marks: F.length(F.regexp_replace("text", f"[^{marks}]", ""))
    order = Window.partitionBy("path").orderBy("line")
    depth = F.coalesce(F.sum(count("({\\[") - count(")}\\]")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = lines.withColumn("depth", depth)
    outer = F.col("depth") == 0
    opened = F.when(outer & F.col("text").rlike(r"^func\b"), "func").when(outer & F.col("text").rlike(r"^type\s*\("), "types").when(outer & F.col("text").rlike(r"^(type|var|const|import)\b"), "other")
    x = x.withColumn("opened", opened)
    func = r"^func\s*(?:\(\s*(?:\w+\s+)?(\*?\w+)[^)]*\)\s*)?(\w+)"
    part = lambda pattern, k: F.nullif(F.regexp_extract("text", pattern, k), F.lit(""))
    x = x.withColumn("within", F.last("opened", ignorenulls=True).over(order))
    symbol = F.when(F.col("opened") == "func", part(func, 2)).when(outer, part(r"^type\s+(\w+)", 1)).when((F.col("within") == "types") & (F.col("depth") == 1), part(r"^\s*(\w+)", 1))
    x = x.withColumn("symbol", symbol).withColumn("receiver", F.when(F.col("opened") == "func", part(func, 1)))
    declared = x.where("symbol is not null")
    form = F.when(F.col("receiver").isNotNull(), F.concat(F.lit("("), "receiver", F.lit(")."), "symbol"))
    name = F.concat("package", F.lit("."), "symbol")
    aliases = T.distinct_by_key(F.concat(F.filter(F.array(F.col("symbol"), form), lambda a: a.isNotNull()), T.symbol_aliases(F.col("symbol"))), name)
    entities = declared.select("path", "line", name.alias("name"), F.when(F.col("opened") == "func", "function").otherwise("type").alias("type"), aliases.alias("aliases"))

    # a function goes from its declaration to the next one; outside its brackets there are no calls
    x = x.withColumn("caller", F.last(F.when(F.col("opened").isNotNull(), F.struct(F.when(F.col("opened") == "func", name).alias("name"))), ignorenulls=True).over(order)["name"])
    body = F.when(F.col("opened") == "func", F.regexp_extract("text", r"\{(.*)$", 1)).when(~outer, F.col("text"))
    x = x.where("caller is not null").select("path", "line", "package", "caller", body.alias("body")).where("body is not null")
    found = F.regexp_extract_all("body", F.lit(r"(?<![\w.)\]])(?:\w+\.)?\w+(?=\()"), F.lit(0))
    calls = x.select("path", "line", "package", "caller", F.explode(found).alias("called")).where(~F.col("called").isin(GO_KEYWORDS) & ~F.col("called").rlike(r"^\d"))
    callee = F.when(F.contains("called", F.lit(".")), F.col("called")).otherwise(F.concat("package", F.lit("."), "called"))
    calls = calls.groupBy("path", F.col("caller").alias("src"), callee.alias("dst")).agg(F.min("line").alias("line"))
    edges = go.select("path", F.lit(0).alias("line"), F.col("path").alias("src"), F.explode("imports").alias("dst"), F.lit(DEPENDS).alias("label"))
    edges = edges.unionByName(entities.select("path", "line", F.col("path").alias("src"), F.col("name").alias("dst"), F.lit(CONTAINS).alias("label")))
    return entities, edges.unionByName(calls.select("path", "line", "src", "dst", F.lit(CALLS).alias("label")))


def package_in_degree(relations: DataFrame) -> DataFrame:
    """(package, degree): how many relations lead into each package."""
    return relations.groupBy(T.package_name(F.col("dst")).alias("package")).agg(F.count("*").alias("degree"))


def change_frequency(commit_files: DataFrame, newest: int = 300) -> DataFrame:
    """(path, n): in how many of the ``newest`` commits each path of (commit_rank, path) occurs; ranks begin at 1."""
    return commit_files.where(F.col("commit_rank") <= newest).groupBy("path").agg(F.count("*").alias("n"))


def file_symbols(relations: DataFrame, label: str = "包含") -> DataFrame:
    """(src, symbols): what each file contains, in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "dst"))), lambda x: x["dst"])
    return relations.where(F.col("label") == label).groupBy("src").agg(rows.alias("symbols"))


def size_preference(size: Column) -> Column:
    return F.when(size == 0, 0.0).when(size < 200, 0.2).when(size < 12_000, 1.0).otherwise(0.3)


def select_key_files(files: DataFrame, changes: DataFrame, relations: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` files (path, size, ordinal) of highest score by changes, the package's incoming edges, naming and size."""
    freq = changes.groupBy("path").agg(F.count("*").alias("freq"))
    degree = package_in_degree(relations)
    x = files.join(freq, "path", "left").withColumn("package", T.package_name(F.col("path"))).join(degree, "package", "left")
    score = 3.0 * F.coalesce("freq", F.lit(0)) + 1.5 * F.coalesce("degree", F.lit(0)) + F.when(T.is_entry_point(F.col("path")), 4.0).otherwise(0.0) + size_preference(F.col("size"))
    return x.select("path", "ordinal", score.alias("score")).orderBy(F.desc("score"), "ordinal").limit(n)


def extract_note_graph(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Note entities (name, type, aliases) and links (src, dst, label), none to itself."""
    title = T.note_title(F.col("path"))
    entities = notes.select(title.alias("name"), F.lit("note").alias("type"), T.distinct_by_key(F.array("path", T.base_name(F.col("path"))), title).alias("aliases"))
    links = notes.select(title.alias("src"), F.explode(T.parse_wikilinks(F.col("content"))).alias("dst"))
    return entities, links.where(T.norm_key(F.col("src")) != T.norm_key(F.col("dst"))).select("src", "dst", F.lit("链接").alias("label"))


def extract_link_graph(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct targets of each page's links."""
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select(F.col("url").alias("src"), F.explode(targets).alias("dst"))
