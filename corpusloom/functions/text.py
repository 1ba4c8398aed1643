"""Text expressions: every function takes and returns Columns and stays inside Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
STOP_WORDS = [
    "的", "了", "是", "在", "有", "和", "就", "不", "也", "都",
    "这", "那", "要", "会", "对", "能", "把", "到", "从", "被",
    "更新", "修改", "处理", "使用", "需要", "进行", "通过", "如何",
    "查看", "检查", "确认", "获取", "设置", "添加", "删除", "创建",
    "the", "is", "in", "to", "of", "and", "for", "on", "at",
    "how", "what", "this", "that", "with", "from", "can", "do",
]
ACKNOWLEDGEMENTS = ["好的", "好", "继续", "谢谢", "多谢", "ok", "okay", "thanks", "thank you", "收到", "嗯", "行"]
VAGUE_WORDS = ["可能", "大概", "也许", "好像", "似乎", "应该是", "maybe", "probably", "might"]
RULE_WORDS = [
    "push 后自动触发", "push 后会自动", "自动触发构建", "约定", "约束", "必须", "不能", "不允许",
    "规则", "规范", "流程", "架构", "职责", "负责", "设计决策", "原因是", "因为", "为了",
]
SNAPSHOT_WORDS = [
    "单副本 Running", "Pod 状态为 Running", "Pod 状态为", "已扩容", "已推送到 release/", "已合入 release/", "已 push 到",
    "已推送远程", "提交为 ", "最终提交为", "修复提交为", "当前镜像为", "修复镜像为", "构建镜像为", "部署镜像为",
    "pipeline 均成功", "构建成功", "CI 成功后", "pipeline 构建成功",
]
COMMIT_WORDS = ["提交", "commit", "push", "合入", "cherry-pick", "rebase", "已推送"]
BATCH_RULE_WORDS = [
    "push 后自动触发", "push 后会自动", "自动触发构建", "release 分支", "收发双方运行同一套", "ClusterIP 第三段",
    "namespace 对应", "API类型增加", "接口", "约定", "约束", "必须", "不能", "不允许", "规则", "规范", "流程", "架构",
    "职责", "负责", "所在服务", "设计决策", "原因是", "因为", "为了",
]
BATCH_SNAPSHOT_WORDS = [
    "单副本 Running", "Pod 状态为 Running", "Pod 状态为", "已扩容", "已推送到 release/", "已合入 release/", "已 push 到",
    "已推送远程", "已 push", "提交为 ", "提交 commit", "最终提交为", "修复提交为",
    "当前镜像为", "修复镜像为", "构建镜像为", "部署镜像", "镜像为 ", "pipeline 均成功", "构建成功", "CI 成功", "pipeline 构建成功",
]
BATCH_COMMIT_WORDS = ["提交", "commit", "push", "合入", "cherry-pick", "rebase"]
IMAGE_TAG = r"\d+\.\d+\.\d+-(?:beta|stable)-[0-9a-f]{6,}"
PIPELINE = r"pipeline\s*#?\s*\d{5,}"
#: Addresses of private networks; pass those of your own installations, and names of its deployments, as parameters.
PRIVATE_ADDRESS = r"\b(?:10\.\d+|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d+"
COMMIT_HASH = r"\b[0-9a-f]{7,40}\b"
GENERATED_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock"]
GENERATED_SUFFIXES = [".lock", ".min.js", ".min.css", ".snap"]
GENERATED_FOLDERS = ["node_modules", "vendor", "dist", "build", ".next", "target"]
SKIPPED_FOLDERS = [".git", "node_modules", "vendor", "dist", "build", ".next", "target", ".idea", ".vscode", "__pycache__", ".gradle", "out"]
SECRET_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".keystore", ".jks"]
SOURCE_EXTENSIONS = [".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".rs", ".rb", ".php", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".kt", ".swift", ".scala", ".m"]
ENTRY_FILES = ["main.go", "app.go", "index.ts", "index.js", "server.go", "server.ts"]
ENTRY_WORDS = ["controller", "service", "handler", "router", "route"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def trim(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def norm_key(text: Column) -> Column:
    return F.lower(trim(text))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Last dot of the base name and what follows; empty without a dot."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def package_name(path: Column) -> Column:
    """The folder of a path, "." at the top."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~F.contains(path, F.lit("/")) | (folder == ""), F.lit(".")).otherwise(folder)


def note_title(path: Column) -> Column:
    return stem(path)


def query_terms(text: Column) -> Column:
    """Lower-cased words of two characters or more, without outer punctuation, stop words and repeats."""
    words = F.transform(F.split(trim(F.lower(text)), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:!?()\[\]{}"'`]+|[.,;:!?()\[\]{}"'`]+$""", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS)))


def token_set(text: Column) -> Column:
    """Distinct Han characters and runs of other letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def split_words(name: Column) -> Column:
    """Parts of an identifier: at separators and before a capital that follows no capital, lower-cased."""
    spaced = F.regexp_replace(name, r"(?<![A-Z])(?<!^)(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[\s_\-.]+"), lambda w: w != "")


def symbol_aliases(name: Column) -> Column:
    """One alias of the identifier's words, if there are two or more."""
    words = split_words(name)
    return F.when(F.size(words) >= 2, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def distinct_by_key(values: Column, without: Column | None = None) -> Column:
    """Values in order, the first of each normalised spelling, no blanks, and not ``without``."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, v: Column) -> Column:
        key = norm_key(v)
        skip = v.isNull() | (key == "") | F.array_contains(acc["seen"], key)
        if without is not None:
            skip = skip | (key == norm_key(without))
        return F.when(skip, acc).otherwise(F.struct(F.array_append(acc["seen"], key).alias("seen"), F.array_append(acc["kept"], v).alias("kept")))

    return F.aggregate(values, start, add, lambda acc: acc["kept"])


def parse_wikilinks(text: Column) -> Column:
    """Titles that [[...]] links name, without heading, display text, folders and extension; distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    titles = F.transform(found, lambda x: F.regexp_replace(base_name(trim(F.split(F.split(x, r"\|")[0], "#")[0])), r"(?i)\.md$", ""))
    return distinct_by_key(F.transform(titles, trim))


def first_line(text: Column, most: int = 60, mark: str = "…", default: str = "") -> Column:
    """The first line that isn't blank, cut after ``most`` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")
    line = F.when(F.size(lines) > 0, lines[0]).otherwise(F.lit(default))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit(mark))).otherwise(line)


def task_title(text: Column) -> Column:
    return first_line(text, 60, "...", "Untitled task")


def chat_title(title: Column, first_message: Column) -> Column:
    short = trim(first_message)
    short = F.when(F.length(short) > 60, F.concat(F.substring(short, 1, 60), F.lit("..."))).otherwise(short)
    return F.coalesce(F.nullif(trim(title), F.lit("")), short)


def json_part(reply: Column) -> Column:
    """From the first { to the last }."""
    part = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(part != "", part).otherwise(reply)


def extract_tag(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>; to the end, if it isn't closed; empty without the tag."""
    rest = F.substring_index(text, f"<{tag}>", 1)
    after = F.substr(text, F.length(rest) + len(tag) + 3, F.length(text))
    closed = F.contains(after, F.lit(f"</{tag}>"))
    return F.when(~F.contains(text, F.lit(f"<{tag}>")), F.lit("")).when(closed, F.substring_index(after, f"</{tag}>", 1)).otherwise(trim(after))


def obs_key(entity: Column, obs: Column) -> Column:
    return F.sha1(F.concat(norm_key(entity), F.char(F.lit(0)), trim(obs)))


def age_days(source: Column, now_ms: Column) -> Column:
    """Days since the time in ``mcp:<millis>-<tail>``; null for other sources."""
    ms = F.regexp_extract(source, r"^mcp:([0-9]+)", 1).try_cast("long")
    return F.when(ms > 0, F.floor((now_ms - ms) / 86_400_000))


def age_note(source: Column, now_ms: Column) -> Column:
    d = age_days(source, now_ms)
    return F.when(d.isNull(), "").when(d <= 0, " (今天)").when(d > 90, F.concat(F.lit(" ("), d, F.lit("天前⚠️)"))).otherwise(F.concat(F.lit(" ("), d, F.lit("天前)")))


def recall_method(semantic: Column, keyword: Column) -> Column:
    return F.when(semantic & keyword, "hybrid").when(semantic, "semantic").when(keyword, "keyword").otherwise("none")


def entity_embed_text(name: Column, facts: Column) -> Column:
    return trim(F.concat_ws(" ", name, facts))


def render_entity(name: Column, kind: Column, facts: Column, sources: Column) -> Column:
    lines = F.zip_with(facts, sources, lambda o, s: F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit("- "), o, F.lit(" （来源："), s, F.lit("）\n"))).otherwise(F.concat(F.lit("- "), o, F.lit("\n"))))
    return F.concat(F.lit("\n### "), name, F.lit("（"), kind, F.lit("）\n"), F.array_join(lines, ""))


def render_relation(src: Column, label: Column, dst: Column) -> Column:
    return F.concat(src, F.lit(" —"), label, F.lit("→ "), dst)


def render_chunk(source: Column, text: Column) -> Column:
    return F.concat(F.lit("\n〔来源："), source, F.lit("〕\n"), text, F.lit("\n\n---\n"))


def render_source(source: Column, title: Column, now_ms: Column) -> Column:
    rest = F.regexp_replace(source, "^[a-z]+:", "")
    return (
        F.when(F.startswith(source, F.lit("code:")), F.concat(F.lit("代码 "), rest))
        .when(F.startswith(source, F.lit("task:")), F.concat(F.lit("任务 "), rest))
        .when(F.startswith(source, F.lit("obsidian:")), F.concat(F.lit("笔记 "), rest))
        .when(F.startswith(source, F.lit("mcp:")), F.concat(F.lit("MCP写入"), age_note(source, now_ms)))
        .when(F.startswith(source, F.lit("moved:")), F.lit("迁移"))
        .otherwise(F.coalesce(F.nullif(trim(title), F.lit("")), source))
    )


def enrich_query(text: Column, scope: Column) -> Column:
    """The text, then each scope path and, for paths with folders, its stem."""
    parts = F.transform(F.filter(F.transform(scope, trim), lambda s: s != ""), lambda s: F.when(F.contains(s, F.lit("/")), F.concat_ws(" ", s, stem(s))).otherwise(s))
    return F.concat_ws(" ", text, F.array_join(parts, " ")) if scope is not None else text


def strip_prefix(session_id: Column) -> Column:
    return F.regexp_replace(session_id, "^(codex|workbuddy|codebuddy):", "")


def agent_of(session_id: Column) -> Column:
    name = F.regexp_extract(session_id, "^(codex|workbuddy|codebuddy):", 1)
    return F.when(name == "", "claude").otherwise(name)


def strip_speaker(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?i:user|assistant):(?U:\s*)", "")


def looks_like_log(text: Column) -> Column:
    """Three lines or more, at least half of which look like output of tools."""
    lines = F.split(F.lower(text), "\n")

    def logish(raw: Column) -> Column:
        x = trim(raw)
        return x.rlike(r"^(at |\$ |> |error:|warning:)") | F.contains(x, F.lit("traceback")) | F.contains(x, F.lit("goroutine ")) | F.contains(x, F.lit("\tat "))

    return (F.size(lines) >= 3) & (F.size(F.filter(lines, logish)) * 2 >= F.size(lines))


def is_noise_chunk(text: Column, least: int = 40) -> Column:
    body = trim(strip_speaker(trim(text)))
    bare = F.regexp_replace(F.lower(body), "[。.!！~ ]+$", "")
    return (F.length(body) < least) | bare.isin(ACKNOWLEDGEMENTS) | looks_like_log(body)


def _is_snapshot(text: Column, rules: list[str], words: list[str], commits: list[str], pipeline: str, addresses: str) -> Column:
    shown = text.rlike(IMAGE_TAG) | text.rlike(addresses) | text.rlike(pipeline) | (text.rlike(COMMIT_HASH) & contains_any(F.lower(text), commits)) | contains_any(text, words)
    return ~contains_any(text, rules) & shown


def is_snapshot_obs(text: Column, addresses: str = PRIVATE_ADDRESS, names: tuple[str, ...] = ()) -> Column:
    """A passing state (image, address, build, commit) rather than a lasting rule; ``addresses`` is a pattern of private ones, ``names`` are further words that show one."""
    return _is_snapshot(text, RULE_WORDS, [*SNAPSHOT_WORDS, *names], COMMIT_WORDS, "(?i)" + PIPELINE, addresses)


def is_snapshot_obs_batch(text: Column, addresses: str = PRIVATE_ADDRESS, names: tuple[str, ...] = ()) -> Column:
    """The same with the word lists for cleaning what is stored."""
    return _is_snapshot(text, BATCH_RULE_WORDS, [*BATCH_SNAPSHOT_WORDS, *names], BATCH_COMMIT_WORDS, PIPELINE, addresses)


def vague_wording(text: Column) -> Column:
    """The first hedge word of the list that the text holds."""
    found = F.filter(F.array(*[F.lit(w) for w in VAGUE_WORDS]), lambda w: F.contains(F.lower(text), w))
    return F.get(found, F.lit(0))


def skip_generated(path: Column) -> Column:
    base = base_name(path)
    return base.isin(GENERATED_FILES) | any_of([F.endswith(base, F.lit(s)) for s in GENERATED_SUFFIXES]) | F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in GENERATED_FOLDERS]))


def skip_secret(path: Column) -> Column:
    base = F.lower(base_name(path))
    return (
        base.rlike(r"^\.env(\.|$)|\.env$")
        | any_of([F.endswith(base, F.lit(s)) for s in SECRET_SUFFIXES])
        | base.rlike("^(id_rsa|id_ed25519)")
        | F.contains(base, F.lit("credential"))
        | F.contains(base, F.lit("secret"))
    )


def is_entry_point(path: Column) -> Column:
    base = F.lower(base_name(path))
    return base.isin(ENTRY_FILES) | F.startswith(path, F.lit("cmd/")) | contains_any(base, ENTRY_WORDS)


def search_snippet(content: Column, keyword: Column, before: int = 40, after: int = 60) -> Column:
    """Text around the first match, with … where it is cut; without a match the first 160 characters."""
    at = F.position(F.lower(keyword), F.lower(content))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + F.length(keyword) - 1 + after, F.length(content))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substr(content, start, end - start + 1), F.when(end < F.length(content), "…").otherwise(""))
    head = F.when(F.length(content) > 160, F.concat(F.substring(content, 1, 160), F.lit("…"))).otherwise(content)
    return F.when(at > 0, cut).otherwise(head)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors that are empty, unequal in length or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = (F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))
