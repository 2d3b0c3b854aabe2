"""Text column functions. All of them stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Unicode blanks, spelled out because regex engines disagree about \s.
BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_BLANK = BLANK.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]+"
CJK = "[一-鿿]"
EDGE = "[。！？，,.!? \\t\\n\\r]+"

# The tool types and their labels.
TOOL_TYPES = [
    ("file-systems", "文件系统"),
    ("search", "搜索"),
    ("research", "研究"),
    ("location", "位置"),
    ("media", "多媒体"),
    ("calendar", "日历"),
    ("browser", "浏览器"),
    ("finance", "金融"),
]
NO_TYPE_LABEL = "未分类"

# Known wrong -> right pairs.
TYPO_PAIRS = [("象", "像"), ("目地", "目的"), ("已后", "以后"), ("那里", "哪里"), ("那么", "怎么"), ("在哪", "在哪儿")]

# Issue categories by ordered keyword test.
ISSUE_CATEGORIES = [
    (["错别字"], "错别字"),
    (["标点"], "标点"),
    (["用词", "词不当", "词语搭配"], "用词"),
    (["语法"], "语法"),
    (["语序"], "语序"),
    (["成分残缺"], "成分残缺"),
    (["成分赘余"], "成分赘余"),
    (["关联词"], "关联词"),
    (["指代"], "指代不明"),
    (["语义", "逻辑"], "语义逻辑"),
]
ERROR_TYPES = ["错别字", "词语搭配错误", "词性错误", "语序错误", "成分残缺", "成分赘余",
               "关联词使用错误", "指代不明", "语义逻辑不通", "无误"]
DEFAULT_CATEGORY = "错别字"


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once per row; a lambda body would compute it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rag_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscore; unbroken CJK stays one token."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def catalog_tokens(c: Column) -> Column:
    """Lower-case ASCII words followed by single CJK characters."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
    return F.concat(words, F.regexp_extract_all(c, F.lit(CJK), F.lit(0)))


def catalog_runs(c: Column) -> Column:
    """Lower-case ASCII words followed by unbroken CJK runs."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
    return F.concat(words, F.regexp_extract_all(c, F.lit(CJK + "+"), F.lit(0)))


def token_count(tokenizer, c: Column) -> Column:
    """Number of tokens, counted without building them where the tokenizer allows it."""
    if tokenizer is rag_tokens:
        return F.regexp_count(F.lower(c), F.lit(WORD))
    if tokenizer is catalog_tokens:
        return F.regexp_count(c, F.lit("[a-zA-Z0-9]+")) + F.regexp_count(c, F.lit(CJK))
    return F.size(tokenizer(c))


def query_terms(c: Column) -> Column:
    """Blank-separated lower-case terms."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), f"{BLANK}+", " "), " "), lambda t: t != "")


def count_substring(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))


def term_hits(text: Column, terms: Column) -> Column:
    """Sum of substring counts of all terms in the lower-cased text."""
    return let(F.lower(text), lambda low: F.aggregate(
        terms, F.lit(0).cast("bigint"), lambda acc, t: acc + count_substring(low, t)))


def tool_search_text(name: Column, description: Column, params: Column) -> Column:
    """Name with separators as blanks, description, parameter names."""
    return F.concat_ws(" ", F.regexp_replace(name, r"[_.:\-]+", " "), F.coalesce(description, F.lit("")),
                       F.array_join(F.map_keys(params), " "))


_QUALIFIED = r"(?s)^mcp__(.*?)__(.*)$"


def leaf_name(name: Column) -> Column:
    return F.when(name.rlike(_QUALIFIED), F.regexp_extract(name, _QUALIFIED, 2)).otherwise(name)


def service_of(name: Column, declared: Column) -> Column:
    """Declared service, else the middle part of a qualified name, else 'mcp'; '' for own tools."""
    declared = F.coalesce(declared, F.lit(""))
    return (F.when(declared != "", declared)
            .when(name.rlike(_QUALIFIED), F.regexp_extract(name, _QUALIFIED, 1))
            .when(name.startswith("mcp__"), F.lit("mcp"))
            .otherwise(F.lit("")))


def _map_of(pairs) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def normalize_type(c: Column) -> Column:
    """Slug of a slug (any case) or of a label; '' when unknown."""
    text = strip_blank(F.coalesce(c, F.lit("")))
    slugs = _map_of([(s, s) for s, _ in TOOL_TYPES])
    labels = _map_of([(l, s) for s, l in TOOL_TYPES])
    return F.coalesce(F.try_element_at(slugs, F.lower(text)), F.try_element_at(labels, text), F.lit(""))


def type_label(c: Column) -> Column:
    raw = strip_blank(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(_map_of(TOOL_TYPES), normalize_type(c)),
                      F.when(raw != "", raw), F.lit(NO_TYPE_LABEL))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def text_stats(c: Column) -> dict[str, Column]:
    return {
        "chars": F.length(c).cast("bigint"),
        "chars_no_space": F.length(F.regexp_replace(c, BLANK, "")).cast("bigint"),
        "chinese_chars": F.regexp_count(c, F.lit(CJK)).cast("bigint"),
        "words": F.regexp_count(c, F.lit(WORD)).cast("bigint"),
        "lines": F.when(F.length(c) == 0, F.lit(0)).otherwise(F.regexp_count(c, F.lit("\n")) + 1).cast("bigint"),
    }


def strip_html(c: Column) -> Column:
    """Drop script/style/noscript, tags to blanks, four entities in order, squeeze blanks."""
    t = c
    for pattern, repl in [
        (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", " "),
        (r"(?s)<[^>]+>", " "),
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        (r"[ \t]+", " "),
        (rf"\n{BLANK}*\n{BLANK}*", "\n\n"),
    ]:
        t = F.regexp_replace(t, pattern, repl)
    return strip_blank(t)


def truncate_note(c: Column, limit: int = 12_000) -> Column:
    note = F.concat(F.left(c, F.lit(limit)), F.lit("\n…（已截断，共 "), F.length(c).cast("string"), F.lit(" 字符）"))
    return F.when(F.length(c) > limit, note).otherwise(c)


def regex_matches(c: Column, pattern: str, group: int = 0, max_matches: int = 50) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), 1, max_matches)


def json_path(c: Column, path: str) -> tuple[Column, Column]:
    """(value, error) for a path like a.b[0].c."""
    value = F.get_json_object(c, "$" if path in ("", ".") else "$." + path)
    return value, F.when(value.isNull(), F.lit(f"路径 '{path}' 无法解析"))


def json_path_strict(c: Column, path: str) -> Column:
    """Like json_path, but a missing path fails the job instead of filling the error column."""
    value, error = json_path(c, path)
    return F.when(error.isNotNull(), F.raise_error(error)).otherwise(value)


def normalize_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{a0}\x{3000}]+", " ")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r", "\n")


def last_tag(c: Column, tag: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return strip_blank(F.try_element_at(found, F.lit(-1)))


def numbered_items(c: Column, n: int) -> Column:
    """Texts of lines like `1. x` or `2、y`, trimmed, blank ones dropped, first n."""
    found = F.regexp_extract_all(c, F.lit(r"(?md)\d+[.、](.+?)$"), F.lit(1))
    return F.slice(F.filter(F.transform(found, strip_blank), lambda t: t != ""), 1, n)


def query_variants(original: Column, subs: Column) -> Column:
    """Original first, then the non-empty sub-queries, each once."""
    return F.array_distinct(F.concat(F.array(original), F.filter(subs, lambda s: s != "")))


def expand_env(c: Column, env: Column) -> Column:
    """Replace $X and ${X} by the map's values, one pass; unknown names stay."""
    pattern = r"\$(?:\w+|\{[^}]*\})"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    looked = F.transform(found, lambda m: F.coalesce(
        F.try_element_at(env, F.regexp_replace(m, r"^\$\{|^\$|\}$", "")), m))
    pieces = F.split(c, pattern)
    return F.array_join(F.zip_with(pieces, looked, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def expand_env_in(value: Column, kind: T.DataType, env: Column) -> Column:
    """`expand_env` in a string, and in every string of a list, map (values) or struct; other types come back as they are."""
    if isinstance(kind, T.StringType):
        return expand_env(value, env)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: expand_env_in(x, kind.elementType, env))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: expand_env_in(x, kind.valueType, env))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[expand_env_in(value[f.name], f.dataType, env).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def chunk_uid(doc: Column, index: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), index.cast("string"))


def collection_name(tenant: Column) -> Column:
    return F.concat(F.lit("rag_chunks_"), F.replace(F.coalesce(tenant, F.lit("default")), F.lit("-"), F.lit("_")))


def hit_key(uid: Column, index: Column) -> Column:
    return F.coalesce(uid, index.cast("string"))


def fingerprint(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols]))


def map_category(c: Column, without: tuple[str, ...] = ()) -> Column:
    return _first_match(c, [([w for w in words if w not in without], label) for words, label in ISSUE_CATEGORIES])


def map_error_type(c: Column) -> Column:
    return _first_match(c, [([t], t) for t in ERROR_TYPES])


def _first_match(c: Column, rules) -> Column:
    chain = None
    for words, label in rules:
        cond = F.lit(False)
        for w in words:
            cond = cond | c.contains(w)
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return chain.otherwise(F.lit(DEFAULT_CATEGORY))


def redact(m: Column) -> Column:
    """Drop map entries whose key looks secret."""
    return F.map_filter(m, lambda k, v: ~k.rlike("(?i)(KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL|API)"))


def occurrences(text: Column, term: Column) -> Column:
    """0-based starts of the non-overlapping occurrences of a literal term."""
    # One pass over the pieces: where the last one ended, and the starts so far.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    pieces = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece)
        return F.struct((start + F.length(term)).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), begin, step, lambda acc: acc["starts"])


def token_windows(c: Column, size: int = 600, overlap: int = 100, token: str | None = None) -> Column:
    """Array of struct(chunk_index, n_tokens, text). Tokens keep the blanks behind them."""
    step = size - overlap

    def windows(tokens: Column) -> Column:
        n = F.size(tokens)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(
            F.floor(s / step).cast("int").alias("chunk_index"),
            F.least(F.lit(size), n - s).alias("n_tokens"),
            F.array_join(F.slice(tokens, s + 1, F.lit(size)), "").alias("text"),
        ))
    return let(F.regexp_extract_all(c, F.lit(token or f"{NOT_BLANK}+{BLANK}*|^{BLANK}+"), F.lit(0)), windows)


def window_count(c: Column, size: int = 600, overlap: int = 100, token: str | None = None) -> Column:
    """How many windows `token_windows` gives, without building them."""
    n = F.regexp_count(c, F.lit(token or f"{NOT_BLANK}+{BLANK}*|^{BLANK}+"))
    return F.ceil(n / (size - overlap))
