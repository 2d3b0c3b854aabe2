"""Literal and hand-computed values of the text functions."""

import math

import pytest
from pyspark.sql import functions as F

from lexweave.functions import numbers as nm
from lexweave.functions import pytext as pt
from lexweave.functions import text as tx


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,slug", [("  FILE-SYSTEMS ", "file-systems"), ("搜索", "search"), ("nonsense", ""), ("", ""), (None, "")])
def test_normalize_type(spark, raw, slug):
    assert one(spark, tx.normalize_type(F.lit(raw).cast("string"))) == slug


def test_type_label(spark):
    assert one(spark, tx.type_label(F.lit("research"))) == "研究"
    assert one(spark, tx.type_label(F.lit(""))) == "未分类"
    assert one(spark, tx.type_label(F.lit("odd"))) == "odd"


def test_text_stats(spark):
    s = tx.text_stats(F.lit("你好 world\n第二行"))
    got = {k: one(spark, c) for k, c in s.items()}
    assert got == {"chars": 12, "chars_no_space": 10, "chinese_chars": 5, "words": 3, "lines": 2}
    assert one(spark, tx.text_stats(F.lit(""))["lines"]) == 0


def test_json_path(spark):
    blob = F.lit('{"items":[{"name":"x"},{"name":"y"}]}')
    assert one(spark, tx.json_path(blob, "items[1].name")[0]) == "y"
    assert one(spark, tx.json_path(blob, "items[7].name")[1]).startswith("路径")
    with pytest.raises(Exception, match="无法解析"):
        one(spark, tx.json_path_strict(blob, "nope"))


def test_regex_and_math(spark):
    assert one(spark, tx.regex_matches(F.lit("a1 b22 c333"), r"\d+")) == ["1", "22", "333"]
    assert one(spark, (F.lit(3) + 4) * 2 + nm.FUNCTIONS["sqrt"](F.lit(16.0))) == 18.0
    assert one(spark, nm.floor_div(F.lit(-7), F.lit(2))) == -4
    assert one(spark, nm.floor_mod(F.lit(-7), F.lit(2))) == 1
    assert one(spark, nm.factorial(F.lit(5))) == 120.0
    assert one(spark, nm.factorial(F.lit(25))) == pytest.approx(math.factorial(25), rel=1e-12)


@pytest.mark.parametrize("n,text", [(0, "0 B"), (-5, "0 B"), (1, "1.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"),
                                    (1048576, "1.0 MB"), (5 * 1024 ** 4, "5.0 TB"), (3000 * 1024 ** 4, "3000.0 TB")])
def test_format_bytes(spark, n, text):
    assert one(spark, nm.format_bytes(F.lit(n).cast("bigint"))) == text


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (500, [500]), (501, [501, 1]), (600, [600, 100]), (601, [601 - 1, 101]), (1100, [600, 600, 100])])
def test_token_windows(spark, n, sizes):
    text = " ".join(f"w{i}" for i in range(n))
    got = one(spark, tx.token_windows(F.lit(text)))
    assert [w["n_tokens"] for w in got] == sizes
    assert one(spark, tx.window_count(F.lit(text))) == len(sizes)
    # Windows without their overlap join back to the text.
    stride = [" ".join(w["text"].split()[:500]) for w in got]
    assert " ".join(stride) == text


def test_tokenizers(spark):
    assert one(spark, tx.rag_tokens(F.lit("Hello, wörld_1 你好吗!"))) == ["hello", "wörld_1", "你好吗"]
    assert one(spark, tx.catalog_tokens(F.lit("Send_Email 发送"))) == ["send", "email", "发", "送"]


def test_expand_env_is_one_pass(spark):
    env = F.create_map(F.lit("A"), F.lit("$B"), F.lit("B"), F.lit("x"))
    assert one(spark, tx.expand_env(F.lit("${A}-$B-$C-$"), env)) == "$B-x-$C-$"


def test_leaf_name(spark):
    for name, leaf, service in [("mcp__git__open_pr", "open_pr", "git"), ("mcp__a__b__c", "b__c", "a"), ("mcp__x", "mcp__x", "mcp"), ("add", "add", "")]:
        assert one(spark, tx.leaf_name(F.lit(name))) == leaf
        assert one(spark, tx.service_of(F.lit(name), F.lit(None).cast("string"))) == service


def test_occurrences_do_not_overlap(spark):
    assert one(spark, tx.occurrences(F.lit("aaaa.a"), F.lit("aa"))) == [0, 2]


def test_diff_spans():
    assert pt.diff_spans("我的明字", "我的名字") == [(2, 3, "明", "名")]
    assert pt.diff_spans("ab", "axb") == [(1, 1, "", "x")]
    assert pt.diff_spans("axb", "ab") == [(1, 2, "x", "")]
    assert pt.diff_spans("ab。", "ab！") == []
    assert pt.diff_spans("  ab", "ac") == [(3, 4, "b", "c")]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_against_brute_force():
    import random
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 90))) for _ in range(2))
        assert pt.common_subsequence(a, b) == brute_lcs(a, b)
    assert pt.similarity("", "x") == 0.0 and pt.similarity("x.", "x") == 1.0
    assert pt.similarity("abc", "abd") == 0.5


def test_clauses_and_segments():
    long = ("一二三四五六七八九十一二三四五六，" * 80)
    parts = pt.clauses(long)
    assert "".join(parts) == long
    segs = pt.sub_segments("好。坏！" * 3)
    assert [s for _, s in segs] == ["好。", "坏！"] * 3
    assert [o for o, _ in segs] == [0, 2, 4, 6, 8, 10]


def test_sanitize_keeps_code():
    raw = "a\n| x | y |\nsee /tmp/f.txt\n\n\n\n```\n| keep | /tmp/z |\n```\nend\x00"
    assert pt.sanitize(raw) == "a\n\nsee \n\n```\n| keep | /tmp/z |\n```\nend"


def test_labelled_defaults_and_categories(spark):
    from lexweave.operators.spans import parse_labelled
    rec = "[纠错结果]\n原句: 我的明字叫小明\n错情: 错误类型：错别字\\n修改原因：写错\n正确建议：我的名字叫小明"
    r = parse_labelled(spark.createDataFrame([(1, rec)], "doc_id int, content string")).collect()
    assert [(x["original"], x["category"], x["start"], x["end"], x["suggestion"]) for x in r] == [("我的明字叫小明", "错别字", 2, 3, "我的名字叫小明")]
