"""Small Python helpers for data-dependent text scans, exposed as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from lexweave.functions.diffing import opcodes

# Edge marks, clause marks and lengths of the segmentation and diff rules.
EDGE_MARKS = "。！？，,.!? \t\n\r"
CLAUSE_MARKS = ",，;；)）"
MAX_SEGMENT, MIN_CLAUSE, COMMA_LOOK_AHEAD = 1000, 16, 5
# Characters that do not count as sentence-ending marks.
_NOT_MARK = r"\w《》“\"【】\[\]<>（）()〔〕「」『』〖〗〈〉﹛﹜{}×—－\-%％￥$□℃\xa0\u3000\r\n "
_NOT_MARK_CUT = r"\w《了么为\"【】\[\]<>（）()〔〕「」『』〖〗〈〉﹛﹜{}×—－\-%％￥$□℃\xa0\u3000\r\n "
_HAS_MARKS = re.compile(f"[^{_NOT_MARK}]{{2,}}")
_AFTER_MARKS = re.compile(f"([^{_NOT_MARK_CUT}]{{2,}})")
_AFTER_STOP = re.compile(r"([。？！…?!|](?![了\]'\"]))")
_AFTER_QUOTE = re.compile(r"((?:[。？！!?|]|…{1,2})[了\"'])")


def strip_edge(text: str) -> str:
    return text.strip(EDGE_MARKS)


def clauses(sentence: str) -> list[str]:
    """Cut after a clause mark once the piece is long enough and no wide comma follows closely."""
    out, begin, last = [], 0, len(sentence) - 1
    for i, ch in enumerate(sentence):
        if ch in CLAUSE_MARKS:
            if i == last - 1:
                break
            ahead = sentence[i + 1:min(last, i + COMMA_LOOK_AHEAD + 1)]
            if i == last or ("，" not in ahead and i + 1 - begin >= MIN_CLAUSE):
                out.append(sentence[begin:i + 1])
                begin = i + 1
    return out + ([sentence[begin:]] if begin <= last else [])


def _ends(text: str) -> list[int]:
    """Places after which a sentence ends: after runs of marks, or else after stops, a quote included."""
    if _HAS_MARKS.search(text):
        return [m.end() for m in _AFTER_MARKS.finditer(text)]
    return sorted({m.end() for rule in (_AFTER_STOP, _AFTER_QUOTE) for m in rule.finditer(text)})


def sub_segments(text: str) -> list[tuple[int, str]]:
    """(offset, sentence) of a long paragraph, over-long sentences cut into clauses; bars and line ends take no offset."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    edges = sorted({0, len(text), *_ends(text), *breaks})
    out, offset = [], 0
    for begin, end in zip(edges, edges[1:]):
        sentence = text[begin:end].replace("|", "").replace("\n", "")
        for piece in filter(None, [sentence] if len(sentence) <= MAX_SEGMENT else clauses(sentence)):
            out.append((offset, piece))
            offset += len(piece)
    return out


def diff_spans(original: str, corrected: str) -> list[tuple[int, int, str, str]]:
    """Changed stretches (start, end, old, new) after leaving out blanks at the edges.

    Stretches that only differ in edge marks are not reported.
    """
    a, b = original.strip(" \t\n\r"), corrected.strip(" \t\n\r")
    shift = len(original) - len(original.lstrip(" \t\n\r"))
    changes = opcodes(a, b) if a != b else []
    return [(i1 + shift, i2 + shift, a[i1:i2], b[j1:j2]) for tag, i1, i2, j1, j2 in changes
            if tag != "equal" and strip_edge(a[i1:i2]) != strip_edge(b[j1:j2])]


def _shared(a: str, b: str, equal) -> int:
    """The greatest n for which equal(n) holds; it holds up to there."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if equal(n) else (low, n - 1)
    return low


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per 64 characters (bit vectors)."""
    # What both begin and end with is common; only the rest is searched.
    head = _shared(a, b, lambda n: a[:n] == b[:n])
    a, b = a[head:], b[head:]
    tail = _shared(a, b, lambda n: a[len(a) - n:] == b[len(b) - n:])
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return head + tail + len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    a, b = strip_edge(a or ""), strip_edge(b or "")
    if not a or not b:
        return 0.0
    common = common_subsequence(a, b)
    return common / (len(a) + len(b) - common)


def most_similar(text: str, others: list[tuple[int, str]], above: float) -> int | None:
    """Of the others (number, text) the first of the greatest similarity, if that is above the bound.

    Lengths bound a similarity, so those go first that can be most similar, and what cannot win is not compared.
    """
    size = len(strip_edge(text or ""))
    reach = []
    for j, other in others:
        n = len(strip_edge(other or ""))
        reach.append((min(size, n) / max(size, n, 1), -j, other))
    best, found = above, None
    for most, k, other in sorted(reach, key=lambda r: r[:2], reverse=True):
        if most < best or (most == best and (found is None or k < found)):
            continue
        got = similarity(text, other)
        if got > best or (found is not None and got == best and k > found):
            best, found = got, k
    return None if found is None else -found


def pick_lines(rows: list[str], texts: list[str]) -> list[str | None]:
    """The row of each text: contained either way first, then the most similar above 0.3; each row once."""
    taken: dict[int, str] = {}
    late = []
    bare = [strip_edge(t) for t in texts]
    for row in rows:
        a = strip_edge(row)
        hit = next((j for j, b in enumerate(bare) if j not in taken and (b in a or a in b)), None)
        if hit is None:
            late.append(row)
        else:
            taken[hit] = row
    for row in late:
        hit = most_similar(row, [(j, t) for j, t in enumerate(texts) if j not in taken], 0.3)
        if hit is not None:
            taken[hit] = row
    return [taken.get(j) for j in range(len(texts))]


def pick_originals(originals: list[str], corrected: list[str], texts: list[str]) -> list[str | None]:
    """The known text each result belongs to, None where there is none."""
    out: list[str | None] = []
    for org, cor in zip(originals, corrected):
        pick = None
        if org and org in texts:
            pick = org
        elif org:
            best, j = max(((similarity(org, t), -j) for j, t in enumerate(texts)), default=(0.0, 0))
            pick = texts[-j] if best > 0.5 else None
        else:
            a, best = cor.strip(" \t\n\r"), 0.3
            for t in (t for t in texts if t not in out):
                b = t.strip(" \t\n\r")
                if b in a or a in b:
                    pick = t
                    break
                score = similarity(a, b)
                if score > best:
                    best, pick = score, t
        out.append(pick)
    return out


# Type objects, not DDL: the module can be imported before a session exists.
_SPAN_ROW = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                          T.StructField("span_original", T.StringType()), T.StructField("span_corrected", T.StringType())])
_STEP_ROW = T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2")]])
_SEG = T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("text", T.StringType())]))
_SPAN = T.ArrayType(_SPAN_ROW)


@F.pandas_udf(_SEG)
def sub_segments_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"offset": o, "text": s} for o, s in sub_segments(t)])


@F.pandas_udf(_SPAN)
def diff_udf(original: pd.Series, corrected: pd.Series) -> pd.Series:
    names = ("start", "end", "span_original", "span_corrected")
    return pd.Series([[dict(zip(names, s)) for s in diff_spans(a, b)] for a, b in zip(original, corrected)])


@F.pandas_udf(T.ArrayType(_STEP_ROW))
def opcodes_udf(original: pd.Series, corrected: pd.Series) -> pd.Series:
    names = ("tag", "i1", "i2", "j1", "j2")
    return pd.Series([None if a is None or b is None else [dict(zip(names, s)) for s in opcodes(a, b)] for a, b in zip(original, corrected)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def align_udf(rows: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([pick_lines(list(r), list(t)) for r, t in zip(rows, texts)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def match_udf(originals: pd.Series, corrected: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([pick_originals(list(o), list(c), list(t)) for o, c, t in zip(originals, corrected, texts)])


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)])


@udtf(returnType=T.StructType([T.StructField("seg_offset", T.IntegerType()), T.StructField("seg_text", T.StringType())]))
class Segments:
    """Table function: segments of one text."""

    def eval(self, text: str):
        if text:
            yield from sub_segments(text)


@udtf(returnType=_SPAN_ROW)
class DiffSpans:
    """Table function: changed stretches between two texts."""

    def eval(self, original: str, corrected: str):
        if original is not None and corrected is not None:
            yield from diff_spans(original, corrected)


@udtf(returnType=_STEP_ROW)
class DiffSteps:
    """Table function: the steps (tag, i1, i2, j1, j2) that turn one text into another, equal stretches included."""

    def eval(self, original: str, corrected: str):
        if original is not None and corrected is not None:
            yield from opcodes(original, corrected)


# What fences code, and the control characters that go.
_FENCE = "```"
_CONTROL = dict.fromkeys([*range(0, 9), 11, 12, *range(14, 32)])
# Patterns of internal traces in prose, in order.
_TRACES = [re.compile(p) for p in (
    r"(?ms)^---\s*\n.*?\n---\s*",
    r"\[[^\]]*?/[^]\n]*(?:SKILL\.md|\.py)[^\]]*\]",
    r"/(?:Users|home|app|tmp)[^\s,'\"\]]+",
    r"(?im)^.*SKILL\.md.*$",
    r"(?im)^.*已调用\s*[\w\-]+\s*技能[^。]*[：:]?\s*$",
    r'(?s)\{\s*"datetime"\s*:\s*".*?"\s*,\s*"date"\s*:\s*".*?"\s*,\s*"time"\s*:\s*".*?"[\s\S]*?"utc_offset"\s*:\s*".*?"\s*\}',
    r"(?im)^\s*\|.*\|\s*$",
)]


def _prose_and_code(text: str) -> Iterator[tuple[bool, str]]:
    """Runs of text with whether they are prose; an opened fence without its close lasts to the end."""
    at = 0
    while at < len(text):
        opened = text.find(_FENCE, at)
        if opened < 0:
            yield True, text[at:]
            return
        yield True, text[at:opened]
        closed = text.find(_FENCE, opened + len(_FENCE))
        at = len(text) if closed < 0 else closed + len(_FENCE)
        yield False, text[opened:at]


def sanitize(text: str) -> str:
    """Without internal traces in prose and control characters anywhere; three line ends or more become two."""
    prose = lambda run: reduce(lambda left, trace: trace.sub("", left), _TRACES, run)
    kept = "".join(prose(run) if plain else run for plain, run in _prose_and_code(text or "")).strip()
    # Squeezed before control characters go, which may stand between line ends.
    return re.sub("\n\n\n+", "\n\n", kept).translate(_CONTROL)


@F.pandas_udf(T.StringType())
def sanitize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(sanitize, na_action="ignore")
