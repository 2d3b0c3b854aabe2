"""Secrets in texts: fixed forms, and tokens that a battery of randomness tests finds random.

Fixed forms are assignments to a secret's name, access key ids and long hexadecimal runs. Beside them every token of
`TOKEN_MIN` or more characters with a letter is a candidate. Its encoding is inferred from its characters (hyphens of
UUIDs left out); over that alphabet it takes a chi-squared test of uniformity, of the characters and of their kinds
(digits, capitals, small letters, signs), a runs test about the alphabet's middle and a lag-one serial correlation test.
Fisher's method combines them to one value, which is even on [0, 1] for random tokens and mostly tiny for text.

False-discovery control needs how often text does as well. Every text's own letters, in small letters, capitals and with
capital initials, give null tokens of every length class, which take the same battery. A candidate's p-value is the share
of null tokens of its length class that have its encoding and reach its value (one more, over one more). These go through
Benjamini-Hochberg at `RATE`, per encoding and length class, over all candidates of the corpus. A discovery must also not
be rejected as random at `BATTERY`. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import let
from lexweave.llm.store import staged

# The forms, in the order in which kinds sort at equal starts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_MIN = 6

TOKEN_MIN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_MIN
BATTERY = 0.01
RATE = 0.05
#: Least lengths of the classes of length.
CLASSES = [20, 24, 32, 40, 64]
#: Encodings tried in this order: pattern and alphabet.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6]),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", r"^([a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", UPPER + LOWER + DIGITS + "+/"),
]
_KINDS = ["[0-9]", "[A-Z]", "[a-z]", "[+/]"]
_BINS, _CHUNK = 40, 256


def _upper_tail(z: Column) -> Column:
    """P(Z >= z) of a normal variable (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _floor(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0))


def battery(tokens: Column) -> Column:
    """Every token (start, end, value) with its tests: encoding, n and the p-values uniform, kinds, runs, serial and fisher, whose
    null hypothesis is a random token.

    The tests are built up in steps over the array, so that each step's terms appear once.
    """
    kept: list[str] = ["start", "end", "value"]

    def step(array: Column, **made) -> Column:
        names = list(kept)
        out = F.transform(array, lambda t: F.struct(*[t[c].alias(c) for c in names], *[make(t).alias(c) for c, make in made.items()]))
        kept.extend(c for c in made if c not in kept)
        return out

    def chosen(values: list, t: Column) -> Column:
        out = F.lit(values[-1])
        for (_, pattern, _), value in list(zip(ENCODINGS, values))[-2::-1]:
            out = F.when(t["plain"].rlike(pattern), F.lit(value)).otherwise(out)
        return out

    bare = lambda t: F.replace(t["value"], F.lit("-"), F.lit(""))
    out = step(tokens, plain=lambda t: F.when(bare(t).rlike(ENCODINGS[0][1]), bare(t)).otherwise(F.regexp_replace(F.translate(t["value"], "-_", "+/"), "=+$", "")))
    out = step(out, encoding=lambda t: chosen([e[0] for e in ENCODINGS], t), alphabet=lambda t: chosen([e[2] for e in ENCODINGS], t))
    out = step(out, v=lambda t: F.translate(F.when(t["encoding"].isin("hex", "base36"), F.lower(t["plain"])).otherwise(t["plain"]), "=", ""))
    out = step(out, n=lambda t: F.length(t["v"]).cast("double"), k=lambda t: F.length(t["alphabet"]).cast("double"),
               # Which half of the alphabet each character lies in, as zeros and ones.
               halves=lambda t: F.call_function("translate", t["v"], t["alphabet"], F.concat(
                   F.repeat(F.lit("0"), F.floor(F.length(t["alphabet"]) / 2).cast("int")), F.repeat(F.lit("1"), F.ceil(F.length(t["alphabet"]) / 2).cast("int")))),
               places=lambda t: F.transform(F.filter(F.split(t["v"], ""), lambda c: c != ""), lambda c: F.instr(t["alphabet"], c).cast("double")),
               squares=lambda t: F.aggregate(F.split(t["alphabet"], ""), F.lit(0.0), lambda acc, c: acc + F.pow(
                   (F.length(t["v"]) - F.length(F.replace(t["v"], c, F.lit("")))).cast("double"), F.lit(2.0))))
    out = step(out, ones=lambda t: F.length(F.replace(t["halves"], F.lit("0"), F.lit(""))).cast("double"),
               turns=lambda t: F.regexp_count(t["halves"], F.lit("0+|1+")).cast("double"),
               centre=lambda t: F.aggregate(t["places"], F.lit(0.0), lambda acc, x: acc + x) / t["n"],
               chi=lambda t: F.greatest(t["squares"] * t["k"] / t["n"] - t["n"], F.lit(0.0)))
    out = step(out, mean=lambda t: 2 * t["ones"] * (t["n"] - t["ones"]) / t["n"] + 1, spread=lambda t: 2.0 / (9 * (t["k"] - 1)),
               power=lambda t: F.aggregate(t["places"], F.lit(0.0), lambda acc, x: acc + (x - t["centre"]) * (x - t["centre"])),
               lagged=lambda t: F.aggregate(F.zip_with(F.slice(t["places"], 1, F.length(t["v"]) - 1), F.slice(t["places"], 2, F.length(t["v"]) - 1),
                                                       lambda x, y: (x - t["centre"]) * (y - t["centre"])), F.lit(0.0), lambda acc, x: acc + x))
    shares = lambda pattern: F.array(*[F.lit(len(re.findall(pattern, a)) / len(a)) for _, _, a in ENCODINGS])
    place = lambda t: chosen([F.lit(i) for i in range(len(ENCODINGS))], t)
    off = lambda t, kind: F.when(F.get(shares(kind), place(t)) > 0, F.pow(F.regexp_count(t["v"], F.lit(kind)) - t["n"] * F.get(shares(kind), place(t)), F.lit(2.0))
                                 / F.nullif(t["n"] * F.get(shares(kind), place(t)), F.lit(0.0))).otherwise(F.lit(0.0))
    out = step(out, chi_kinds=lambda t: sum((off(t, k) for k in _KINDS[1:]), off(t, _KINDS[0])),
               df_kinds=lambda t: sum((F.when(F.get(shares(k), place(t)) > 0, 1.0).otherwise(0.0) for k in _KINDS), F.lit(-1.0)))
    kept[:] = [c for c in kept if c not in ("plain", "alphabet", "v", "halves", "places")]
    out = step(out, variance=lambda t: F.greatest((t["mean"] - 1) * (t["mean"] - 2) / (t["n"] - 1), F.lit(0.0)),
               # Wilson and Hilferty: the cube root of chi-squared per degree of freedom is nearly normal.
               z_uniform=lambda t: (F.cbrt(t["chi"] / (t["k"] - 1)) - (1 - t["spread"])) / F.sqrt(t["spread"]),
               z_serial=lambda t: F.abs(t["lagged"] / F.nullif(t["power"], F.lit(0.0)) + 1 / t["n"]) * F.sqrt(t["n"]),
               z_kinds=lambda t: (F.cbrt(t["chi_kinds"] / t["df_kinds"]) - (1 - 2.0 / (9 * t["df_kinds"]))) / F.sqrt(2.0 / (9 * t["df_kinds"])))
    out = step(out, z_runs=lambda t: F.abs(t["turns"] - t["mean"]) / F.sqrt(F.nullif(t["variance"], F.lit(0.0))))
    kept[:] = ["start", "end", "value", "encoding", "n", "z_uniform", "z_kinds", "z_runs", "z_serial"]
    # A token without variation has no runs or serial value; it is not random.
    out = step(out, uniform=lambda t: _floor(_upper_tail(t["z_uniform"])), runs=lambda t: _floor(F.coalesce(2 * _upper_tail(t["z_runs"]), F.lit(0.0))),
               serial=lambda t: _floor(F.coalesce(2 * _upper_tail(t["z_serial"]), F.lit(0.0))), kinds=lambda t: _floor(_upper_tail(t["z_kinds"])))
    kept[:] = ["start", "end", "value", "encoding", "n", "uniform", "kinds", "runs", "serial"]
    out = step(out, half=lambda t: -(F.ln(t["uniform"]) + F.ln(t["kinds"]) + F.ln(t["runs"]) + F.ln(t["serial"])))
    return step(out, fisher=lambda t: F.exp(-t["half"]) * (1 + t["half"] + t["half"] * t["half"] / 2 + F.pow(t["half"], F.lit(3.0)) / 6))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, value) in code points of the matches `found` of `pattern`, by adding up what lies between them."""
    kind = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint,value:string>>>"
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("value")))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value")))).alias("spans"))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    begin = lambda at: F.struct(at.alias("at"), none.alias("spans")).cast(kind)
    # A text's matches are placed in chunks, each from its own start: adding to an array copies it, so arrays stay short.
    chunks = let(steps, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _CHUNK).cast("int")), lambda i: F.slice(all_, i * _CHUNK + 1, _CHUNK)))
    sized = F.transform(chunks, lambda c: F.struct(c.alias("steps"), F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["gap"] + F.length(s["value"])).alias("length")))
    placed = let(sized, lambda cs: F.transform(cs, lambda c, i: F.aggregate(
        c["steps"], begin(F.aggregate(F.slice(cs, F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + x["length"])), step, lambda a: a["spans"])))
    return F.when(F.size(found) > 0, F.flatten(placed)).otherwise(none)


def null_tokens(text: Column) -> Column:
    """Tokens of every length class from the text's own letters, in small letters, capitals and with capital initials.

    Each class begins at another word, so that classes are not the same letters cut to other lengths.
    """
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))

    def made(ws: Column) -> Column:
        out = []
        for i, n in enumerate(CLASSES):
            own = F.slice(ws, F.greatest(F.floor(F.size(ws) * (i + 1) / (len(CLASSES) + 2)).cast("int"), F.lit(1)), F.lit(n))
            joined = F.array_join(own, "")
            out += [F.substring(v, 1, n) for v in (F.lower(joined), F.upper(joined), F.array_join(F.transform(own, lambda w: F.initcap(w)), ""))]
        return F.filter(F.array(*out), lambda v: F.length(v).isin(*CLASSES))
    return F.transform(let(words, made), lambda v: F.struct(F.lit(0).cast("long").alias("start"), F.length(v).cast("long").alias("end"), v.alias("value")))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, base, tokens): per row of docs its fixed-form spans and its tested tokens outside of them."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"))
    found = read.select("row", "body", *[F.regexp_extract_all("body", F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate([ASSIGN, ACCESS, HEX, TOKEN])])
    placed = found.select("row", *[_placed(F.col("body"), p, F.col(f"m{i}")).alias(f"p{i}") for i, p in enumerate([ASSIGN, ACCESS, HEX, TOKEN])])
    named = lambda i: F.transform(F.col(f"p{i}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    strong = F.filter(named(0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_MIN)
    based = placed.select("row", F.array_sort(F.concat(strong, named(1), named(2))).alias("base"), "p3")
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    bare = based.select("row", "base", F.filter("p3", lambda s: s["value"].rlike("[A-Za-z]") & apart(s)).alias("bare"))
    return bare.select("row", "base", battery(F.col("bare")).alias("tokens"))


def _family(t: Column) -> Column:
    return F.concat_ws(":", t["encoding"], _class(t["n"]).cast("string"))


def _class(n: Column) -> Column:
    """The length class; tokens that lose hyphens or padding below the least length belong to the first."""
    return F.greatest(sum((F.when(n >= least, 1).otherwise(0) for least in CLASSES), F.lit(-1)), F.lit(0))


def _bin(t: Column) -> Column:
    """Fisher's value in steps of a tenth of a decade, 0 for the most random."""
    return F.least(F.floor(-10 * F.log10(t["fisher"])), F.lit(_BINS)).cast("int")


def null_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(class, encoding, bin, n): the null tokens of all texts; at most classes * encodings * bins rows."""
    held = docs.select(F.explode(battery(null_tokens(F.coalesce(F.col(text).cast("string"), F.lit(""))))).alias("t"))
    return held.groupBy(_class(F.col("t.n")).alias("class"), F.col("t.encoding").alias("encoding"), _bin(F.col("t")).alias("bin")).agg(F.count("*").alias("n"))


def discovery_bins(found: DataFrame, null: DataFrame) -> DataFrame:
    """One row: a map from family to the last bin that Benjamini-Hochberg accepts at RATE.

    Values are counted in bins, taken at their far ends, so a table of all candidates shrinks to at most (encodings *
    length classes * bins) counts before it is ordered.
    """
    tests = found.select(F.explode("tokens").alias("t")).select(_class(F.col("t.n")).alias("class"), F.col("t.encoding").alias("encoding"), _bin(F.col("t")).alias("bin"))
    counts = tests.groupBy("class", "encoding", "bin").agg(F.count("*").alias("c"))
    both = counts.select("class", "encoding", "bin", "c", F.lit(0).cast("long").alias("n")).unionAll(null.select("class", "encoding", "bin", F.lit(0).cast("long").alias("c"), "n"))
    family = Window.partitionBy("class", "encoding")
    so_far = family.orderBy("bin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.select("class", "encoding", "bin", F.sum("c").over(so_far).alias("k"), F.sum("c").over(family).alias("m"), F.sum("n").over(so_far).alias("reached"),
                         F.sum("n").over(Window.partitionBy("class")).alias("null"))
    p = (1 + F.col("reached")) / (1 + F.col("null"))
    last = ranked.filter((F.col("k") > 0) & (p * F.col("m") <= RATE * F.col("k"))).groupBy("class", "encoding").agg(F.max("bin").alias("bin"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "encoding", F.col("class").cast("string")), "bin"))).alias("bins"))


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, base, random): per row of docs the fixed-form spans and the discovered random tokens with their tests.

    Spans hold start, kind (its place in KINDS), end (exclusive, code points) and value. Null text is empty: no spans.
    Repeated rows get equal answers; other columns are not looked at; an empty table gives an empty one.
    """
    found = staged(candidates(docs, text), "candidates")
    bins = discovery_bins(found, null_counts(docs, text)).scalar()
    judged = found.withColumn("_bins", bins)
    secret = lambda s: (s["fisher"] >= BATTERY) & F.coalesce(_bin(s) <= F.try_element_at(F.col("_bins"), _family(s)), F.lit(False))
    return judged.select("row", "base", F.filter("tokens", secret).alias("random"))


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
