"""Random tokens: every figure of the battery and the false-discovery control by brute force, planted keys, long texts."""

import math
import random
import re
import string
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexweave.llm import secrets

ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567",
             "base36": string.digits + string.ascii_lowercase, "base64": string.ascii_letters + string.digits + "+/"}


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def brute_battery(value):
    bare = value.replace("-", "")
    plain = bare if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare) else re.sub("=+$", "", value.replace("-", "+").replace("_", "/"))
    name, alphabet = next((n, a) for n, p, a in secrets.ENCODINGS if re.search(p, plain))
    v = (plain.lower() if name in ("hex", "base36") else plain).replace("=", "")
    n, k = len(v), len(alphabet)
    cube = lambda chi, df: tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    uniform = cube(max(sum(c * c for c in Counter(v).values()) * k / n - n, 0), k - 1)
    shares = [sum(bool(re.match(p, c)) for c in alphabet) / k for p in secrets._KINDS]
    seen = [sum(bool(re.match(p, c)) for c in v) for p in secrets._KINDS]
    kinds = cube(sum((o - n * s) ** 2 / (n * s) for o, s in zip(seen, shares) if s), sum(s > 0 for s in shares) - 1)
    halves = [int(alphabet.index(c) >= k // 2) for c in v]
    ones, turns = sum(halves), 1 + sum(a != b for a, b in zip(halves, halves[1:]))
    mean = 2 * ones * (n - ones) / n + 1
    variance = max((mean - 1) * (mean - 2) / (n - 1), 0)
    runs = 2 * tail(abs(turns - mean) / math.sqrt(variance)) if variance else 0
    places = [alphabet.index(c) + 1 for c in v]
    centre = sum(places) / n
    power = sum((x - centre) ** 2 for x in places)
    serial = 2 * tail(abs(sum((x - centre) * (y - centre) for x, y in zip(places, places[1:])) / power + 1 / n) * math.sqrt(n)) if power else 0
    half = -sum(math.log(min(max(p, 1e-300), 1)) for p in (uniform, kinds, runs, serial))
    return name, n, math.exp(-half) * (1 + half + half ** 2 / 2 + half ** 3 / 6)


def length_class(n):
    return max(sum(n >= c for c in secrets.CLASSES) - 1, 0)


def bin_of(fisher):
    return min(int(math.floor(-10 * math.log10(fisher))), secrets._BINS) if fisher > 0 else secrets._BINS


def brute_null(texts):
    counts = Counter()
    for text in texts:
        words = re.findall("[A-Za-z]+", text or "")
        for i, n in enumerate(secrets.CLASSES):
            begin = max(int(len(words) * (i + 1) / (len(secrets.CLASSES) + 2)), 1) - 1
            own = words[begin:begin + n]
            for v in ("".join(own).lower(), "".join(own).upper(), "".join(w.capitalize() for w in own)):
                if len(v[:n]) in secrets.CLASSES:
                    name, size, fisher = brute_battery(v[:n])
                    counts[(length_class(size), name, bin_of(fisher))] += 1
    return counts


def brute_found(texts, base):
    """The values discovered in each text."""
    null = brute_null(texts)
    tokens = [[(m.start(), m.end(), m[0]) for m in re.finditer(secrets.TOKEN, t or "") if re.search("[A-Za-z]", m[0])] for t in texts]
    tokens = [[x for x in xs if not any(s < x[1] and x[0] < e for s, e in b)] for xs, b in zip(tokens, base)]
    tested = [[(x[2], *brute_battery(x[2])) for x in xs] for xs in tokens]
    families = defaultdict(list)
    for xs in tested:
        for _, name, n, fisher in xs:
            families[(length_class(n), name)].append(bin_of(fisher))
    last = {}
    for (c, name), bins in families.items():
        total = sum(k for (d, _, _), k in null.items() if d == c)
        for b in sorted(set(bins)):
            reached = sum(k for (d, e, x), k in null.items() if d == c and e == name and x <= b)
            if (1 + reached) / (1 + total) * len(bins) <= secrets.RATE * sum(x <= b for x in bins):
                last[(c, name)] = b
    return [sorted(v for v, name, n, fisher in xs if fisher >= secrets.BATTERY and bin_of(fisher) <= last.get((length_class(n), name), -1)) for xs in tested]


def planted(rng, each, sizes):
    keys = [(name, n, "".join(rng.choice(a) for _ in range(n))) for name, a in ALPHABETS.items() for n in sizes for _ in range(each)]
    for _ in range(each):
        h = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        keys.append(("uuid", 36, "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]])))
    return keys


def test_against_brute_force(spark):
    rng = random.Random(11)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    texts = [r["text"] for r in docs]
    texts += [f"see {k} and /usr/share/some/longer/path/of/words then 2024-01-01-2024-02-02 ok" for _, _, k in planted(rng, 2, [20, 33, 64])]
    texts += ["getUserNameFromTheDatabaseTable ABCDEFGHIJKLMNOPQRSTUVWXYZ aaaaaaaaaaaaaaaaaaaaaaaa", "", None, "00000000000000000000a " * 3]
    found = secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).select("row.id", "base", "random").collect()
    base = {r["id"]: [(s["start"], s["end"]) for s in r["base"]] for r in found}
    want = brute_found(texts, [base[i] for i in range(len(texts))])
    got = {r["id"]: sorted(s["value"] for s in r["random"]) for r in found}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(map(len, want)) > 20 and not any(want[:60])


def test_planted_keys_are_found_and_text_is_left_alone(spark):
    """From 32 characters on at least 90 of 100 keys of every encoding; shorter ones at least two thirds, hexadecimal ones 90."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    keys = planted(random.Random(5), 100, [20, 24, 32, 40, 64])
    extra = spark.createDataFrame([(10 ** 6 + i, f"the key of the house is {k} and more") for i, (_, _, k) in enumerate(keys)], "id long, text string")
    rows = secrets.secrets(docs.unionByName(extra)).filter(F.size("random") > 0).select("row.id", "base", "random.value").collect()
    assert not [r for r in rows if r["id"] < 10 ** 6]
    hits = Counter((keys[r["id"] - 10 ** 6][0], keys[r["id"] - 10 ** 6][1]) for r in rows if keys[r["id"] - 10 ** 6][2] in r["value"])
    for name, n in {(name, n) for name, n, _ in keys}:
        if name == "hex" and n >= 24:  # a fixed form already
            assert not hits[(name, n)]
        else:
            assert hits[(name, n)] >= (90 if n >= 32 or name in ("hex", "HEX", "base36") else 66), (name, n, hits[(name, n)])


def test_long_text(spark):
    """Spans of one long text of keys are placed right, and twice the text takes far less than four times the time."""
    rng = random.Random(3)
    line = lambda: "".join(rng.choice(ALPHABETS["base64"]) for _ in range(76))
    text = "\n".join(line() for _ in range(3000))
    place = lambda t: spark.createDataFrame([(t,)], "text string").select(secrets._placed(F.col("text"), secrets.TOKEN, F.regexp_extract_all("text", F.lit(secrets.TOKEN), F.lit(0))).alias("p")).first()["p"]
    assert [(s["start"], s["end"], s["value"]) for s in place(text)] == [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.TOKEN, text)]

    def seconds(t):
        begin = time.perf_counter()
        place(t)
        return time.perf_counter() - begin
    long = "\n".join(line() for _ in range(12_000))
    assert seconds(long + "\n" + long) < 3 * seconds(long) + 2
