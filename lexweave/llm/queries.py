"""One thin query per operator, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.llm.bpe import decode, encode, n_tokens
from lexweave.llm.huffman import documents_of, read_book, token_ids, write_files
from lexweave.llm.langid import fit, held_out, identify
from lexweave.llm.neardup import near_duplicates
from lexweave.llm.ledger import CURRENT, MEASURES, POLICIES, RULES, ledger, mask, passes
from lexweave.llm.licenses import licensed
from lexweave.llm.matroska import read_track, with_media
from lexweave.llm.merkle import manifest, verified
from lexweave.llm.mixing import by_rank, copies, placed, word_count
from lexweave.llm.registry import documents, query
from lexweave.llm.secrets import as_text, secrets
from lexweave.llm.separators import document_counts, token_files
from lexweave.llm.store import staged
from lexweave.llm.templates import without_recurring_lines
from lexweave.llm.whitening import whitened
from lexweave.scale import scratch_path


@query("op4_near_duplicates")
def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = identify(docs, fit(docs), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = decode(encode(docs).select("doc_id", "ids"))
    return coded.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


MIX_WEIGHTS, MIX_TILTS = [3.0, 1.0, 2.0], [0.5, -0.5, 0.0]


@query("op1_mixture", """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
sources as (
  select source, sum(size)::double as s, row_number() over (order by source nulls last) - 1 as k from sized group by source),
weighted as (select *, [3.0, 1.0, 2.0][k % 3 + 1]::double as w, [0.5, -0.5, 0.0][k % 3 + 1]::double as tilt, sum(s) over () * 1.5 as total from sources),
leveled as (
  select *, 2 * s / w as ratio,
    (total - coalesce(sum(2 * s) over (order by 2 * s / w, source nulls first rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by 2 * s / w, source nulls first rows between current row and unbounded following) as lv from weighted),
plan as (select *, least(2 * s, (select arg_min(lv, ratio) from leveled where ratio >= lv) * w) as target from leveled),
started as (
  select d.doc_id, d.size, p.s, p.w, p.tilt, p.target, round(p.target)::bigint as demand,
    coalesce(sum(d.size) over (partition by d.source order by md5(coalesce(d.doc_id::varchar, '')), d.size rows between unbounded preceding and 1 preceding), 0) as start
  from sized d join plan p on d.source is not distinct from p.source),
took as (
  select *, greatest(0, least(size, demand - start)) as t0, greatest(0, least(size, demand - start - s)) as t1 from started),
timed as (
  select *, w * (1 + tilt) as w0, w * (1 - tilt) - w * (1 + tilt) as slope,
    w * least(1.0, (start + t0 / 2) / demand) as area from took)
select doc_id, size::bigint as size, s::bigint as source_size, round(target, 6) as target, (t0 + t1)::bigint as taken,
  case when t0 > 0 then round(2 * area / (w0 + sqrt(w0 * w0 + 2 * slope * area)), 6) end as position
from timed
""")
def op1_mixture(spark, sf_dir):
    sized = staged(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    mixed = copies(placed(sized, by_rank(sized, MIX_WEIGHTS, MIX_TILTS), 1.5, 2.0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"])
    return (mixed.select("row.doc_id", "row.size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"),
                         F.round(F.get("copies", F.lit(0))["position"], 6).alias("position")).orderBy("position", "doc_id"))


@query("op9_line_dedup")
def op9_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return without_recurring_lines(docs).select(
        "row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("lines").cast("long").alias("n_dropped"), "words_dropped",
        F.array_join(F.col("lines").cast("array<string>"), ",").alias("dropped"), F.sha2("text", 256).alias("text_sha256"))


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    found = secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    bare = lambda name, kind: F.transform(name, lambda s: F.struct(s["start"].alias("start"), kind(s).alias("kind"), s["end"].alias("end")))
    base, added = bare("base", lambda s: s["kind"]), bare("random", lambda s: F.lit(3))
    return found.select("row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.array_sort(F.concat(base, added))).alias("spans"),
                        F.size("random").cast("long").alias("n_random"))


@query("op5_matroska")
def op5_matroska(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    read = read_track(with_media(docs).select("row.doc_id", "row.n_bytes", "media"))
    size = F.octet_length("payload")
    return read.select("row.doc_id", "row.n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                       F.crc32(F.substring("payload", size - 15, F.lit(16))).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
                       F.sha2("media", 256).alias("media_sha256"), "feature", F.col("n_packets").cast("long").alias("n_packets"))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    files = staged(token_files(documents(spark, sf_dir)), "tokens")
    order = files.filter(F.col("ordinal").isNotNull()).select("file", "ordinal", "doc_id")
    counts = document_counts(files.filter(F.col("data").isNotNull()))
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


_WORD, _BLANKS = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
LEDGER_SQL = f"""
with d as (select doc_id, coalesce(text, '') t, row_number() over () rid from documents),
w as (select rid, regexp_extract_all(t, '{_WORD}+') ws from d),
e as (select rid, unnest(ws) word from w),
per as (select rid, count(*) n_words, sum(length(word))::bigint word_chars, count(*) filter (regexp_matches(word, '[A-Za-z]|[^\\x00-\\x7F]')) n_letter_words from e group by rid),
top as (select rid, max(c) max_word_repeat from (select rid, word, count(*) c from e group by all) group by rid),
g as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) k from (select rid, ws, unnest(generate_series(1, len(ws) - 2)) i from w)),
cov as (select rid, count(distinct j) n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) j from g where k > 1) group by rid),
l as (select rid, count(*) n_lines, count(*) - count(distinct s) n_dup_lines, count(*) filter (regexp_matches(s, '(\\.\\.\\.|…){_BLANKS}*$')) n_ellipsis_lines,
  count(*) filter (regexp_matches(s, '^{_BLANKS}*[-*•]')) n_bullet_lines from (select rid, unnest(string_split(t, chr(10))) s from d) where regexp_matches(s, '{_WORD}') group by rid),
m as (select doc_id, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, {", ".join(f"coalesce({c}, 0) {c}" for c in MEASURES if c != "n_symbols")}
  from d left join per using (rid) left join top using (rid) left join cov using (rid) left join l using (rid)),
f as (select *, ({" + ".join(f"case when {r.fails} then {1 << i} else 0 end" for i, r in enumerate(RULES))})::bigint failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask(POLICIES[1])}) <> 0 base_failed, (failed & {mask(POLICIES[CURRENT])}) = 0 kept, failed from f"""


@query("op8_quality_ledger", LEDGER_SQL)
def op8_quality_ledger(spark, sf_dir):
    rows = ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~passes(1)).alias("base_failed"), passes(CURRENT).alias("kept"), "failed")


@query("op10_licences")
def op10_licences(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    # The table has no paths: sources are top folders, ids are dealt to folders of 400 and 20, of which the first is the licence file.
    spot = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 400").cast("string"), F.expr("doc_id div 20").cast("string"),
                       F.when(spot % 20 == 0, F.lit("LICENSE")).otherwise(spot.cast("string")))
    found = licensed(docs.withColumn("path", path))
    return found.select("row.doc_id", "row.path", "licence", F.round("score", 6).alias("score"), "via", "inherited_from")


@query("op11_huffman_ids")
def op11_huffman_ids(spark, sf_dir):
    folder = scratch_path(spark, "huffman")
    write_files(staged(token_ids(documents(spark, sf_dir)), "ids"), folder)
    return documents_of(spark.read.parquet(f"{folder}/blocks"), read_book(spark, folder))


#: The tree in SQL: `node` by recursion over levels, `fold` again with the changed leaf in its slot; the sources' tree is tree null.
MERKLE_SQL = """
with recursive d as (
  select doc_id, source, row_number() over () rid, text,
    {leaf} h, case when coalesce({crc} % 5 = 0, false) then {changed} else {leaf} end t from documents),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 idx, count(*) over (partition by source) n from d),
sized as (select distinct source, n, ceil(round(log(n) / log(16), 9))::int depth from placed),
node as (
  select source, 0 as l, idx, h from placed
  union all
  select k.source, k.l + 1, k.idx // 16, sha256(string_agg(k.h, '' order by k.idx)) from node k join sized s on k.source is not distinct from s.source
  where k.l < s.depth group by k.source, k.l, k.idx // 16),
sub as (select k.source, k.h, row_number() over (order by k.source nulls first) - 1 idx from node k join sized s on k.source is not distinct from s.source and k.l = s.depth),
upper_depth as (select ceil(round(log(count(*)) / log(16), 9))::int depth from sub),
top as (
  select 0 as l, idx, h from sub
  union all
  select k.l + 1, k.idx // 16, sha256(string_agg(k.h, '' order by k.idx)) from top k where k.l < (select depth from upper_depth) group by k.l, k.idx // 16),
step as (
  select p.rid, p.t, p.idx, s.depth, b.idx up, b.h subroot from placed p join sized s on p.source is not distinct from s.source join sub b on p.source is not distinct from b.source),
way as (
  select x.rid, k.l, k.idx, k.h, k.idx = x.idx // pow(16, k.l)::bigint own from placed x join sized s on x.source is not distinct from s.source
    join node k on k.source is not distinct from x.source and k.l < s.depth and k.idx // 16 = x.idx // pow(16, k.l + 1)::bigint
  union all
  select x.rid, x.depth + k.l, k.idx, k.h, k.idx = x.up // pow(16, k.l)::bigint from step x, upper_depth u
    join top k on k.l < u.depth and k.idx // 16 = x.up // pow(16, k.l + 1)::bigint),
proof as (select rid, sha256(coalesce(string_agg(h, '' order by l, idx) filter (not own), '')) proof_sha256 from way group by rid),
fold as (
  select rid, 0 as l, t as h from placed
  union all
  select f.rid, f.l + 1, sha256(string_agg(case when w.own then f.h else w.h end, '' order by w.idx)) from fold f join way w on w.rid = f.rid and w.l = f.l group by f.rid, f.l),
folded as (select rid, arg_max(h, l) folded_root from fold group by rid)
select p.doc_id, p.h leaf, s.subroot, r.h root, coalesce(proof.proof_sha256, sha256('')) proof_sha256, folded_root, folded_root = r.h verified
from placed p join step s using (rid) join folded using (rid) left join proof using (rid)
  join (select h from top where l = (select depth from upper_depth)) r on true
"""
_field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
_leaf = lambda text: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of the decimal id, bit by bit.
_crc = ("xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint), "
        "lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)")


@query("op12_merkle_manifest", MERKLE_SQL.format(leaf=_leaf("text"), changed=_leaf(_lowered), crc=_crc))
def op12_merkle_manifest(spark, sf_dir):
    return verified(manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"]))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return (rows.select("row.vec_id", "n", "deviation", "identity_error", each)
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
                    F.col("c.explained").alias("explained"), "identity_error"))
